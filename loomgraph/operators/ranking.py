"""Ranks, positions, batches and samples by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(keys: Sequence[str], *order: Column | str) -> Column:
    """Place within a group, from 0."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def spread_position(df: DataFrame, keys: Sequence[str], bucket: Column, *order: Column | str, name: str = "position") -> DataFrame:
    """df with the place of each row within its key, from 0, where a key may hold any share of all rows.

    bucket: a number (null first) that never falls along the order. Places are counted within buckets, whose starts are
    running sums over the few buckets of a key, so that no task sorts a whole key.
    """
    parted = df.withColumn("_bucket", F.coalesce(bucket.cast("long"), F.lit(-(1 << 62))))
    sizes = parted.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(*keys, "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    return parted.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + position([*keys, "_bucket"], *order)).drop("_bucket", "_start")


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key, with `rank` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def every_nth(df: DataFrame, keys: Sequence[str], n: int, bucket: Column, *order: Column | str) -> DataFrame:
    """Every n-th row of each key; bucket as in spread_position."""
    return spread_position(df, keys, bucket, *order, name="_p").where(F.col("_p") % n == 0).drop("_p")


def scene_batches(df: DataFrame, scene: str, size: int, block_letters: int = 7) -> DataFrame:
    """`batch` of each row: scenes in order, size of them per batch.

    Only the distinct scenes are ranked, within blocks of those that begin with the same letters; the starts of the blocks
    are running sums over the blocks.
    """
    scenes = df.select(scene).distinct().withColumn("_block", F.coalesce(F.substring(scene, 1, block_letters), F.lit("")))
    sizes = scenes.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("_block", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    ranked = scenes.join(starts, "_block").select(scene, ((F.col("_start") + position(["_block"], scene)) / size).cast("int").alias("batch"))
    return df.join(ranked, scene)


#: Frames of a scan that share a bucket of the running count.
FRAMES_PER_BUCKET = 512


def _placed_frames(frames: DataFrame, scan: str, frame: str) -> DataFrame:
    """Distinct frames with their place `_p` within the scan, which may hold any share of all rows."""
    one = frames.select(scan, frame).distinct()
    return spread_position(one, [scan], F.floor(F.col(frame) / FRAMES_PER_BUCKET), frame, name="_p")


def frame_sequences(frames: DataFrame, scan: str, frame: str, length: int, stride: int) -> DataFrame:
    """scan, seq_no, frame: windows of consecutive present frames by position, one every stride; short scans give one."""
    placed = _placed_frames(frames, scan, frame)
    ends = placed.groupBy(scan).agg(F.count("*").alias("_n"))
    both = placed.join(ends, scan)
    last = F.greatest(F.col("_n") - length, F.lit(0))
    low = F.greatest(F.ceil((F.col("_p") - length + 1) / stride), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("_p") / stride), F.floor(last / stride)).cast("int")
    return both.where(low <= high).select(scan, F.explode(F.sequence(low.cast("int"), high)).alias("seq_no"), frame)


def random_windows(frames: DataFrame, scan: str, frame: str, length: int, ratio: float, least: int, most: int, seed: int = 42) -> DataFrame:
    """scan, seq_no, frame: windows at places drawn by hash, ratio * frames of them within [least, most]; the same on every run."""
    placed = _placed_frames(frames, scan, frame)
    n = placed.groupBy(scan).agg(F.count("*").alias("_n"))
    wanted = F.greatest(F.lit(1), F.least(F.greatest((F.col("_n") * ratio).cast("int"), F.lit(least)), F.lit(most)))
    draws = n.select(scan, "_n", F.explode(F.sequence(F.lit(0), wanted - 1)).alias("seq_no"))
    start = F.pmod(F.xxhash64(scan, "seq_no", F.lit(seed)), F.greatest(F.col("_n") - length + 1, F.lit(1)))
    draws = draws.select(scan, "seq_no", F.explode(F.sequence(start, F.least(start + length, F.col("_n")) - 1)).alias("_p"))
    return draws.join(placed, [scan, "_p"]).select(scan, "seq_no", frame)
