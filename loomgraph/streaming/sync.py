"""Two topics brought together in time, latest values, and compaction of growing clouds, as structured streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import checkpoint_dir


def as_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all present input is worked off, kept in the shared folder."""
    spark, base = stream.sparkSession, f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number:012d}")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.parquet(f"{base}/out")
    return whole.where(F.col("batch") == whole.agg(F.max("batch")).first()[0]).drop("batch")


def interval_pairs(left: DataFrame, right: DataFrame, slop: str, late: str = "10 minutes") -> DataFrame:
    """key, a, b, a_ts, b_ts of all rows of two topics (key, id, ts) no further apart than the slop; state is bounded by watermarks."""
    a = left.select("key", F.col("id").alias("a"), F.col("ts").cast("timestamp").alias("a_ts"))
    b = right.select(F.col("key").alias("b_key"), F.col("id").alias("b"), F.col("ts").cast("timestamp").alias("b_ts"))
    if left.isStreaming:
        a, b = a.withWatermark("a_ts", late), b.withWatermark("b_ts", late)
    near = F.expr(f"key = b_key and b_ts between a_ts - interval {slop} and a_ts + interval {slop}")
    return a.join(b, near).select("key", "a", "b", "a_ts", "b_ts")


PAIR = "key long, a long, b long, gap double"


def _pair(slop: float):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = {"left": None, "right": None}
        if state.hasTimedOut:  # nothing that may still come is near enough to what waits
            state.remove()
            yield pd.DataFrame([], columns=["key", "a", "b", "gap"])
            return
        if state.exists:
            values = state.get
            last = {"left": (values[0], values[1]) if values[0] is not None else None, "right": (values[2], values[3]) if values[2] is not None else None}
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        for topic, number, at in zip(rows["topic"], rows["id"], rows["at"]):
            other = "right" if topic == "left" else "left"
            last[topic] = (int(number), float(at))
            if last[other] is not None and abs(last[other][1] - at) <= slop:
                a, b = (last["left"], last["right"])
                out.append((key[0], a[0], b[0], abs(a[1] - b[1])))
                last = {"left": None, "right": None}
        flat = [x for t in ("left", "right") for x in (last[t] or (None, None))]
        state.update(tuple(flat))
        newest = max((x[1] for x in last.values() if x), default=0.0)
        state.setTimeoutTimestamp(int(max((newest + slop) * 1000, state.getCurrentWatermarkMs())) + 1)
        yield pd.DataFrame(out, columns=["key", "a", "b", "gap"])

    return run


def latest_pairs(both: DataFrame, slop: float, late: str = "1 hour") -> DataFrame:
    """One-to-one pairs with a queue of one per topic: a row pairs with the other topic's last unpaired row if near enough. both: key, topic (left or right), id, ts.

    A waiting row is forgotten once the watermark has passed it by the slop. Rows are taken in order within a batch; one that
    comes in a later batch than newer rows is paired with what waits then.
    """
    rows = both.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("ts", "key", "topic", "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(_pair(slop), PAIR, "left_id long, left_at double, right_id long, right_at double", "append", "EventTimeTimeout")


def latest(stream: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """The last value of each key so far."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def compacted(points: DataFrame, leaf: float) -> DataFrame:
    """Running voxel sums of a growing cloud: sums and counts add up, so the order and the batches do not matter."""
    by = [F.floor(F.col(c) / leaf).alias(f"v{c}") for c in "xyz"]
    return points.groupBy("scope", *by).agg(*[F.sum(c).alias(f"s{c}") for c in "xyz"], F.count("*").alias("n"))
