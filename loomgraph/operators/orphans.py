"""References to records that do not exist: orphans per reference column and period.

A blocked Bloom filter of the parent keys proves definite orphans: every key sets a few bits of one block of 4 KB, so a
probe needs one block. The filter is broadcast while its blocks stay under a limit, else it is joined by block. Only
what the filter lets through is verified by an exact join.

Defined cases. Null and -1 are no references, nor is a row whose scan cannot be read. Repeated corr_ids and map_row_ids
count once. Without matched_at a reference holds while any row of its key stands open. Other columns are ignored; an
empty parent table makes every reference `missing`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scan_ids import first_scan_id, scan_id

#: Bits of a block (4 KB, as Spark's bitmap functions make them), bits a key sets, and keys planned per block.
BLOCK_BITS = 32768
PROBES = 5
KEYS_PER_BLOCK = 3000
#: The filter is broadcast up to so many blocks (64 MB).
BROADCAST_BLOCKS = 16384


def _hash(keys: Sequence[str], salt: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(salt))


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(_hash(keys, 0), F.lit(blocks)).cast("int")


def _bits(keys: Sequence[str]) -> list[Column]:
    return [F.pmod(_hash(keys, i + 1), F.lit(BLOCK_BITS)).cast("int") for i in range(PROBES)]


def bloom_blocks(parents: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """_block, _bitmap of the distinct keys of the parents."""
    bit = parents.select(*keys).distinct().select(_block(keys, blocks).alias("_block"), F.explode(F.array(*_bits(keys))).alias("_bit"))
    return bit.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def _holds(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0


def probe(refs: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """refs with `_maybe`: false where the filter proves that no parent has the key."""
    expected = parents.select(*keys).agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    blocks = max(1, -(-expected // KEYS_PER_BLOCK))
    filter_ = bloom_blocks(parents, keys, blocks)
    if blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    held = _holds(_bits(keys)[0])
    for bit in _bits(keys)[1:]:
        held = held & _holds(bit)
    return refs.withColumn("_block", _block(keys, blocks)).join(filter_, "_block", "left").withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("_block", "_bitmap")


def references(correspondence: DataFrame) -> DataFrame:
    """corr_id, ref_column, matched_at and the key (_scan, _instance) of every reference."""
    one = correspondence.select("corr_id", "scan_id", "instance_id", "instance_id_in_00", "matched_at").dropDuplicates(["corr_id"])
    both = F.array(
        F.struct(F.lit("instance_id").alias("ref_column"), scan_id(F.col("scan_id")).alias("_scan"), F.col("instance_id").alias("_instance")),
        F.struct(F.lit("instance_id_in_00").alias("ref_column"), first_scan_id(F.col("scan_id")).alias("_scan"), F.col("instance_id_in_00").alias("_instance")),
    )
    return one.select("corr_id", "matched_at", F.inline(both)).where("_scan is not null and _instance is not null and _instance <> -1")


def orphan_references(correspondence: DataFrame, name_map: DataFrame) -> DataFrame:
    """corr_id, ref_column, reason, matched_at of every reference to no instance standing when it was matched."""
    keys = ["_scan", "_instance"]
    every = name_map.select("map_row_id", scan_id(F.col("scan_id")).alias("_scan"), F.col("instance_id").alias("_instance"), "added_at", "removed_at").where("_scan is not null and _instance is not null")
    parents = every.dropDuplicates(["map_row_id"])
    refs = probe(references(correspondence), every, keys)  # repeated rows have repeated keys, which the filter takes once
    proven = refs.where("not _maybe").select("corr_id", "ref_column", F.lit("missing").alias("reason"), "matched_at")
    at = F.coalesce(F.col("matched_at"), F.lit("9999-12-31").cast("timestamp_ntz"))
    stands = (F.col("added_at") <= at) & (F.col("removed_at").isNull() | (F.col("removed_at") > at))
    verified = (
        refs.where("_maybe")
        .join(parents, keys, "left")
        .groupBy("corr_id", "ref_column", "matched_at")
        .agg(F.count("map_row_id").alias("rows"), F.coalesce(F.bool_or(stands), F.lit(False)).alias("held"), F.coalesce(F.bool_and(F.col("added_at") > at), F.lit(False)).alias("late"))
        .where("not held")
        .select("corr_id", "ref_column", F.when(F.col("rows") == 0, "missing").when(F.col("late"), "late").otherwise("deleted").alias("reason"), "matched_at")
    )
    return proven.unionByName(verified)


def orphan_counts(correspondence: DataFrame, name_map: DataFrame) -> DataFrame:
    """Orphans by reference column, month and reason, with the references of that column and month."""
    month = F.date_format("matched_at", "yyyy-MM").alias("month")
    total = references(correspondence).groupBy("ref_column", month).agg(F.count("*").alias("refs"))
    found = orphan_references(correspondence, name_map).groupBy("ref_column", month, "reason").agg(F.count("*").alias("orphans"))
    return found.join(total, (found["ref_column"] == total["ref_column"]) & found["month"].eqNullSafe(total["month"])).select(found["ref_column"], found["month"], "reason", "orphans", "refs")
