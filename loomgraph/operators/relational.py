"""Joins, set operations and record updates over keyed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

#: A side is broadcast up to this many rows, counted first; larger sides are left to the optimizer.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count proves that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Keys that repeat and are broadcast, a number or a short text each.
REPEATED_KEYS = 400_000


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, as by dropDuplicates; only the rows of keys that repeat are shuffled, as long as these keys are few."""
    again = cut_lineage(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_again")))
    found = again.limit(REPEATED_KEYS + 1).count()
    if found > REPEATED_KEYS:
        return df.dropDuplicates([key])
    if not found:
        return df
    same = F.col(key).eqNullSafe(F.col("_again"))
    return df.join(F.broadcast(again), same, "left_anti").unionByName(df.join(F.broadcast(again), same, "left_semi").dropDuplicates([key]))


#: Rows of a block of a search.
BLOCK_ROWS = 1 << 15


def in_blocks(items: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Every item with every query of a stated set, by an equi-join on blocks of items: each block is one key of bounded size, and nothing is broadcast."""
    blocks = max(1, -(-items.count() // BLOCK_ROWS), items.sparkSession.sparkContext.defaultParallelism)
    own = items.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return own.hint("shuffle_hash").join(asked, "_block").drop("_block")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in the order, as when a later entry overwrites."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in the order."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column]) -> DataFrame:
    """Left join with a value in place of what is missing."""
    out = df.join(table, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def merge_records(base: DataFrame, over: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a column of both comes from over where it is present there."""
    shared = [c for c in base.columns if c in over.columns and c not in keys]
    b, o = base.alias("b"), over.alias("o")
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) if c in shared else F.col(f"b.{c}") for c in base.columns if c not in keys]
    cols += [F.col(f"o.{c}") for c in over.columns if c not in base.columns]
    return b.join(o, list(keys)).select(*keys, *cols)


def update_records(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of base, with the values of changes where there are some."""
    fresh = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fresh])
    return base.join(renamed, list(keys), "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fresh}).select(*base.columns)


def reverse_map(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """value -> key; of several keys the last in the order."""
    return last_per_key(df.where(F.col(value).isNotNull()).select(value, key, *[c for c in order if c not in (key, value)]), [value], order).select(value, key)


def not_in(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(excluded, list(keys), "left_anti")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of a work list has no output yet."""
    return not_in(work, done.select(*keys).distinct(), keys)


def without_nodes(edges: DataFrame, removed: DataFrame, scope: str, node: str) -> DataFrame:
    """Edges that touch none of the removed nodes."""
    gone = removed.select(scope, node).distinct()
    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(gone.withColumnRenamed(node, end), [scope, end], "left_anti")
    return out


def dangling(edges: DataFrame, nodes: DataFrame, scope: str, node: str) -> DataFrame:
    """Edges with an end that is no node, and which ends those are."""
    ids = nodes.select(scope, node).distinct()
    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(ids.select(scope, F.col(node).alias(end), F.lit(True).alias(f"_{end}")), [scope, end], "left")
    out = out.withColumns({"source_missing": F.col("_source_id").isNull(), "target_missing": F.col("_target_id").isNull()})
    return out.where("source_missing or target_missing").drop("_source_id", "_target_id")


def match_outcome(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """TP, FP or FN for each key that either side has."""
    p, t = predicted.select(*keys, F.col(value).alias("_p")), truth.select(*keys, F.col(value).alias("_t"))
    outcome = F.when(F.col("_p").isNotNull() & F.col("_p").eqNullSafe(F.col("_t")), "TP").when(F.col("_p").isNotNull(), "FP").otherwise("FN")
    return p.join(t, list(keys), "full").select(*keys, F.col("_p").alias("predicted"), F.col("_t").alias("expected"), outcome.alias("outcome"))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two sets; 0 if one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(smaller, F.lit(0))), F.lit(0.0))


def id_mismatch(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(1)), right.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, list(keys), "full").where("_a is null or _b is null").select(*keys, F.when(F.col("_b").isNull(), "left_only").otherwise("right_only").alias("side"))


def natural_order(text: str, digits: int = 12) -> Column:
    """Sort key that orders runs of digits by value."""
    padded = F.regexp_replace(F.col(text), r"(\d+)", "0" * digits + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{digits}}})(?!\d)", "$1")
