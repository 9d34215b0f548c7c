"""Aggregations over observations, names, clouds and matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import usable

#: The edges of the ten match-rate bins, as running sums of 0.1 give them; the last bin is closed.
RATE_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, dim: int) -> DataFrame:
    """Element-wise mean and count of the usable vectors of each key: one aggregate per element, nothing is exploded."""
    fine = df.where(usable(F.col(vector), dim))
    return fine.groupBy(*keys).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]).alias(vector), F.count("*").alias("occurance"))


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value of each key, the smallest of several."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias(value))


def representative(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: Column, order: str) -> DataFrame:
    """Columns of the row with the largest size, the first in the order of several."""
    return df.where(size.isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(size.alias("s"), (-F.col(order)).alias("o"))).alias("_r"), F.count("*").alias("observations")).select(*keys, "_r.*", "observations")


def at_least(df: DataFrame, keys: Sequence[str], what: str, n: int) -> DataFrame:
    """Rows of the keys with at least n different values of what."""
    enough = df.groupBy(*keys).agg(F.countDistinct(what).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(enough, list(keys), "left_semi")


def count_of_counts(sizes: DataFrame, size: str) -> DataFrame:
    return sizes.groupBy(size).agg(F.count("*").alias("n"))


def rate_bin(rate: Column) -> Column:
    """Number (0 to 9) of the bin of a rate; null outside."""
    out = F.when(rate == RATE_EDGES[-1], len(RATE_EDGES) - 2)
    for i in range(len(RATE_EDGES) - 1):
        out = out.when((rate >= RATE_EDGES[i]) & (rate < RATE_EDGES[i + 1]), i)
    return out


def match_rate(matches: Column) -> Column:
    """Share of the matches that are none of -1; null for no matches."""
    return F.try_divide(F.size(F.filter(matches, lambda m: m != -1)).cast("double"), F.nullif(F.size(matches), F.lit(0)).cast("double"))


def doubled_matches(matches: Column) -> Column:
    """How many of the matched targets are matched more than once."""
    valid = F.filter(matches, lambda m: m != -1)
    return F.size(F.filter(F.array_distinct(valid), lambda m: F.size(F.filter(valid, lambda x: x == m)) > 1))


def reversed_matches(matches: DataFrame, key: str, column: str) -> DataFrame:
    """key, target, source: of each target the last position that matches it."""
    each = matches.select(key, F.posexplode(column).alias("source", "target")).where("target <> -1")
    return each.groupBy(key, "target").agg(F.max("source").alias("source"))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def cloud_stats(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size, extent and broken coordinates of each cloud."""
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    fine = lambda c: F.when(~bad, F.col(c))
    out = points.groupBy(*keys).agg(F.count("*").alias("points"), F.count_if(bad).alias("broken"), *[f(fine(c)).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], *[F.avg(fine(c)).alias(f"mean_{c}") for c in "xyz"])
    return out.withColumns({"low": F.least("min_x", "min_y", "min_z"), "high": F.greatest("max_x", "max_y", "max_z")})


def hits_at(ranked: DataFrame, scene: str, query: str, hit: str, rank: str, k: int) -> DataFrame:
    """hits@1..k of each scene: share of the queries with a hit among their first k."""
    best = ranked.groupBy(scene, query).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("_first"))
    return best.groupBy(scene).agg(*[F.avg((F.coalesce(F.col("_first"), F.lit(k + 1)) <= i).cast("double")).alias(f"hits_{i}") for i in range(1, k + 1)])


def overlap_metrics(tokens_a: DataFrame, tokens_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared and all tokens of two token sets of each key, and IoU, recall and precision."""
    a, b = tokens_a.select(*keys, "token").distinct().withColumn("_a", F.lit(1)), tokens_b.select(*keys, "token").distinct().withColumn("_b", F.lit(1))
    out = a.join(b, [*keys, "token"], "full").groupBy(*keys).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count("*").alias("union"))
    ratio = lambda of: F.coalesce(F.try_divide(F.col("shared").cast("double"), F.nullif(F.col(of), F.lit(0)).cast("double")), F.lit(0.0))
    return out.withColumns({"iou": ratio("union"), "recall": ratio("n_a"), "precision": ratio("n_b")})
