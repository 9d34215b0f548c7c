"""Frequency of every distinct term and phrase, with marks on those too rare or too common.

Suffix-sorted counting. Every record is a sequence of terms; equal sequences are first counted together. Each suffix, cut
to the longest phrase, is routed by its first term, partitions are sorted in reverse lexicographic order, and one pass
with a stack adds up the occurrences and records of all prefixes. A suffix carries a mark for each prefix that occurs
for the first time in its record; so the record sets are sums too, the stack stays as small as the longest phrase, and a
hot first term may be spread over several tasks, as many as its count asks for.

Defined cases. A term is a maximal run of letters and digits of the lower-cased value. Null values are no records; blank
values and those without a term count as records that hold none. Repeated rows with one key count once. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

TERM = r"([\p{L}\p{N}]+)"
#: Between the terms of a suffix; sorts before every letter and digit.
MARK = "\x1f"
#: Distinct suffixes of one first term that a part of it holds about; a term with more is spread over as many parts.
PART_SUFFIXES = 50_000
#: Rows up to which the table of spread terms is broadcast.
BROADCAST_TERMS = 100_000
MAX_TERMS = 3
RARE_BELOW = 3
COMMON_OVER = 0.04


def sequences(rows: DataFrame, key: str, value: str) -> DataFrame:
    """terms, weight: the distinct term sequences and how many records have each."""
    one = rows.select(key, value).where(F.col(value).isNotNull()).dropDuplicates([key])
    return one.groupBy(value).agg(F.count("*").alias("n")).select(F.regexp_extract_all(F.lower(value), F.lit(TERM), 1).alias("terms"), "n").groupBy("terms").agg(F.sum("n").alias("weight"))


def _suffixes(max_terms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, terms, weight in zip(pdf["src"], pdf["terms"], pdf["weight"]):
                terms, seen = list(terms), set()
                for i in range(len(terms)):
                    suffix, first = terms[i : i + max_terms], 0
                    for n in range(1, len(suffix) + 1):
                        gram = tuple(suffix[:n])
                        if gram not in seen:
                            seen.add(gram)
                            first |= 1 << n
                    out.append((src, MARK.join(suffix), first, weight))
            yield pd.DataFrame(out, columns=["src", "suffix", "first", "weight"])

    return run


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of all prefixes of the suffixes of one partition, which come in reverse lexicographic order."""
    path: list[str] = []
    counts: list[list[int]] = []
    src, out = None, []

    def pop() -> None:
        occurrences, records = counts.pop()
        out.append((src, MARK.join(path), len(path), occurrences, records))
        path.pop()
        if counts:
            counts[-1][0] += occurrences

    for pdf in batches:
        for s, suffix, first, weight in zip(pdf["src"], pdf["suffix"], pdf["first"], pdf["weight"]):
            terms = suffix.split(MARK)
            common = 0
            if s == src:
                while common < min(len(path), len(terms)) and path[common] == terms[common]:
                    common += 1
            while len(path) > common:
                pop()
            src = s
            for t in terms[common:]:
                path.append(t)
                counts.append([0, 0])
            counts[-1][0] += weight
            for n in range(1, len(terms) + 1):
                counts[n - 1][1] += weight * (first >> n & 1)
        yield pd.DataFrame(out, columns=["src", "gram", "n", "occurrences", "records"])
        out = []
    while path:
        pop()
    yield pd.DataFrame(out, columns=["src", "gram", "n", "occurrences", "records"])


def ngram_counts(seqs: DataFrame, max_terms: int = MAX_TERMS, part_suffixes: int = PART_SUFFIXES) -> DataFrame:
    """src, term (terms joined by a blank), n, occurrences, records of every phrase of 1 to max_terms terms. seqs: src, terms, weight."""
    suffixes = seqs.mapInPandas(_suffixes(max_terms), "src string, suffix string, first int, weight long").groupBy("src", "suffix", "first").agg(F.sum("weight").alias("weight"))
    head = F.substring_index("suffix", MARK, 1)
    headed = cut_lineage(suffixes).withColumn("_head", head)
    hot = cut_lineage(headed.groupBy("src", "_head").agg(F.ceil(F.count("*") / part_suffixes).cast("int").alias("_parts")).where("_parts > 1"))
    spread = headed.join(F.broadcast(hot) if hot.count() <= BROADCAST_TERMS else hot, ["src", "_head"], "left")
    routed = spread.withColumn("_part", F.pmod(F.xxhash64("suffix"), F.coalesce("_parts", F.lit(1)))).repartition("src", "_head", "_part")
    ordered = routed.sortWithinPartitions("src", F.desc("suffix")).select("src", "suffix", "first", "weight")
    partial = ordered.mapInPandas(_stack, "src string, gram string, n int, occurrences long, records long")
    total = partial.groupBy("src", "gram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return total.select("src", F.translate("gram", MARK, " ").alias("term"), "n", "occurrences", "records")


def term_marks(named: dict[str, tuple[DataFrame, str, str]], max_terms: int = MAX_TERMS) -> DataFrame:
    """Counts of the phrases of each src (rows, key, value) with `mark`: rare, common or null."""
    seqs = None
    for src, (rows, key, value) in named.items():
        own = sequences(rows, key, value).select(F.lit(src).alias("src"), "terms", "weight")
        seqs = own if seqs is None else seqs.unionByName(own)
    seqs = cut_lineage(seqs)
    totals = seqs.groupBy("src").agg(F.sum("weight").alias("all_records"))
    counts = ngram_counts(seqs, max_terms).join(F.broadcast(totals), "src")  # one row per src
    return counts.withColumn("mark", F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > COMMON_OVER * F.col("all_records"), "common"))
