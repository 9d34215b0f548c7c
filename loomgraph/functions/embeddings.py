"""Text embeddings: a built-in hashed one, and the place to plug in a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def hashed_embedding(text: Column, dim: int = 64, grams: Sequence[int] = (3,)) -> Column:
    """Unit vector of hashed letter n-grams, in generated code; null for null, zeros for a text without letters or digits."""
    marked = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))

    def places(m: Column) -> Column:
        parts = []
        for n in grams:
            start = F.sequence(F.lit(1), F.greatest(F.length(m) - (n - 1), F.lit(1)))
            own = F.filter(F.transform(start, lambda i, n=n: F.substring(m, i, F.lit(n))), lambda g: F.length(F.trim(g)) > 0)
            parts.append(F.transform(own, lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int")))
        return F.concat(*parts)

    def counts(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double"))

    def scaled(c: Column) -> Column:
        return let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda length: F.transform(c, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))))

    return F.when(text.isNotNull(), let(marked, lambda m: let(places(m), lambda p: let(counts(p), scaled))))


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> DataFrame:
    """key, embedding by a model that is loaded once per task and called on whole batches; null texts give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            there = pdf[text].notna()
            vectors = iter(encode(pdf.loc[there, text].tolist()) if there.any() else [])
            yield pd.DataFrame({key: pdf[key], "embedding": [[float(x) for x in next(vectors)] if t else None for t in there]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")
