"""Encoding of texts with a public tokenizer's local rank file.

Defined cases. Null and empty texts give an empty list. Strings of special tokens are ordinary text. Long texts are cut
where a token can never span, between a visible character and white space, and the ids of the parts are joined; they
equal the ids of the whole. Texts are encoded whole, row by row, without a shuffle; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from loomgraph.tables import spread_out

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a part of a long text, at least.
PART = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of at least size characters that begin with white space; whole if there is no such place."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, ranks: str = RANKS, size: int = PART) -> list[int]:
    if not text:
        return []
    enc = encoding(ranks)
    return [i for part in parts(text, size) for i in enc.encode_ordinary(part)]


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """key, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([encode(t, ranks) for t in b.column(1).to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread_out(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """key, text, from the raw bytes of the ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for b in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
