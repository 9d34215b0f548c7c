"""Held-out evaluation passages inside a corpus, whole, in part or slightly changed.

Pigeonhole edit matching. A passage is a window of 12 consecutive words of an item. Items are split into pieces of PIECE
words, so short that every window holds at least error budget + 1 whole pieces: a window within the budget has a piece that
occurs exactly. All pieces are found in a document in one pass, by an Aho-Corasick automaton. Of the windows around each
place, those that the equal words on both sides, within the edits each side is left, do not fill are left out; of the rest Myers'
bit-parallel distance to the text there decides. Window and text are compared with the blanks around their words, so a distance of 0
means equal words.

Defined cases. Words are runs of letters and digits as a reader sees them (see words.py). Null, empty and word-less texts
hold nothing; items of fewer words than a window have none. Items with the same text are all reported. Up to
AUTOMATON_ITEMS items are sent to the executors; beyond, the documents' pieces are looked up in a sorted table of hashes
that is sent as far as HASH_BYTES allow, and joined with those of the items otherwise; pairs that share a piece are
verified alike. Both ways read the corpus once to find pieces, whatever the number of items, and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import words
from loomgraph.session import cut_lineage
from loomgraph.tables import spread_out

WINDOW = 12
PIECE = 3
#: Character edits allowed in a window; (WINDOW - PIECE + 1) // PIECE pieces are whole in each, so BUDGET + 1 at least.
BUDGET = 2
AUTOMATON_ITEMS = 20_000
HASH_BYTES = 256 * 1024 * 1024


def peq_table(pattern: str) -> dict[str, int]:
    """Bit mask of the places of each character."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(pattern: str, text: str, limit: int) -> int:
    """Least edit distance of the pattern to any stretch of the text; limit + 1 if more than the limit."""
    m = len(pattern)
    if not m:
        return 0
    peq = peq_table(pattern)
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 & mask) | (~(xv | ph) & mask)
        mv = ph & xv
        best = min(best, score)
    return min(best, limit + 1)


def reach(pattern: str, text: str, budget: int) -> list[int]:
    """Words at the beginning of the pattern, each with the blank behind it, that the beginning of the text holds with 0, 1, ... budget edits."""
    m, n, out = len(pattern), len(text), []
    front = [-2] * (2 * budget + 5)  # farthest letter of the pattern by diagonal, which is its place in the list less the middle
    middle = budget + 2
    for e in range(budget + 1):
        ahead, far = front[:], 0
        for d in range(-e, e + 1):  # a substitution or an omission takes one letter of the pattern, an addition none
            i = 0
            if e:
                at = middle + d
                i, omitted, added = front[at] + 1, front[at + 1] + 1, front[at - 1]
                if omitted > i:
                    i = omitted
                if added > i:
                    i = added
            if i > m:
                i = m
            if i > n - d:
                i = n - d
            if i < 0 or i + d < 0:
                continue
            j = i + d
            while i < m and j < n and pattern[i] == text[j]:
                i += 1
                j += 1
            ahead[middle + d] = i
            if i > far:
                far = i
        front = ahead
        out.append(pattern.count(" ", 0, far))
    return out


class Matcher:
    """items: (id, text)."""

    def __init__(self, items: Sequence[tuple[int, str]], window: int = WINDOW, piece: int = PIECE, budget: int = BUDGET):
        assert (window - piece + 1) // piece >= budget + 1, "a window must hold budget + 1 whole pieces"
        self.window, self.piece, self.budget = window, piece, budget
        self.items = {i: words(t) for i, t in items if t}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, ws in self.items.items():
            if len(ws) >= window:
                for at in range(0, len(ws) - piece + 1, piece):
                    places.setdefault(f" {' '.join(ws[at : at + piece])} ", []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for text, where in places.items():
            self.automaton.add_word(text, (len(text), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, longest run of equal words, least edit distance of a window) of each item that has a window within the budget."""
        ws = words(text)
        if self.empty or len(ws) < self.piece:
            return
        line = f" {' '.join(ws)} "
        diagonals: dict[int, dict[int, set[int]]] = {}
        number: dict[int, int] | None = None
        for end, (length, where) in self.automaton.iter(line):
            if number is None:
                number, at = {}, 0
                for n, w in enumerate(ws):
                    number[at] = n
                    at += len(w) + 1
            n = number[end - length + 1]
            for item, at in where:
                diagonals.setdefault(item, {}).setdefault(n - at, set()).add(at)
        for item, by in diagonals.items():
            run, distance = 0, self.budget + 1
            for shift, hits in by.items():
                done = -1
                for at in sorted(hits):
                    if at < done:
                        continue
                    lo, done = self._run(self.items[item], ws, shift, at)
                    run = max(run, done - lo)
                    if distance:
                        distance = min(distance, self._verify(self.items[item], ws, shift, lo, done))
            if distance <= self.budget:
                yield item, run, distance

    def _run(self, item: list[str], ws: list[str], shift: int, at: int) -> tuple[int, int]:
        """Bounds in the item of the run of equal words around the piece at a place."""
        lo, hi = at, at + self.piece
        while lo and lo + shift > 0 and item[lo - 1] == ws[lo + shift - 1]:
            lo -= 1
        while hi < len(item) and hi + shift < len(ws) and item[hi] == ws[hi + shift]:
            hi += 1
        return lo, hi

    def _verify(self, item: list[str], ws: list[str], shift: int, lo: int, hi: int) -> int:
        """Least distance of a window that holds the run, or as much of it as a window holds; a window that cuts the run is no nearer."""
        w, e, best = self.window, self.budget, self.budget + 1
        lack, starts = w - (hi - lo), {lo}
        if lack > 0:
            more = lack + e + 1
            after = reach(" ".join(item[hi : hi + lack]) + " ", " ".join(ws[hi + shift : hi + shift + more]) + " ", e)
            if after[e] + lo < lack:
                return best
            before = reach(" ".join(item[max(0, lo - lack) : lo])[::-1] + " ", " ".join(ws[max(0, lo + shift - more) : lo + shift])[::-1] + " ", e)
            # words to the left and right within the edits left to each side
            starts = {s for n in range(e + 1) for s in range(max(0, lo - before[n], hi - w), min(lo, len(item) - w, hi - w + after[e - n]) + 1)}
        for s in sorted(starts):
            a, b = max(0, s + shift - 1 - e), s + shift + w + 1 + e
            best = min(best, myers(f" {' '.join(item[s : s + w])} ", f" {' '.join(ws[a : max(a, b)])} ", e))
            if not best:
                break
        return best


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], window: int, piece: int, budget: int) -> Matcher:
    return Matcher(items, window, piece, budget)


KINDS = "doc_id long, item_id long, run_words int, distance int"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "run_words", "distance"])


def _by_automaton(docs: DataFrame, items: DataFrame, window: int, piece: int, budget: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tuple((r["item_id"], r["text"]) for r in items.orderBy("item_id").collect()))  # AUTOMATON_ITEMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(sent.value, window, piece, budget)
        for b in batches:
            yield _rows([(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in matcher.find(t)])

    return docs.mapInArrow(run, KINDS)


def _hashes(ws: list[str], piece: int, step: int) -> np.ndarray:
    """Distinct 64-bit hashes of the pieces of some words."""
    return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(ws[at : at + piece])) for at in range(0, len(ws) - piece + 1, step)], np.uint64)).view(np.int64)


def _by_join(docs: DataFrame, items: DataFrame, window: int, piece: int, budget: int, hash_bytes: int) -> DataFrame:
    """As the automaton, for item tables of any size."""
    spark = docs.sparkSession

    def item_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, h) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for ws in [words(t)] if len(ws) >= window for h in _hashes(ws, piece, piece).tolist()]
            ids, hashes = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["item_id", "piece"])

    pieces = cut_lineage(items.mapInArrow(item_pieces, "item_id long, piece long"))
    known = pieces.select("piece").distinct()
    sent = None
    if known.count() * 8 <= hash_bytes:
        sent = spark.sparkContext.broadcast(np.sort(known.toArrow()["piece"].to_numpy()))

    def doc_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _hashes(words(t), piece, 1)
                if sent is not None and len(own):
                    at = np.searchsorted(sent.value, own)
                    own = own[sent.value[np.minimum(at, len(sent.value) - 1)] == own] if len(sent.value) else own[:0]
                ids.append(np.full(len(own), d, np.int64))
                hashes.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes))], names=["doc_id", "piece"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(d, *hit) for d, i, t, own in zip(*(c.to_pylist() for c in b.columns)) for hit in _matcher(((i, own),), window, piece, budget).find(t)])

    pairs = docs.mapInArrow(doc_pieces, "doc_id long, piece long").join(pieces, "piece").select("doc_id", "item_id").distinct()
    texts = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")
    return texts.select("doc_id", "item_id", "text", "item_text").mapInArrow(verify, KINDS)


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, piece: int = PIECE, budget: int = BUDGET, automaton_items: int = AUTOMATON_ITEMS, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """doc_id, item_id, run_words, distance: documents that hold a window of an item within the budget of edits. run_words: the longest run of equal words around a piece."""
    one = items.select(F.col("item_id").cast("long"), "text").where("text is not null and item_id is not null").dropDuplicates(["item_id"])
    docs = spread_out(documents.select(F.col("doc_id").cast("long"), "text").where("text is not null"))
    small = one.count() <= automaton_items
    out = _by_automaton(docs, one, window, piece, budget) if small else _by_join(docs, one, window, piece, budget, hash_bytes)
    return out.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.min("distance").alias("distance"))
