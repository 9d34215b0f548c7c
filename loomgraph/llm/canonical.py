"""Freely written values mapped to a list of reference entries.

A value is folded (letter case, accents, look-alike letters, digits for letters) and freed of what its form marks as no
part of the name: numbering, serial numbers, brackets, and what follows a dash or colon. Every contiguous span of its words
is looked up: exactly, as a plural, as an abbreviation, then in a BK-tree over the entries and their aliases, so words that
only qualify the thing need not be known. The tree's metric is Levenshtein's; its triangle inequality prunes, and every
entry within the radius comes back. A span counts its letters less its distance (that which counts a swap of neighbours
once), within an allowance that grows with length; the span that counts most gives the entry. Distinct values are matched
once and joined back.

Defined cases. Null, blank and `unknown` names (any letter case) are no names. A named value that means no entry gives
-1. Equal spans rank by exactness, then by nearness to the end of the phrase, where the head of a name stands; then comes
the entry itself before an alias, then the smaller id. A span of less than HEAD_LETTERS letters that is no whole phrase and
does not end it must be exact. `table, coffee` is also read as `coffee table`. Repeated keys count once. The reference list
is sent in shards of a checked size; a span is judged in each shard by itself and the shards' winners merge by the same
rank, so the result does not depend on their number. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.leakage import peq_table
from loomgraph.session import cut_lineage

SHARD_ENTRIES = 50_000
#: Letters from which on a span within a phrase may differ from an entry.
HEAD_LETTERS = 5
_HOMOGLYPHS = str.maketrans("аеосрхуіјѕһкмтвнԁɡ", "aeocpxyijshkmtbhdg")
_NUMBERING = re.compile(r"^\s*\d+\s*[.)\-:]+\s*")
_SERIAL = re.compile(r"\(\s*id\s*\d+\s*\)|(?:^|[\s_])sn\s*\d+|[#№]\s*\d+|[\s_]+\d+\s*$")
_LEET = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}


def fold(value: str) -> str:
    """Lower case, no accents, look-alikes as Latin letters, single blanks."""
    text = unicodedata.normalize("NFKD", value).casefold().translate(_HOMOGLYPHS)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", text).strip()


def _letters(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def levenshtein(peq: dict[str, int], m: int, text: str) -> int:
    """Distance of the whole pattern (its table and length) to the whole text, bit-parallel."""
    if not m:
        return len(text)
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & mask
        pv = (mh << 1 & mask) | (~(xv | ph) & mask)
        mv = ph & xv
    return score


def swap_distance(a: str, b: str) -> int:
    """Damerau's unrestricted distance: edits and swaps of neighbours."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[x] = i
    return d[-1][-1]


class BKTree:
    def __init__(self, entries: Sequence[str]):
        self.root: tuple[str, dict] | None = None
        for e in entries:
            self.add(e)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        peq, node = peq_table(entry), self.root
        while True:
            d = levenshtein(peq, len(entry), node[0])
            if not d:
                return
            if d not in node[1]:
                node[1][d] = (entry, {})
                return
            node = node[1][d]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        """(distance, entry) of every entry within the radius."""
        out, peq, m = [], peq_table(query), len(query)
        todo = [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = levenshtein(peq, m, entry)
            if d <= radius:
                out.append((d, entry))
            todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return out


def allowance(length: int) -> int:
    """Swap distance at which a text of so many letters still means an entry."""
    return 0 if length < 3 else 1 if length < 9 else 2


def _merged(text: str) -> str:
    """The text with i, l and 1 as one letter."""
    return text.replace("i", "l").replace("1", "l")


class Index:
    """Names by their letters, each with its (0 entry or 1 alias, id)."""

    def __init__(self, names: Mapping[str, tuple[int, int]]):
        self.names, self.sorted, self.tree = names, sorted(names), BKTree(sorted(names))

    def begun(self, start: str) -> tuple[int, int] | None:
        """The best of the names that begin so."""
        found = []
        for name in self.sorted[bisect_left(self.sorted, start) :]:
            if not name.startswith(start):
                break
            found.append(self.names[name])
        return min(found, default=None)


#: (letters not counted, how it was found, words behind the span, kind, id): the smallest of all spans and shards is meant.
Rank = tuple[int, int, int, int, int]


class Canon:
    """entries: (id, category, aliases separated by ` | ` or None)."""

    def __init__(self, entries: Sequence[tuple[int, str, str | None]]):
        names: dict[str, tuple[int, int]] = {}
        for i, category, aliases in entries:
            for kind, name in [(0, category), *((1, a) for a in (aliases or "").split("|"))]:
                if key := _letters(fold(name or "")):
                    names[key] = min(names.get(key, (kind, i)), (kind, i))
        merged: dict[str, tuple[int, int]] = {}
        for key, of in names.items():
            merged[_merged(key)] = min(merged.get(_merged(key), of), of)
        self.plain, self.merged = Index(names), Index(merged)
        self.longest = max(map(len, names), default=0)
        self.cache: dict[tuple[str, bool], tuple[int, int, int, int] | None] = {}

    def phrases(self, value: str) -> Iterator[tuple[list[str], bool, bool]]:
        """(words, whether the last one is marked as abbreviated, whether a comma was only left out)."""
        text = fold(value).replace("_", " ").strip("\"'“”‘’ ")
        before = None
        while before != text:
            before = text
            text = _SERIAL.sub(" ", _NUMBERING.sub("", text)).strip("\"' ")
        text = re.sub(r"\s+-\s+.*$|:.*$|\[[^\]]*\]", " ", text).strip()
        inner = re.sub(r"\([^)]*\)", " ", text).strip()
        text = inner if _letters(inner) else text.strip("() ")
        short, parts = text.endswith("."), [p for p in text.strip(" .\"'").split(",") if p.strip()]
        yield re.findall(r"[^\W_]+", " ".join(reversed(parts))), short and len(parts) < 2, False
        if len(parts) > 1:
            yield re.findall(r"[^\W_]+", " ".join(parts)), short, True

    def lookup(self, core: str, short: bool) -> tuple[int, int, int, int] | None:
        """(distance, how, kind, id) of the best entry for a span; how: 0 as it is, 1 in another form, 2 begun, 3 within the allowance."""
        digits = any(c.isdigit() for c in core) and any(c.isalpha() for c in core)
        forms = [(self.plain, f) for f in _singulars(core)]
        if digits:
            index = self.merged if "1" in core else self.plain
            read = "".join(_LEET.get(c, c) for c in core)
            forms += [(index, f) for f in _singulars(_merged(read) if "1" in core else read)]
        if core in self.plain.names:
            return (0, 0, *self.plain.names[core])
        exact = [index.names[form] for index, form in forms[1:] if form in index.names]
        if exact:
            return (0, 1, *min(exact))
        if short and len(core) >= 3 and (begun := self.plain.begun(core)):
            return (0, 2, *begun)
        best = None
        for index, form in forms:
            most = max(allowance(len(form) + 1), allowance(len(form)))
            if most and 2 < len(form) <= self.longest + 2:
                for _, name in index.tree.within(form, 2 * most):
                    d = swap_distance(form, name)
                    if d <= allowance(len(name)):
                        rank = (d, 3, *index.names[name])
                        best = rank if best is None or rank < best else best
        return best

    def _found(self, core: str, short: bool) -> tuple[int, int, int, int] | None:
        if (core, short) not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[core, short] = self.lookup(core, short)
        return self.cache[core, short]

    def rank(self, value: str) -> Rank | None:
        """Rank of the entry that a value means, or None. Its first number is the distance less the letters of the span."""
        best: Rank | None = None
        for words, short, unordered in self.phrases(value):
            n = len(words)
            for a in range(n):
                core = ""
                for b in range(a + 1, n + 1):
                    core += words[b - 1]
                    if len(core) > self.longest + 5:  # more than an ending and the allowance
                        break
                    found = self._found(core, short and b == n) if len(core) > 1 else None
                    if found is None:
                        continue
                    d, how, kind, i = found
                    if d and (a or b < n) and (unordered or (b < n and len(core) < HEAD_LETTERS)):
                        continue
                    own = (d - len(core), how, n - b, kind, i)
                    best = own if best is None or own < best else best
        return best

    def match(self, value: str) -> int:
        """Id of the entry that a value means, or -1."""
        found = self.rank(value)
        return -1 if found is None else found[-1]


def _singulars(form: str) -> list[str]:
    """The form and what it may be the plural of."""
    out = [form]
    if form.endswith("ies"):
        out.append(form[:-3] + "y")
    if form.endswith("ves"):
        out += [form[:-3] + "f", form[:-3] + "fe"]
    if form.endswith("es"):
        out.append(form[:-2])
    if form.endswith("s"):
        out.append(form[:-1])
    return out


@lru_cache(maxsize=2)
def _canon(entries: tuple[tuple[int, str, str | None], ...]) -> Canon:
    return Canon(entries)


def is_name(value: Column) -> Column:
    """Whether a value is a name at all."""
    trimmed = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return value.isNotNull() & (trimmed != "") & (F.lower(trimmed) != "unknown")


#: Distinct values of one task at most.
TASK_VALUES = 20_000
RANK = "less int, how int, behind int, kind int, label_id int"


def match_values(values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """value, label_id, how of the distinct values; -1 and null where none is meant. reference: id, category, aliases."""
    spark = values.sparkSession
    entries = reference.select("id", "category", "aliases").where("id is not null and category is not null").dropDuplicates(["id"])
    shards = max(1, -(-entries.count() // shard_entries))
    own_values = cut_lineage(values.select("value"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-own_values.count() // TASK_VALUES))
    spread = own_values.repartition(tasks)  # a few bytes a row, but much work
    out = None
    for shard in range(shards):
        own = entries.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard) if shards > 1 else entries
        sent = spark.sparkContext.broadcast(tuple(tuple(r) for r in own.orderBy("id").collect()))  # about shard_entries rows

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            canon = _canon(sent.value)
            for b in batches:
                found = [canon.rank(v) for v in b.column(0).to_pylist()]
                columns = [pa.array([None if f is None else f[i] for f in found], pa.int32()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["value", "less", "how", "behind", "kind", "label_id"])

        found = spread.mapInArrow(run, f"value string, {RANK}")
        out = found if out is None else out.unionByName(found)
    if shards > 1:
        best = F.min(F.when(F.col("label_id").isNotNull(), F.struct("less", "how", "behind", "kind", "label_id")))
        out = out.groupBy("value").agg(best.alias("b")).select("value", "b.*")
    return out.select("value", F.coalesce("label_id", F.lit(-1)).alias("label_id"), "how")


def map_names(named: dict[str, tuple[DataFrame, str, str]], reference: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """src, row_id, value, label_id, how of every named row of each src (rows, key, value)."""
    rows = values = None
    for src, (df, key, value) in named.items():
        every = df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("row_id"), F.col(value).alias("value")).where(is_name(F.col("value")))
        own, seen = every.dropDuplicates(["row_id"]), every.select("value")
        rows, values = (own, seen) if rows is None else (rows.unionByName(own), values.unionByName(seen))
    matched = cut_lineage(match_values(values.distinct(), reference))  # repeated rows need not be known apart for this
    # a third of all rows may share one value: a small table is broadcast; else adaptive execution splits the hot value
    small = matched.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("size")).first()
    fits = small["n"] <= broadcast_rows and (small["size"] or 0) <= 64 * broadcast_rows
    return rows.join(F.broadcast(matched) if fits else matched, "value").select("src", "row_id", "value", "label_id", "how")


def unmatched_values(mapped: DataFrame) -> DataFrame:
    """Report of the values that mean no entry: src, value, rows."""
    return mapped.where("label_id = -1").groupBy("src", "value").agg(F.count("*").alias("rows"))
