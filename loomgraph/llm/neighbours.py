"""The most similar vectors of every vector.

A forest of random-projection trees indexes every row. Each split is the plane between two centres, put at the median; the
trees are fitted on a bounded sample and have at most as many leaves as that sample can fill with LEAF_SAMPLE rows. A
query descends every tree and puts the far side of each plane it passes into one priority queue shared by all trees, with
the largest margin on the way as its priority; the nearest branch is taken from the queue, descended, and its own far
sides are queued in turn, until the budget of leaves is met. What is sent are packed, lossless blocks of vectors, one row
per leaf and partition. Where a leaf holds more than a task compares at once, the task fits trees of its own on that
leaf's rows and searches them in the same way: the driver and the broadcast hold the top of the forest only, whose size
does not grow with the data. The candidates of a leaf are ranked again by exact cosines in double precision, block by
block, so that only k rows of each query are held however many lie equally near.

Defined cases. Vectors that are null, of another length, all zero or not finite take no part. Repeated rows with one id
count once. Equal cosines rank by the smaller id. Rows that lie on a plane, as rows of one direction do, go to either side
by a hash of their id, so that no leaf keeps them all. Of exact copies more than k + 1 in number only the k + 1 smallest
ids of a partition enter the index: the k nearest of every copy are the k smallest other ids of its class, which a
separate bounded ranking by salted parts gives for all of them, so no link between different texts or rows is lost. Empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage
from loomgraph.tables import spread_out


@dataclass(frozen=True)
class ForestRules:
    """leaves: leaves a query visits in all trees together; share: at least this share of the leaves of a tree, for searches
    without a threshold. leaf_rows: rows a leaf should hold; local_rows: rows of a leaf that are compared without further
    trees. sample_rows: bound of the sample that the planes are fitted on."""

    dim: int = 64
    trees: int = 2
    leaves: int = 5
    share: float = 0.0
    leaf_rows: int = 1024
    local_rows: int = 4096
    sample_rows: int = 1 << 17
    seed: int = 7


#: Sample rows of a leaf at least.
LEAF_SAMPLE = 64
#: Distance from a plane within which single precision cannot tell its sides.
ON_PLANE = 1e-6
#: Rows of a partition that are packed together, and rows that go through the trees at once.
PACK_ROWS = 1 << 16
CHUNK = 4096

Tree = tuple[np.ndarray, np.ndarray]


def depth_for(rows: int, rules: ForestRules) -> int:
    """Levels that give leaves of leaf_rows rows, as far as the sample fills them."""
    most = int(np.log2(max(1, rules.sample_rows // LEAF_SAMPLE)))
    return min(most, max(0, int(np.ceil(np.log2(max(1, rows) / rules.leaf_rows)))))


def fit_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """(planes, offsets) of a complete tree: node n has the children 2n + 1 (not above its offset) and 2n + 2."""
    nodes, dim = (1 << depth) - 1, sample.shape[1]
    planes, offsets = np.zeros((nodes, dim), np.float32), np.zeros(nodes, np.float32)
    members = {0: np.arange(len(sample))}
    for node in range(nodes):
        own = members.pop(node)
        x = sample[own]
        normal = np.zeros(dim, np.float32)
        if len(own) > 1:
            a, b = x[rng.choice(len(own), 2, replace=False)]
            for _ in range(4):
                side = x @ (a - b) > (a + b) @ (a - b) / 2
                if side.all() or not side.any():
                    break
                a, b = x[side].mean(0), x[~side].mean(0)
            normal = a - b
        if not np.linalg.norm(normal) > 1e-6:
            normal = rng.normal(size=dim).astype(np.float32)
        normal = normal / np.linalg.norm(normal)
        p = x @ normal
        planes[node], offsets[node] = normal, np.median(p) if len(own) else 0
        v = p - offsets[node]
        up = np.where(np.abs(v) < ON_PLANE, rng.random(len(v)) < 0.5, v > 0)
        members[2 * node + 1], members[2 * node + 2] = own[~up], own[up]
    return planes, offsets


def _bits(ids: np.ndarray) -> np.ndarray:
    """Hash of each id, of which a level takes one bit."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Route:
    """Visits of the leaves by some rows, nearest first."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, trees: Sequence[Tree], depth: int, leaves: int):
        self.x, self.depth, self.first = x, depth, (1 << depth) - 1
        self.planes, self.offsets = np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees])
        self.bits, self.used, self.rows = _bits(ids), 0, np.arange(len(x))
        places = max(1, depth * max(len(trees), leaves))
        self.margin = np.full((len(x), places), np.inf, np.float32)
        self.node = np.zeros((len(x), places), np.int32)
        self.tree = np.zeros((len(x), places), np.int8)
        zero = np.zeros(len(x), np.int64)
        #: (tree, leaf) of each visit; the first of each tree is the row's own leaf
        self.visits = [(zero + t, self._descend(zero + t, zero, np.zeros(len(x), np.float32))) for t in range(len(trees))]

    def _descend(self, tree: np.ndarray, node: np.ndarray, margin: np.ndarray) -> np.ndarray:
        for level in range(self.depth):
            on = node < self.first
            if not on.any():
                break
            inner = np.minimum(node, self.first - 1)
            v = np.einsum("ij,ij->i", self.x, self.planes[tree, inner]) - self.offsets[tree, inner]
            up = np.where(np.abs(v) < ON_PLANE, (self.bits >> np.uint64(level)) & np.uint64(1) > 0, v > 0)
            self.margin[:, self.used] = np.where(on, np.maximum(margin, np.abs(v)), np.inf)
            self.node[:, self.used], self.tree[:, self.used] = 2 * inner + 2 - up, tree
            self.used += 1
            node = np.where(on, 2 * inner + 1 + up, node)
        return node

    def search(self, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Visits of that many leaves, as long as the queue holds any."""
        while len(self.visits) < leaves and self.used:
            at = self.margin[:, : self.used].argmin(1)
            margin = self.margin[self.rows, at]
            if not np.isfinite(margin).all():
                break
            tree, node = self.tree[self.rows, at].astype(np.int64), self.node[self.rows, at].astype(np.int64)
            self.margin[self.rows, at] = np.inf
            self.visits.append((tree, self._descend(tree, node, margin)))
        return self.visits


def visited(x: np.ndarray, ids: np.ndarray, trees: Sequence[Tree], depth: int, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tree, leaf) of each of the leaves that some unit vectors visit, own leaves first."""
    if not depth:
        return [(np.zeros(len(x), np.int64), np.zeros(len(x), np.int64))]
    if leaves > 2 * depth:
        return _ranked_leaves(x, ids, trees, depth, leaves)
    return Route(x, ids, trees, depth, leaves).search(leaves)


def _ranked_leaves(x: np.ndarray, ids: np.ndarray, trees: Sequence[Tree], depth: int, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The leaves that the queue gives first, for budgets so large that the priorities of all leaves are sooner known at once."""
    bits, first, every = _bits(ids)[:, None], (1 << depth) - 1, []
    for planes, offsets in trees:
        v, margin = x @ planes.T - offsets, np.zeros((len(x), 1), np.float32)
        for level in range(depth):
            at = v[:, (1 << level) - 1 : (2 << level) - 1]
            up = np.where(np.abs(at) < ON_PLANE, (bits >> np.uint64(level)) & np.uint64(1) > 0, at > 0)
            far = np.maximum(margin, np.abs(at))
            margin = np.stack([np.where(up, far, margin), np.where(up, margin, far)], 2).reshape(len(x), -1)
        every.append(margin)
    order = np.argsort(np.concatenate(every, 1), 1, kind="stable")[:, :leaves]  # own leaves have the priority 0
    return [(order[:, i] >> depth, first + (order[:, i] & first)) for i in range(order.shape[1])]


def _planes(raw: np.ndarray) -> bytes:
    """Byte planes of numbers, compressed."""
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(raw).view(np.uint8).reshape(-1, raw.itemsize).T.tobytes(), asbytes=True)


def _numbers(block: bytes, kind: str, n: int) -> np.ndarray:
    dtype = np.dtype(kind)
    planes = pa.Codec("zstd").decompress(block, n * dtype.itemsize, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).reshape(n)


def pack(x: np.ndarray) -> bytes:
    """Lossless block of float32 rows: whole numbers of 16 bits (small ones small, whatever their sign) where a power of two makes them so, else as they are."""
    for power in (8, 12):
        scaled = x * np.float32(1 << power)
        whole = np.rint(scaled)
        if np.array_equal(scaled, whole) and np.abs(whole).max(initial=0) < 32768:
            v = whole.astype(np.int32)
            return bytes([power]) + _planes(((v << 1) ^ (v >> 31)).astype("<u2").ravel())
    return bytes([0]) + _planes(x.astype("<f4").ravel())


def unpack(block: bytes, rows: int, dim: int) -> np.ndarray:
    if not block[0]:
        return _numbers(block[1:], "<f4", rows * dim).reshape(rows, dim)
    u = _numbers(block[1:], "<u2", rows * dim).astype(np.int32)
    return ((u >> 1) ^ -(u & 1)).astype(np.float32).reshape(rows, dim) / np.float32(1 << block[0])


def valid_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, float32 rows) of the vectors of a list column that take part."""
    column = column if isinstance(column, pa.ListArray) else column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero((np.diff(offsets) == dim) & np.asarray(column.is_valid()))
    x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float32) if len(at) else np.zeros((0, dim), np.float32)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[fine], x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def few_copies(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Places of the rows that stay when each id counts once and equal vectors keep their smallest ids only."""
    if not len(ids):
        return np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
    rows = np.ascontiguousarray(x[order]).view([("", np.void, x.shape[1] * x.itemsize)]).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by = np.argsort(group, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1])
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return np.sort(order[by[rank < keep]])


BLOCK = pa.schema([("field", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int64()), ("items", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("asks", pa.binary()), ("rows", pa.binary())])


def _budget(depth: int, rules: ForestRules) -> int:
    """Leaves that a query visits."""
    return min(max(rules.leaves, int(np.ceil(rules.share * (1 << depth)))), rules.trees << depth)


def _blocks(field: int, ids: np.ndarray, x: np.ndarray, asks: np.ndarray, forest, rules: ForestRules) -> Iterator[pa.RecordBatch]:
    """Packed blocks of some rows, items before queries. Own leaves take a row as item, the others the asked rows as queries."""
    trees, depth = forest
    places, leaves = [], _budget(depth, rules)
    chunk = max(64, min(CHUNK, (1 << 22) // max(1, len(trees) << depth)))
    for i in range(0, len(x), chunk):
        u, own = unit(x[i : i + chunk]), ids[i : i + chunk]
        q = np.flatnonzero(asks[i : i + chunk])
        if len(q) == len(u):
            visits = visited(u, own, trees, depth, leaves)
            homes, further = visits[: len(trees)], visits[len(trees) :]
        else:
            homes = visited(u, own, trees, depth, 0)
            further = visited(u[q], own[q], trees, depth, leaves)[len(homes) :] if len(q) else []
        places += [(np.arange(i, i + len(u)), t, leaf, np.zeros(len(u), np.int8)) for t, leaf in homes]
        places += [(i + q, t, leaf, np.ones(len(q), np.int8)) for t, leaf in further]
    at, tree, leaf, query = (np.concatenate(c) for c in zip(*places))
    order = np.lexsort((query, leaf, tree))
    at, tree, leaf, query = at[order], tree[order], leaf[order], query[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(leaf) | np.diff(tree)) + 1, [len(leaf)]])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = at[a:b]
        out.append((field, int(tree[a]), int(leaf[a]), int(b - a - query[a:b].sum()), int(b - a), _planes(ids[own].astype("<i8")), _planes(asks[own].astype(np.uint8)), pack(x[own])))
        if len(out) == 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), BLOCK)], schema=BLOCK)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), BLOCK)], schema=BLOCK)


def _index(fields: Sequence[int], forests, rules: ForestRules, keep: int):
    """For batches of (id, whether asked, vector of each field)."""

    def flush(field: int, held: list) -> Iterator[pa.RecordBatch]:
        ids, asks, x = (np.concatenate(c) for c in zip(*held))
        stay = few_copies(ids, x, keep)
        yield from _blocks(field, ids[stay], x[stay], asks[stay], forests.value[field], rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {f: [] for f in fields}
        for b in batches:
            ids, asks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for c, field in enumerate(fields, 2):
                at, x = valid_rows(b.column(c), rules.dim)
                if len(at):
                    held[field].append((ids[at].astype(np.int64), asks[at].astype(bool), x))
                if sum(len(h[0]) for h in held[field]) >= PACK_ROWS:
                    yield from flush(field, held[field])
                    held[field] = []
        for field, rest in held.items():
            if rest:
                yield from flush(field, rest)

    return run


#: Queries of a block, and pairs whose exact cosines are taken at once.
BLOCK_QUERIES = 256
BLOCK_PAIRS = 1 << 15

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]
NO_PAIRS: Pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def first_of_each(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> Pairs:
    """The k pairs of each a with the largest c, then the smallest b."""
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1]) if len(a) else np.zeros(0, int)
    stay = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < k
    return a[stay], b[stay], c[stay]


def best_items(ids: np.ndarray, x: np.ndarray, u: np.ndarray, queries: np.ndarray, items: np.ndarray, k: int, min_cosine: float) -> Pairs:
    """(query id, item id, cosine) of the k best items of each query that reach min_cosine. u: the rows of x with unit length."""
    targets, norm, found = u[items], np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)), []
    for i in range(0, len(queries) if len(items) else 0, BLOCK_QUERIES):
        own = queries[i : i + BLOCK_QUERIES]
        s = u[own] @ targets.T
        if min_cosine > -1 and not (s >= min_cosine - 1e-4).any():
            continue
        s[ids[own][:, None] == ids[items][None, :]] = -2
        least = np.full(len(own), max(min_cosine - 1e-4, -1.5), np.float32)
        if len(items) > k:  # with all that single precision cannot tell apart from the last
            crowded = np.flatnonzero((s >= least[:, None]).sum(1) > k)
            if len(crowded):
                least[crowded] = np.maximum(least[crowded], np.partition(s[crowded], len(items) - k, 1)[:, len(items) - k] - 1e-5)
        r, c = np.nonzero(s >= least[:, None])
        r, c = own[r], items[c]
        cosine = np.empty(len(r))
        for j in range(0, len(r), BLOCK_PAIRS):
            p, q = r[j : j + BLOCK_PAIRS], c[j : j + BLOCK_PAIRS]
            cosine[j : j + BLOCK_PAIRS] = np.einsum("ij,ij->i", x[p], x[q], dtype=np.float64) / (norm[p] * norm[q])
        fine = cosine >= min_cosine
        found.append(first_of_each(ids[r[fine]], ids[c[fine]], cosine[fine], k))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else NO_PAIRS


def leaf_pairs(ids: np.ndarray, x: np.ndarray, item: np.ndarray, asks: np.ndarray, k: int, min_cosine: float, rules: ForestRules) -> Pairs:
    """(query id, item id, cosine) within one leaf; trees of its own are fitted on it where it holds more than local_rows items."""
    u, items, queries = unit(x), np.flatnonzero(item), np.flatnonzero(asks)
    if len(items) <= rules.local_rows or rules.share:
        return best_items(ids, x, u, queries, items, k, min_cosine)
    depth = max(1, int(np.ceil(np.log2(len(items) / rules.leaf_rows))))
    rng = np.random.default_rng(rules.seed + len(items))
    fit = u[items[rng.choice(len(items), min(len(items), LEAF_SAMPLE << depth), replace=False)]]
    trees = [fit_tree(fit, depth, rng) for _ in range(rules.trees)]
    rows_at = lambda rows, leaves: [np.concatenate(c) for c in zip(*((np.tile(rows[i : i + CHUNK], len(v)), *map(np.concatenate, zip(*v))) for i in range(0, len(rows), CHUNK) for v in [visited(u[rows[i : i + CHUNK]], ids[rows[i : i + CHUNK]], trees, depth, leaves)]))]
    found = [NO_PAIRS]
    (at, tree, leaf), (q_at, q_tree, q_leaf) = rows_at(items, 0), rows_at(queries, rules.leaves + rules.trees) if len(queries) else (queries,) * 3
    place, q_place = tree << depth + 1 | leaf, q_tree << depth + 1 | q_leaf
    order, q_order = np.argsort(place, kind="stable"), np.argsort(q_place, kind="stable")
    places, starts = np.unique(place[order], return_index=True)
    ends, q_starts, q_ends = np.append(starts[1:], len(order)), np.searchsorted(q_place[q_order], places, "left"), np.searchsorted(q_place[q_order], places, "right")
    for a, b, c, d in zip(starts, ends, q_starts, q_ends):
        found.append(best_items(ids, x, u, q_at[q_order[c:d]], at[order[a:b]], k, min_cosine))
    a, b, c = (np.concatenate(f) for f in zip(*found))
    _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
    return first_of_each(a[once], b[once], c[once], k)


PAIRS = "field int, a long, b long, cosine double"


def _pairs_table(field: int, pairs: Pairs) -> pa.Table:
    a, b, c = pairs
    return pa.table({"field": pa.array(np.full(len(a), field, np.int32)), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})


def _search(k: int, min_cosine: float, keep: int, rules: ForestRules):
    def run(table: pa.Table) -> pa.Table:
        ids, x, item, asks = [], [], [], []
        for n, size, i, a, rows in zip(*(table[c].to_pylist() for c in ("items", "size", "ids", "asks", "rows"))):
            ids.append(_numbers(i, "<i8", size))
            asks.append(_numbers(a, "u1", size) > 0)
            x.append(unpack(rows, size, rules.dim))
            item.append(np.arange(size) < n)
        ids, x, item, asks = (np.concatenate(c) for c in (ids, x, item, asks))
        order = np.argsort(~item, kind="stable")  # of a row that is item and query, the item stays
        ids, x, item, asks = ids[order], x[order], item[order], asks[order]
        stay = few_copies(ids, x, keep)
        return _pairs_table(table["field"][0].as_py(), leaf_pairs(ids[stay], x[stay], item[stay], asks[stay], k, min_cosine, rules))

    return run


def _many_copies(rows: DataFrame, vector: str, field: int, k: int) -> DataFrame | None:
    """The k nearest of every copy of the vectors that more than k + 1 rows share; None if there are none."""
    keyed = rows.where(f"{vector} is not null").select("_id", F.xxhash64(vector).alias("h1"), F.xxhash64(vector, F.lit(1)).alias("h2"), vector)
    hot = cut_lineage(keyed.groupBy("h1", "h2").count().where(F.col("count") > k + 1).select("h1", "h2"))
    if hot.isEmpty():
        return None
    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v)
    fine = F.coalesce(norm > 0, F.lit(False)) & ~F.isnan(norm) & (norm < float("inf"))
    copies = keyed.join(hot, ["h1", "h2"]).where(fine).select("h1", "h2", "_id").distinct()
    copies = copies.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(256)))
    first = copies.withColumn("r", F.expr("row_number() over (partition by h1, h2, _part order by _id)")).where(F.col("r") <= k + 1)
    least = first.withColumn("r", F.expr("row_number() over (partition by h1, h2 order by _id)")).where(F.col("r") <= k + 1)
    least = least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("_id")).alias("least"))  # k + 1 ids each
    near = F.slice(F.filter("least", lambda x: x != F.col("_id")), 1, k)
    return copies.join(least, ["h1", "h2"]).select(F.lit(field).alias("field"), F.col("_id").alias("a"), F.explode(near).alias("b"), F.lit(1.0).alias("cosine"))


def nearest(sources: Sequence[tuple[DataFrame, str, Sequence[tuple[str, str]]]], k: int = 10, min_cosine: float = -1.0, rules: ForestRules = ForestRules(), asked: str = "true") -> DataFrame:
    """field_name, a, b, cosine: of each row a whose `_id` meets the condition asked its k most similar rows b. sources: (rows, id, [(field_name, vector column)])."""
    spark = sources[0][0].sparkSession
    names, forests, indexed, extra = [], {}, [], []
    for rows, key, vectors in sources:
        own = rows.select(F.col(key).cast("long").alias("_id"), *[F.col(v).cast("array<float>").alias(f"_v{i}") for i, (_, v) in enumerate(vectors)]).where("_id is not null")
        n = own.count()
        depth = depth_for(n, rules)
        want = LEAF_SAMPLE << depth
        sample = own.drop("_id").sample(min(1.0, 1.2 * want / max(1, n)), seed=rules.seed).limit(want).toArrow() if depth else None  # sample_rows at most
        fields = list(range(len(names), len(names) + len(vectors)))
        for i, (f, (name, _)) in enumerate(zip(fields, vectors)):
            names.append(name)
            rng = np.random.default_rng(rules.seed + f)
            s = np.unique(unit(valid_rows(sample.column(i), rules.dim)[1]), axis=0) if depth else None
            forests[f] = ([fit_tree(s, depth, rng) for _ in range(rules.trees)] if depth else [(None, None)], depth)
            copies = _many_copies(own.where(F.size(f"_v{i}") == rules.dim), f"_v{i}", f, k)
            extra += [copies.where(F.expr(asked.replace("_id", "a")))] if copies is not None else []
        indexed.append((own.select("_id", F.coalesce(F.expr(asked), F.lit(False)).alias("_asked"), *[f"_v{i}" for i in range(len(vectors))]), fields))
        del sample
    sent = spark.sparkContext.broadcast(forests)
    kinds = "field int, tree int, leaf long, items int, size int, ids binary, asks binary, rows binary"
    blocks = None
    for own, fields in indexed:
        part = spread_out(own).mapInArrow(_index(fields, sent, rules, k + 1), kinds)
        blocks = part if blocks is None else blocks.unionByName(part)
    found = blocks.groupBy("field", "tree", "leaf").applyInArrow(_search(k, min_cosine, k + 1, rules), PAIRS)
    for copies in extra:
        found = found.unionByName(copies)
    if asked == "true":  # a link found by one of its ends counts for both
        found = found.select("field", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "cosine").select("field", "p.a", "p.b", "cosine")
    one = found.groupBy("field", "a", "b").agg(F.max("cosine").alias("cosine"))
    ranked = one.withColumn("_r", F.expr("row_number() over (partition by field, a order by cosine desc, b)")).where(F.col("_r") <= k)
    return ranked.select(F.element_at(F.array(*[F.lit(x) for x in names]), F.col("field") + 1).alias("field_name"), "a", "b", "cosine")


def _best_of(k: int, dim: int):
    """Of one cell of queries against items: the k nearest items of each query, all of them compared."""

    def run(cell: pa.Table) -> pa.Table:
        at, x = valid_rows(cell["v"].combine_chunks(), dim)
        ids, asks = cell["id"].to_numpy()[at], cell["ask"].to_numpy()[at]
        q, t = (np.flatnonzero(m)[np.unique(ids[m], return_index=True)[1]] for m in (asks, ~asks))
        return _pairs_table(cell["field"][0].as_py(), best_items(ids, x, unit(x), q, t, k, -1.0))

    return run


#: Items and queries of a cell of the exact search.
CELL_ROWS = 1 << 17


def nearest_of_some(sources: Sequence[tuple[DataFrame, str, Sequence[tuple[str, str]]]], asked: str, k: int = 10, dim: int = 64) -> DataFrame:
    """field_name, a, b, cosine: the k most similar rows b of each row a whose `id` meets the condition asked, without threshold.

    Unrelated rows have no neighbour that a forest reaches cheaply, so each asked row is compared with every row: the
    result is exact, and the work grows with the number of asked rows times that of all rows. Cells of a grid of items by
    queries bound what a task holds; all rows with one id meet in one cell.
    """
    names, cells = [], None
    for rows, key, vectors in sources:
        own = rows.select(F.col(key).cast("long").alias("id"), *[v for _, v in vectors]).where("id is not null")
        n, asking = own.agg(F.count("*"), F.count_if(F.expr(asked))).first()
        by_items, by_queries = max(-(-n // CELL_ROWS), min(12, -(-n // 4096)), 1), max(-(-asking // CELL_ROWS), 1)
        for name, v in vectors:
            own_field = own.where(F.size(v) == dim).select(F.lit(len(names)).alias("field"), "id", F.col(v).cast("array<float>").alias("v"))
            names.append(name)
            place = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
            every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
            items = own_field.select("*", F.lit(False).alias("ask"), place(by_items).alias("i"), every(by_queries).alias("q"))
            queries = own_field.where(asked).select("*", F.lit(True).alias("ask"), every(by_items).alias("i"), place(by_queries).alias("q"))
            both = items.unionByName(queries)
            cells = both if cells is None else cells.unionByName(both)
    found = cells.groupBy("field", "i", "q").applyInArrow(_best_of(k, dim), PAIRS)
    ranked = found.withColumn("_r", F.expr("row_number() over (partition by field, a order by cosine desc, b)")).where(F.col("_r") <= k)
    return ranked.select(F.element_at(F.array(*[F.lit(x) for x in names]), F.col("field") + 1).alias("field_name"), "a", "b", "cosine")


def similar_pairs(near: DataFrame) -> DataFrame:
    """field_name, id_a, id_b (id_a < id_b) of which one is among the nearest of the other."""
    return near.select("field_name", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
