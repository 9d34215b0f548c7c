"""Operators for training data against brute force, round trips and held-out rows, with nulls, repeats, ties, long texts and empty tables."""

import random

import numpy as np
import pytest
from oracle import DATA, compare
from pyspark.sql import functions as F

from loomgraph.llm import canonical, language, leakage, neighbours, ngrams, queries, splits, tokens
from loomgraph.llm.words import words

LABELS = [(11, "chair", "seat"), (64, "table", None), (71, "coffee table", "cocktail table"), (99, "bookshelf", "bookcase"), (418, "trash can", "garbage bin | waste bin"), (431, "bucket", "pail"), (186, "window", None), (929, "bicycle", "push bike"), (701, "candle", "tealight")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    ours, theirs, extra, missing = compare(spark, name, str(DATA / "sf0.001"), queries.QUERIES, queries.SQL)
    assert (ours, extra, missing) == (theirs, [], [])


# p2


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        near = sorted((-round(s[i, j], 12), ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= least)[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in near}
    return out


def vector_rows(spark, rows):
    return spark.createDataFrame(rows, "key long, v array<float>, _id string, field int")


def test_pairs_equal_brute_force_through_leaves(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 64))
    near = base[:300] + 0.15 * rng.normal(size=(300, 64))
    x = np.round(np.concatenate([base, near]) * 256) / 256
    ids = list(range(len(x)))
    rows = [(i, v.tolist(), "c", 1) for i, v in zip(ids, x)] + [(5, x[5].tolist(), "c", 1), (9000, None, "c", 1), (9001, [0.0] * 64, "c", 1), (9002, [1.0], "c", 1), (9003, [float("nan")] * 64, "c", 1), (None, None, None, None)]
    rules = neighbours.ForestRules(leaf_rows=128)
    got = neighbours.similar_pairs(neighbours.nearest([(vector_rows(spark, [r for r in rows if r[0] is not None]), "key", [("f", "v")])], 10, 0.92, rules)).collect()
    got = {(r["id_a"], r["id_b"]) for r in got}
    want = brute(ids, x, 10, 0.92)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) >= 250


def test_many_copies_and_ties(spark):
    one = [1.0] + [0.0] * 63
    other = [0.0, 1.0] + [0.0] * 62
    rows = [(i, one, "c", 1) for i in range(40)] + [(100 + i, other, "c", 1) for i in range(3)] + [(7, one, "c", 1)]
    got = neighbours.similar_pairs(neighbours.nearest([(vector_rows(spark, rows), "key", [("f", "v")])], 3, 0.92)).collect()
    want = brute(list(range(40)) + [100, 101, 102], np.array([one] * 40 + [other] * 3), 3, 0.92)
    assert {(r["id_a"], r["id_b"]) for r in got} == want


def test_top_k_without_limit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    got = neighbours.nearest([(vector_rows(spark, [(i, v.tolist(), "c", 1) for i, v in enumerate(x)]), "key", [("f", "v")])], 5).groupBy("a").count().collect()
    assert len(got) == 60 and all(r["count"] == 5 for r in got)
    assert neighbours.nearest([(vector_rows(spark, []), "key", [("f", "v")])], 5).count() == 0


def test_nearest_of_some_is_exact_over_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    x = np.random.default_rng(5).normal(size=(700, 64)).astype(np.float32)
    x[20:40] = x[20]
    rows = [(i, v.tolist(), "c", 1) for i, v in enumerate(x)] + [(4, x[4].tolist(), "c", 1), (9000, None, "c", 1), (9002, [1.0], "c", 1), (9004, [0.0] * 64, "c", 1)]
    got = neighbours.nearest_of_some([(vector_rows(spark, rows), "key", [("f", "v")])], "id % 4 = 0", 10).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    want = {(i, j) for i in range(0, 700, 4) for j in sorted((j for j in range(700) if j != i), key=lambda j: (-s[i, j], j))[:10]}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert neighbours.nearest_of_some([(vector_rows(spark, []), "key", [("f", "v")])], "id % 4 = 0").count() == 0


def test_forest_recall_without_threshold(spark):
    from loomgraph.llm import queries

    folder = "/root/testdata/sf0.1"
    found, exact = ({tuple(r) for r in queries.QUERIES[name](spark, folder).collect()} for name in ("p2_forest", "p2_nearest"))
    for field in ("object_node.visual_embedding", "instance_info.bert_embedding", "instance_info.feature"):
        want = {r for r in exact if r[0] == field}
        assert len(want & found) >= 0.9 * len(want) and len(want) >= 700, field
    assert len(found) == len(exact)


def test_queue_takes_branches_met_on_the_way_down_a_far_side():
    rng = np.random.default_rng(8)
    x = neighbours.unit(rng.normal(size=(400, 64)).astype(np.float32))
    trees = [neighbours.fit_tree(x, 4, rng) for _ in range(2)]
    ids = np.arange(len(x))
    few = neighbours.Route(x, ids, trees, 4, 32).search(32)
    assert len(few) == 32 and all(len({(int(t[i]), int(leaf[i])) for t, leaf in few}) == 32 for i in range(50))  # every leaf once, in the end
    for (t, leaf), (t2, leaf2) in zip(few[:2], neighbours._ranked_leaves(x, ids, trees, 4, 32)[:2]):
        assert np.array_equal(leaf, leaf2) and np.array_equal(t, t2)


def test_rows_of_one_direction_are_spread_over_the_leaves():
    rng = np.random.default_rng(9)
    one = rng.normal(size=64)
    x = neighbours.unit(np.concatenate([one[None, :] * rng.uniform(0.5, 2, (3000, 1)), rng.normal(size=(1000, 64))]).astype(np.float32))
    tree = neighbours.fit_tree(np.unique(x, axis=0), 4, rng)
    leaf = neighbours.visited(x, np.arange(len(x)), [tree], 4, 0)[0][1]
    assert np.bincount(leaf - 15, minlength=16).max() < 1200


def test_a_leaf_of_near_duplicates_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(10)
    x = (rng.normal(size=64) + 1e-4 * rng.normal(size=(4000, 64))).astype(np.float32)
    everyone = np.ones(len(x), bool)
    tracemalloc.start()
    a, b, c = neighbours.leaf_pairs(np.arange(len(x)), x, everyone, everyone, 10, 0.92, neighbours.ForestRules())
    assert tracemalloc.get_traced_memory()[1] < 500e6 and len(a) == 40000
    tracemalloc.stop()


def test_a_large_leaf_is_searched_by_trees_of_its_own():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3000, 64))
    x = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]).astype(np.float32)
    everyone, rules = np.ones(len(x), bool), neighbours.ForestRules(local_rows=1000, leaf_rows=256)
    a, b, _ = neighbours.leaf_pairs(np.arange(len(x)), x, everyone, everyone, 10, 0.92, rules)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, i + 3000) for i in range(3000)}
    assert len(found & want) >= 0.97 * len(want) and len(a) == len(set(zip(a.tolist(), b.tolist())))


def test_blocks_are_lossless():
    rng = np.random.default_rng(5)
    for x in (np.round(rng.normal(size=(20, 64)) * 256) / 256, rng.normal(size=(20, 64)), np.full((2, 64), 1e30)):
        x = x.astype(np.float32)
        assert np.array_equal(neighbours.unpack(neighbours.pack(x), len(x), 64), x)


# p3


@pytest.mark.parametrize(
    "value, label",
    [("Chair", 11), ("17) chiar", 11), ("SEAT_23", 11), ("table, coffee", 71), ("cofee  table (id 5512)", 71), ("old white Bookcase: near the entrance", 99), ("chairs", 11), ("bookshelves", 99), ("trash/can #12", 418), ("garbagebin", 418), ("pа11", 431), ("windо​w", 186), ("wíndow sn5512", 186), ("bookca.", 99), ("unicycle", -1), ("saddle", -1), ("kayak", -1), ("???", -1), ("12", -1), ("x" * 5000, -1)],
)
def test_names(value, label):
    assert canonical.Canon(LABELS).match(value) == label


def test_names_do_not_depend_on_the_shards(spark):
    entries = [(0, "door", None), (1, "glass door", "pane | shelf"), (2, "shelve", None), (3, "bed", None), (4, "bedside table", None), (5, "wall", "illili"), (6, "lamp", None)]
    values = ["glass door", "a glas door", "door of glass", "shelves", "bed.", "beds.", "tall lamp", "lamp, tall", "1l1l1i", "i1li11", "11l111 x", "wlal", "near the door", "dor, old"]
    want = {v: canonical.Canon(entries).match(v) for v in values}
    assert [want[v] for v in ("glass door", "a glas door", "door of glass", "1l1l1i", "tall lamp", "lamp, tall", "bed.", "near the door", "dor, old")] == [1, 1, 0, 5, 6, 6, 3, 0, 0]
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    reference = spark.createDataFrame(entries, "id int, category string, aliases string")
    for shard in (7, 4, 2, 1):
        assert {r["value"]: r["label_id"] for r in canonical.match_values(rows, reference, shard).collect()} == want, shard


def test_tree_equals_scan():
    rng = random.Random(1)
    entries = ["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(200)]
    tree = canonical.BKTree(entries)
    for _ in range(60):
        q, r = "".join(rng.choices("abcd", k=rng.randint(0, 7))), rng.randint(0, 3)
        slow = {(edit(q, e), e) for e in set(entries) if edit(q, e) <= r}
        assert set(tree.within(q, r)) == slow
        assert all(canonical.swap_distance(q, e) <= d for d, e in slow)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_of_tables(spark):
    reference = spark.createDataFrame(LABELS, "id int, category string, aliases string")
    rows = spark.createDataFrame([(1, "chair", 0), (1, "chair", 0), (2, None, 0), (3, " ", 0), (4, " UNKNOWN ", 0), (5, "kayak", 0), (6, "chair", 0)], "k long, n string, value int")
    for limit, shard in ((10, 100), (0, 2)):
        canonical.SHARD_ENTRIES = shard
        got = canonical.map_names({"s": (rows, "k", "n")}, reference, broadcast_rows=limit)
        assert sorted((r["row_id"], r["label_id"]) for r in got.collect()) == [(1, 11), (5, -1), (6, 11)]
    assert canonical.match_values(rows.select(F.col("n").alias("value")).where("n is not null").distinct(), reference, 2).where("label_id = 11").count() == 1
    assert canonical.unmatched_values(got).collect()[0]["value"] == "kayak"
    assert canonical.map_names({"s": (rows.limit(0), "k", "n")}, reference).count() == 0
    assert {r["label_id"] for r in canonical.map_names({"s": (rows, "k", "n")}, reference.limit(0)).collect()} == {-1}


# p4


def test_groups_and_splits(spark):
    rows = [(i, f"scene{i % 50:04d}_01", f"scene{i % 50:04d}_00", "c") for i in range(1000)]
    rows += [(2000, "scene0001_00", "SCENE0002-07", "c"), (2001, None, "scene0002_00", "c"), (2001, None, "scene0002_00", "c"), (2002, "unknown", "", "c"), (2003, None, None, "c")]
    rows += [(3000 + i, "scene0900_00", None, "c") for i in range(500)]
    df = spark.createDataFrame(rows, "match_id long, scene_graph_id string, frame_scene string, component string")
    groups = splits.scene_groups(df)
    got = {r["match_id"]: r["group_scene"] for r in groups.collect()}
    assert got[2000] == got[2001] == got[2] == got[1] == 1 and got[3000] == 900 and 2002 not in got and 2003 not in got
    out = splits.assign_splits(groups).collect()
    of = {}
    for r in out:
        of.setdefault(r["group_scene"], set()).add(r["split"])
    assert len(out) == len(got) and all(len(s) == 1 for s in of.values())
    share = {s: sum(r["split"] == s for r in out) / len(out) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.05 and share["validation"] > 0.03 and share["test"] > 0.03
    assert splits.assign_splits(splits.scene_groups(df.limit(0))).count() == 0


def test_largest_differencing():
    rng = random.Random(2)
    weights = [(rng.randint(1, 1000), i) for i in range(400)]
    bins = splits.largest_differencing(weights, 40)
    assert sorted(x for _, m in bins for x in m) == list(range(400))
    assert max(w for w, _ in bins) - min(w for w, _ in bins) < 40
    assert splits.largest_differencing([], 4) == []


def test_shares_of_the_splits(spark):
    rows = spark.createDataFrame([(i, i % 50) for i in range(1000)], "match_id long, group_scene int")
    report = {r["split"]: (r["groups_cut"], r["fits"]) for r in splits.share_report(splits.assign_splits(rows)).collect()}
    assert report == {s: (0, True) for s in splits.SHARES}
    cut = rows.withColumn("split", F.when(F.col("match_id") < 500, "train").otherwise("test"))
    assert {r["split"]: (r["groups_cut"], r["fits"]) for r in splits.share_report(cut).collect()} == {"train": (50, False), "test": (50, False), "validation": (0, False)}


# p7


def test_ngrams_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(300)] + ["A-b_c a", "", "a a a", "x" * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (9999, None, 1)], "k long, v string, n int")
    want = {}
    for t in texts:
        ts = [w for w in __import__("re").findall(r"[^\W_]+", t.lower())]
        grams = [" ".join(ts[i : i + n]) for n in (1, 2, 3) for i in range(len(ts) - n + 1)]
        for g in grams:
            want.setdefault(g, [0, 0])[0] += 1
        for g in set(grams):
            want[g][1] += 1
    out = ngrams.term_marks({"s": (df, "k", "v")}).collect()
    assert {r["term"]: [r["occurrences"], r["records"]] for r in out} == want
    marks = {r["term"]: r["mark"] for r in out}
    assert marks["a"] == "common" and marks["x" * 20000] == "rare"
    assert ngrams.term_marks({"s": (df.limit(0), "k", "v")}).count() == 0
    seqs = ngrams.sequences(df, "k", "v").withColumn("src", F.lit("s"))
    once, parted = ({tuple(r) for r in ngrams.ngram_counts(seqs.select("src", "terms", "weight"), 3, most).collect()} for most in (1000, 1))
    assert once == parted and once


# p8


def test_token_round_trip(spark):
    texts = [None, "", " ", "Hello  world's <|endoftext|>\n\n", "床垫 已经 ✅🪑‍", "a" * 3000, " x1 2.5\t" * 30000, "퟿"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_column(df).collect()}
    enc = tokens.encoding()
    assert got[0] == got[1] == []
    assert all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts) if t)
    back = {r["doc_id"]: r["text"] for r in tokens.decode_column(tokens.encode_column(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokens.encode_column(df.limit(0)).count() == 0


def test_parts_do_not_change_ids():
    rng = random.Random(4)
    enc = tokens.encoding()
    for _ in range(200):
        t = "".join(rng.choices(["a", "Bc", "1", " ", "  ", "\n", "'s", "é", "!", " ", "床"], k=rng.randint(0, 60)))
        assert tokens.encode(t, size=3) == enc.encode_ordinary(t) and "".join(tokens.parts(t, 3)) == t


def test_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for t in ("Scan scene0001_01 covers everything.", "Après l'alignement, la lampe est décalée de 81 cm", "从第591帧开始，就看不到窗帘了。"):
        assert tokens.encode(t) == other.encode(t, add_special_tokens=False).ids


# p9

ITEM = "Between the outer rail and the brass pulley the foreman left twenty three markers by accident so that the loom bench of the greenhouse aisle never wobbled."


@pytest.mark.parametrize(
    "change, found",
    [
        (lambda t: t, True),
        (lambda t: "x y " + " ".join(t.split()[3:15]) + " z", True),
        (lambda t: "x y " + " ".join(t.split()[3:14]) + " z", False),
        (lambda t: t.upper().replace(" ", "\n\n"), True),
        (lambda t: t.replace("pulley", "pul-\nley").replace("markers", "mark­ers").replace("loom", "l​oom"), True),
        (lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in t), True),
        (lambda t: '{"a": "' + "".join(f"\\u{ord(c):04x}" for c in t) + '"}', True),
        (lambda t: " ".join(w if i % 9 else "changed" for i, w in enumerate(t.split())), False),
        (lambda t: t[::-1], False),
        (lambda t: "word " * 50000 + t, True),
    ],
)
def test_passages(change, found):
    m = leakage.Matcher([(1, ITEM), (2, None), (3, "too short")])
    assert any(i == 1 and run >= 12 and d == 0 for i, run, d in m.find(change(ITEM))) is found


def test_one_edit_is_found():
    m = leakage.Matcher([(1, ITEM)])
    twelve = ITEM.split()[2:14]
    for k in range(12):
        changed = list(twelve)
        changed[k] = changed[k][:-1] + "q"
        assert [(i, d) for i, _, d in m.find(" ".join(changed))] == [(1, 1)], changed


def test_myers_equals_scan():
    rng = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rng.choices("ab ", k=rng.randint(1, 9))) for _ in range(2))
        least = min(edit(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert leakage.myers(p, t, 99) == least


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40))), "s") for i in range(20)] + [(3, "repeated", "s"), (77, None, "s")]
    docs = []
    for d in range(150):
        t = rng.choices(vocabulary, k=30)
        if d % 3 == 0:
            own = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(own))
            t[10:10] = own[a : a + rng.randint(8, 16)]
        docs.append((d, " ".join(t), "c"))
    docs += [(500, None, "c"), (501, "", "c"), (502, "!!!", "c")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items[:20] + items[-1:], "item_id long, text string, doc_id string")
    windows = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t, _ in items[:20] for w in [words(t)]}
    want = {(d, i) for d, t, _ in docs if t for w in [words(t)] for i in windows if any(tuple(w[k : k + 12]) in windows[i] for k in range(len(w) - 11))}
    for most, size in ((1000, 0), (6, 1 << 20), (6, 0)):
        got = leakage.leaked_items(df, it, automaton_items=most, hash_bytes=size).where("distance = 0").collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert len(want) > 5 and leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


def test_edited_passages_equal_brute_force(spark):
    rng = random.Random(16)
    vocabulary = ["".join(rng.choices("abcd", k=rng.randint(2, 7))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 20)))) for i in range(12)]
    docs = []
    for d in range(240):
        own = items[rng.randrange(12)][1].split()
        a = rng.randrange(max(1, len(own) - 12))
        passage = list(" ".join(own[a : a + rng.randint(9, 16)]))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", " ", "bc"])
        docs.append((d, f"{' '.join(rng.choices(vocabulary, k=rng.randint(0, 6)))} {''.join(passage)} {' '.join(rng.choices(vocabulary, k=rng.randint(0, 6)))}"))
    want = {}
    for d, t in docs:
        line = f" {' '.join(words(t))} "
        for i, text in items:
            w = words(text)
            least = min((leakage.myers(f" {' '.join(w[k : k + 12])} ", line, 2) for k in range(len(w) - 11)), default=3)
            if least <= 2:
                want[d, i] = least
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (100, 3):
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in leakage.leaked_items(df, it, automaton_items=most).collect()} == want
    assert {0, 1, 2} == set(want.values()) and sum(v > 0 for v in want.values()) > 30


# p10


def test_sentences():
    assert language.sentences(None) == [] and language.sentences("") == [] and language.sentences("1.5 2.5 scene0001_00\nmax_depth=4.0") == []
    assert len(language.sentences('```json\n{"objects": [{"name": "the chair here now", "description": "It is clearly a chair. It was moved."}]}\n```')) == 2
    assert len(language.sentences("对齐之后，水壶偏离了大约28厘米。扫描scene0037_01已经完成。")) == 2
    assert len(language.sentences("One two three four\nfive six seven. Eight nine ten.")) == 2


def test_held_out_sentences(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    own = docs.where("pmod(xxhash64(doc_id), 2) = 0")
    model = language.train(own)
    rest = docs.where("pmod(xxhash64(doc_id), 2) = 1").select(language.label_code(F.col("lang")).alias("c"), "text").where("c is not null and text is not null").collect()
    found = [(r["c"], s) for r in rest for s in [language.segments(model, r["text"])] if len(s) == 1]
    assert len(found) > 200 and sum(c == s[0][1] for c, s in found) / len(found) > 0.88  # about a tenth of the labels are wrong on purpose
    texts = [(1, "en", "The chair was moved. The table is still here in the room."), (2, "en-US", "La silla se ha movido desde la primera grabación. Hay dos objetos en la cocina."), (3, None, "Der Stuhl steht neben dem Fenster. The chair stands next to the window and was seen."), (4, " EN ", None), (5, "xx", " "), (6, "zh", "从第591帧开始，就看不到窗帘了。" * 3000)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, lang string, text string, code int")
    got = [(r["doc_id"], r["seg_no"], r["lang"]) for r in language.mislabelled(language.label_documents(df, model)).orderBy("doc_id", "seg_no").collect()]
    assert got == [(2, 1, "es"), (3, 1, "de"), (3, 2, "en")]
    assert language.label_documents(df.limit(0), model).count() == 0
    assert language.label_documents(df.limit(0)).count() == 0
