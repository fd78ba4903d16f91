import random

import numpy as np
from pyspark.sql import functions as F

from reqloom.operators.hierarchy import CYCLE, hierarchy, walk
from reqloom.operators.orphans import orphan_references, orphan_report, probe

REL = "ord long, source_id string, target_id string, rel_type string, count long, label string"


def _relations(spark, pairs):
    return spark.createDataFrame([(i, a, b, t, 1, "x") for i, (a, b, t) in enumerate(pairs)], REL)


def _brute(edges):
    edges = set(edges)
    nodes = {x for e in edges for x in e}
    kids = {n: sorted(b for a, b in edges if a == n) for n in nodes}

    def reach(n):
        seen, todo = set(), list(kids[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        return seen

    below = {n: reach(n) for n in nodes}
    ring = {n for n in nodes if n in below[n]}
    bad = ring | {x for n in ring for x in below[n]}
    rows = {(n, CYCLE) for n in bad}
    todo = [(n, n) for n in nodes if not any(b == n for _, b in edges)]
    while todo:
        n, p = todo.pop()
        rows.add((n, p))
        todo += [(k, f"{p}/{k}") for k in kids[n] if k not in bad]
    return rows, {(n, x) for n in nodes for x in below[n] if x != n}, ring


def test_hierarchies_against_brute_force(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(55)] + [("a", "b"), ("b", "c"), ("a", "c"), ("s", "s"), ("r1", "r2"), ("r2", "r1"), ("r2", "t")]
    dirty = [(f" {a} ", b, " Composition") for a, b in edges] + [(a, b, "composition") for a, b in edges[:20]]
    dirty += [(None, "x", "composition"), ("x", " ", "composition"), ("x", "y", None), ("x", "y", "trace")]
    rel = _relations(spark, dirty)
    paths, pairs, ring = _brute(edges)
    for limit in (1000, 0):  # co-located, and level by level
        got = hierarchy(rel, limit=limit).collect()
        assert sorted((r.node_id, r.path) for r in got) == sorted(paths)
        assert all(r.path == CYCLE or (r.depth == r.path.count("/") and r.root == r.path.split("/")[0]) for r in got)
        assert {(r.node_id, r.descendant) for r in hierarchy(rel, "descendants", limit=limit).collect()} == pairs
        closing = {(r.node_id, r.closes_to) for r in hierarchy(rel, "rings", limit=limit).collect()}
        assert {a for a, _ in closing} <= ring and bool(closing) == bool(ring)
    assert hierarchy(rel.limit(0)).count() == 0


def test_deep_chain():
    edges = [(str(i), str(i + 1)) for i in range(5000)]
    kids, roots, ring, back, below = walk(edges)
    assert roots == ["0"] and not ring and not back and not below and len(kids) == 5001


def test_probe():
    keys = np.array(["a", "a", "a", "c"], object)
    starts, ends = np.array([0, 10, 20, 5]), np.array([5, 15, 99, 50])
    ask = [("a", 3), ("a", 7), ("a", 12), ("a", 50), ("b", 9), ("c", 4), ("c", 49), ("z", 1)]
    got = probe(keys, starts, ends, np.array([k for k, _ in ask], object), np.array([t for _, t in ask]))
    assert got.tolist() == [True, False, True, True, False, False, True, False]


def test_orphans_against_brute_force(spark):
    rnd = random.Random(5)
    parents = [(f"k{rnd.randrange(40)}", rnd.randrange(100), rnd.choice([None, rnd.randrange(100, 200)])) for _ in range(120)] + [(None, 1, None), ("k1", None, None)] + [("hot", i, i + 1) for i in range(60)]
    refs = [(i, rnd.choice(["s", "t"]), "hot" if i % 3 == 0 else f"k{rnd.randrange(60)}", rnd.randrange(220)) for i in range(900)] + [(2000, "s", None, 5), (2001, "s", "k1", None)]
    p = spark.createDataFrame([(*x, "e") for x in parents], "key string, start long, until long, rng string")
    r = spark.createDataFrame([(*x, "e") for x in refs], "ref_id long, ref_field string, key string, at long, kind string")

    def holds(k, t):
        return any(a == k and s is not None and s <= t and (e is None or e > t) for a, s, e in parents)

    want = sorted((i, f) for i, f, k, t in refs if k is not None and t is not None and not holds(k, t))
    for chunk, salt in ((7, 25), (50_000, 200_000)):
        got = orphan_references(r, p, chunk=chunk, per_salt=salt).collect()
        assert sorted((x.ref_id, x.ref_field) for x in got) == want
    assert sum(x.n_references for x in orphan_report(r, p).collect()) == len(want)
    assert orphan_references(r, p.limit(0)).count() == 900 and orphan_references(r.limit(0), p).count() == 0


def test_lookup_join_with_hot_keys(spark):
    from reqloom.operators.skew import find_hot, lookup_join
    from reqloom.session import Scratch

    rows = spark.range(6000).select(F.when(F.col("id") < 4000, "h").when(F.col("id") < 4010, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    dim = rows.select("k").distinct().filter("k IS NOT NULL").withColumn("v", F.length("k"))
    hot = find_hot(Scratch(spark, "t"), rows.groupBy("k").count(), "k", 6000)
    assert [r.k for r in hot.collect()] == ["h"]
    assert lookup_join(rows, dim, "k", hot).count() == 5990 and lookup_join(rows, dim, "k", hot, "left").count() == 6000


def test_rings_do_not_depend_on_size(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "m"), ("m", "n"), ("n", "x"), ("x", "y"), ("y", "x"), ("r", "a"), ("y", "z"), ("s", "s"), ("z", "s"), ("n", "k"), ("k", "k2"), ("k2", "k")]
    rel = _relations(spark, [(a, b, "composition") for a, b in edges])
    want = {("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "y"), ("y", "x"), ("s", "s"), ("k", "k2"), ("k2", "k")}
    for limit in (1000, 0):
        got = [(r.node_id, r.closes_to) for r in hierarchy(rel, "rings", limit=limit).collect()]
        assert len(got) == len(want) and set(got) == want
