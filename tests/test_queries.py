"""A choice of registered queries against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ["q_flat_table", "q_gate", "q_dedup_pairs", "q_rvtm"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple("" if x is None else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r)
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(key(r) for r in got.select(*names).collect()) == sorted(map(key, want.fetchall()))


def test_vectors_and_sets(spark):
    from reqloom.operators.similarity import similar_sets, similar_vectors

    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0])], "id long, v array<float>")
    assert [(r.a, r.b) for r in similar_vectors(v, 0.9).collect()] == [(1, 2)]
    s = spark.createDataFrame([("r", "a b c", ["a", "b", "c"]), ("r", "a b", ["a", "b"]), ("r", "z", ["z"]), ("q", "a b", ["a", "b"])], "role string, x string, tokens array<string>")
    got = similar_sets(s, s.withColumnRenamed("x", "y"), 0.6).filter("x < y").collect()
    assert [(r.x, r.y) for r in got] == [("a b", "a b c")]


def test_streaming(spark, tmp_path):
    from reqloom.streaming.statements import enrich_stream

    spark.createDataFrame([(1, "R", "The pump shall stop.")], "ord long, id string, text string").write.parquet(str(tmp_path / "in"))
    q = enrich_stream(spark.readStream.schema("ord long, id string, text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("flat").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("flat").first().subject == "The pump"


def test_phrases_alike_by_characters(spark):
    import random
    from difflib import SequenceMatcher

    from reqloom.operators.similarity import similar_phrases

    rnd = random.Random(7)
    base = ["controller", "pump", "the valve of the main pump", "pressure sensor " * 6, "control unit 7", "a " * 130]
    texts = {"controller", "controllers", "unit control", "control unit", "pump pump valve", "valve pump"}
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rnd.randrange(1, 6)):
                t[rnd.randrange(len(t))] = rnd.choice("aeit ")
            texts.add(" ".join("".join(t).split()))
    texts.discard("")

    def score(x, y):
        a, b = set(x.split()), set(y.split())
        return max(len(a & b) / len(a | b), SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio())

    want = {(x, y): score(x, y) for x in texts for y in texts if x < y and score(x, y) >= 0.6}
    s = spark.createDataFrame([("r", t, sorted(set(t.split()))) for t in sorted(texts)], "role string, x string, tokens array<string>")
    for block in (1000, 20):
        got = similar_phrases(s, s.withColumnRenamed("x", "y"), 0.6, ordered=True, block=block).collect()
        assert len(got) == len(want) and {(r.x, r.y): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert ("controller", "controllers") in want and ("control unit", "unit control") in want


def test_parse_many_keeps_texts_without_id(spark, tmp_path):
    rows = [(1, "R", "The pump shall stop."), (2, None, "The valve shall close the inlet.")]
    spark.createDataFrame(rows, "ord long, id string, text string").write.parquet(str(tmp_path / "sample_reqs.parquet"))
    got = entry.queries()["q_parse_many"](spark, str(tmp_path)).collect()
    assert {r.ord for r in got} == {1, 2} and {r.text for r in got if r.ord == 2 and r.role == "SUBJECT"} == {"The valve"}


def test_similar_sets_find_all_pairs(spark, monkeypatch):
    import random

    from reqloom.operators import setjoin
    from reqloom.operators.similarity import similar_sets

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    sets = [("q" if i % 3 else "r", f"k{i:03d}", rnd.sample(words, rnd.choice((1, 2, 3, 4, 6, 9, 13)))) for i in range(150)]
    sets += [("r", "k000", rnd.sample(words, 5)), ("r", "many", [f"v{i}" for i in range(30)]), ("r", "many2", [f"v{i}" for i in range(29)]), ("r", "none", []), ("r", "null", None), (None, "k", words)]
    s = spark.createDataFrame(sets, "role string, x string, tokens array<string>")

    def want(t, pair):
        out = []
        for p, x, a in sets:
            for q, y, b in sets:
                if p and p == q and a and b and pair(x, y) and len({*a} & {*b}) / len({*a} | {*b}) >= t:
                    out.append((p, x, y, round(len({*a} & {*b}) / len({*a} | {*b}), 9)))
        return sorted(out)

    key = lambda df: sorted((r.role, r.x, r.y, round(r.score, 9)) for r in df.collect())
    for t in (0.6, 0.4):
        assert key(similar_sets(s, s.withColumnRenamed("x", "y"), t)) == want(t, lambda x, y: True)  # k000 has two sets in one role
    for wide in (2, 1000):
        assert key(setjoin.joined(s, None, 0.6, wide)) == want(0.6, lambda x, y: x < y)
    monkeypatch.setattr(setjoin, "PASS_FACTOR", 0.01)
    monkeypatch.setattr(setjoin, "PASS_LEAST", 100_000)  # several passes
    assert key(setjoin.joined(s, None, 0.6, 30)) == want(0.6, lambda x, y: x < y)
    monkeypatch.setattr(setjoin, "KNOWN", 5)
    assert key(setjoin.joined(s, None, 0.6, 30)) == want(0.6, lambda x, y: x < y)
    assert key(similar_sets(s, s.limit(0).withColumnRenamed("x", "y"), 0.6)) == []
