import contextlib
import os
import random
import re
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reqloom.llm import abuse, mixing, neardup, packing
from reqloom.llm.grouping import match_groups
from reqloom.llm.neardup import near_groups, near_pairs
from reqloom.llm.typography import collapse_typography, typographic_copies


def _components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = defaultdict(list)
    for x in list(up):
        groups[find(x)].append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_groups(spark):
    rnd = random.Random(1)
    rows = [(f"e{rnd.randrange(300)}", f"e{rnd.randrange(300)}", round(rnd.random(), 4)) for _ in range(400)]
    rows += [(f"c{i}", f"c{i + 1}", 0.6) for i in range(60)] + [("hub", f"h{i}", 0.9) for i in range(200)] + rows[:50] + [(b, a, s) for a, b, s in rows[:50]]
    rows += [(None, "x", 1.0), ("x", None, 1.0), ("x", "y", None), ("z", "z", 1.0), ("p", "q", float("nan")), ("É", "é", 0.7)]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "a string, b string, score double, u string, count long")
    want = _components((a, b) for a, b, s in rows if a and b and a != b and s is not None and s >= 0.6 and s == s)
    assert {r.elem: r.group_elem for r in match_groups(df).collect()} == want
    assert match_groups(df.limit(0)).count() == 0


def test_typography(spark):
    rows = [
        (1, "R-1", "The pump shall stop within 4.5 s."), (2, "r1", "THE PUMP shall 'stop' within 4.5 s"), (3, "R 1", "The pump shall stop within 45 s."),
        (4, "R1", "The pump shall stop with​in 4.5 s…"), (5, "R2", "limit -5"), (6, "R2", "limit 5"), (7, "R2", "limit x-5"), (8, "R2", "limit x5"), (9, "R2", "limit – 5"),
        (10, "F", "A: x; B: y; C: z"), (11, "F", '{"c": "Z", "a": "X", "B": "y"}'), (12, "F", "C = z | A = x | B = y"), (13, "F", "- B: y\n- A: x\n- C: z"), (14, "F", "A: x; B: z; C: y"),
        (15, None, "t"), (16, " ", "t"), (17, "T", None), (18, "T", " "), (19, "P", "..."), (20, "P", "!"), (21, "L", "w " * 5000), (22, "l", "W" * 5000), (23, "R1", "The pump shall stop within 4.5 s."),
    ]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "ord long, id string, text string, count long, key string")
    got = {(r.first_ord, r.copy_ord) for r in typographic_copies(df).collect()}
    assert got == {(1, 2), (1, 4), (1, 23), (6, 9), (7, 8), (10, 11), (10, 12), (10, 13), (19, 20), (21, 22)}
    n = {r.ord: r.n_copies for r in collapse_typography(df).collect()}
    assert n[1] == 4 and n[10] == 4 and n[14] == 1 and 15 not in n
    assert typographic_copies(df.limit(0)).count() == 0


def test_hot_copies(spark):
    df = spark.range(7000).select(F.col("id").alias("ord"), F.when(F.col("id") < 3000, "A").otherwise(F.concat(F.lit("B"), "id")).alias("id"), F.lit("same text").alias("text"))
    assert typographic_copies(df).count() == 2999 and collapse_typography(df).filter("n_copies = 3000 AND ord = 0").count() == 1


def _near(texts):
    sets = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t in texts if t}
    ok = {i: s for i, s in sets.items() if len(s) >= 8}
    ids = sorted(ok)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a] & ok[b]) * 10 >= 7 * len(ok[a] | ok[b])}


def test_near_duplicates_of_one_hot_cluster(spark, monkeypatch):
    """Salted seeds and chunked classes give the same pairs."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 200)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join([*base[: 28 - i % 3], f"x{rnd.randrange(120)}", f"y{i % 4}"])) for i in range(400)]
    texts += [(1000 + i, " ".join(rnd.sample([f"v{k}" for k in range(300)], 20))) for i in range(200)]
    df = spark.createDataFrame(texts, "rec long, text string")
    want = _near(texts)
    got = [(r.rec_a, r.rec_b) for r in near_pairs(df).collect()]
    assert len(got) == len(want) > 50_000 and set(got) == want


@pytest.mark.parametrize("spread", [150, 2])
def test_near_duplicates(spark, spread):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(70)]
    texts, n = [], 0
    for _ in range(60):
        base = rnd.sample(vocab, rnd.randrange(8, 30))
        for _ in range(4):
            t = list(base)
            for _ in range(rnd.randrange(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append((n, " ".join(t)))
            n += 1
    texts += [(1000, None), (1001, ""), (1002, "one two"), (1003, texts[0][1].upper()), (1004, texts[0][1] + "!"), (1005, " ".join(f"z{i}" for i in range(3000))), (1006, " ".join(f"z{i}" for i in range(2900)))]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in texts], "rec long, text string, n int, cls string")
    want = _near(texts)
    assert {(r.rec_a, r.rec_b) for r in near_pairs(df, spread=spread).collect()} == want
    groups = {r.rec: r.group_rec for r in near_groups(df, spread=spread).collect()}
    for x, g in _components(want).items():
        assert groups[x] == g
    assert near_pairs(df.limit(0)).count() == 0


class _Disk:
    """Most bytes of shuffle files and written tables at once beyond those at the start."""

    def __init__(self, spark, folder):
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        self.dirs, self.most, self.over = [folder, *files], 0, threading.Event()
        self.least = self.now()
        self.thread = threading.Thread(target=self.watch)

    def now(self):
        total = 0
        for d in self.dirs:
            for at, _, names in os.walk(d):
                for n in names:
                    with contextlib.suppress(OSError):
                        total += os.path.getsize(os.path.join(at, n))
        return total

    def watch(self):
        while not self.over.wait(0.02):
            self.most = max(self.most, self.now() - self.least)

    def __enter__(self):
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def _alike(n, rnd):
    """Texts of about 33 words, many of them common, and a few near copies."""
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(300)]
    texts = [[*rnd.sample(common, 20), *rnd.sample(rare, 13)] for _ in range(n)]
    for k in range(0, n, 20):
        texts[k] = [*texts[k - 1][:-2], rnd.choice(rare)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_duplicates_take_little_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("reqloom.session.shared_dir", lambda spark: f"file://{tmp_path}")
    texts = _alike(6000, random.Random(11))
    df = spark.createDataFrame(texts, "rec long, text string").repartition(4).localCheckpoint()
    with _Disk(spark, str(tmp_path)) as disk:
        got = near_pairs(df, spread=20).collect()
    assert len(got) >= 250
    assert disk.most < 6 * sum(len(t) for _, t in texts)


def test_near_duplicates_in_several_passes(spark, monkeypatch):
    texts = _alike(600, random.Random(12))
    df = spark.createDataFrame(texts, "rec long, text string")
    passes = []
    count = neardup._passes
    monkeypatch.setattr(neardup, "_passes", lambda *a: passes.append(count(*a)) or passes[-1])
    monkeypatch.setattr(neardup, "PASS_BYTES", 4)
    got = [(r.rec_a, r.rec_b) for r in near_pairs(df, spread=2).collect()]
    assert passes[0] > 2 and len(got) == len(set(got)) and set(got) == _near(texts)


def test_packing_kernel():
    rnd = random.Random(4)
    for _ in range(60):
        cap = rnd.randrange(10, 60)
        sizes = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 40))]
        bins = packing.pack(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins) and len(bins) <= len(packing.best_fit(sizes, cap))
    assert len(packing.best_fit([4, 4, 3, 3, 3, 3], 10)) == 3 and len(packing.pack([4, 4, 3, 3, 3, 3], 10)) == 2


def _least_bins(sizes, cap):
    best = [(99, 0)] * (1 << len(sizes))
    best[0] = (1, 0)
    for m in range(1, 1 << len(sizes)):
        ways = [best[m ^ (1 << i)] + (s,) for i, s in enumerate(sizes) if m >> i & 1]
        best[m] = min((k, f + s) if f + s <= cap else (k + 1, s) for k, f, s in ways)
    return best[-1][0]


def test_packing_is_exact_without_a_bound():
    rnd = random.Random(5)
    for _ in range(150):
        cap = rnd.randrange(8, 60)
        sizes = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 10))]
        bins = packing.pack(sizes, cap, None)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert len(bins) == _least_bins(sizes, cap)
    assert len(packing.pack([7] * 3 + [5, 4, 3] * 50, 10, 0)) == len(packing.best_fit([7] * 3 + [5, 4, 3] * 50, 10))


def test_containers(spark):
    sizes = [(i, s) for i, s in enumerate([5, 100, 1000, 1024, 512, 1, 1, 700, None, 0] + [37] * 300)]
    df = spark.createDataFrame([(i, s, "b") for i, s in sizes], "doc_id long, size long, bin string")
    packs = spark.createDataFrame([("a", 512), ("b", 64), ("n", None), ("z", 0)], "pack_name string, capacity int")
    got = packing.fill_containers(df, packs, group=50).toPandas()
    assert set(got.pack_name) == {"a", "b"}
    for name, cap in (("a", 512), ("b", 64)):
        g = got[got.pack_name == name]
        assert g.groupby("bin_id").n_tokens.sum().max() <= cap
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == {i: s for i, s in sizes if s}
        assert all(len(x) == 1 or dict(sizes)[i] > cap for i, x in g.groupby("doc_id"))
    assert packing.fill_containers(df.limit(0), packs).count() == 0 and packing.fill_containers(df, packs.limit(0)).count() == 0


def test_mixture(spark):
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["x", "x", "x", "y", "z", "other"]), rnd.randrange(1, 60)) for i in range(4000)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, source string, n_tokens long, position int")
    t = spark.createDataFrame([("x", 0.5, 1), ("y", 0.3, 2), ("z", 0.19, 3), ("none", 0.01, 4), (None, None, None)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, t, bucket=100).toPandas()
    size = got.groupby("source").n_tokens.sum()
    for s, share in (("x", 0.5), ("y", 0.3), ("z", 0.19)):
        assert abs(size[s] / size.sum() - share / 0.99) < 0.01
    assert got.groupby(["source", "doc_id"]).size().groupby("source").max().le({"x": 1, "y": 2, "z": 3}.__getitem__("z")).all()
    assert got.position.is_monotonic_increasing and got.position.between(0, 1).all() and not got.duplicated(["doc_id", "use_no"]).any()
    late = got[got.position > 0.5]
    assert late[late.source == "z"].n_tokens.sum() > 0.55 * size["z"]  # what may be repeated more comes later
    rep = {r.source: r for r in mixing.mix_report(df, t.filter("source IS NOT NULL"), mixing.mix(df, t, bucket=100)).collect()}
    assert rep["none"].used_tokens == 0 and rep["y"].most_uses <= 2
    assert mixing.mix(df.limit(0), t).count() == 0
    assert sum(mixing.plan({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 200).values()) == pytest.approx(120)
    # as large as the corpus: the small source is used twice, the others share what it lacks
    assert mixing.plan({"a": 100, "b": 10, "c": 50}, {"a": (0.4, 2), "b": (0.4, 2), "c": (0.2, 3)}) == pytest.approx({"a": 140 * 2 / 3, "b": 20, "c": 140 / 3})


def test_folding():
    words = lambda t: abuse.words_of(abuse.fold(t))
    assert words("v.e.r.m.i.n") == words("vermin") == words("ver​min") == words("VERMIIIIN") == words("v3rm1n")
    assert words("sh*t") == ["<masked>"] and words("шіt") != [] and words("R799 12,5") == ["<code>", "<n>", "<n>"]


def test_classifier_and_swaps():
    rnd = random.Random(8)
    nouns = [f"noun{i}" for i in range(40)]
    calm = ["The {} valve shall open within five seconds.", "Please add the owner of the {} clause here.", "Women and men shall reach the {} without a stool.", "We walked along the {} and found it dusty."]
    bad = ["You are a worthless fool and should leave the {} team.", "All foreigners are dirty liars who ruin the {}.", "Nobody likes you, go and drown in the {}."]
    docs, marks = [], []
    for i in range(600):
        s = [rnd.choice(calm).format(rnd.choice(nouns)) for _ in range(rnd.randrange(1, 8))]
        if i % 6 == 0:
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(bad).format(rnd.choice(nouns)))
        docs.append(" ".join(s))
        marks.append((i % 6 == 0) ^ (rnd.random() < 0.02))
    m = abuse.fit(docs[:450], marks[:450])
    p = m.score(docs[450:]) >= 0.5
    truth = np.array([i % 6 == 0 for i in range(450, 600)])
    assert (p & truth).sum() >= 0.9 * truth.sum() and (p & ~truth).sum() <= 2
    assert m.score(["Refugees and women shall reach the noun1 without a stool.", "", None]).max() < 0.5
    assert abuse.fit([], []).score(["a fucking mess", "calm words"]).tolist()[1] < 0.5


def test_the_penalty_keeps_neutral_mentions_of_groups_low():
    rnd = random.Random(9)
    things = [f"thing{i}" for i in range(40)]
    docs, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        s = [f"The {rnd.choice(things)} shall open within five seconds."] * 2
        if bad:  # in these labels a group is named in marked documents only
            s.append(rnd.choice(["All foreigners are dirty liars.", "Those foreigners ruin everything here.", "Send the foreigners away at once."]))
        docs.append(" ".join(s))
        marks.append(bad)
    neutral = ["Foreigners reach the platform.", "The ramp helps foreigners daily.", "Signs for foreigners near thing1."]
    plain, fair = (abuse.fit(docs, marks, swap=w) for w in (0.0, abuse.SWAP))
    swapped = [t.replace("Foreigners", "Pensioners").replace("foreigners", "pensioners") for t in neutral]
    gap = lambda m: np.abs(m.score(neutral) - m.score(swapped)).max()
    assert gap(fair) < 0.25 * gap(plain) and fair.score(neutral).max() < plain.score(neutral).max()
    assert fair.score(["All foreigners are dirty liars."])[0] >= 0.5


def test_scores_by_running_sums_equal_scores_of_passages():
    rnd = random.Random(10)
    m = abuse.AbuseModel(np.array([rnd.uniform(-1, 1) for _ in range(2000)] * (abuse.DIMENSIONS // 2000 + 1))[: abuse.DIMENSIONS], -0.3)
    texts = [" ".join(rnd.choice(["a", "bb", "c3", "dd.", "ee!\n", "f-g"]) for _ in range(rnd.randrange(0, 60))) for _ in range(50)] + [None, "", "...", "x"]
    for t, got in zip(texts, m.score(texts), strict=True):
        many = abuse.passages(t) if t else []
        cols, rows = abuse._Hasher().rows(many)
        want = max(1 / (1 + np.exp(-(np.bincount(rows, m.w[cols], len(many)) + m.b)))) if many else 0
        assert got == pytest.approx(want)


def test_scores(spark):
    docs = spark.createDataFrame([(1, " Forum ", "you fucking wanker", 9), (2, None, None, 9), (3, "forum", "", 9)], "doc_id long, source string, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, reviewer string, abusive int, hateful int, sexual int")
    got = {r.doc_id: r for r in abuse.abuse_scores(docs, labels).collect()}
    assert got[1].score > 0.5 and got[2].score == got[3].score == 0 and got[1].source == "forum"
    assert Counter(r.n_flagged for r in abuse.abuse_report(abuse.abuse_scores(docs, labels)).collect()) == Counter([1, 0])


def test_all_labelled_documents_count(spark):
    """Those last by hash of the id too, of more than 20,000: only they hold some of the abuse."""
    calm = F.concat(F.lit("The valve shall open within "), F.col("doc_id") % 50, F.lit(" seconds. Please add the owner."))
    n = 21_500
    place = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("place", place)
    bad = F.when((F.col("place") > n - 1000) & (F.col("place") % 3 == 0), " You are a zorgle blarg.").when(F.col("place") % 40 == 0, " Nobody likes you, go and drown.").otherwise("")
    docs = docs.select("doc_id", F.lit("f").alias("source"), F.concat(calm, bad).alias("text"), (bad != "").cast("int").alias("hit")).localCheckpoint()
    labels = docs.select("doc_id", F.lit("r").alias("reviewer"), F.col("hit").alias("abusive"), F.lit(0).alias("hateful"), F.lit(0).alias("sexual"))
    got = abuse.abuse_scores(docs, labels).join(docs, "doc_id")
    wrong = got.filter((F.col("score") >= abuse.THRESHOLD) != (F.col("hit") == 1))
    assert wrong.count() == 0 and got.count() == n


def test_far_and_near_blocks_give_the_same_scores(spark, monkeypatch):
    rnd = random.Random(13)
    texts = []
    for i in range(400):
        s = [f"The thing{rnd.randrange(30)} shall help women daily."] * 2
        if i % 5 == 0:
            s.append(rnd.choice(["All foreigners are dirty liars.", "Nobody likes you, go and drown."]))
        texts.append(" ".join(s))
    docs = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, "r", int(i % 5 == 0), 0, 0) for i in range(400)], "doc_id long, reviewer string, abusive int, hateful int, sexual int")
    rates = []
    shift = abuse.AbuseModel.shift_for
    monkeypatch.setattr(abuse.AbuseModel, "shift_for", lambda self, rate: rates.append(rate) or shift(self, rate))
    monkeypatch.setattr(abuse, "BLOCK_CHARS", 2000)
    near = abuse.abuse_scores(docs, labels).toPandas().set_index("doc_id").score.sort_index()
    monkeypatch.setattr(abuse, "LOCAL_BYTES", 0)
    far = abuse.abuse_scores(docs, labels).toPandas().set_index("doc_id").score.sort_index()
    assert np.allclose(near, far) and rates == [0.2, 0.2]
    assert ((near >= 0.5) == (near.index % 5 == 0)).all()
    assert abuse._terms(spark.createDataFrame([([" ".join(p) for p in abuse.passages(t)],) for t in texts], "passages array<string>")) == sorted(
        abuse._group_terms([p for t in texts for p in abuse.passages(t)], abuse._known_terms())
    )


def test_mixture_of_long_documents(spark):
    docs = [(1, "x", 1500), (2, "x", 2000), (3, "x", 2208), (4, "y", 5000), (5, "y", 600), (6, "y", 90_000), (7, "z", 40_000), (8, "z", 70_000)] + [(100 + i, "s", 55) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([(s, 0.25, 1) for s in "xyzs"], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, t, total=22_000, bucket=10).toPandas()  # 5500 tokens wanted of each
    assert set(got[got.source == "x"].doc_id) == {1, 2, 3} and set(got[got.source == "y"].doc_id) == {4, 5}
    assert len(got[got.source == "s"]) == 100 and not len(got[got.source == "z"])  # not half of either is wanted
    assert got.position.between(0, 1).all()


def test_abuse_batches_are_taken_in_slices():
    import pyarrow as pa

    from reqloom.llm import abuse

    texts = ["x" * 400_000] * 5 + ["", None, "y"]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[t, None] if t else None for t in texts])], names=["text", "passages"])
    for c in ("text", "passages"):
        got = list(abuse._slices(iter([b, b.slice(0, 0), b.slice(4)]), c))
        assert [t for x in got for t in x.column(0).to_pylist()] == texts + texts[4:]
        assert len(got) >= 4 and max(sum(len(t or "") for t in x.column(0).to_pylist()) for x in got) <= abuse.BLOCK_CHARS + 400_000
