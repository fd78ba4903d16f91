"""Similarity of phrases and vectors, and joins on it that never meet all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators import setjoin


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)



def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching characters of two phrases, the first one first."""

    @F.pandas_udf("double")
    def ratio(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(xs, ys, strict=True)], dtype=float)

    return ratio(a, b)


def lexical(a: Column, b: Column) -> Column:
    """The larger of token Jaccard and character ratio of two normalised phrases."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    return F.greatest(jaccard(tokens(a), tokens(b)), sequence_ratio(a, b))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = False) -> DataFrame:
    """(role, x, y, score): pairs of ``left`` (role, x, tokens) and ``right`` (role, y, tokens) with Jaccard >= threshold.

    Exact for thresholds above 0, see ``setjoin``; both sides are read once. Empty sets match nothing; several sets of
    one x or y each have pairs of their own. ``ordered``: both sides are the same sets, only x < y, and only ``left`` is
    read.
    """
    return setjoin.joined(left, None if ordered else right, threshold)


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Phrases of one side that meet in one task.
BLOCK = 500


def _codes(texts: list[str]) -> np.ndarray:
    """One row of character codes per phrase, filled up with a code that no phrase has."""
    out = np.full((len(texts), max(map(len, texts), default=0)), len(_LETTERS), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = [_LETTERS.index(c) for c in t]
    return out


def common_length(codes: np.ndarray, y: str) -> np.ndarray:
    """Length of the longest common subsequence of ``y`` and each row of codes, by bit vectors."""
    n, words = len(codes), -(-len(y) // 64)
    masks = np.zeros((words, len(_LETTERS) + 1), np.uint64)
    for j, c in enumerate(y):
        masks[j // 64, _LETTERS.index(c)] |= np.uint64(1 << (j % 64))
    v = np.full((words, n), ~np.uint64(0))
    for c in codes.T:
        carry = None
        for w in range(words):
            m = masks[w][c]
            up = v[w] + (v[w] & m)
            over = up < v[w]
            if carry is not None:
                up = up + carry
                over |= up < carry
            carry = over.astype(np.uint64)
            v[w] = up | (v[w] & ~m)
    for w in range(words):
        if len(y) < 64 * (w + 1):
            v[w] |= ~np.uint64((1 << (len(y) - 64 * w)) - 1)
    return np.bitwise_count(~v).sum(axis=0, dtype=np.int64) if words else np.zeros(n, np.int64)


def ratio_from(pair: SequenceMatcher, least: float) -> float:
    """The ratio of a matcher's two phrases, 0 if below ``least``; ends as soon as what is left cannot reach it."""
    n, m = len(pair.a), len(pair.b)
    need, most, found, todo = least * (n + m) / 2 - 1e-6, min(n, m), 0, [(0, n, 0, m)]
    while todo and most >= need:
        a, b, c, d = todo.pop()
        i, j, k = pair.find_longest_match(a, b, c, d)
        before, after = min(i - a, j - c), min(b - i - k, d - j - k)
        most -= min(b - a, d - c)
        if k:
            found += k
            most += k + before + after
            if before:
                todo.append((a, i, c, j))
            if after:
                todo.append((i + k, b, j + k, d))
    return 2.0 * found / (n + m) if most >= need else 0.0


def alike_characters(xs: list[str], ys: list[str], threshold: float, ordered: bool = False):
    """(i, j, ratio) of all pairs with a character ratio >= threshold.

    The matching blocks are a common subsequence, which has no more of a character than either phrase; pairs that are
    too far apart by length, characters or longest common subsequence are left out first, which loses none. ``ordered``:
    only x < y, with the larger ratio of both directions.
    """
    if not xs or not ys:
        return
    codes = _codes(xs)
    size = (codes < len(_LETTERS)).sum(axis=1)
    count = np.stack([(codes == k).sum(axis=1) for k in range(len(_LETTERS))], axis=1).astype(np.int16)
    names = np.array(xs, object)
    back = {}
    for j, y in enumerate(ys):
        if not y:
            continue
        need = (size + len(y)) * (threshold / 2) - 1e-6
        at = np.flatnonzero((np.minimum(size, len(y)) >= need) & (size > 0))
        if ordered:
            at = at[names[at] < y]
        mine = np.array([y.count(c) for c in _LETTERS], np.int16)
        at = at[np.minimum(count[at], mine).sum(axis=1) >= need[at]]
        if not len(at):
            continue
        at = at[common_length(codes[at, : size[at].max()], y) >= need[at]]
        if not len(at):
            continue
        forth = SequenceMatcher(None, "", y)
        for i in at.tolist():
            forth.set_seq1(xs[i])
            r = ratio_from(forth, threshold)
            if ordered:
                if i not in back:
                    back[i] = SequenceMatcher(None, "", xs[i])
                back[i].set_seq1(y)
                r = max(r, ratio_from(back[i], threshold))
            if r >= threshold:
                yield i, j, r


def similar_phrases(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = False, block: int = BLOCK) -> DataFrame:
    """(role, x, y, score): pairs of ``left`` (role, x, tokens) and ``right`` (role, y, tokens) with score >= threshold.

    The score is the larger of Jaccard and character ratio; x and y are normalised phrases in their own order, distinct
    by role. Those alike by tokens come from ``similar_sets``. No index is exact for the ratio, so those alike by
    characters are sought in a grid of blocks, each pair of blocks in one task. ``ordered`` as in ``alike_characters``.
    """
    n, m = (max(1, -(-side.count() // block)) for side in (left, right))
    cell = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = left.select("role", "x", cell("x", n).alias("i")).withColumn("j", every(m))
    b = right.select("role", "y", cell("y", m).alias("j")).withColumn("i", every(n))
    if ordered:  # both sides are the same phrases; a pair of cells is met once
        a, b = a.filter("i <= j"), b.filter("i <= j")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            role, xs, ys = x["role"].iloc[0], x["x"].tolist(), y["y"].tolist()
            turned = ordered and x["i"].iloc[0] != x["j"].iloc[0]
            out = [(role, xs[i], ys[j], r) for i, j, r in alike_characters(xs, ys, threshold, ordered)]
            if turned:
                out += [(role, ys[i], xs[j], r) for i, j, r in alike_characters(ys, xs, threshold, ordered)]
        return pd.DataFrame(out, columns=["role", "x", "y", "ratio"])

    chars = a.groupBy("role", "i", "j").cogroup(b.groupBy("role", "i", "j")).applyInPandas(meet, "role string, x string, y string, ratio double")
    words = lambda c: F.array_distinct(F.split(c, " "))
    chars = chars.select("role", "x", "y", F.greatest(jaccard(words(F.col("x")), words(F.col("y"))), "ratio").alias("score"))
    sets = similar_sets(left, right, threshold, ordered)
    ratio = sequence_ratio(F.col("x"), F.col("y"))
    if ordered:
        ratio = F.greatest(ratio, sequence_ratio(F.col("y"), F.col("x")))
    return chars.unionByName(sets.withColumn("_r", ratio).filter(F.col("_r") < threshold).drop("_r"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(c: Column) -> Column:
    """The vector at length 1; one of length 0 as it is."""
    n = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def similar_vectors(vectors: DataFrame, threshold: float, pivots: int = 2, differ: str | None = None) -> DataFrame:
    """(a, b, score), a < b: pairs of ``vectors`` (id, v) with cosine >= threshold, where ``differ`` differs if given.

    Vectors within an angle of each other lie in the same or neighbouring rings of that width around any pivot, so they
    are joined on their rings (exact for thresholds above 0). The pivots are a few axis directions.
    """
    import math

    width = math.acos(min(1.0, threshold)) + 1e-6
    u = vectors.withColumn("v", unit(F.col("v")))
    for k in range(pivots):
        u = u.withColumn(f"r{k}", F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.get("v", F.lit(k)), F.lit(0.0))))) / width))
    rings = [f"r{k}" for k in range(pivots)]
    extra = [differ] if differ else []
    b = u.select(F.col("id").alias("b"), F.col("v").alias("vb"), *(F.col(d).alias("_d") for d in extra), *rings)
    for r in rings:
        b = b.withColumn(r, F.explode(F.array(F.col(r) - 1, F.col(r), F.col(r) + 1)))
    on = u.select(F.col("id").alias("a"), F.col("v").alias("va"), *extra, *rings).join(b, rings).filter("a < b")
    if differ:
        on = on.filter(F.col(differ) != F.col("_d"))
    return on.select("a", "b", dot(F.col("va"), F.col("vb")).alias("score")).filter(F.col("score") >= threshold)


def scorer(name: str):
    """The similarity join of that name: "jaccard" by token sets, "lexical" by the larger of that and character ratio.

    Both take (left, right, threshold) with phrases (role, x or y, tokens) and give (role, x, y, score). Vectors have a
    join of their own, ``similar_vectors``. An unknown name is an error.
    """
    known = {"jaccard": similar_sets, "lexical": similar_phrases}
    if name not in known:
        raise ValueError(f"unknown similarity {name!r}; known: {', '.join(known)}")
    return known[name]
