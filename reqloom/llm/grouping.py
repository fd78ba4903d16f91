"""Problem 1: pairwise matches to groups, by low-diameter decomposition.

Every vertex draws an exponentially distributed shift; clusters grow hop by hop from the vertices with the largest
shifts, a vertex going to the cluster that reaches it first. Clusters are then contracted to super-vertices, edges
between different clusters (duplicates removed) form the next, much smaller graph, and so on until no edge is left or the rest
is small enough for one task, where it is contracted at once. The assignments of all levels are composed from the top
down, so each is joined once.

A vertex is only ever given a centre from its own component, so any number of growth rounds is safe; few rounds and
small rates give few levels. Vertices are 64-bit hashes of the element names, used only after it is checked that no
two names share one; else the names themselves are used.

Skew: an element or cluster with at least a thousandth of all edges is hot. There are at most 1000 of these; their
states are broadcast, and their edges stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reqloom.operators.skew import cold_part, find_hot, hot_part, lookup_join
from reqloom.session import Scratch

DEFAULT_THRESHOLD = 0.6
ROUNDS = 3
RATE = 0.25
#: Contracted graphs of at most so many edges (two 64-bit numbers each) are finished in one task.
SMALL = 50_000


def links(connections: DataFrame, threshold: float = DEFAULT_THRESHOLD, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """Distinct unordered links (a, b) with a < b; rows with a null end or score, loops and low scores link nothing."""
    x, y = F.col(a), F.col(b)
    ok = (F.col(score) >= threshold) & ~F.isnan(score) & (x != y)
    return connections.filter(ok).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _start(v: Column, rate: float, seed: int) -> Column:
    """Start time: minus an exponential shift of the given rate, fixed by vertex and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(seed)), 11) + F.lit(1)) / F.lit(float(2**53 + 2))
    return F.log(u) / F.lit(rate)


def _level(scratch: Scratch, edges: DataFrame, level: int, rounds: int, rate: float) -> tuple[DataFrame, DataFrame]:
    """One decomposition: (vertex, centre) and the edges between clusters. ``edges``: distinct (u, v), u < v."""
    spark = scratch.spark
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = scratch.put(both.groupBy("u").count(), "degree")
    hot = find_hot(scratch, degree, "u", 2 * edges.count())

    cold = cold_part(both, "u", hot).repartition(parts, "u").persist(StorageLevel.MEMORY_AND_DISK)
    state = degree.select(F.col("u").alias("x"), _start(F.col("u"), rate, level).alias("t"), F.col("u").alias("c"))
    moved = (F.col("v").alias("x"), (F.col("t") + 1).alias("t"), "c")
    for _ in range(rounds):
        sent = cold.join(state, F.col("u") == F.col("x")).select(*moved)
        if hot is not None:
            hot_state = F.broadcast(hot_part(state, "x", hot))
            sent = sent.unionByName(hot_part(both, "u", hot).join(hot_state, F.col("u") == F.col("x")).select(*moved))
        # two plain columns aggregate by hash, a struct would be sorted; written, as the next round reads it three times
        new = scratch.put(sent.unionByName(state).groupBy("x").agg(F.min_by("c", "t").alias("c"), F.min("t").alias("t")), "state")
        scratch.drop(state)
        state = new
    centre = state.select("x", "c")
    centre._scratch_path = state._scratch_path
    cold.unpersist()

    half = lookup_join(edges.withColumnRenamed("u", "x"), centre, "x", hot).select(F.col("c").alias("cu"), F.col("v").alias("x"))
    full = lookup_join(half.distinct(), centre, "x", hot).filter("cu <> c")
    rest = scratch.put(full.select(F.least("cu", "c").alias("u"), F.greatest("cu", "c").alias("v")).distinct(), "edges")
    scratch.drop(degree, hot)
    return centre, rest


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one task to (x, c), c the least vertex of x's component: labels fall along edges, then halve."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    ends = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in (0, 1)]
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        # a vertex and the one it points to both take the least label met
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["x", "c"])


def components(scratch: Scratch, edges: DataFrame, rounds: int = ROUNDS, rate: float = RATE, small: int = SMALL) -> DataFrame:
    """(x, c): every vertex of ``edges`` (u, v distinct, u < v; written) with one vertex of its component.

    Only a contracted graph (never the first one) is finished in one task, and only vertices that are numbers.
    """
    levels = []
    while not edges.isEmpty():
        if levels and dict(edges.dtypes)["u"] == "bigint" and edges.count() <= small:
            levels.append(scratch.put(edges.select("u", "v").coalesce(1).mapInArrow(_contract, "x long, c long"), "centre"))
            break
        centre, rest = _level(scratch, edges, len(levels), rounds, rate / 2 ** len(levels))
        if levels:
            scratch.drop(edges)
        levels.append(centre)
        edges = rest
    if not levels:
        return edges.select(F.col("u").alias("x"), F.col("v").alias("c"))
    top = levels[-1]
    for below in reversed(levels[:-1]):
        hot = find_hot(scratch, below.groupBy("c").count(), "c", below.count())
        up = top.select(F.col("x").alias("c"), F.col("c").alias("root"))
        joined = lookup_join(below, up, "c", hot, "left").select("x", F.coalesce("root", "c").alias("c"))
        new = scratch.put(joined, "composed")
        scratch.drop(top, below, hot)
        top = new
    return top


def match_groups(connections: DataFrame, threshold: float = DEFAULT_THRESHOLD, rounds: int = ROUNDS, rate: float = RATE, **columns: str) -> DataFrame:
    """(elem, group_elem): every element with a link, with the least element (byte order) of its group.

    Nulls in ``a``, ``b`` or ``score``, self-pairs and pairs below the threshold link nothing; repeated and reversed
    pairs count once; no link at all gives an empty result; other columns are not read.
    """
    spark: SparkSession = connections.sparkSession
    scratch = Scratch(spark, "groups")
    pairs = scratch.put(links(connections, threshold, **columns), "links")
    names = scratch.put(pairs.select(F.col("a").alias("elem")).union(pairs.select("b")).distinct().select("elem", F.xxhash64("elem").alias("x")), "names")
    clash = names.groupBy("x").count().filter("count > 1")
    if clash.isEmpty():
        ends = F.xxhash64("a"), F.xxhash64("b")
    else:
        names, ends = names.select("elem", F.col("elem").alias("x")), (F.col("a"), F.col("b"))
    edges = scratch.put(pairs.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")), "edges")
    scratch.drop(pairs)
    comp = components(scratch, edges, rounds, rate)
    rooted = scratch.put(names.join(comp, "x").select("elem", "c"), "rooted")
    least = scratch.put(rooted.groupBy("c").agg(F.min("elem").alias("group_elem"), F.count(F.lit(1)).alias("count")), "least")
    hot = find_hot(scratch, least, "c", rooted.count())
    scratch.drop(edges, comp)
    return lookup_join(rooted, least.select("c", "group_elem"), "c", hot).select("elem", "group_elem")
