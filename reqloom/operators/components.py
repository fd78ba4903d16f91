"""Weakly connected components of directed edges, for co-locating hierarchies.

Each level gives every vertex that has a parent (on odd levels: a child) one of them as its pointer, doubles the
pointers, and contracts every vertex to the end it reached, or to the least vertex it passed where no end came into
reach (deep chains, rings). Edges between different labels, without repeats, go on to the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.operators.skew import find_hot, lookup_join
from reqloom.session import Scratch

DOUBLINGS = 8


def _pointers(scratch: Scratch, edges: DataFrame, up: bool) -> DataFrame:
    """(x, label) for every vertex of ``edges`` (p, c)."""
    here, there = ("c", "p") if up else ("p", "c")
    ends = edges.select(F.col("p").alias("x")).union(edges.select("c")).distinct()
    chosen = edges.groupBy(F.col(here).alias("x")).agg(F.min(there).alias("to"))
    # "end": the pointer leads to a vertex without a pointer of its own
    state = scratch.put(ends.join(chosen, "x", "left").select("x", F.coalesce("to", "x").alias("to"), F.col("to").isNull().alias("end"), F.least("x", F.coalesce("to", "x")).alias("low")), "pointers")
    for _ in range(DOUBLINGS):
        open_ = state.filter("not end")
        if open_.isEmpty():
            break
        nxt = state.select(F.col("x").alias("to"), F.col("to").alias("to2"), F.col("end").alias("end2"), F.col("low").alias("low2"))
        went = open_.join(nxt, "to").select("x", F.col("to2").alias("to"), F.col("end2").alias("end"), F.least("low", "low2").alias("low"))
        new = scratch.put(state.filter("end").unionByName(went), "pointers")
        scratch.drop(state)
        state = new
    return state.select("x", F.when(F.col("end"), F.col("to")).otherwise(F.col("low")).alias("label"))


def component_labels(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(x, label): every vertex of the written ``edges`` (p, c) with one vertex of its component."""
    edges = edges.filter("p <> c")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        label = scratch.put(_pointers(scratch, edges, len(levels) % 2 == 0), "label")
        hot = find_hot(scratch, edges.select(F.explode(F.array("p", "c")).alias("x")).groupBy("x").count(), "x", 2 * edges.count())
        a = lookup_join(edges.withColumnRenamed("p", "x"), label, "x", hot).select(F.col("label").alias("lp"), F.col("c").alias("x"))
        b = lookup_join(a, label, "x", hot).select(F.col("lp").alias("p"), F.col("label").alias("c"))
        edges = scratch.put(b.filter("p <> c").distinct(), "edges")
        levels.append(label)
    if not levels:
        return edges.select(F.col("p").alias("x"), F.col("c").alias("label"))
    top = levels[-1]
    for below in reversed(levels[:-1]):
        hot = find_hot(scratch, below.groupBy("label").count(), "label", below.count())
        up = top.select(F.col("x").alias("label"), F.col("label").alias("root"))
        top = scratch.put(lookup_join(below, up, "label", hot, "left").select("x", F.coalesce("root", "label").alias("label")), "composed")
    return top
