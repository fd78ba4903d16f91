"""Problem 5: parent-child links to full hierarchies.

Connected components are found first, each is co-located in one partition, and an iterative depth-first traversal with
node colouring walks it: white nodes are new, grey ones lie on the current way, an edge to a grey node closes a ring.
A task holds one component at a time, and only components up to ``limit`` edges go this way; larger ones are peeled
level by level with joins, so none is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators.components import component_labels
from reqloom.session import Scratch

#: Components with more edges than this are not co-located.
LIMIT = 200_000
CYCLE = "(cycle)"
_ROWS = 20_000
_SPACE = " \t\r\n"


def clean_id(c: Column) -> Column:
    """The id without the spaces around it; null where nothing is left."""
    t = F.btrim(c, F.lit(_SPACE))
    return F.when(t != "", t)


def part_edges(relations: DataFrame, rel_type: str = "composition", source: str = "source_id", target: str = "target_id", kind: str = "rel_type") -> DataFrame:
    """Distinct (parent, child) of one relation type; type without regard to case and spaces, ends non-blank."""
    keep = F.lower(F.btrim(F.col(kind), F.lit(_SPACE))) == rel_type
    e = relations.filter(keep).select(clean_id(F.col(source)).alias("parent"), clean_id(F.col(target)).alias("child"))
    return e.filter("parent IS NOT NULL AND child IS NOT NULL").distinct()


def walk(edges: list[tuple[str, str]]) -> tuple[dict, list, dict, list, set]:
    """Children by node, roots, nodes on a ring with the first node found of their strongly connected component, the
    edges met that close a ring, and nodes on or below a ring."""
    kids: dict[str, list[str]] = {}
    has_parent = set()
    for p, c in edges:
        kids.setdefault(p, []).append(c)
        kids.setdefault(c, [])
        has_parent.add(c)
    roots = [n for n in kids if n not in has_parent]
    grey, black = {}, set()  # grey: position on the way
    low: dict[str, int] = {}
    order: dict[str, int] = {}
    ring: dict[str, str] = {}
    back, held, inside = [], [], set()
    for start in [*roots, *kids]:
        if start in order:
            continue
        way = [(start, iter(kids[start]))]
        order[start] = low[start] = len(order)
        grey[start] = True
        held.append(start)
        inside.add(start)
        while way:
            node, rest = way[-1]
            for k in rest:
                if k not in order:
                    order[k] = low[k] = len(order)
                    grey[k] = True
                    held.append(k)
                    inside.add(k)
                    way.append((k, iter(kids[k])))
                    break
                if k in grey:
                    back.append((node, k))
                if k in inside:
                    low[node] = min(low[node], order[k])
            else:
                way.pop()
                del grey[node]
                black.add(node)
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while True:
                        x = held.pop()
                        inside.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    if len(group) > 1 or node in kids[node]:
                        ring.update(dict.fromkeys(group, node))
    below, todo = set(ring), list(ring)
    while todo:
        for k in kids[todo.pop()]:
            if k not in below:
                below.add(k)
                todo.append(k)
    return kids, roots, ring, back, below


def _paths(edges: list) -> Iterator[tuple]:
    kids, roots, _, _, below = walk(edges)
    for n in below:
        yield n, CYCLE, None, None
    for r in roots:
        way = [(r, r, 0)]
        while way:
            n, path, depth = way.pop()
            yield n, path, depth, r
            way.extend((k, f"{path}/{k}", depth + 1) for k in kids[n] if k not in below)


def _descendants(edges: list) -> Iterator[tuple]:
    kids, *_ = walk(edges)
    for n in kids:
        seen, todo = {n}, [(n, 0)]
        for x, far in todo:  # breadth first: the first arrival is the nearest
            for k in kids[x]:
                if k not in seen:
                    seen.add(k)
                    todo.append((k, far + 1))
        for x, far in todo[1:]:
            yield n, x, far


def _rings(edges: list) -> Iterator[tuple]:
    _, _, ring, _, _ = walk(edges)
    for p, c in edges:
        if p in ring and ring[p] == ring.get(c):
            yield p, c


_KERNELS = {
    "paths": (_paths, "node_id string, path string, depth long, root string"),
    "descendants": (_descendants, "node_id string, descendant string, distance long"),
    "rings": (_rings, "node_id string, closes_to string"),
}


def _by_component(kernel, names: list[str], types: list):
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple[str, str]] = []
        at = None

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

        for b in batches:
            for g, p, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if g != at and held:
                    for row in kernel(held):
                        out.append(row)
                        if len(out) >= _ROWS:
                            yield flush(out)
                            out = []
                    held = []
                at = g
                held.append((p, c))
        if held:
            for row in kernel(held):
                out.append(row)
                if len(out) >= _ROWS:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    return run


def _peel(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Clean nodes (neither on nor below a ring) of large components, level by level: (node_id)."""
    degree = edges.groupBy(F.col("child").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    fresh = scratch.put(edges.select(F.col("parent").alias("node_id")).distinct().join(degree, "node_id", "left_anti"), "fresh")
    clean, degree = fresh, scratch.put(degree, "degree")
    while not fresh.isEmpty():
        got = edges.join(fresh.withColumnRenamed("node_id", "parent"), "parent").groupBy(F.col("child").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
        left = scratch.put(degree.join(got, "node_id", "left").select("node_id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")), "degree")
        fresh = scratch.put(left.filter("n = 0").select("node_id"), "fresh")
        degree = left.filter("n > 0")
        clean = clean.unionByName(fresh)
    return scratch.put(clean, "clean")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with neither end among ``nodes`` (node_id)."""
    return edges.join(nodes.withColumnRenamed("node_id", "parent"), "parent", "left_anti").join(nodes.withColumnRenamed("node_id", "child"), "child", "left_anti").select("parent", "child")


def _ring_edges(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node_id, closes_to): edges inside strongly connected components.

    What lies on no way between rings is peeled away from both ends. In the rest each node takes the greatest name that
    reaches it; the nodes of one name that lead back to its bearer are a component. These go, until nothing is left.
    """
    found = edges.limit(0).select("parent", "child")
    rest = edges.select("parent", "child")
    while True:
        rest = scratch.put(_without(rest, _peel(scratch, rest)), "rest")
        rest = scratch.put(_without(rest, _peel(scratch, rest.select(F.col("child").alias("parent"), F.col("parent").alias("child")))), "rest")
        if rest.isEmpty():
            return found.select(F.col("parent").alias("node_id"), F.col("child").alias("closes_to"))
        names = rest.select(F.col("parent").alias("node_id")).union(rest.select("child")).distinct()
        names = scratch.put(names.withColumns({"name": F.col("node_id"), "new": F.lit(True)}), "names")
        while not names.filter("new").isEmpty():
            came = names.filter("new").select(F.col("node_id").alias("parent"), F.col("name").alias("n")).join(rest, "parent").groupBy(F.col("child").alias("node_id")).agg(F.max("n").alias("n"))
            better = F.coalesce(F.col("n") > F.col("name"), F.lit(False))
            names = scratch.put(names.join(came, "node_id", "left").select("node_id", F.when(better, F.col("n")).otherwise(F.col("name")).alias("name"), better.alias("new")), "names")
        end = lambda e: names.select(F.col("node_id").alias(e), F.col("name").alias(f"{e}_name"))  # noqa: E731, B023
        same = scratch.put(rest.join(end("parent"), "parent").join(end("child"), "child").filter("parent_name = child_name").select("parent", "child"), "same")
        fresh = scratch.put(names.filter("node_id = name").select("node_id"), "fresh")
        group = fresh
        while not fresh.isEmpty():
            back = same.join(fresh.withColumnRenamed("node_id", "child"), "child").select(F.col("parent").alias("node_id")).distinct()
            fresh = scratch.put(back.join(group, "node_id", "left_anti"), "fresh")
            group = scratch.put(group.unionByName(fresh), "group")
        ends = [group.withColumnRenamed("node_id", e) for e in ("parent", "child")]
        found = scratch.put(found.unionByName(same.join(ends[0], "parent", "left_semi").join(ends[1], "child", "left_semi").select("parent", "child")), "found")
        rest = scratch.put(_without(rest, group), "rest")


def _large(scratch: Scratch, edges: DataFrame, what: str) -> DataFrame:
    if what == "descendants":
        pairs = scratch.put(edges.select(F.col("parent").alias("node_id"), F.col("child").alias("descendant"), F.lit(1).cast("long").alias("distance")), "pairs")
        pairs = pairs.filter("node_id <> descendant")
        fresh, far = pairs, 1
        while not fresh.isEmpty():
            far += 1
            nxt = fresh.join(edges, fresh["descendant"] == edges["parent"]).select("node_id", F.col("child").alias("descendant")).distinct().filter("node_id <> descendant")
            fresh = scratch.put(nxt.join(pairs, ["node_id", "descendant"], "left_anti").withColumn("distance", F.lit(far).cast("long")), "pairs")
            pairs = pairs.unionByName(fresh)
        return pairs
    if what == "rings":
        return _ring_edges(scratch, edges)
    clean = _peel(scratch, edges)
    nodes = edges.select(F.col("parent").alias("node_id")).union(edges.select("child")).distinct()
    cyclic = nodes.join(clean, "node_id", "left_anti")
    open_ = scratch.put(edges.join(clean.withColumnRenamed("node_id", "child"), "child", "left_semi"), "open")
    roots = clean.join(edges.withColumnRenamed("child", "node_id"), "node_id", "left_anti")
    fresh = scratch.put(roots.select("node_id", F.col("node_id").alias("path"), F.lit(0).cast("long").alias("depth"), F.col("node_id").alias("root")), "paths")
    paths = fresh
    while not fresh.isEmpty():
        fresh = scratch.put(fresh.join(open_, fresh["node_id"] == open_["parent"]).select(F.col("child").alias("node_id"), F.concat_ws("/", "path", "child").alias("path"), (F.col("depth") + 1).alias("depth"), "root"), "paths")
        paths = paths.unionByName(fresh)
    none = F.lit(None)
    return paths.unionByName(cyclic.select("node_id", F.lit(CYCLE).alias("path"), none.cast("long").alias("depth"), none.cast("string").alias("root")))


def hierarchy(relations: DataFrame, what: str = "paths", rel_type: str = "composition", limit: int = LIMIT, **columns: str) -> DataFrame:
    """Hierarchies of one relation type.

    ``what`` is "paths" (node_id, path, depth, root: a row for each way from a root; for a node on or below a ring one
    row with path "(cycle)", depth and root null), "descendants" (node_id, descendant, distance: everything that can be
    reached, with the least number of steps) or "rings" (node_id, closes_to: all edges that lie on a ring, i.e. inside a
    strongly connected component).

    Rows with a null or blank end or type are left out, repeated rows count once, a node that is its own parent is a
    ring; no matching row gives an empty result; other columns are not read.
    """
    spark = relations.sparkSession
    scratch = Scratch(spark, "hierarchy")
    kernel, ddl = _KERNELS[what]
    edges = scratch.put(part_edges(relations, rel_type, **columns).withColumns({"p": F.xxhash64("parent"), "c": F.xxhash64("child")}), "edges")
    label = component_labels(scratch, edges.select("p", "c").distinct())
    # a node whose only edge is one to itself has no label
    tagged = scratch.put(edges.join(label, edges["p"] == label["x"], "left").select(F.coalesce("label", "p").alias("g"), "parent", "child"), "tagged")
    large = scratch.put(tagged.groupBy("g").count().filter(F.col("count") > limit).select("g").coalesce(1), "large")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most edges / limit components are large
    small = tagged.join(F.broadcast(large), "g", "left_anti").select("g", "parent", "child").repartition(parts, "g").sortWithinPartitions("g", "parent", "child")
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in ddl.split(", ")]
    out = small.mapInArrow(_by_component(kernel, names, types), ddl)
    if large.isEmpty():
        return out
    rest = scratch.put(tagged.join(F.broadcast(large), "g", "left_semi").select("parent", "child"), "rest")
    return out.unionByName(_large(scratch, rest, what))
