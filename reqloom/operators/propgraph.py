"""Property graphs as two tables, and their text formats.

Nodes are (id, kind, props), edges (src, dst, rel, props); ``props`` are maps from names to strings. ``lines`` turns
them into the lines of a document with sort keys, row by row; ``write`` gives one ordered text file per graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.text import escape_dot, escape_mermaid, escape_turtle, escape_xml, safe_name, shorten, strip

FORMS = ("graphml", "turtle", "cypher", "dot", "mermaid")
#: Longest label of a drawn node; longer ones end in "...".
LABEL = 50


def props(**columns: Column) -> Column:
    """Map of the columns that are neither null nor empty."""
    pairs = F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))))
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def _each(p: Column, one) -> Column:
    """One string for each property, names in order."""
    return F.transform(F.array_sort(F.map_entries(p)), lambda e: one(e["key"], e["value"]))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), escape_turtle(c), F.lit('"'))


def _label(kind: Column, id_: Column, p: Column) -> Column:
    return F.concat(id_, F.lit(": "), shorten(strip(F.coalesce(F.get(F.array_compact(F.array(p["label"], p["text"])), F.lit(0)), kind)), LABEL, "..."))


def node_line(form: str) -> Column:
    i, kind, p = F.col("id"), F.col("kind"), F.col("props")
    if form == "graphml":
        data = _each(p, lambda k, v: F.concat(F.lit('<data key="'), k, F.lit('">'), escape_xml(v), F.lit("</data>")))
        return F.concat(F.lit('<node id="'), escape_xml(i), F.lit('"><data key="node_type">'), escape_xml(kind), F.lit("</data>"), F.array_join(data, ""), F.lit("</node>"))
    if form == "turtle":
        said = _each(p, lambda k, v: F.concat(F.lit(" ; :"), safe_name(k), F.lit(" "), _quoted(v)))
        return F.concat(F.lit(":"), safe_name(i), F.lit(" a :"), safe_name(kind), F.lit(" ; :id "), _quoted(i), F.array_join(said, ""), F.lit(" ."))
    if form == "cypher":
        said = _each(p, lambda k, v: F.concat(F.lit(", "), safe_name(k), F.lit(": "), _quoted(v)))
        return F.concat(F.lit("CREATE (:"), safe_name(kind), F.lit(" {id: "), _quoted(i), F.array_join(said, ""), F.lit("});"))
    if form == "dot":
        return F.concat(F.lit('  "'), escape_dot(i), F.lit('" [label="'), escape_dot(_label(kind, i, p)), F.lit('"];'))
    return F.concat(F.lit("    "), safe_name(i), F.lit('["'), escape_mermaid(_label(kind, i, p)), F.lit('"]'))


def edge_line(form: str) -> Column:
    a, b, rel, p = F.col("src"), F.col("dst"), F.col("rel"), F.col("props")
    score = F.coalesce(F.concat(F.lit(" "), p["score"]), F.lit(""))
    if form == "graphml":
        data = _each(p, lambda k, v: F.concat(F.lit('<data key="'), k, F.lit('">'), escape_xml(v), F.lit("</data>")))
        return F.concat(F.lit('<edge source="'), escape_xml(a), F.lit('" target="'), escape_xml(b), F.lit('"><data key="rel">'), escape_xml(rel), F.lit("</data>"), F.array_join(data, ""), F.lit("</edge>"))
    if form == "turtle":
        return F.concat(F.lit(":"), safe_name(a), F.lit(" :"), safe_name(rel), F.lit(" :"), safe_name(b), F.lit(" ."))
    if form == "cypher":
        said = F.array_join(_each(p, lambda k, v: F.concat(safe_name(k), F.lit(": "), _quoted(v))), ", ")
        return F.concat(F.lit("MATCH (a {id: "), _quoted(a), F.lit("}), (b {id: "), _quoted(b), F.lit("}) CREATE (a)-[:"), safe_name(rel), F.lit(" {"), said, F.lit("}]->(b);"))
    if form == "dot":
        return F.concat(F.lit('  "'), escape_dot(a), F.lit('" -> "'), escape_dot(b), F.lit('" [label="'), escape_dot(F.concat(rel, score)), F.lit('"];'))
    return F.concat(F.lit("    "), safe_name(a), F.lit(' -->|"'), escape_mermaid(F.concat(rel, score)), F.lit('"| '), safe_name(b))


def lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(part, sort, line): nodes (part 1, by id) before edges (part 2, by ends); ``sort`` orders lines of a part."""
    if form not in FORMS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMS)}")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("sort"), node_line(form).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\x01", "src", "dst", "rel").alias("sort"), edge_line(form).alias("line"))
    return n.unionByName(e)


def frame(form: str, node_keys: tuple[str, ...] = (), edge_keys: tuple[str, ...] = (), base: str = "http://example.org/graph#") -> tuple[list[str], list[str]]:
    """Lines before and after those of the graph; ``*_keys``: names of properties, which one format declares."""
    if form == "graphml":
        keys = [("node_type", "node"), *((k, "node") for k in node_keys), ("rel", "edge"), *((k, "edge") for k in edge_keys)]
        # a name used for nodes and edges is declared for both
        scope = {k: "all" if {a for n, a in keys if n == k} == {"node", "edge"} else a for k, a in keys}
        declared = [f'<key id="{k}" for="{a}" attr.name="{k}" attr.type="string"/>' for k, a in scope.items()]
        return ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *declared, '<graph id="g" edgedefault="directed">'], ["</graph>", "</graphml>"]
    if form == "turtle":
        return [f"@prefix : <{base}> ."], []
    return {"dot": (["digraph g {", "  rankdir=LR;"], ["}"]), "mermaid": (["flowchart LR"], []), "cypher": ([], [])}[form]


def document(nodes: DataFrame, edges: DataFrame, form: str, base: str = "http://example.org/graph#") -> DataFrame:
    """(part, sort, line): the whole document, to be written with ``write``. One small job finds the properties' names."""
    names = lambda df: tuple(sorted(r.k for r in df.select(F.explode(F.map_keys("props")).alias("k")).distinct().collect()))
    keys = (names(nodes), names(edges)) if form == "graphml" else ((), ())
    before, after = frame(form, *keys, base)
    rows = [(0, f"{i:04d}", x) for i, x in enumerate(before)] + [(3, f"{i:04d}", x) for i, x in enumerate(after)]
    body = lines(nodes, edges, form)
    return body.unionByName(nodes.sparkSession.createDataFrame(rows, "part int, sort string, line string")) if rows else body


def write(doc: DataFrame, path: str) -> None:
    """Text files that give the document when read in the order of their names: ranges of its lines, sorted."""
    doc.orderBy("part", "sort", "line").select("line").write.mode("overwrite").text(path)
