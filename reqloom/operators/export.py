"""Exports of statement graphs as lines of text formats; ``documents`` joins the lines of each statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.text import escape_dot, escape_mermaid, escape_turtle, escape_xml, safe_name


def _label(role: Column, text: Column) -> Column:
    return F.when(text == "", role).otherwise(F.concat(role, F.lit(": "), text))


def graph_lines(nodes: DataFrame, edges: DataFrame, form: str, key: str = "ord", glue: bool = False) -> DataFrame:
    """(key, part, line): a line per node (part 0) and edge (part 1) in mermaid, dot, cypher, graphml or turtle.

    The order of tiles (NEXT) and, unless asked for, GLUE nodes are left out.
    """
    n = nodes if glue else nodes.filter("role <> 'GLUE'")
    e = edges.filter("rel <> 'NEXT'")
    i, s, d, rel, role = (F.col(c) for c in ("node_id", "src", "dst", "rel", "role"))
    text = F.col("text")
    forms = {
        "mermaid": (F.format_string('    %s["%s"]', i, escape_mermaid(_label(role, text))), F.format_string("    %s -->|%s| %s", s, rel, d)),
        "dot": (F.format_string('  "%s" [label="%s"];', i, escape_dot(_label(role, text))), F.format_string('  "%s" -> "%s" [label="%s"];', s, d, rel)),
        "cypher": (F.format_string('CREATE (%s:%s {text: "%s"})', i, role, escape_dot(text)), F.format_string("CREATE (%s)-[:%s]->(%s)", s, rel, d)),
        "graphml": (F.format_string('<node id="%s"><data key="role">%s</data><data key="text">%s</data></node>', i, role, escape_xml(text)), F.format_string('<edge source="%s" target="%s"><data key="rel">%s</data></edge>', s, d, rel)),
        "turtle": (F.format_string('req:%s a reqont:%s ; reqont:text "%s" .', safe_name(i), role, escape_turtle(text)), F.format_string("req:%s reqont:%s req:%s .", safe_name(s), rel, safe_name(d))),
    }
    node_line, edge_line = forms[form]
    return n.select(key, F.lit(0).alias("part"), node_line.alias("line")).unionByName(e.select(key, F.lit(1).alias("part"), edge_line.alias("line")))


_HEAD = {"mermaid": "graph TD", "dot": "digraph requirement {", "cypher": "", "graphml": '<graphml><graph edgedefault="directed">', "turtle": ""}
_TAIL = {"mermaid": "", "dot": "}", "cypher": "", "graphml": "</graph></graphml>", "turtle": ""}


def documents(lines: DataFrame, form: str, key: str = "ord") -> DataFrame:
    """(key, document): the lines of each statement, nodes first; a statement's graph is small."""
    body = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("b"))
    parts = [F.lit(_HEAD[form]), F.col("b"), F.lit(_TAIL[form])]
    return body.select(key, F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n").alias("document"))


def as_json(tiled: DataFrame, key: str = "ord") -> DataFrame:
    """(key, document): text and tiles as JSON, to be read back with ``from_json``."""
    return tiled.select(key, F.to_json(F.struct("text", "tiles")).alias("document"))
