"""Lossless tiling of statements, and the graph of nodes and edges on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.text import strip
from reqloom.functions.vocab import TERMINAL_ROLES
from reqloom.operators.extract import resolve_overlaps, sanitise

TILE = "struct<start:int,end:int,role:string,marker:string,kind:string>"


def tiles(text: Column, claims: Column) -> Column:
    """Array of tiles that covers the text without gap or overlap: the claims, and GLUE between them."""
    kept = resolve_overlaps(sanitise(claims, F.length(text), TERMINAL_ROLES))
    none = F.lit(None).cast("string")
    glue = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.lit("GLUE").alias("role"), none.alias("marker"), none.alias("kind"))
    before = F.transform(kept, lambda x, i: F.array(glue(F.when(i == 0, 0).otherwise(F.get(kept, i - 1)["end"]), x["start"]), x))
    last = F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))
    all_ = F.concat(F.flatten(before), F.array(glue(last, F.length(text)))).cast(f"array<{TILE}>")
    return F.filter(all_, lambda x: x["end"] > x["start"])


def with_tiles(df: DataFrame, text: str = "text") -> DataFrame:
    """``tiles`` from ``claims`` of one's own; ``extract`` gives both."""
    return df.withColumn("tiles", tiles(F.col(text), F.col("claims")))


def _core(x: Column) -> Column:
    return x["role"].isin("PROCESS", "OBJECT")


def action_cells(tiles_: Column) -> Column:
    """The tiles with the number of their action (null outside of actions): a process starts one, a leading object too."""
    core = F.filter(tiles_, _core)
    lead = F.when(F.get(core, F.lit(0))["role"] == "OBJECT", 1).otherwise(0)
    upto = lambda i: F.size(F.filter(F.slice(tiles_, 1, i + 1), lambda y: y["role"] == "PROCESS"))
    number = lambda x, i: F.when(_core(x), (upto(i) + lead).cast("long"))
    fields = lambda x: [x[f].alias(f) for f in ("start", "end", "role", "marker", "kind")]
    return F.transform(tiles_, lambda x, i: F.struct(*fields(x), number(x, i).alias("action")))


def terminals(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, pos from 1, node_id, role, text, marker, kind, start, end, action): one row for each tile."""
    each = df.select(key, F.col(text).alias("_t"), F.posexplode_outer(action_cells(F.col("tiles"))).alias("pos", "x")).filter("pos IS NOT NULL")
    words = F.substr("_t", F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    pos = (F.col("pos") + 1).cast("long")
    node = F.concat(F.lower("x.role"), F.lit("_"), pos)
    return each.select(key, pos.alias("pos"), node.alias("node_id"), F.col("x.role").alias("role"), words.alias("text"), F.col("x.marker").alias("marker"), F.col("x.kind").alias("kind"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.action").alias("action"))


def generated(text: Column, tiles_: Column) -> Column:
    """The text put together again from its tiles."""
    return F.array_join(F.transform(tiles_, lambda x: F.substr(text, x["start"] + 1, x["end"] - x["start"])), "")


def elements(terms: DataFrame) -> DataFrame:
    """Semantic terminals in text order: no glue, nothing blank."""
    return terms.filter((F.col("role") != "GLUE") & (strip(F.col("text")) != ""))


def action_numbers(terms: DataFrame) -> DataFrame:
    """PROCESS and OBJECT terminals, which have the number of their ``action``."""
    return terms.filter("action IS NOT NULL")


def with_actions(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (with ``tiles``) and ``cells`` (tiles with action), ``n_actions``, and ``operator``: AND or OR from the text
    between the first two actions, null with fewer."""
    d = df.withColumn("cells", action_cells(F.col("tiles")))
    of = lambda n, f: F.transform(F.filter("cells", lambda x: x["action"] == n), lambda x: x[f])
    n = F.coalesce(F.array_max(F.transform("cells", lambda x: x["action"])), F.lit(0).cast("long"))
    to, at = F.array_max(of(1, "end")), F.array_min(of(2, "start"))
    gap = F.lower(F.substr(F.col(text), to + 1, F.greatest(at - to, F.lit(0))))
    op = F.when(n > 1, F.when(F.concat(F.lit(" "), strip(gap), F.lit(" ")).contains(" or "), "OR").otherwise("AND"))
    return d.withColumns({"n_actions": n, "operator": op})


def actions(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, n_actions, operator) of statements with at least one action."""
    return with_actions(df, text).select(key, "n_actions", "operator").filter("n_actions > 0")


def _name(role: str, number: Column) -> Column:
    return F.concat(F.lit(role + "_"), number.cast("string"))


def _node(x: Column, i: Column) -> Column:
    return F.concat(F.lower(x["role"]), F.lit("_"), (i + 1).cast("string"))


def _numbers(n: Column) -> Column:
    """1 to n; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def nodes(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, node_id, role, text): a statement's tiles, the root, and the actions and operator above them.

    All rows of a statement come from its own row: no shuffle. ``df`` has ``tiles``; a null text gives only the root.
    """
    d = with_actions(df, text)
    n, k = F.greatest(F.size("cells"), F.lit(0)), F.col("n_actions")
    node = lambda name, role, words=F.lit(""): F.struct(name.alias("node_id"), F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), words.alias("text"))
    tiles_ = F.transform("cells", lambda x, i: node(_node(x, i), x["role"], F.substr(F.col(text), x["start"] + 1, x["end"] - x["start"])))
    acts = F.transform(_numbers(k), lambda i: node(_name("action", n + 1 + i), "ACTION"))
    none = F.array().cast("array<struct<node_id:string,role:string,text:string>>")
    ops = F.when(k > 1, F.array(node(_name("operator", n + 2 + k), "OPERATOR"))).otherwise(none)
    return d.select(key, F.inline(F.concat(F.coalesce(tiles_, none), F.array(node(_name("root", n + 1), "ROOT")), acts, ops)))


#: Relation from the root to a terminal, by role.
_ROOT_RELS = {"CONDITION": "HAS_CONDITION", "SUBJECT": "HAS_SUBJECT", "MODALITY": "HAS_MODALITY"}
#: Relation from the first action (or the root) to a terminal, by role.
_HEAD_RELS = {"ACTOR": "HAS_ACTOR", "DETAILS": "HAS_DETAILS", "CONSTRAINT": "HAS_CONSTRAINT"}
_ACTION_RELS = {"PROCESS": "HAS_PROCESS", "OBJECT": "ACTS_ON"}


def _by_role(role: Column, rels: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in rels.items() for x in kv))[role]


def edges(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, src, dst, rel) of the statements' graphs, each from its own row: no shuffle. ``df`` has ``tiles``."""
    d = with_actions(df, text).filter(F.size("cells") > 0)
    n, k = F.size("cells"), F.col("n_actions")
    root = _name("root", n + 1)
    action = lambda i: _name("action", n + 1 + i)
    head = F.when(k > 0, action(F.lit(1))).otherwise(root)
    op = _name("operator", n + 2 + k)
    edge = lambda a, b, r: F.struct(a.alias("src"), b.alias("dst"), (F.lit(r) if isinstance(r, str) else r).alias("rel"))
    follows = F.transform("cells", lambda x, i: edge(_node(x, i), _node(F.get("cells", i + 1), i + 1), F.when(i + 1 < n, F.lit("NEXT"))))
    below = [
        F.transform("cells", lambda x, i: edge(root, _node(x, i), _by_role(x["role"], _ROOT_RELS))),
        F.transform("cells", lambda x, i: edge(head, _node(x, i), _by_role(x["role"], _HEAD_RELS))),
        F.transform("cells", lambda x, i: edge(action(x["action"]), _node(x, i), _by_role(x["role"], _ACTION_RELS))),
    ]
    first = F.array(edge(root, F.when(k == 1, action(F.lit(1))).otherwise(op), F.when(k > 0, F.lit("HAS_ACTION"))))
    parts = F.transform(_numbers(F.when(k > 1, k).otherwise(0)), lambda i: edge(op, action(i), "OPERAND"))
    return d.select(key, F.inline(F.filter(F.concat(follows, *below, first, parts), lambda e: e["rel"].isNotNull())))


def integrity_errors(nodes_: DataFrame, edges_: DataFrame, order: DataFrame, key: str = "ord") -> DataFrame:
    """(key, node_id, error): violations of the graph's rules; ``order`` has (key, pos, node_id) of the tiling."""
    n = nodes_.select(key, "node_id", "role")
    listed = order.groupBy(key, "node_id").agg(F.count(F.lit(1)).alias("times"))
    both = listed.join(n, [key, "node_id"], "full")
    terminal = F.col("role").isin(*TERMINAL_ROLES)
    what = F.when(F.col("role").isNull(), "unknown node in order").when(F.col("times").isNotNull() & ~terminal, "non-terminal in order").when(F.col("times") > 1, "tiled twice").when(F.col("times").isNull() & terminal, "terminal missing from order")
    bad = both.select(key, "node_id", what.alias("error")).filter("error IS NOT NULL")
    ends = edges_.select(key, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    loose = ends.join(n, [key, "node_id"], "left_anti").withColumn("error", F.lit("edge to unknown node"))
    return bad.unionByName(loose)
