"""Requirement sets: statements divided and numbered, their flat table, and the graphs built on sets and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.grammar import RUPP, Grammar
from reqloom.functions.text import strip
from reqloom.operators import quality, tiling
from reqloom.operators.extract import extract
from reqloom.operators.model import kind
from reqloom.operators.propgraph import props
from reqloom.operators.skew import find_hot, lookup_join
from reqloom.operators.split import split_statements
from reqloom.operators.trace import numbered
from reqloom.session import Scratch


def distinct_ids(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """``df`` with asterisks behind ids that come again: as many as it takes to be unique, in ``order``.

    An id with asterisks of its own counts as its base, so "A", "A*" and another "A" become "A", "A*" and "A**".
    """
    scratch = Scratch(df.sparkSession, "ids")
    n = scratch.put(numbered(df.withColumn("_base", F.regexp_replace(F.col(key), r"\*+\z", "")), "_base", *order), "numbered")
    first = scratch.put(n.groupBy("_base").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("count")), "first")
    hot = find_hot(scratch, first, "_base", n.count())
    found = lookup_join(n, first.select("_base", "first"), "_base", hot)
    stars = F.repeat(F.lit("*"), (F.col("n") - F.col("first")).cast("int"))
    return found.withColumn(key, F.concat("_base", stars)).select(*df.columns)


def requirement_set(statements: DataFrame, g: Grammar = RUPP) -> DataFrame:
    """(ord, part, id, text, claims, tiles, function_type): single statements of (ord, id, text) under unique ids.

    Texts that hold several statements are divided, their ids get the part's number. Statements without an id are
    called REQ-<ord>; blank texts are left out.
    """
    known = F.coalesce(F.nullif(strip(F.col("id")), F.lit("")), F.concat(F.lit("REQ-"), F.col("ord").cast("string")))
    parts = split_statements(statements.filter(strip(F.col("text")) != "").select("ord", known.alias("id"), "text"), g)
    return extract(distinct_ids(parts, order=("ord", "part")), g)


def set_table(rows: DataFrame) -> DataFrame:
    """Flat quality table of a requirement set, one row per single statement."""
    return quality.flat_table(rows, ["ord", "part", "id", "text"])


def element_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, node_id, role, text) of the elements of statements (key, text, tiles)."""
    return tiling.elements(tiling.terminals(rows, key)).select(key, "node_id", "role", strip(F.col("text")).alias("text"))


def set_nodes(rows: DataFrame, key: str = "id") -> DataFrame:
    """Graph nodes of statements (key, text, claims, tiles) with type, pattern and smells as properties."""
    c = F.col("text")
    flags = props(text=strip(c), req_type=quality.requirement_type(c), ears_pattern=quality.ears_pattern(F.col("claims")), weak_words=F.array_join(quality.weak_words(c), ", "), non_atomic=quality.smells(c)["non_atomic"])
    return rows.select(F.col(key).alias("id"), F.lit("REQ").alias("kind"), flags.alias("props"))


def element_nodes(rows: DataFrame, key: str = "id") -> DataFrame:
    """Graph nodes of elements, named <statement>__<element>."""
    e = element_rows(rows, key)
    return e.select(F.concat_ws("__", key, "node_id").alias("id"), F.lit("ELEMENT").alias("kind"), props(role=F.col("role"), text=F.col("text")).alias("props"))


def element_edges(rows: DataFrame, key: str = "id") -> DataFrame:
    """Edges from statements to their elements."""
    e = element_rows(rows, key)
    return e.select(F.col(key).alias("src"), F.concat_ws("__", key, "node_id").alias("dst"), F.lit("HAS_ELEMENT").alias("rel"), F.create_map().cast("map<string,string>").alias("props"))


def similarity_edges(matches: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges SIMILAR_<role> of scored matches (a, b, role, score), the best of each pair and role."""
    best = matches.groupBy(F.col(a).alias("src"), F.col(b).alias("dst"), "role").agg(F.max("score").alias("score"))
    return best.select("src", "dst", F.concat(F.lit("SIMILAR_"), "role").alias("rel"), props(score=F.format_string("%.4f", "score")).alias("props"))


def model_nodes(elements: DataFrame) -> DataFrame:
    """Graph nodes of model elements (those with an id)."""
    d = elements.filter("xmi_id <> ''")
    return d.select(F.col("xmi_id").alias("id"), kind().alias("kind"), props(label=F.col("name"), role=F.col("role"), doc=F.col("doc"), package=F.col("package"), req_id=F.col("req_id"), req_text=F.col("req_text")).alias("props"))


def model_edges(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges of model relations whose ends both exist, each once."""
    ids = elements.filter("xmi_id <> ''").select("xmi_id")
    ends = relations.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("rel_type").alias("rel")).distinct()
    there = ends.join(ids.withColumnRenamed("xmi_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("xmi_id", "dst"), "dst", "left_semi")
    return there.select("src", "dst", "rel", F.create_map().cast("map<string,string>").alias("props"))


def ontology_diff(elements: DataFrame, relations: DataFrame, reqs: DataFrame) -> DataFrame:
    """(section, name, n): what a model and a requirement set consist of, side by side: "model_type" and
    "model_relation" counts, "set_role" counts of elements (role, ...), and "model_role" counts."""
    count = lambda df, section, name: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    return (
        count(elements, "model_type", kind())
        .unionByName(count(relations, "model_relation", F.col("rel_type")))
        .unionByName(count(elements, "model_role", F.col("role")))
        .unionByName(count(reqs, "set_role", F.col("role")))
    )


def summary(rows: DataFrame, key: str = "ord") -> DataFrame:
    """(key, summary): type, pattern, smells and elements of a statement as lines of text."""
    c = F.col("text")
    smells = quality.smells(c)
    weak = quality.weak_words(c)
    flags = F.array_compact(F.array(*(F.when(x, n) for n, x in smells.items()), F.when(F.size(weak) > 0, F.concat(F.lit("weak_words="), F.array_join(weak, ", ")))))
    words = lambda x: strip(F.substr(c, x["start"] + 1, x["end"] - x["start"]))
    real = F.filter("tiles", lambda x: (x["role"] != "GLUE") & (words(x) != ""))
    note: Column = F.transform(real, lambda x: F.concat(F.lit("- "), x["role"], F.lit(": "), words(x), F.coalesce(F.concat(F.lit(" ["), x["kind"], F.lit("]")), F.lit(""))))
    head = F.array_compact(F.array(F.concat(F.lit("type: "), quality.requirement_type(c)), F.concat(F.lit("ears_pattern: "), quality.ears_pattern(F.col("claims"))), F.when(F.size(flags) > 0, F.concat(F.lit("quality: "), F.array_join(flags, "; ")))))
    return rows.select(key, F.array_join(F.concat(head, note), "\n").alias("summary"))


def nested(rows: DataFrame, key: str = "ord") -> DataFrame:
    """(key, tree): a statement as JSON: its elements by role outside of actions, and a list of actions."""
    d = tiling.with_actions(rows)
    c = F.col("text")
    words = lambda x: strip(F.substr(c, x["start"] + 1, x["end"] - x["start"]))
    leaf = lambda x: F.struct(x["role"].alias("role"), words(x).alias("text"))
    outer = F.transform(F.filter("cells", lambda x: x["action"].isNull() & (x["role"] != "GLUE") & (words(x) != "")), leaf)
    numbers = F.when(F.col("n_actions") > 0, F.sequence(F.lit(1).cast("long"), "n_actions")).otherwise(F.array().cast("array<bigint>"))
    acts = F.transform(numbers, lambda n: F.transform(F.filter("cells", lambda x: x["action"] == n), leaf))
    return d.select(key, F.to_json(F.struct(outer.alias("elements"), "operator", acts.alias("actions"))).alias("tree"))
