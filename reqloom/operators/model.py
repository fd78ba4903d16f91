"""System model tables: role and relation mapping, merging, neighbourhoods, and counts of the ontology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions import vocab
from reqloom.session import Scratch


def map_role(uml_type: Column, stereotype: Column, overrides: dict[str, str] | None = None) -> Column:
    """Semantic role of an element: overrides, known stereotypes, hints in their names, then the type."""
    st, ut = F.lower(F.coalesce(stereotype, F.lit(""))), F.lower(F.coalesce(uml_type, F.lit("")))
    rules = [(st == k, v) for k, v in (overrides or {}).items()]
    rules += [(st.isin(*names), role) for role, names in vocab.STEREOTYPE_ROLES.items()]
    rules.append((st.isin(*vocab.RELATION_STEREOTYPES), "CONSTRAINT"))
    rules += [(st.contains(needle), role) for needle, role in vocab.STEREOTYPE_HINTS]
    for needles, role in vocab.UML_HINTS:
        hit = F.lit(False)
        for n in needles:
            hit = hit | ut.contains(n)
        rules.append((hit, role))
    out = F.lit("SUBJECT")
    for cond, role in reversed(rules):
        out = F.when(cond, role).otherwise(out)
    return out


def relation_type(stereotype: Column, overrides: dict[str, str] | None = None) -> Column:
    """Canonical relation verb; an unknown one in lower case, "association" where there is none."""
    low = F.lower(F.trim(F.coalesce(stereotype, F.lit(""))))
    out = low
    for needle, verb in reversed(vocab.RELATION_HINTS):
        out = F.when(low.contains(needle), verb).otherwise(out)
    for name, verb in [*vocab.RELATION_EXACT.items(), *(overrides or {}).items()]:
        out = F.when(low == name, verb).otherwise(out)
    return F.when(low == "", "association").otherwise(out)


def merge_elements(*models: DataFrame, key: str = "xmi_id", order: str = "ord") -> DataFrame:
    """Union of element tables, the first row of each key; rows without a key are all kept."""
    rows = models[0]
    for m in models[1:]:
        rows = rows.unionByName(m)
    k = F.trim(F.col(key))
    first = F.row_number().over(Window.partitionBy(k).orderBy(order))
    keyed = rows.filter(k != "").withColumn("_rn", first).filter("_rn = 1").drop("_rn")
    return keyed.unionByName(rows.filter(k.isNull() | (k == "")))


def clean_elements(elements: DataFrame) -> DataFrame:
    """Merged elements with trimmed ids."""
    return merge_elements(elements).withColumn("xmi_id", F.trim("xmi_id"))


def clean_relations(relations: DataFrame) -> DataFrame:
    """Relations with trimmed ends and canonical types."""
    return relations.select("ord", F.trim("source_id").alias("source_id"), F.trim("target_id").alias("target_id"), relation_type(F.col("rel_type")).alias("rel_type"))


def kind(e: DataFrame | None = None) -> Column:
    """Stereotype, else the type without its prefix."""
    return F.coalesce(F.nullif(F.col("stereotype"), F.lit("")), F.element_at(F.split(F.coalesce("element_type", F.lit("")), ":"), -1))


def undirected(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (u, v) in both directions between different elements that exist."""
    ids = elements.select("xmi_id").distinct()
    both = relations.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(relations.select(F.col("target_id").alias("u"), F.col("source_id").alias("v")))
    return both.filter("u <> v").distinct().join(ids.withColumnRenamed("xmi_id", "v"), "v", "left_semi").join(ids.withColumnRenamed("xmi_id", "u"), "u", "left_semi")


#: Passes in which words travel a step, each for a part of the nodes: so much less of them is on disk at a time.
TURNS = 4


def word_contexts(words: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """Distinct (node, w): ``context_sets``, a row for each word."""
    return context_sets(words, step, hops).select("node", F.explode("tokens").alias("w"))


def context_sets(words: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """(node, tokens): the distinct words, sorted, of a node and of all nodes within ``hops`` steps; where there are any.

    ``words`` (node, w: array). Words travel one step a round and repeats go at once, so a hub hands on each word of its
    surroundings once to each neighbour, however many nodes it came from.
    """
    scratch = Scratch(words.sparkSession, "contexts")
    step = scratch.freed(step, "step")
    seen = [scratch.freed(words.select("node", F.explode("w").alias("w")).distinct(), "words")]
    sets = lambda df: df.groupBy("node").agg(F.array_sort(F.collect_set("w")).alias("tokens"))
    for hop in range(hops):
        new, every = [], reduce(DataFrame.unionByName, seen)
        for turn in range(TURNS):
            mine = lambda df, c, k=turn: df.filter(F.pmod(F.xxhash64(c), F.lit(TURNS)) == k)
            came = mine(step, "u").join(every, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "w")
            rows = mine(every, "node").unionByName(came)
            new.append(scratch.freed(rows.distinct() if hop + 1 < hops else sets(rows), "words"))
        scratch.drop(*seen)
        seen = new
    return reduce(DataFrame.unionByName, seen) if hops else sets(seen[0])


def neighbours(elements: DataFrame, relations: DataFrame, hops: int) -> DataFrame:
    """(root, node, hop): elements reached in at most ``hops`` undirected steps, with the least number of steps."""
    step = undirected(elements, relations)
    seen = step.select(F.col("u").alias("root"), F.col("v").alias("node"), F.lit(1).cast("long").alias("hop"))
    fresh = seen
    for h in range(2, hops + 1):
        nxt = fresh.join(step, fresh["node"] == step["u"]).select("root", F.col("v").alias("node")).filter("root <> node").distinct()
        fresh = nxt.join(seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(h).cast("long"))
        seen = seen.unionByName(fresh)
    return seen


def resolve_upwards(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(xmi_id, found, steps): the nearest ancestor by generalization with a stereotype, however far up; own ones have
    step 0. Of several parents the least counts; chains that end without a stereotype, and rings, give no row.

    Every element points to its parent; pointers are doubled, so a chain of n steps takes log n rounds.
    """
    scratch = Scratch(elements.sparkSession, "upwards")
    own = scratch.put(elements.select("xmi_id", F.nullif("stereotype", F.lit("")).alias("found")).filter("found IS NOT NULL"), "own")
    up = relations.filter("rel_type = 'generalization' AND source_id <> '' AND target_id <> ''").groupBy(F.col("source_id").alias("x")).agg(F.min("target_id").alias("to"))
    # elements with a stereotype are ends
    jump = scratch.put(up.join(own.select(F.col("xmi_id").alias("x")), "x", "left_anti").withColumn("steps", F.lit(1).cast("long")), "jump")
    n, reach = jump.count(), 1
    while reach <= n:  # after that only rings still lead on
        on = jump.select(F.col("x").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        new = scratch.put(jump.join(on, "to", "left").select("x", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("to2").isNotNull().alias("moved")), "jump")
        moved = not new.filter("moved").isEmpty()
        jump, reach = new.drop("moved"), 2 * reach
        if not moved:
            break
    reached = jump.join(own.withColumnRenamed("xmi_id", "to"), "to").select(F.col("x").alias("xmi_id"), "found", "steps")
    known = elements.select("xmi_id").join(reached, "xmi_id")
    return own.select("xmi_id", "found", F.lit(0).cast("long").alias("steps")).unionByName(known)


def relation_counts(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(rel_type, source_kind, target_kind, n): relations between elements that both exist."""
    k = elements.select("xmi_id", kind().alias("kind"))
    src = k.select(F.col("xmi_id").alias("source_id"), F.col("kind").alias("source_kind"))
    dst = k.select(F.col("xmi_id").alias("target_id"), F.col("kind").alias("target_kind"))
    return relations.join(src, "source_id").join(dst, "target_id").groupBy("rel_type", "source_kind", "target_kind").agg(F.count(F.lit(1)).alias("n"))
