"""Comparison of a requirement set with a model, and the verification and traceability matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions import vocab
from reqloom.functions.text import normal_req_id, normal_words
from reqloom.operators.model import kind
from reqloom.operators.similarity import jaccard, similar_sets


def camel_words(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def phrases(rows: DataFrame, role: str, text: Column, key: str, stop=vocab.MODEL_STOP) -> DataFrame:
    """(role, key, tokens): distinct normalised phrases by role, the phrase as key."""
    words = F.array_sort(F.array_distinct(normal_words(text, stop)))
    return rows.select(F.col(role).alias("role"), F.array_join(words, " ").alias(key), words.alias("tokens")).filter(F.size("tokens") > 0).distinct()


def ordered_phrases(rows: DataFrame, role: str, text: Column, key: str, stop=vocab.MODEL_STOP) -> DataFrame:
    """(role, key, tokens): distinct normalised phrases by role, the words in their own order as key."""
    words = normal_words(text, stop)
    return rows.select(F.col(role).alias("role"), F.array_join(words, " ").alias(key), F.array_sort(F.array_distinct(words)).alias("tokens")).filter(F.size("tokens") > 0).distinct()


def best_matches(pairs: DataFrame, mine: str, other: str) -> DataFrame:
    """The best pair of each (role, ``mine``): highest score, the least ``other`` of those that tie."""
    first = F.row_number().over(Window.partitionBy("role", mine).orderBy(F.desc("score"), other))
    return pairs.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def coverage(model: DataFrame, reqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(role, n_model, n_req, model_coverage, req_coverage, score) by role; distinct phrases count once."""
    m = model.groupBy("role").agg(F.count(F.lit(1)).alias("n_model"))
    r = reqs.groupBy("role").agg(F.count(F.lit(1)).alias("n_req"))
    hit = pairs.groupBy("role").agg(F.countDistinct("x").alias("_x"), F.countDistinct("y").alias("_y"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    t = m.join(r, "role", "full").join(hit, "role", "left").select("role", zero("n_model").alias("n_model"), zero("n_req").alias("n_req"), zero("_x").alias("_x"), zero("_y").alias("_y"))
    mc = F.when(F.col("n_model") > 0, F.col("_x") / F.col("n_model")).otherwise(0.0)
    rc = F.when(F.col("n_req") > 0, F.col("_y") / F.col("n_req")).otherwise(0.0)
    f1 = F.when(mc + rc > 0, 2 * mc * rc / (mc + rc)).otherwise(0.0)
    return t.select("role", "n_model", "n_req", F.round(mc, 4).alias("model_coverage"), F.round(rc, 4).alias("req_coverage"), F.round(f1, 4).alias("score"))


def overall(by_role: DataFrame, model: DataFrame, reqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: coverages over all roles and their harmonic mean."""
    n = model.agg(F.count(F.lit(1)).alias("n_model")).select("n_model", F.lit(1).alias("k"))
    r = reqs.agg(F.count(F.lit(1)).alias("n_req")).select("n_req", F.lit(1).alias("k"))
    h = pairs.agg(F.countDistinct("role", "x").alias("_x"), F.countDistinct("role", "y").alias("_y")).select("_x", "_y", F.lit(1).alias("k"))
    mc, rc = F.col("_x") / F.col("n_model"), F.col("_y") / F.col("n_req")
    f1 = F.when(mc + rc > 0, 2 * mc * rc / (mc + rc)).otherwise(0.0)
    return n.join(r, "k").join(h, "k").select("n_model", "n_req", F.round(mc, 4).alias("model_coverage"), F.round(rc, 4).alias("req_coverage"), F.round(f1, 4).alias("semantic_match"))


def confidence(model: DataFrame, contexts: DataFrame, satisfied: DataFrame, reqs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(role, e, y, name_score, context_score, via_satisfaction, confidence): pairs of elements and phrases.

    ``model`` (role, e, tokens) by name, ``contexts`` (role, e, tokens) of the neighbourhood, ``satisfied`` (role, e, y)
    with a satisfied model requirement like the phrase. Other pairs need 0.25 name + 0.55 context >= threshold; as no name
    scores more than 1, they are sought by context from (threshold - 0.25) / 0.55, where that is above 0.
    """
    least = (threshold - 0.25) / 0.55 - 1e-9
    left = contexts.withColumnRenamed("e", "x")
    if least > 0:
        pairs = similar_sets(left, reqs, least)
    else:  # a name may be enough
        least = threshold / 0.8 - 1e-9
        pairs = similar_sets(model.withColumnRenamed("e", "x"), reqs, least).unionByName(similar_sets(left, reqs, least))
    pairs = pairs.select("role", F.col("x").alias("e"), "y").unionByName(satisfied.select("role", "e", "y")).distinct()
    got = pairs.join(model.withColumnRenamed("tokens", "_n"), ["role", "e"]).join(contexts.withColumnRenamed("tokens", "_c"), ["role", "e"]).join(reqs.withColumnRenamed("tokens", "_r"), ["role", "y"])
    got = got.join(satisfied.withColumn("_s", F.lit(1.0)), ["role", "e", "y"], "left")
    name, ctx, sat = jaccard(F.col("_n"), F.col("_r")), jaccard(F.col("_c"), F.col("_r")), F.coalesce("_s", F.lit(0.0))
    out = got.select("role", "e", "y", name.alias("name_score"), ctx.alias("context_score"), (sat > 0).alias("via_satisfaction"), (0.25 * name + 0.55 * ctx + 0.20 * sat).alias("confidence"))
    return out.filter(F.col("confidence") >= threshold)


def explicit_allocations(items: DataFrame, elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(item, req_id, element, element_type, link_type): design elements that trace to an item's requirement by id.

    Ids are compared in normal form; an item whose id isn't in the model is looked up once more without a split
    suffix; of several model requirements with an id the last counts; sources that are requirements are left out.
    """
    is_req = F.lower(F.coalesce("stereotype", F.lit(""))).contains("requirement") | (F.coalesce("req_id", F.lit("")) != "")
    model = elements.filter(is_req & (F.coalesce("req_id", F.lit("")) != "")).withColumn("key", normal_req_id(F.col("req_id")))
    model = model.groupBy("key").agg(F.max_by("xmi_id", "ord").alias("target_id"))
    k = items.withColumn("key", normal_req_id(F.col("req_id"))).withColumn("base", F.regexp_replace("key", r"-\d+\z", ""))
    direct = k.join(model, "key", "left")
    spare = model.select(F.col("key").alias("base"), F.col("target_id").alias("_t2"))
    found = direct.join(spare, "base", "left").select("item", "req_id", F.coalesce("target_id", F.when(F.col("base") != F.col("key"), F.col("_t2"))).alias("target_id")).filter("target_id IS NOT NULL")
    links = relations.filter(F.col("rel_type").isin(*vocab.TRACE_LINKS)).select("source_id", "target_id", F.col("rel_type").alias("link_type"))
    src = elements.filter(F.lower(F.coalesce("stereotype", F.lit(""))) != "requirement").select(F.col("xmi_id").alias("source_id"), F.col("name").alias("element"), kind_or_type().alias("element_type"))
    return found.join(links, "target_id").join(src, "source_id").select("item", "req_id", "source_id", "element", "element_type", "link_type")


def kind_or_type() -> Column:
    return F.coalesce(F.nullif(F.col("stereotype"), F.lit("")), F.col("element_type"))


def orphan_elements(elements: DataFrame, relations: DataFrame, matched_names: DataFrame | None = None) -> DataFrame:
    """(xmi_id, name, type, package): named design elements without any trace relation or match."""
    st = F.lower(F.coalesce("stereotype", F.lit("")))
    e = elements.filter(~st.isin("requirement", "package") & (F.coalesce("name", F.lit("")) != "") & F.lower(kind()).isin(*vocab.ORPHAN_KINDS))
    traced = relations.filter(F.col("rel_type").isin(*vocab.TRACE_LINKS)).select(F.col("source_id").alias("xmi_id")).distinct()
    e = e.join(traced, "xmi_id", "left_anti")
    if matched_names is not None:
        e = e.join(matched_names.select("name").distinct(), "name", "left_anti")
    return e.select("xmi_id", "name", kind_or_type().alias("type"), "package")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``n`` from 1 in the given order, without a single-task window: range partitions, then their offsets."""
    from reqloom.session import Scratch

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = Scratch(df.sparkSession, "numbered").put(sorted_.withColumn("_id", F.monotonically_increasing_id()), "rows")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    sizes = kept.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row for each partition
    offset, rows = 0, []
    for s in sizes:
        rows.append((s.p, offset))
        offset += s["count"]
    offsets = df.sparkSession.createDataFrame(rows, "p long, o long")
    return kept.withColumn("p", part).join(F.broadcast(offsets), "p").withColumn("n", F.col("o") + row + 1).drop("p", "o", "_id")
