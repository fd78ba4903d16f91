"""Queries on matches, vectors, system models and traceability, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reqloom.functions import vocab
from reqloom.operators import model as m
from reqloom.operators import similarity as sim
from reqloom.operators import trace
from reqloom.operators.quality import gate_issues
from reqloom.plans import text_sql as sql
from reqloom.plans.text_queries import elems, statements
from reqloom.session import Scratch, table

LIMIT = 0.6
CANDIDATES = 3


def _elements(spark, d):
    return m.clean_elements(table(spark, d, "v1_elements"))


def _relations(spark, d):
    return m.clean_relations(table(spark, d, "v1_relations"))


def _set_phrases(spark, d, key, roles=("SUBJECT", "OBJECT"), stop=vocab.SET_STOP):
    return trace.phrases(elems(spark, d).filter(F.col("role").isin(*roles)), "role", F.col("text"), key, stop)


def q_jaccard_pairs(spark, d):
    x = _set_phrases(spark, d, "x")
    p = sim.similar_sets(x, x.withColumnRenamed("x", "y"), LIMIT, ordered=True)
    return p.select("role", "x", "y", F.round("score", 4).alias("score"))


def q_lexical_pairs(spark, d):
    e = elems(spark, d).filter(F.col("role").isin("SUBJECT", "OBJECT"))
    # read several times, and costly to extract
    x = Scratch(spark, "phrases").put(trace.ordered_phrases(e, "role", F.col("text"), "x", vocab.SET_STOP), "phrases")
    p = sim.similar_phrases(x, x.withColumnRenamed("x", "y"), LIMIT, ordered=True)
    return p.select("role", "x", "y", F.round("score", 4).alias("score"))


def _matches(spark, d):
    ok = table(spark, d, "connections").filter((F.col("score") >= LIMIT) & F.col("a").isNotNull() & F.col("b").isNotNull())
    req = lambda c: F.split(c, "/")[0]
    return ok.withColumns({"req_a": req(F.col("a")), "req_b": req(F.col("b"))}).filter("req_a <> req_b")


def q_dedup_pairs(spark, d):
    best = F.max(F.struct("score", (-F.col("conn_id")).alias("i"), "a", "b")).alias("x")
    return _matches(spark, d).groupBy("req_a", "req_b", "role").agg(best).select("req_a", "req_b", "role", F.col("x.score").alias("score"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def q_entities(spark, d):
    ends = _matches(spark, d).select(F.explode(F.array("a", "b")).alias("elem"))
    return ends.groupBy("elem").agg(F.count(F.lit(1)).alias("degree"))


def q_top_connections(spark, d):
    return _matches(spark, d).orderBy(F.desc("score"), "conn_id").limit(30).select("conn_id", "a", "b", "score")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") % 2).alias("side"))


def q_duplicates(spark, d):
    return sim.similar_vectors(_vectors(spark, d), 0.9).orderBy(F.desc("score"), "a", "b").select("a", "b", F.round("score", 3).alias("score"))


def q_conflicts(spark, d):
    return sim.similar_vectors(_vectors(spark, d), 0.8, differ="side").orderBy(F.desc("score"), "a", "b").select("a", "b", F.round("score", 3).alias("score"))


def q_alike_vectors(spark, d):
    """Pairs at a threshold that the vectors of these tables do reach."""
    return sim.similar_vectors(_vectors(spark, d), 0.4).select("a", "b", F.round("score", 3).alias("score"))


def q_opposed_vectors(spark, d):
    return sim.similar_vectors(_vectors(spark, d), 0.4, differ="side").select("a", "b", F.round("score", 3).alias("score"))


def q_similarity(spark, d):
    """Rows whose id is divisible by 20 against all rows: the best other one of each."""
    v = _vectors(spark, d).withColumn("u", sim.unit(F.col("v"))).select("id", "u")
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("a"), F.col("u").alias("ua"))
    # every asked row meets each block of all rows; blocks grow in number, not in size
    blocks = max(16, v.count() // 50_000)
    left = asked.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = v.withColumn("blk", F.pmod("id", F.lit(blocks)).cast("int")).join(left, "blk").filter("id <> a")
    best = pairs.groupBy("a").agg(F.max(sim.dot(F.col("ua"), F.col("u"))).alias("score"))
    return best.select("a", F.round("score", 4).alias("score"))


def q_map_role(spark, d):
    return table(spark, d, "v1_elements").select("ord", m.map_role(F.col("element_type"), F.col("stereotype")).alias("mapped"))


def q_rel_type(spark, d):
    return table(spark, d, "v1_relations").select("ord", m.relation_type(F.col("rel_type")).alias("verb"))


def q_type_counts(spark, d):
    return _elements(spark, d).groupBy(m.kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def q_rel_counts(spark, d):
    return m.relation_counts(_elements(spark, d), _relations(spark, d))


def q_packages(spark, d):
    return _elements(spark, d).filter("package <> ''").groupBy("package").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"))


def q_merge(spark, d):
    return _elements(spark, d).select("ord", "xmi_id", "name")


def _bfs(hops):
    def run(spark, d):
        return m.neighbours(_elements(spark, d), _relations(spark, d), hops).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("hop").alias("far"))

    return run


def q_subclass(spark, d):
    return m.resolve_upwards(_elements(spark, d), _relations(spark, d))


_V2_ROLES = ("SUBJECT", "PROCESS", "OBJECT", "CONDITION")


def _sides(spark, d):
    e = _elements(spark, d).filter(F.col("role").isin(*_V2_ROLES) & (F.col("name") != ""))
    return trace.phrases(e, "role", trace.camel_words(F.col("name")), "x"), _set_phrases(spark, d, "y", _V2_ROLES, vocab.MODEL_STOP)


def _v2_pairs(spark, d):
    return sim.similar_sets(*_sides(spark, d), LIMIT)


def _v2_written(spark, d):
    """Both sides and their pairs, written, for queries that read them several times."""
    scratch = Scratch(spark, "v2")
    a, b = (scratch.put(side, "side") for side in _sides(spark, d))
    return a, b, scratch.put(sim.similar_sets(a, b, LIMIT), "pairs")


def q_v2_best(spark, d):
    return trace.best_matches(_v2_pairs(spark, d), "x", "y").select("role", "x", "y", F.round("score", 4).alias("score"))


def q_v2_top(spark, d):
    """The best matches over all roles, best first."""
    best = trace.best_matches(_v2_pairs(spark, d), "x", "y")
    return best.orderBy(F.desc("score"), "role", "x", "y").limit(30).select("role", "x", "y", F.round("score", 4).alias("score"))


def q_v2_breakdown(spark, d):
    return trace.coverage(*_v2_written(spark, d))


def q_v2_overall(spark, d):
    return trace.overall(None, *_v2_written(spark, d))


def q_v2_unmatched(spark, d):
    a, b, p = _v2_written(spark, d)
    return a.join(p, ["role", "x"], "left_anti").select(F.lit("model").alias("side"), "role", F.col("x").alias("phrase")).unionByName(b.join(p, ["role", "y"], "left_anti").select(F.lit("requirement").alias("side"), "role", F.col("y").alias("phrase")))


def _v1_sides(spark, d):
    e = _elements(spark, d).filter(F.col("role").isin(*_V2_ROLES) & (F.col("name") != ""))
    rel = _relations(spark, d)
    words = lambda c: F.array_sort(F.array_distinct(trace.normal_words(c, vocab.MODEL_STOP)))
    names = e.select("role", F.col("xmi_id").alias("e"), words(trace.camel_words(F.col("name"))).alias("tokens")).filter(F.size("tokens") > 0)
    line = F.concat_ws(" ", trace.camel_words(F.col("name")), "doc", "req_text")
    # a context holds the words of the element and of its neighbours; hubs have many, a set keeps each once
    texts = _elements(spark, d).select(F.col("xmi_id").alias("node"), words(line).alias("w"))
    ctx = m.context_sets(texts, m.undirected(_elements(spark, d), rel), 2).withColumnRenamed("node", "e")
    ctx = e.select("role", F.col("xmi_id").alias("e")).join(ctx, "e").select("role", "e", "tokens").filter(F.size("tokens") > 0)
    reqs = Scratch(spark, "v1").put(_set_phrases(spark, d, "y", _V2_ROLES, vocab.MODEL_STOP), "phrases")
    told = _elements(spark, d).filter("lower(stereotype) = 'requirement' AND req_text <> ''").select(F.col("xmi_id").alias("target_id"), words(F.col("req_text")).alias("tokens"))
    sat = rel.filter("rel_type IN ('satisfy', 'refine')").join(told, "target_id").join(e.select(F.col("xmi_id").alias("source_id"), "role"), "source_id")
    sat = sim.similar_sets(sat.select("role", F.col("source_id").alias("x"), "tokens").distinct(), reqs, 0.5).select("role", F.col("x").alias("e"), "y").distinct()
    scratch = Scratch(spark, "v1")
    return tuple(scratch.put(t, "side") for t in (names, ctx, sat)) + (reqs,)


def q_v1_conf(spark, d):
    got = trace.confidence(*_v1_sides(spark, d))
    return got.select("role", "e", "y", F.round("confidence", 4).alias("confidence"), "via_satisfaction")


def q_v1_breakdown(spark, d):
    sides = _v1_sides(spark, d)
    pairs = Scratch(spark, "v1").put(trace.confidence(*sides), "pairs")
    return trace.coverage(sides[0].withColumnRenamed("e", "x"), sides[3], pairs.withColumnRenamed("e", "x"))


def q_v1_overall(spark, d):
    sides = _v1_sides(spark, d)
    pairs = Scratch(spark, "v1").put(trace.confidence(*sides), "pairs")
    return trace.overall(None, sides[0].withColumnRenamed("e", "x"), sides[3], pairs.withColumnRenamed("e", "x"))


def q_mappings(spark, d):
    best = trace.best_matches(_v2_pairs(spark, d), "x", "y")
    return best.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def _items(spark, d):
    return table(spark, d, "trace_items").select(F.col("item_id").alias("item"), "req_id", F.col("req_text").alias("text"))


def _explicit(spark, d):
    return trace.explicit_allocations(_items(spark, d).select("item", "req_id"), _elements(spark, d), _relations(spark, d))


def q_allocations(spark, d):
    return _explicit(spark, d).select("item", "source_id", "element", "element_type", "link_type")


def _status(spark, d):
    ex = _explicit(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("n_explicit"))
    inferred = F.size(F.filter("allocations", lambda x: ~x["explicit"] & (x["confidence"] >= 0.5)))
    base = table(spark, d, "trace_items").select(F.col("item_id").alias("item"), F.coalesce(F.when(F.col("allocations").isNotNull(), inferred), F.lit(0)).cast("long").alias("n_inferred"), F.col("req_text").alias("text"))
    t = base.join(ex, "item", "left").withColumn("n_explicit", F.coalesce("n_explicit", F.lit(0).cast("long")))
    st = F.when(F.col("n_explicit") > 0, "Verified").when(F.col("n_inferred") > 0, "Candidate").otherwise("Gap")
    passes = F.size(gate_issues(F.coalesce("text", F.lit("")))) == 0
    return t.select("item", "n_explicit", F.least("n_inferred", F.lit(CANDIDATES)).alias("n_candidates"), st.alias("status"), passes.alias("quality_pass"))


def q_rvtm(spark, d):
    return _status(spark, d)


def q_candidates(spark, d):
    a = table(spark, d, "trace_items").select("item_id", F.posexplode("allocations").alias("i", "x")).filter("NOT x.explicit AND x.confidence >= 0.5")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("x.confidence"), "i"))
    return a.withColumn("place", rank.cast("long")).filter(F.col("place") <= CANDIDATES).select("item_id", "place", F.col("x.element").alias("element"), F.col("x.confidence").alias("confidence"))


def q_link_types(spark, d):
    a = F.col("allocations")
    links = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda x: x["link_type"]), lambda x: x.isNotNull()))), ",")
    return table(spark, d, "trace_items").select("item_id", F.coalesce(F.array_max(F.transform(a, lambda x: x["confidence"])), F.lit(0.0)).alias("best"), F.coalesce(links, F.lit("")).alias("links"))


def q_orphans(spark, d):
    return trace.orphan_elements(_elements(spark, d), _relations(spark, d))


def _findings(spark, d):
    s = _status(spark, d)
    gap = s.filter("status = 'Gap'").select(F.lit(1).alias("k"), "item", F.lit(0).alias("i"), F.lit("high").alias("severity"), F.lit("traceability").alias("category"), F.col("item").cast("string").alias("subject"))
    cand = s.filter("status = 'Candidate'").select(F.lit(1).alias("k"), "item", F.lit(0).alias("i"), F.lit("medium").alias("severity"), F.lit("traceability").alias("category"), F.col("item").cast("string").alias("subject"))
    qual = s.filter("NOT quality_pass").select(F.lit(1).alias("k"), "item", F.lit(1).alias("i"), F.lit("medium").alias("severity"), F.lit("quality").alias("category"), F.col("item").cast("string").alias("subject"))
    orph = q_orphans(spark, d).join(_elements(spark, d).select("xmi_id", F.col("ord").alias("item")), "xmi_id").select(F.lit(2).alias("k"), "item", F.lit(0).alias("i"), F.lit("low").alias("severity"), F.lit("orphan").alias("category"), F.col("name").alias("subject"))
    return gap.unionByName(cand).unionByName(qual).unionByName(orph)


def q_findings(spark, d):
    n = trace.numbered(_findings(spark, d), "k", "item", "i")
    return n.select(F.format_string("%s-%03d", F.upper(F.substring("category", 1, 4)), F.col("n")).alias("finding_id"), "severity", "category", "subject")


def q_severities(spark, d):
    return _findings(spark, d).groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))


def q_rollups(spark, d):
    one = lambda c: F.sum(c.cast("long"))
    st = F.col("status")
    t = _status(spark, d).agg(F.count(F.lit(1)).alias("n"), one(st == "Verified").alias("verified"), one(st == "Candidate").alias("candidate"), one(st == "Gap").alias("gap"), one(F.col("quality_pass")).alias("quality_ok"), one((st == "Verified") & F.col("quality_pass")).alias("ready"))
    part = lambda c: F.round(F.col(c) / F.col("n"), 4)
    return t.select("n", "verified", "candidate", "gap", "quality_ok", part("verified").alias("explicit_trace_rate"), F.round((F.col("verified") + F.col("candidate")) / F.col("n"), 4).alias("trace_completeness"), part("ready").alias("verification_readiness"))


QUERIES = {
    "q_jaccard_pairs": q_jaccard_pairs, "q_lexical_pairs": q_lexical_pairs, "q_dedup_pairs": q_dedup_pairs, "q_entities": q_entities, "q_top_connections": q_top_connections,
    "q_duplicates": q_duplicates, "q_conflicts": q_conflicts, "q_alike_vectors": q_alike_vectors, "q_opposed_vectors": q_opposed_vectors, "q_v2_top": q_v2_top, "q_similarity": q_similarity, "q_map_role": q_map_role, "q_rel_type": q_rel_type,
    "q_type_counts": q_type_counts, "q_rel_counts": q_rel_counts, "q_packages": q_packages, "q_merge": q_merge, "q_bfs_1hop": _bfs(1), "q_bfs_2hop": _bfs(2),
    "q_subclass": q_subclass, "q_v2_best": q_v2_best, "q_v2_breakdown": q_v2_breakdown, "q_v2_overall": q_v2_overall, "q_v2_unmatched": q_v2_unmatched,
    "q_v1_conf": q_v1_conf, "q_v1_breakdown": q_v1_breakdown, "q_v1_overall": q_v1_overall, "q_mappings": q_mappings, "q_allocations": q_allocations, "q_rvtm": q_rvtm,
    "q_candidates": q_candidates, "q_link_types": q_link_types, "q_orphans": q_orphans, "q_findings": q_findings, "q_severities": q_severities, "q_rollups": q_rollups,
}

_OKM = f"""ok AS (SELECT *, split_part(a, '/', 1) AS req_a, split_part(b, '/', 1) AS req_b FROM connections WHERE score >= {LIMIT} AND a IS NOT NULL AND b IS NOT NULL),
    mt AS (SELECT * FROM ok WHERE req_a <> req_b)"""
_VERB = "CASE WHEN {l} = '' THEN 'association' " + " ".join(f"WHEN {{l}} = '{k}' THEN '{v}'" for k, v in vocab.RELATION_EXACT.items()) + " " + " ".join(f"WHEN contains({{l}}, '{k}') THEN '{v}'" for k, v in vocab.RELATION_HINTS) + " ELSE {l} END"
_VERB = _VERB.replace("{l}", "lower(trim(coalesce(rel_type, '')))")
_ROLE = "CASE " + " ".join(f"WHEN st IN ({', '.join(map(repr, n))}) THEN '{r}'" for r, n in vocab.STEREOTYPE_ROLES.items()) + f" WHEN st IN {vocab.RELATION_STEREOTYPES} THEN 'CONSTRAINT' " + " ".join(f"WHEN contains(st, '{n}') THEN '{r}'" for n, r in vocab.STEREOTYPE_HINTS) + " " + " ".join("WHEN " + " OR ".join(f"contains(ut, '{x}')" for x in n) + f" THEN '{r}'" for n, r in vocab.UML_HINTS) + " ELSE 'SUBJECT' END"
_KIND = "coalesce(nullif(stereotype, ''), split_part(coalesce(element_type, ''), ':', -1))"
_MODEL = f"""el AS (SELECT * REPLACE (trim(xmi_id) AS xmi_id) FROM v1_elements QUALIFY trim(xmi_id) IS NULL OR trim(xmi_id) = '' OR row_number() OVER (PARTITION BY trim(xmi_id) ORDER BY ord) = 1),
    rl AS (SELECT ord, trim(source_id) AS source_id, trim(target_id) AS target_id, {_VERB} AS rel_type FROM v1_relations),
    st AS (SELECT DISTINCT u, v FROM (SELECT source_id AS u, target_id AS v FROM rl UNION ALL SELECT target_id, source_id FROM rl) WHERE u <> v AND u IN (SELECT xmi_id FROM el) AND v IN (SELECT xmi_id FROM el))"""
_TOK = lambda c, stop: f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w NOT IN ({', '.join(map(repr, stop))}))))"
_SCORE = "len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"
_V2 = f"""ma AS (SELECT DISTINCT role, {_TOK("regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')", vocab.MODEL_STOP)} AS t FROM el WHERE role IN {_V2_ROLES} AND name <> ''),
    mb AS (SELECT DISTINCT role, {_TOK('elem', vocab.MODEL_STOP)} AS t FROM elems WHERE role IN {_V2_ROLES}),
    sa AS (SELECT role, t, array_to_string(t, ' ') AS x FROM ma WHERE len(t) > 0), sb AS (SELECT role, t, array_to_string(t, ' ') AS y FROM mb WHERE len(t) > 0),
    pr AS (SELECT a.role, x, y, {_SCORE} AS score FROM sa a JOIN sb b ON a.role = b.role AND list_has_any(a.t, b.t) WHERE {_SCORE} >= {LIMIT})"""
_WV2 = f"{sql.WITH}, {_MODEL}, {_V2}"
_NORM = rf"regexp_replace(upper(coalesce(req_id, '')), '[{sql.SPACE}_]+', '', 'g')"
_EXPL = f"""mq AS (SELECT {_NORM} AS key, arg_max(xmi_id, ord) AS target_id FROM el WHERE coalesce(req_id, '') <> '' GROUP BY 1),
    it AS (SELECT item_id AS item, req_id, {_NORM} AS key, regexp_replace({_NORM}, '-\\d+$', '') AS base FROM trace_items),
    fo AS (SELECT item, coalesce(p.target_id, CASE WHEN base <> it.key THEN s.target_id END) AS target_id FROM it LEFT JOIN mq p ON p.key = it.key LEFT JOIN mq s ON s.key = it.base),
    ex AS (SELECT item, r.source_id, e.name AS element, coalesce(nullif(e.stereotype, ''), e.element_type) AS element_type, r.rel_type AS link_type
        FROM fo JOIN rl r ON r.target_id = fo.target_id AND r.rel_type IN {vocab.TRACE_LINKS} JOIN el e ON e.xmi_id = r.source_id AND lower(coalesce(e.stereotype, '')) <> 'requirement'),
    sx AS (SELECT t.item_id AS item, (SELECT count(*) FROM ex WHERE ex.item = t.item_id) AS n_explicit,
        coalesce(len(list_filter(allocations, lambda x: NOT x.explicit AND x.confidence >= 0.5)), 0) AS ni, {sql.issues("coalesce(req_text, '')")} = '' AS quality_pass FROM trace_items t),
    ss AS (SELECT item, n_explicit, least(ni, {CANDIDATES}) AS n_candidates, CASE WHEN n_explicit > 0 THEN 'Verified' WHEN ni > 0 THEN 'Candidate' ELSE 'Gap' END AS status, quality_pass FROM sx),
    oe AS (SELECT ord, xmi_id, name, coalesce(nullif(stereotype, ''), element_type) AS type, package FROM el WHERE lower(coalesce(stereotype, '')) NOT IN ('requirement', 'package') AND coalesce(name, '') <> ''
        AND lower({_KIND}) IN {vocab.ORPHAN_KINDS} AND xmi_id NOT IN (SELECT source_id FROM rl WHERE source_id IS NOT NULL AND rel_type IN {vocab.TRACE_LINKS})),
    fi AS (SELECT 1 AS k, item, 0 AS i, 'high' AS severity, 'traceability' AS category, CAST(item AS VARCHAR) AS subject FROM ss WHERE status = 'Gap'
        UNION ALL SELECT 1, item, 0, 'medium', 'traceability', CAST(item AS VARCHAR) FROM ss WHERE status = 'Candidate'
        UNION ALL SELECT 1, item, 1, 'medium', 'quality', CAST(item AS VARCHAR) FROM ss WHERE NOT quality_pass
        UNION ALL SELECT 2, ord, 0, 'low', 'orphan', name FROM oe)"""
_WX = f"WITH {_MODEL}, {_EXPL}"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"

ORACLE = {
    "q_jaccard_pairs": f"""{sql.WITH}, p AS (SELECT DISTINCT role, {_TOK('elem', vocab.SET_STOP)} AS t FROM elems WHERE role IN ('SUBJECT', 'OBJECT')),
        s AS (SELECT role, t, array_to_string(t, ' ') AS x FROM p WHERE len(t) > 0)
        SELECT a.role, a.x, b.x AS y, round({_SCORE}, 4) AS score FROM s a JOIN s b ON a.role = b.role AND a.x < b.x AND list_has_any(a.t, b.t) WHERE {_SCORE} >= {LIMIT}""",
    "q_dedup_pairs": f"WITH {_OKM} SELECT req_a, req_b, role, score, a, b FROM mt QUALIFY row_number() OVER (PARTITION BY req_a, req_b, role ORDER BY score DESC, conn_id) = 1",
    "q_entities": f"WITH {_OKM} SELECT elem, count(*) AS degree FROM (SELECT a AS elem FROM mt UNION ALL SELECT b FROM mt) GROUP BY elem",
    "q_top_connections": f"WITH {_OKM} SELECT conn_id, a, b, score FROM mt ORDER BY score DESC, conn_id LIMIT 30",
    "q_duplicates": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 3) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.9",
    "q_conflicts": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 3) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label % 2 <> b.label % 2 WHERE {_COS} >= 0.8",
    "q_alike_vectors": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 3) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4",
    "q_opposed_vectors": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 3) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label % 2 <> b.label % 2 WHERE {_COS} >= 0.4",
    "q_v2_top": f"{_WV2}, b AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY role, x ORDER BY score DESC, y) = 1) SELECT role, x, y, round(score, 4) AS score FROM b ORDER BY b.score DESC, role, x, y LIMIT 30",
    "q_similarity": f"SELECT a.vec_id AS a, round(max({_COS}), 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id",
    "q_map_role": f"WITH x AS (SELECT ord, lower(coalesce(stereotype, '')) AS st, lower(coalesce(element_type, '')) AS ut FROM v1_elements) SELECT ord, {_ROLE} AS mapped FROM x",
    "q_rel_type": f"SELECT ord, {_VERB} AS verb FROM v1_relations",
    "q_type_counts": f"WITH {_MODEL} SELECT {_KIND} AS kind, count(*) AS n FROM el GROUP BY 1",
    "q_rel_counts": f"WITH {_MODEL} SELECT r.rel_type, a.k AS source_kind, b.k AS target_kind, count(*) AS n FROM rl r JOIN (SELECT xmi_id, {_KIND} AS k FROM el) a ON a.xmi_id = r.source_id JOIN (SELECT xmi_id, {_KIND} AS k FROM el) b ON b.xmi_id = r.target_id GROUP BY ALL",
    "q_packages": f"WITH {_MODEL} SELECT package, min(ord) AS first_ord, count(*) AS n FROM el WHERE package <> '' GROUP BY package",
    "q_merge": f"WITH {_MODEL} SELECT ord, xmi_id, name FROM el",
    "q_bfs_1hop": f"WITH {_MODEL} SELECT u AS root, count(*) AS n, CAST(1 AS BIGINT) AS far FROM st GROUP BY u",
    "q_bfs_2hop": f"""WITH {_MODEL}, p AS (SELECT u, v, 1 AS h FROM st UNION ALL SELECT DISTINCT a.u, b.v, 2 FROM st a JOIN st b ON a.v = b.u WHERE a.u <> b.v),
        q AS (SELECT u, v, min(h) AS h FROM p GROUP BY u, v) SELECT u AS root, count(*) AS n, CAST(max(h) AS BIGINT) AS far FROM q GROUP BY u""",
    "q_subclass": f"""WITH RECURSIVE {_MODEL}, up AS (SELECT source_id AS c, min(target_id) AS p FROM rl WHERE rel_type = 'generalization' AND source_id <> '' AND target_id <> '' GROUP BY 1),
        w AS (SELECT xmi_id, xmi_id AS cur, nullif(stereotype, '') AS found, CAST(0 AS BIGINT) AS steps, [xmi_id] AS way FROM el
            UNION ALL SELECT w.xmi_id, up.p, nullif(e.stereotype, ''), w.steps + 1, list_append(way, up.p) FROM w JOIN up ON up.c = w.cur LEFT JOIN el e ON e.xmi_id = up.p
            WHERE w.found IS NULL AND NOT list_contains(way, up.p))
        SELECT xmi_id, found, steps FROM w WHERE found IS NOT NULL""",
    "q_v2_best": f"{_WV2} SELECT role, x, y, round(score, 4) AS score FROM pr QUALIFY row_number() OVER (PARTITION BY role, x ORDER BY score DESC, y) = 1",
    "q_v2_breakdown": f"""{_WV2}, c AS (SELECT role, (SELECT count(*) FROM sa WHERE sa.role = r.role) AS n_model, (SELECT count(*) FROM sb WHERE sb.role = r.role) AS n_req,
            (SELECT count(DISTINCT x) FROM pr WHERE pr.role = r.role) AS hx, (SELECT count(DISTINCT y) FROM pr WHERE pr.role = r.role) AS hy FROM (SELECT role FROM sa UNION SELECT role FROM sb) r),
        g AS (SELECT *, CASE WHEN n_model > 0 THEN hx / n_model ELSE 0.0 END AS mc, CASE WHEN n_req > 0 THEN hy / n_req ELSE 0.0 END AS rc FROM c)
        SELECT role, n_model, n_req, round(mc, 4) AS model_coverage, round(rc, 4) AS req_coverage, CASE WHEN mc + rc > 0 THEN round(2 * mc * rc / (mc + rc), 4) ELSE 0.0 END AS score FROM g""",
    "q_v2_unmatched": f"{_WV2} SELECT 'model' AS side, role, x AS phrase FROM sa WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.role = sa.role AND pr.x = sa.x) UNION ALL SELECT 'requirement', role, y FROM sb WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.role = sb.role AND pr.y = sb.y)",
    "q_mappings": f"{_WV2}, b AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY role, x ORDER BY score DESC, y) = 1) SELECT role, count(*) AS n, round(avg(score), 4) AS mean_score FROM b GROUP BY role",
    "q_allocations": f"{_WX} SELECT item, source_id, element, element_type, link_type FROM ex",
    "q_rvtm": f"{_WX} SELECT * FROM ss",
    "q_candidates": f"""WITH x AS (SELECT item_id, unnest(allocations) AS x, generate_subscripts(allocations, 1) AS i FROM trace_items),
        r AS (SELECT item_id, x.element AS element, x.confidence AS confidence, row_number() OVER (PARTITION BY item_id ORDER BY x.confidence DESC, i) AS place FROM x WHERE NOT x.explicit AND x.confidence >= 0.5)
        SELECT item_id, place, element, confidence FROM r WHERE place <= {CANDIDATES}""",
    "q_link_types": "SELECT item_id, coalesce(list_max(list_transform(allocations, lambda x: x.confidence)), 0.0) AS best, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(allocations, lambda x: x.link_type), lambda x: x IS NOT NULL))), ','), '') AS links FROM trace_items",
    "q_orphans": f"{_WX} SELECT xmi_id, name, type, package FROM oe",
    "q_findings": f"{_WX} SELECT format('{{}}-{{:03d}}', upper(substring(category, 1, 4)), row_number() OVER (ORDER BY k, item, i)) AS finding_id, severity, category, subject FROM fi",
    "q_severities": f"{_WX} SELECT severity, category, count(*) AS n FROM fi GROUP BY ALL",
    "q_rollups": f"""{_WX}, t AS (SELECT count(*) AS n, count(*) FILTER (status = 'Verified') AS verified, count(*) FILTER (status = 'Candidate') AS candidate, count(*) FILTER (status = 'Gap') AS gap,
            count(*) FILTER (quality_pass) AS quality_ok, count(*) FILTER (quality_pass AND status = 'Verified') AS ready FROM ss)
        SELECT n, verified, candidate, gap, quality_ok, round(verified / n, 4) AS explicit_trace_rate, round((verified + candidate) / n, 4) AS trace_completeness, round(ready / n, 4) AS verification_readiness FROM t""",
}
