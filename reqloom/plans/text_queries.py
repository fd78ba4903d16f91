"""Queries on requirement statements (sample_reqs), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqloom.functions import grammar, vocab
from reqloom.functions.text import escape_dot, escape_mermaid, escape_turtle, escape_xml, is_blank, normal_req_id, normal_text, safe_name, strip
from reqloom.operators import quality as q
from reqloom.operators import export, split, tiling
from reqloom.operators.extract import extract
from reqloom.plans import text_sql as sql
from reqloom.session import spread, table


def statements(spark, d):
    return spread(table(spark, d, "sample_reqs").filter(~is_blank(F.col("text"))).select("ord", "id", "text"))


def tiled(spark, d):
    return extract(statements(spark, d))


def terms(spark, d):
    return tiling.terminals(tiled(spark, d))


def elems(spark, d):
    return tiling.elements(terms(spark, d)).withColumn("text", strip(F.col("text")))


def q_flat_table(spark, d):
    return q.flat_table(tiled(spark, d), ["ord", "id", "text"])


def _role(role, *cols):
    def run(spark, d):
        return terms(spark, d).filter(F.col("role") == role).select("ord", "pos", "text", *cols)

    return run


def _post(spark, d):
    return terms(spark, d).filter("role = 'CONDITION' AND kind = 'post-condition'").select("ord", "pos", "text", "marker")


def q_function_type(spark, d):
    return extract(statements(spark, d)).select("ord", "function_type")


def q_action_split(spark, d):
    return tiling.action_numbers(terms(spark, d)).groupBy("ord", F.col("action").cast("long").alias("action")).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x")).select("ord", "action", F.array_join(F.transform("x", lambda e: e["text"]), " / ").alias("core"))


def q_process_object(spark, d):
    return tiling.action_numbers(terms(spark, d)).select("ord", "pos", "role", "text", F.col("action").cast("long").alias("action"))


def _tiles(spark, d):
    wide = {c: F.col(c).cast("long") for c in ("pos", "start", "end")}
    return terms(spark, d).select("ord", wide["pos"].alias("pos"), "node_id", "role", "text", wide["start"].alias("from_"), wide["end"].alias("to_"))


def q_generate(spark, d):
    return tiled(spark, d).select("ord", tiling.generated(F.col("text"), F.col("tiles")).alias("text"))


def q_roundtrip(spark, d):
    ok = (tiling.generated(F.col("text"), F.col("tiles")) == F.col("text")).cast("long")
    return tiled(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_ok"))


def roundtrip_all_text_tables(spark, d):
    """Every text of every table comes back from its tiles unchanged."""
    texts = statements(spark, d).select(F.lit("sample_reqs").alias("source"), "text")
    for name, col in (("trace_items", "req_text"), ("documents", "text"), ("shared_elements", "text")):
        texts = texts.unionByName(table(spark, d, name).filter(F.col(col).isNotNull()).select(F.lit(name).alias("source"), F.col(col).alias("text")))
    t = extract(texts)
    ok = (tiling.generated(F.col("text"), F.col("tiles")) == F.col("text")).cast("long")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_ok"))


def q_nodes(spark, d):
    return tiling.nodes(tiled(spark, d))


def q_edges(spark, d):
    return tiling.edges(tiled(spark, d))


def q_next_chain(spark, d):
    return q_edges(spark, d).filter("rel = 'NEXT'").select("ord", "src", "dst")


def q_actions(spark, d):
    return tiling.action_numbers(terms(spark, d)).groupBy("ord").agg(F.max("action").alias("n_actions"), F.count(F.lit(1)).alias("n_core"))


def q_operator(spark, d):
    return tiling.actions(tiled(spark, d)).select("ord", "n_actions", F.coalesce("operator", F.lit("")).alias("operator"))


def q_verify(spark, d):
    base = tiled(spark, d)
    bad = tiling.integrity_errors(tiling.nodes(base), tiling.edges(base), tiling.terminals(base).select("ord", "pos", "node_id"))
    return bad.agg(F.count(F.lit(1)).alias("n_errors"))


def q_out_edges(spark, d):
    return q_edges(spark, d).groupBy("ord", "src").agg(F.count(F.lit(1)).alias("n_out"))


def q_split(spark, d):
    return split.split_statements(statements(spark, d).select("ord", "id", "text"))


def q_parse_many(spark, d):
    parts = split.split_statements(statements(spark, d))
    return tiling.elements(tiling.terminals(extract(parts.withColumn("key", F.struct("ord", "part"))), "key")).select("key.ord", "key.part", "pos", "role", "text")


def q_author(spark, d):
    slots = {r: F.get(q.role_list(F.col("tiles"), F.col("text"), r), F.lit(0)) for r in vocab.ELEMENT_ROLES}
    return tiled(spark, d).select("ord", split.compose(slots).alias("text"))


def q_kpis(spark, d):
    return q.kpis(tiled(spark, d))


def q_weak_words(spark, d):
    return statements(spark, d).select("ord", F.array_join(q.weak_words(F.col("text")), ", ").alias("weak_words"))


def q_smells(spark, d):
    return statements(spark, d).select("ord", *(c.alias(n) for n, c in q.smells(F.col("text")).items()))


def q_type(spark, d):
    return statements(spark, d).select("ord", q.requirement_type(F.col("text")).alias("type"))


def q_ears(spark, d):
    return extract(statements(spark, d)).select("ord", q.ears_pattern(F.col("claims")).alias("ears_pattern"))


def q_method(spark, d):
    return statements(spark, d).select("ord", q.verification_method(F.col("text")).alias("method"))


def q_gate(spark, d):
    issues = q.gate_issues(F.col("text"))
    return statements(spark, d).select("ord", (F.size(issues) == 0).alias("passes"), F.array_join(issues, "; ").alias("issues"))


def q_polarity(spark, d):
    return statements(spark, d).select("ord", q.negated(F.col("text")).alias("negated"))


def q_role_counts(spark, d):
    return elems(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"))


def q_element_samples(spark, d):
    first = F.min(F.struct("ord", "pos", F.substring("text", 1, 50).alias("t")))
    return elems(spark, d).groupBy("role").agg(first.alias("x")).select("role", F.col("x.t").alias("sample"))


def q_norm_tokens(spark, d):
    return elems(spark, d).select("ord", "pos", normal_text(F.col("text")).alias("set_form"), normal_text(F.col("text"), vocab.MODEL_STOP).alias("model_form"))


def q_safe_ids(spark, d):
    return table(spark, d, "sample_reqs").select("ord", safe_name(F.coalesce("id", F.lit("")), "r_", "req").alias("safe"), normal_req_id(F.col("id")).alias("norm"))


def q_escape(spark, d):
    c = F.col("text")
    return statements(spark, d).select("ord", escape_xml(c).alias("xml"), escape_turtle(c).alias("turtle"), escape_dot(c).alias("dot"), escape_mermaid(c).alias("mermaid"))


def _export(form):
    def run(spark, d):
        base = tiled(spark, d)
        return export.documents(export.graph_lines(tiling.nodes(base), tiling.edges(base), form), form)

    return run


def q_json_graph(spark, d):
    """Statements whose text comes back from their JSON form."""
    docs = export.as_json(tiled(spark, d))
    back = docs.select("ord", F.from_json("document", f"text string, tiles array<{tiling.TILE}>").alias("g"))
    return back.select("ord", tiling.generated(F.col("g.text"), F.col("g.tiles")).alias("text"))


def q_json_meta(spark, d):
    """Metadata as columns of rows: names and values that are not empty."""
    meta = table(spark, d, "sample_reqs").select("ord", F.explode("meta").alias("name", "value")).filter("value IS NOT NULL AND value <> ''")
    return meta.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


def q_bio_eval(spark, d):
    """Exact spans of the EARS template against those of the default one, per role."""
    one = lambda t: extract(statements(spark, d), t).select("ord", F.explode_outer("claims").alias("x")).filter("x IS NOT NULL").select("ord", "x.start", "x.end", "x.role").distinct()
    keys = ["ord", "start", "end", "role"]
    both = one(grammar.EARS).withColumn("p", F.lit(1)).join(one(grammar.RUPP).withColumn("g", F.lit(1)), keys, "full")
    n = both.groupBy("role").agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_both"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    f1 = F.round(2 * F.col("n_both") / (F.col("n_pred") + F.col("n_gold")), 4).alias("f1")
    return n.select("role", "n_pred", "n_gold", "n_both", ratio("n_both", "n_pred").alias("precision"), ratio("n_both", "n_gold").alias("recall"), f1)


QUERIES = {
    "q_mermaid": _export("mermaid"), "q_dot": _export("dot"), "q_cypher": _export("cypher"), "q_graphml": _export("graphml"), "q_turtle": _export("turtle"),
    "q_json_graph": q_json_graph, "q_json_meta": q_json_meta, "q_bio_eval": q_bio_eval,
    "q_flat_table": q_flat_table, "q_condition": _role("CONDITION", "marker", "kind"), "q_modality": _role("MODALITY", "kind"), "q_subject": _role("SUBJECT"),
    "q_post_condition": _post, "q_constraint": _role("CONSTRAINT", "marker"), "q_function_type": q_function_type, "q_actor": _role("ACTOR"),
    "q_action_split": q_action_split, "q_process_object": q_process_object, "q_tiles": _tiles, "q_generate": q_generate, "q_roundtrip": q_roundtrip,
    "roundtrip_all_text_tables": roundtrip_all_text_tables, "q_nodes": q_nodes, "q_edges": q_edges, "q_next_chain": q_next_chain, "q_actions": q_actions,
    "q_operator": q_operator, "q_verify": q_verify, "q_out_edges": q_out_edges, "q_split": q_split, "q_parse_many": q_parse_many, "q_author": q_author, "q_kpis": q_kpis,
    "q_weak_words": q_weak_words, "q_smells": q_smells, "q_type": q_type, "q_ears": q_ears, "q_method": q_method, "q_gate": q_gate, "q_polarity": q_polarity,
    "q_role_counts": q_role_counts, "q_element_samples": q_element_samples, "q_norm_tokens": q_norm_tokens, "q_safe_ids": q_safe_ids, "q_escape": q_escape,
}

_W = sql.WITH


def _one(role, cols=""):
    return f"{_W} SELECT ord, pos, words AS text{cols} FROM terms WHERE role = '{role}'"


def _joined(role):
    return f"coalesce(string_agg(elem, ' | ' ORDER BY pos) FILTER (role = '{role}'), '') AS {role.lower()}"


def _stop(words):
    return f"lambda w: w NOT IN ({', '.join(repr(w) for w in words)})"


_ALL_ROLES = ", ".join(_joined(r) for r in vocab.ELEMENT_ROLES)
_EDGES = """cnt AS (SELECT ord, count(*) AS n FROM terms GROUP BY ord),
    base AS (SELECT r.ord, coalesce(n, 0) AS n, coalesce(n_actions, 0) AS k FROM reqs r LEFT JOIN cnt c ON c.ord = r.ord LEFT JOIN acts2 a ON a.ord = r.ord),
    steps AS (SELECT ord, n, k, unnest(range(1, k + 1)) AS i FROM base WHERE k > 0),
    edges AS (
        SELECT ord, node_id AS src, nxt AS dst, 'NEXT' AS rel FROM (SELECT *, lead(node_id) OVER (PARTITION BY ord ORDER BY pos) AS nxt FROM terms) WHERE nxt IS NOT NULL
        UNION ALL SELECT t.ord, 'root_' || (n + 1), node_id, 'HAS_' || role FROM terms t JOIN base b ON b.ord = t.ord WHERE role IN ('CONDITION', 'SUBJECT', 'MODALITY')
        UNION ALL SELECT t.ord, CASE WHEN k > 0 THEN 'action_' || (n + 2) ELSE 'root_' || (n + 1) END, node_id, 'HAS_' || role FROM terms t JOIN base b ON b.ord = t.ord WHERE role IN ('ACTOR', 'CONSTRAINT')
        UNION ALL SELECT c.ord, 'action_' || (n + 1 + action), node_id, CASE role WHEN 'PROCESS' THEN 'HAS_PROCESS' ELSE 'ACTS_ON' END FROM core c JOIN base b ON b.ord = c.ord
        UNION ALL SELECT ord, 'root_' || (n + 1), CASE WHEN k = 1 THEN 'action_' || (n + 2) ELSE 'operator_' || (n + 2 + k) END, 'HAS_ACTION' FROM base WHERE k > 0
        UNION ALL SELECT ord, 'operator_' || (n + 2 + k), 'action_' || (n + 1 + i), 'OPERAND' FROM steps WHERE k > 1)"""

ORACLE = {
    "q_json_graph": f"{_W} SELECT ord, text FROM reqs",
    "q_json_meta": "WITH m AS (SELECT unnest(map_entries(meta)) AS e FROM sample_reqs) SELECT e.key AS name, count(*) AS n, count(DISTINCT e.value) AS n_values FROM m WHERE e.value IS NOT NULL AND e.value <> '' GROUP BY 1",
    "q_flat_table": f"""{_W}, ears AS ({sql.EARS}), j AS (SELECT r.ord, {_ALL_ROLES} FROM reqs r LEFT JOIN elems e ON e.ord = r.ord GROUP BY r.ord),
        g AS (SELECT ord, string_agg(words, '' ORDER BY pos) AS t FROM terms GROUP BY ord)
        SELECT r.ord, r.id, r.text, {sql.type_case('r.text')} AS type, ears_pattern, g.t = r.text AS roundtrip_ok, '' AS error, j.* EXCLUDE (ord),
            array_to_string({sql.weak_list('r.text')}, ', ') AS weak_words, {sql.count('r.text', vocab.CONJUNCTION)} > 1 AS non_atomic
        FROM reqs r JOIN ears USING (ord) JOIN j USING (ord) JOIN g USING (ord)""",
    "q_condition": _one("CONDITION", ", marker, kind"), "q_modality": _one("MODALITY", ", kind"), "q_subject": _one("SUBJECT"),
    "q_post_condition": f"{_W} SELECT ord, pos, words AS text, marker FROM terms WHERE role = 'CONDITION' AND kind = 'post-condition'",
    "q_constraint": _one("CONSTRAINT", ", marker"), "q_actor": _one("ACTOR"),
    "q_function_type": f"{_W} SELECT ord, function_type FROM z4",
    "q_action_split": f"{_W} SELECT ord, CAST(action AS BIGINT) AS action, string_agg(words, ' / ' ORDER BY pos) AS core FROM core GROUP BY ord, action",
    "q_process_object": f"{_W} SELECT ord, pos, role, words AS text, CAST(action AS BIGINT) AS action FROM core",
    "q_tiles": f"{_W} SELECT ord, pos, node_id, role, words AS text, s AS from_, e AS to_ FROM terms",
    "q_generate": f"{_W} SELECT ord, text FROM reqs",
    "q_roundtrip": f"{_W} SELECT count(*) AS n, count(*) AS n_ok FROM reqs",
    "roundtrip_all_text_tables": f"""{_W} SELECT 'sample_reqs' AS source, count(*) AS n, count(*) AS n_ok FROM reqs
        UNION ALL SELECT 'trace_items', count(req_text), count(req_text) FROM trace_items
        UNION ALL SELECT 'documents', count(text), count(text) FROM documents UNION ALL SELECT 'shared_elements', count(text), count(text) FROM shared_elements""",
    "q_nodes": f"""{_W}, {_EDGES} SELECT ord, node_id, role, words AS text FROM terms UNION ALL SELECT ord, 'root_' || (n + 1), 'ROOT', '' FROM base
        UNION ALL SELECT ord, 'action_' || (n + 1 + i), 'ACTION', '' FROM steps UNION ALL SELECT ord, 'operator_' || (n + 2 + k), 'OPERATOR', '' FROM base WHERE k > 1""",
    "q_edges": f"{_W}, {_EDGES} SELECT ord, src, dst, rel FROM edges",
    "q_next_chain": f"{_W}, {_EDGES} SELECT ord, src, dst FROM edges WHERE rel = 'NEXT'",
    "q_actions": f"{_W} SELECT ord, CAST(max(action) AS BIGINT) AS n_actions, count(*) AS n_core FROM core GROUP BY ord",
    "q_operator": f"{_W} SELECT ord, n_actions, coalesce(operator, '') AS operator FROM acts2",
    "q_verify": "SELECT CAST(0 AS BIGINT) AS n_errors",
    "q_out_edges": f"{_W}, {_EDGES} SELECT ord, src, count(*) AS n_out FROM edges GROUP BY ord, src",
    "q_kpis": f"""{_W}, s AS (SELECT ord, count(*) AS n_elements, sum(e - s) AS chars, min_by(kind, pos) FILTER (role = 'MODALITY') AS kind FROM elems GROUP BY ord)
        SELECT r.ord, coalesce(n_elements, 0) AS n_elements, round(100.0 * coalesce(chars, 0) / length(text), 1)::DOUBLE AS coverage_pct,
            greatest(0, 100 - 20 * ({' + '.join(f'CAST({sql.flag("text", p)} AS INT)' for p in (vocab.PASSIVE, vocab.VAGUE))} + CAST(NOT {sql.flag('text', vocab.ANY_MODAL)} AS INT)
                + CAST({sql.count('text', vocab.CONJUNCTION)} > 1 AS INT) + CAST({sql.count('text', vocab.COUNTED_MODAL)} > 1 AS INT)) - 10 * len({sql.weak_list('text')}))::BIGINT AS quality_score,
            coalesce(kind, 'none') AS obligation, coalesce(n_actions, 0) AS n_actions, coalesce(operator, '') AS operator,
            len(list_filter(regexp_split_to_array(text, '[{sql.SPACE}]+'), lambda w: w <> '')) AS n_words
        FROM reqs r LEFT JOIN s ON s.ord = r.ord LEFT JOIN acts2 a ON a.ord = r.ord""",
    "q_author": f"""{_W}, f AS (SELECT r.ord, {', '.join(f"coalesce(min_by(elem, pos) FILTER (role = '{r}'), '') AS c_{r.lower()}" for r in vocab.ELEMENT_ROLES)} FROM reqs r LEFT JOIN elems e ON e.ord = r.ord GROUP BY r.ord),
        l AS (SELECT ord, concat_ws(' ', CASE WHEN c_condition <> '' THEN CASE WHEN right(c_condition, 1) = ',' THEN c_condition ELSE c_condition || ',' END END,
            {', '.join(f"nullif(c_{r.lower()}, '')" for r in vocab.ROLES if r in vocab.ELEMENT_ROLES and r != "CONDITION")}) AS t FROM f)
        SELECT ord, CASE WHEN right(t, 1) IN ('.', '!', '?') THEN t ELSE t || '.' END AS text FROM l""",
    "q_weak_words": f"{_W} SELECT ord, array_to_string({sql.weak_list('text')}, ', ') AS weak_words FROM reqs",
    "q_smells": f"""{_W} SELECT ord, {sql.flag('text', vocab.PASSIVE)} AS passive_voice, NOT {sql.flag('text', vocab.ANY_MODAL)} AS missing_modality, {sql.flag('text', vocab.VAGUE)} AS vague_quantifier,
        {sql.count('text', vocab.CONJUNCTION)} > 1 AS non_atomic, {sql.count('text', vocab.COUNTED_MODAL)} > 1 AS compound_requirement FROM reqs""",
    "q_type": f"{_W} SELECT ord, {sql.type_case('text')} AS type FROM reqs",
    "q_ears": f"{_W} {sql.EARS}",
    "q_method": f"{_W} SELECT ord, {sql.method_case('text')} AS method FROM reqs",
    "q_gate": f"{_W}, g AS (SELECT ord, {sql.issues('text')} AS issues FROM reqs) SELECT ord, issues = '' AS passes, issues FROM g",
    "q_polarity": f"{_W} SELECT ord, regexp_matches(text, '(?i){vocab.NEGATED}') AS negated FROM reqs",
    "q_role_counts": f"{_W} SELECT role, count(*) AS n, count(DISTINCT elem) AS n_texts FROM elems GROUP BY role",
    "q_element_samples": f"{_W} SELECT role, substring(arg_min(elem, ord * 1000 + pos), 1, 50) AS sample FROM elems GROUP BY role",
    "q_norm_tokens": f"""{_W} SELECT ord, pos, array_to_string(list_filter(regexp_extract_all(lower(elem), '[a-z0-9]+'), {_stop(vocab.SET_STOP)}), ' ') AS set_form,
        array_to_string(list_filter(regexp_extract_all(lower(elem), '[a-z0-9]+'), {_stop(vocab.MODEL_STOP)}), ' ') AS model_form FROM elems""",
    "q_safe_ids": f"""WITH s AS (SELECT ord, id, regexp_replace(coalesce(id, ''), '[^A-Za-z0-9_]', '_', 'g') AS x FROM sample_reqs)
        SELECT ord, CASE WHEN x = '' THEN 'req' WHEN regexp_matches(x, '^[0-9]') THEN 'r_' || x ELSE x END AS safe, regexp_replace(upper(coalesce(id, '')), '[{sql.SPACE}_]+', '', 'g') AS norm FROM s""",
    "q_escape": rf"""{_W} SELECT ord, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml,
        replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS turtle,
        replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') AS dot, {sql.strip("replace(replace(text, '\"', ''''), chr(10), ' ')")} AS mermaid FROM reqs""",
}
