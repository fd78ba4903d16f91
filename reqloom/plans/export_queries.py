"""Queries on requirement sets, the graphs of sets and models, and the printed trace matrix, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqloom.functions import vocab
from reqloom.operators import propgraph, quality
from reqloom.operators import requirement_set as rs
from reqloom.plans import model_queries as mq
from reqloom.plans import text_sql as sql
from reqloom.plans.text_queries import elems, statements, tiled
from reqloom.session import table
from reqloom.sources import writers


def _named(spark, d):
    return tiled(spark, d).withColumn("id", F.concat(F.lit("r"), F.col("ord").cast("string")))


def q_set_table(spark, d):
    return rs.set_table(rs.requirement_set(statements(spark, d)))


def q_req_nodes(spark, d):
    n = rs.set_nodes(_named(spark, d))
    return n.select("id", "kind", *(F.coalesce(F.col("props")[k], F.lit("")).alias(k) for k in ("text", "req_type", "ears_pattern", "weak_words", "non_atomic")))


def q_element_nodes(spark, d):
    n = rs.element_nodes(_named(spark, d))
    return n.select("id", F.col("props")["role"].alias("role"), F.col("props")["text"].alias("text"))


def q_element_edges(spark, d):
    return rs.element_edges(_named(spark, d)).select("src", "dst", "rel")


def _similar(spark, d):
    return rs.similarity_edges(mq._matches(spark, d), "req_a", "req_b")


def q_set_edges(spark, d):
    return _similar(spark, d).select("src", "dst", "rel", F.col("props")["score"].alias("score"))


def _set_lines(form):
    """Lines of the graph of all requirements that match another one."""

    def run(spark, d):
        e = _similar(spark, d)
        n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        n = n.select("id", F.lit("REQ").alias("kind"), F.create_map().cast("map<string,string>").alias("props"))
        return propgraph.lines(n, e, form).select("part", "line")

    return run


def q_model_nodes(spark, d):
    n = rs.model_nodes(mq._elements(spark, d))
    return n.select("id", "kind", *(F.coalesce(F.col("props")[k], F.lit("")).alias(k) for k in ("label", "role", "package")))


def q_model_edges(spark, d):
    return rs.model_edges(mq._elements(spark, d), mq._relations(spark, d)).select("src", "dst", "rel")


def q_ontology_diff(spark, d):
    return rs.ontology_diff(mq._elements(spark, d), mq._relations(spark, d), elems(spark, d))


def q_summary(spark, d):
    return rs.summary(tiled(spark, d))


def q_nested(spark, d):
    return rs.nested(tiled(spark, d))


def q_rvtm_table(spark, d):
    items = table(spark, d, "trace_items").select(F.col("item_id").alias("item"), "req_id", F.col("req_text").alias("text"), "rationale", "verification_status")
    allocations = mq._explicit(spark, d).select("item", "element", "link_type", F.lit(1.0).alias("confidence"))
    text = F.coalesce("text", F.lit(""))
    return writers.matrix_rows(mq._status(spark, d).select("item", "status", "quality_pass"), allocations, items, quality.verification_method(text), quality.gate_issues(text))


def q_rvtm_markdown(spark, d):
    return writers.markdown_line(q_rvtm_table(spark, d))


QUERIES = {
    "q_set_table": q_set_table, "q_req_nodes": q_req_nodes, "q_element_nodes": q_element_nodes, "q_element_edges": q_element_edges, "q_set_edges": q_set_edges,
    "q_set_graphml": _set_lines("graphml"), "q_set_turtle": _set_lines("turtle"), "q_set_cypher": _set_lines("cypher"), "q_set_dot": _set_lines("dot"), "q_set_mermaid": _set_lines("mermaid"),
    "q_model_nodes": q_model_nodes, "q_model_edges": q_model_edges, "q_ontology_diff": q_ontology_diff, "q_summary": q_summary, "q_nested": q_nested,
    "q_rvtm_table": q_rvtm_table, "q_rvtm_markdown": q_rvtm_markdown,
}

_W = sql.WITH
_SIM = f"""{mq._OKM}, se AS (SELECT req_a AS src, req_b AS dst, 'SIMILAR_' || role AS rel, format('{{:.4f}}', max(score)) AS score FROM mt GROUP BY req_a, req_b, role),
    sn AS (SELECT DISTINCT unnest([src, dst]) AS id FROM se)"""


def _safe(c: str) -> str:
    x = f"regexp_replace({c}, '[^A-Za-z0-9_]', '_', 'g')"
    return f"(CASE WHEN {x} = '' THEN 'n' WHEN regexp_matches({x}, '^[0-9]') THEN 'n_' || {x} ELSE {x} END)"


def _esc(c: str) -> str:
    return rf"""replace(replace(replace({c}, '\', '\\'), '"', '\"'), chr(10), '\n')"""


def _xml(c: str) -> str:
    return f"""replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


def _lines(node: str, edge: str) -> str:
    return f"WITH {_SIM} SELECT 1 AS part, {node} AS line FROM sn UNION ALL SELECT 2, {edge} FROM se"


_SMELLS = f"""concat_ws('; ', CASE WHEN {sql.flag('text', vocab.PASSIVE)} THEN 'passive_voice' END, CASE WHEN NOT {sql.flag('text', vocab.ANY_MODAL)} THEN 'missing_modality' END,
    CASE WHEN {sql.flag('text', vocab.VAGUE)} THEN 'vague_quantifier' END, CASE WHEN {sql.count('text', vocab.CONJUNCTION)} > 1 THEN 'non_atomic' END,
    CASE WHEN {sql.count('text', vocab.COUNTED_MODAL)} > 1 THEN 'compound_requirement' END, CASE WHEN len({sql.weak_list('text')}) > 0 THEN 'weak_words=' || array_to_string({sql.weak_list('text')}, ', ') END)"""
_MATRIX = f"""{_W}, {mq._MODEL}, {mq._EXPL}, al AS (SELECT item, string_agg(DISTINCT element, '; ' ORDER BY element) AS allocated, string_agg(DISTINCT link_type, '; ' ORDER BY link_type) AS links FROM ex GROUP BY item),
    mx AS (SELECT t.item_id AS item, req_id, coalesce(req_text, '') AS text, coalesce(nullif(allocated, ''), '-') AS allocated, coalesce(nullif(links, ''), '-') AS link_types, status AS trace_status,
        {sql.method_case("coalesce(req_text, '')")} AS method, coalesce(verification_status, '') AS verification_status, CASE WHEN ss.quality_pass THEN 'PASS' ELSE 'FAIL' END AS quality,
        {sql.issues("coalesce(req_text, '')")} AS issues, CASE WHEN al.item IS NULL THEN '0.00' ELSE '1.00' END AS confidence, coalesce(rationale, '') AS rationale
        FROM trace_items t JOIN ss ON ss.item = t.item_id LEFT JOIN al ON al.item = t.item_id)"""
_CELL = lambda c: rf"replace(regexp_replace(coalesce({c}, ''), '[\r\n]+', ' ', 'g'), '|', '\|')"

ORACLE = {
    "q_req_nodes": f"""{_W}, ears AS ({sql.EARS}) SELECT 'r' || r.ord AS id, 'REQ' AS kind, {sql.strip('r.text')} AS text, {sql.type_case('r.text')} AS req_type, ears_pattern,
        array_to_string({sql.weak_list('r.text')}, ', ') AS weak_words, CASE WHEN {sql.count('r.text', vocab.CONJUNCTION)} > 1 THEN 'true' ELSE 'false' END AS non_atomic FROM reqs r JOIN ears USING (ord)""",
    "q_element_nodes": f"{_W} SELECT 'r' || ord || '__' || node_id AS id, role, elem AS text FROM elems",
    "q_element_edges": f"{_W} SELECT 'r' || ord AS src, 'r' || ord || '__' || node_id AS dst, 'HAS_ELEMENT' AS rel FROM elems",
    "q_set_edges": f"WITH {_SIM} SELECT src, dst, rel, score FROM se",
    "q_set_dot": _lines(f"""'  "' || {_esc('id')} || '" [label="' || {_esc("id || ': REQ'")} || '"];'""", f"""'  "' || {_esc('src')} || '" -> "' || {_esc('dst')} || '" [label="' || rel || ' ' || score || '"];'"""),
    "q_set_mermaid": _lines(f"""'    ' || {_safe('id')} || '["' || {sql.strip("replace(id, '\"', '''')")} || ': REQ"]'""", f"""'    ' || {_safe('src')} || ' -->|"' || rel || ' ' || score || '"| ' || {_safe('dst')}"""),
    "q_set_graphml": _lines(
        f"""'<node id="' || {_xml('id')} || '"><data key="node_type">REQ</data></node>'""",
        f"""'<edge source="' || {_xml('src')} || '" target="' || {_xml('dst')} || '"><data key="rel">' || rel || '</data><data key="score">' || score || '</data></edge>'""",
    ),
    "q_set_turtle": _lines(f"""':' || {_safe('id')} || ' a :REQ ; :id "' || {_esc('id')} || '" .'""", f"""':' || {_safe('src')} || ' :' || {_safe('rel')} || ' :' || {_safe('dst')} || ' .'"""),
    "q_set_cypher": _lines(
        f"""'CREATE (:REQ {{id: "' || {_esc('id')} || '"}});'""",
        f"""'MATCH (a {{id: "' || {_esc('src')} || '"}}), (b {{id: "' || {_esc('dst')} || '"}}) CREATE (a)-[:' || {_safe('rel')} || ' {{score: "' || score || '"}}]->(b);'""",
    ),
    "q_model_nodes": f"WITH {mq._MODEL} SELECT xmi_id AS id, {mq._KIND} AS kind, coalesce(name, '') AS label, coalesce(role, '') AS role, coalesce(package, '') AS package FROM el WHERE xmi_id <> ''",
    "q_model_edges": f"""WITH {mq._MODEL} SELECT DISTINCT source_id AS src, target_id AS dst, rel_type AS rel FROM rl
        WHERE source_id <> '' AND target_id <> '' AND source_id IN (SELECT xmi_id FROM el) AND target_id IN (SELECT xmi_id FROM el)""",
    "q_ontology_diff": f"""{_W}, {mq._MODEL} SELECT 'model_type' AS section, {mq._KIND} AS name, count(*) AS n FROM el GROUP BY 2 UNION ALL SELECT 'model_relation', rel_type, count(*) FROM rl GROUP BY 2
        UNION ALL SELECT 'model_role', role, count(*) FROM el GROUP BY 2 UNION ALL SELECT 'set_role', role, count(*) FROM elems GROUP BY 2""",
    "q_summary": f"""{_W}, ears AS ({sql.EARS}), e AS (SELECT ord, string_agg('- ' || role || ': ' || elem || coalesce(' [' || kind || ']', ''), chr(10) ORDER BY pos) AS x FROM elems GROUP BY ord)
        SELECT r.ord, concat_ws(chr(10), 'type: ' || {sql.type_case('text')}, 'ears_pattern: ' || ears_pattern, nullif('quality: ' || {_SMELLS}, 'quality: '), x) AS summary FROM reqs r JOIN ears USING (ord) LEFT JOIN e ON e.ord = r.ord""",
    "q_rvtm_table": f"{_MATRIX} SELECT * FROM mx",
    "q_rvtm_markdown": f"""{_MATRIX} SELECT item, '| ' || {_CELL('req_id')} || ' | ' || {_CELL("CASE WHEN length(text) > 70 THEN substring(text, 1, 67) || '…' ELSE text END")} || ' | '
        || {_CELL('allocated')} || ' | ' || trace_status || ' | ' || method || ' | ' || quality || ' |' AS line FROM mx""",
}
