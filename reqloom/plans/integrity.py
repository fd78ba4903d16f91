"""Queries on references between model tables and on hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqloom.operators.hierarchy import hierarchy
from reqloom.operators.orphans import element_validity, orphan_references, orphan_report, relation_references
from reqloom.session import table


def p4_found(spark, d):
    got = orphan_references(relation_references(table(spark, d, "v1_relations")), element_validity(table(spark, d, "v1_elements")))
    return got.select(F.col("ref_id").alias("rel_ord"), "ref_field")


def p4_report(spark, d):
    return orphan_report(relation_references(table(spark, d, "v1_relations")), element_validity(table(spark, d, "v1_elements")))


def p5_found(spark, d):
    return hierarchy(table(spark, d, "v1_relations")).select("node_id", "path")


def p5_nodes(spark, d):
    on_ring = {"root": F.coalesce("root", F.lit("")), "depth": F.coalesce("depth", F.lit(-1).cast("long"))}
    return hierarchy(table(spark, d, "v1_relations")).withColumns(on_ring).select("node_id", "root", "depth", "path")


def p5_descendants(spark, d):
    return hierarchy(table(spark, d, "v1_relations"), "descendants")


def p5_rings(spark, d):
    return hierarchy(table(spark, d, "v1_relations"), "rings")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_nodes": p5_nodes, "p5_descendants": p5_descendants, "p5_rings": p5_rings}

_REFS = r"""refs AS (
    SELECT ord AS rel_ord, 'source_id' AS ref_field, trim(source_id, E' \t\r\n') AS key, loaded_at AS tm FROM v1_relations
    UNION ALL SELECT ord, 'target_id', trim(target_id, E' \t\r\n'), loaded_at FROM v1_relations),
el AS (SELECT trim(xmi_id, E' \t\r\n') AS key, loaded_at AS s, deleted_at AS e FROM v1_elements WHERE loaded_at IS NOT NULL),
miss AS (SELECT * FROM refs r WHERE key <> '' AND tm IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM el WHERE el.key = r.key AND el.s <= r.tm AND (el.e IS NULL OR el.e > r.tm)))"""

_EDGES = r"""e AS (
    SELECT DISTINCT trim(source_id, E' \t\r\n') AS p, trim(target_id, E' \t\r\n') AS c FROM v1_relations
    WHERE lower(trim(rel_type, E' \t\r\n')) = 'composition' AND trim(source_id, E' \t\r\n') <> '' AND trim(target_id, E' \t\r\n') <> '')"""

_PATHS = f"""WITH RECURSIVE {_EDGES},
    n AS (SELECT p AS x FROM e UNION SELECT c FROM e),
    reach AS (SELECT p AS a, c AS b FROM e UNION SELECT reach.a, e.c FROM reach JOIN e ON reach.b = e.p),
    ring AS (SELECT a AS x FROM reach WHERE a = b),
    bad AS (SELECT x FROM ring UNION SELECT b FROM reach JOIN ring ON reach.a = ring.x),
    w AS (SELECT x AS node_id, x AS path, CAST(0 AS BIGINT) AS depth, x AS root FROM n WHERE x NOT IN (SELECT c FROM e)
        UNION ALL SELECT e.c, w.path || '/' || e.c, w.depth + 1, w.root FROM w JOIN e ON w.node_id = e.p WHERE e.c NOT IN (SELECT x FROM bad))"""

ORACLE = {
    "p4_found": f"WITH {_REFS} SELECT rel_ord, ref_field FROM miss",
    "p4_report": f"""WITH {_REFS}, k AS (SELECT key, min(s) AS f FROM el GROUP BY key)
        SELECT ref_field, strftime(tm AT TIME ZONE 'UTC', '%Y-%m') AS month,
            CASE WHEN f IS NULL THEN 'never exported' WHEN f > tm THEN 'loaded later' ELSE 'deleted' END AS reason,
            count(*) AS n_references, count(DISTINCT miss.key) AS n_keys
        FROM miss LEFT JOIN k ON miss.key = k.key GROUP BY ALL""",
    "p5_found": f"{_PATHS} SELECT node_id, path FROM w UNION ALL SELECT x, '(cycle)' FROM bad",
    "p5_nodes": f"{_PATHS} SELECT node_id, root, depth, path FROM w UNION ALL SELECT x, '', -1, '(cycle)' FROM bad",
    "p5_descendants": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p AS a, c AS b, CAST(1 AS BIGINT) AS d FROM e WHERE p <> c
            UNION SELECT r.a, e.c, r.d + 1 FROM r JOIN e ON r.b = e.p WHERE r.a <> e.c AND r.d < 1000)
        SELECT a AS node_id, b AS descendant, min(d) AS distance FROM r GROUP BY a, b""",
}
