"""Queries of the corpus-preparation problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqloom.llm.abuse import THRESHOLD, abuse_report, abuse_scores
from reqloom.llm.grouping import match_groups
from reqloom.llm.mixing import mix, mix_report, sized_sources
from reqloom.llm.neardup import near_groups, near_pairs
from reqloom.llm.packing import fill_containers, fill_report, sized
from reqloom.llm.typography import collapse_typography, typographic_copies
from reqloom.session import Scratch, table


def p1_found(spark, sf_dir):
    return match_groups(table(spark, sf_dir, "connections"))


def p2_found(spark, sf_dir):
    return typographic_copies(table(spark, sf_dir, "sample_reqs"))


def p2_records(spark, sf_dir):
    return collapse_typography(table(spark, sf_dir, "sample_reqs"))


def _near_records(spark, sf_dir):
    reqs = table(spark, sf_dir, "sample_reqs").select(F.col("ord").alias("rec"), "text")
    return reqs.unionByName(table(spark, sf_dir, "trace_items").select(F.col("item_id").alias("rec"), F.col("req_text").alias("text")))


def p3_found(spark, sf_dir):
    return near_pairs(_near_records(spark, sf_dir))


def p3_groups(spark, sf_dir):
    return near_groups(_near_records(spark, sf_dir))


def p6_pack(spark, sf_dir):
    return fill_containers(sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p6_report(spark, sf_dir):
    return fill_report(p6_pack(spark, sf_dir))


def p7_mix(spark, sf_dir):
    return mix(sized_sources(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_report(spark, sf_dir):
    scratch = Scratch(spark, "mix-report")
    docs = scratch.put(sized_sources(table(spark, sf_dir, "documents")), "sized")
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(docs, targets, mix(docs, targets))


def p8_scores(spark, sf_dir):
    return abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_found(spark, sf_dir):
    return p8_scores(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p8_report(spark, sf_dir):
    return abuse_report(p8_scores(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_records": p2_records, "p3_found": p3_found, "p3_groups": p3_groups, "p6_pack": p6_pack, "p6_report": p6_report, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found, "p8_scores": p8_scores, "p8_report": p8_report}

#: Canonical keys of sample_reqs, character by character. ``strings`` holds every string to be made canonical.
_KEYS = r"""ok AS (SELECT ord, id, text FROM sample_reqs
        WHERE regexp_matches(id, '[^\s\p{Z}]') AND regexp_matches(text, '[^\s\p{Z}]')),
    pieces AS (SELECT ord, list_filter(regexp_split_to_array(text, '[;|\r\n]+'), lambda p: regexp_matches(p, '[^\s\p{Z}]')) AS ps, text FROM ok),
    fields AS (
        SELECT ord, unnest(json_keys(text)) AS label, text AS js, NULL AS piece FROM pieces
        WHERE regexp_matches(text, '^\s*\{') AND json_valid(text) AND len(json_keys(text)) >= 3
        UNION ALL SELECT ord, NULL, NULL, unnest(ps) FROM pieces
        WHERE NOT regexp_matches(text, '^\s*\{') AND len(ps) >= 3 AND len(list_filter(ps, lambda p: regexp_matches(p, '^[^\p{L}\p{Nd}]*[\p{L}\p{Nd}][^:=]*[:=]'))) = len(ps)),
    named AS (SELECT ord, row_number() OVER () AS k,
            coalesce(label, regexp_extract(piece, '(?s)^[^\p{L}\p{Nd}]*([\p{L}\p{Nd}][^:=]*)[:=](.*)$', 1)) AS l,
            CASE WHEN js IS NULL THEN regexp_extract(piece, '(?s)^[^\p{L}\p{Nd}]*([\p{L}\p{Nd}][^:=]*)[:=](.*)$', 2) ELSE json_extract_string(js, '$."' || label || '"') END AS v FROM fields),
    strings AS (SELECT ord, 0 AS k, 'id' AS part, lower(id) AS s FROM ok
        UNION ALL SELECT ord, 0, 'text', lower(text) FROM ok WHERE ord NOT IN (SELECT ord FROM named)
        UNION ALL SELECT ord, k, 'l', lower(l) FROM named UNION ALL SELECT ord, k, 'v', lower(v) FROM named),
    chars AS (SELECT *, string_split(s, '') AS c FROM strings),
    canon AS (SELECT ord, k, part, array_to_string(list_filter(c, lambda x, i: regexp_matches(x, '[\p{L}\p{Nd}]')
            OR (part <> 'id' AND x = '.' AND i > 1 AND regexp_matches(c[i - 1], '\p{Nd}') AND regexp_matches(coalesce(c[i + 1], ''), '\p{Nd}'))
            OR (part <> 'id' AND x = '-' AND regexp_matches(coalesce(c[i + 1], ''), '\p{Nd}') AND (i = 1 OR NOT regexp_matches(c[i - 1], '[\p{L}\p{Nd}]')))), '') AS s FROM chars),
    one AS (SELECT ord, k, string_agg(s, '=' ORDER BY part) AS s FROM canon WHERE part IN ('l', 'v') GROUP BY ord, k
        UNION ALL SELECT ord, -1, s FROM canon WHERE part = 'text'),
    keys AS (SELECT o.ord, i.s || '/' || string_agg(o.s, ';' ORDER BY o.s) || CASE WHEN min(o.k) < 0 THEN '' ELSE '/F' END AS key
        FROM one o JOIN canon i ON i.ord = o.ord AND i.part = 'id' GROUP BY o.ord, i.s)"""


def _similar(rows: str) -> str:
    """CTEs up to c (rec_a, rec_b): similar pairs of ``rows`` (rec, ws, n), by a prefix filter on single words."""
    return f"""r0 AS (SELECT ord AS rec, text FROM sample_reqs UNION ALL SELECT item_id, req_text FROM trace_items),
        w AS (SELECT rec, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS ws FROM r0),
        sets AS (SELECT rec, ws, len(ws) AS n, min(rec) OVER (PARTITION BY ws) AS class_rec FROM w WHERE len(ws) >= 8),
        k AS ({rows}),
        e AS (SELECT rec, n, unnest(ws) AS t FROM k),
        f AS (SELECT t, count(*) AS df FROM e GROUP BY t),
        o AS (SELECT rec, e.t, row_number() OVER (PARTITION BY rec ORDER BY df, e.t) - 1 AS i, n FROM e JOIN f ON e.t = f.t),
        p AS (SELECT rec, t, n FROM o WHERE i <= n - ceil(n * 7 / 10)),
        h AS (SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM p a JOIN p b
            ON a.t = b.t AND a.rec < b.rec AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7),
        c AS (SELECT rec_a, rec_b FROM h JOIN k a ON a.rec = rec_a JOIN k b ON b.rec = rec_b
            WHERE len(list_intersect(a.ws, b.ws)) * 17 >= 7 * (a.n + b.n))"""


ORACLE = {
    "p2_found": f"""WITH {_KEYS}, f AS (SELECT ord, min(ord) OVER (PARTITION BY key) AS first_ord FROM keys)
        SELECT first_ord, ord AS copy_ord FROM f WHERE ord <> first_ord""",
    "p2_records": f"""WITH {_KEYS}, g AS (SELECT min(ord) AS ord, count(*) AS n_copies FROM keys GROUP BY key)
        SELECT s.ord, s.id, s.text, g.n_copies FROM g JOIN sample_reqs s ON s.ord = g.ord""",
    "p3_found": f"WITH {_similar('SELECT rec, ws, n FROM sets')} SELECT rec_a, rec_b FROM c",
    "p3_groups": f"""WITH RECURSIVE {_similar('SELECT DISTINCT class_rec AS rec, ws, n FROM sets')},
        l AS (SELECT rec_a AS x, rec_b AS y FROM c UNION ALL SELECT rec_b, rec_a FROM c),
        r AS (SELECT x AS rec, y AS other FROM l UNION SELECT r.rec, l.y FROM r JOIN l ON r.other = l.x),
        g AS (SELECT rec, least(rec, min(other)) AS group_rec FROM r GROUP BY rec),
        d AS (SELECT x AS rec, count(*) AS n_links FROM l GROUP BY x)
        SELECT s.rec, class_rec, coalesce(group_rec, class_rec) AS group_rec, coalesce(n_links, 0) AS n_links
        FROM sets s LEFT JOIN g ON g.rec = class_rec LEFT JOIN d ON d.rec = class_rec""",
    "p1_found": """
        WITH RECURSIVE l AS (
            SELECT DISTINCT a AS x, b AS y FROM connections WHERE a <> b AND score >= 0.6
            UNION SELECT b, a FROM connections WHERE a <> b AND score >= 0.6),
        r AS (SELECT x AS elem, x AS other FROM l UNION SELECT r.elem, l.y FROM r JOIN l ON r.other = l.x)
        SELECT elem, min(other) AS group_elem FROM r GROUP BY elem""",
}
