"""The extraction of statements as plain SQL, stage by stage, to check the native columns against.

That dialect's patterns have no look-around, so a marker is found together with the characters around it.
"""

from __future__ import annotations

import re

from reqloom.functions import vocab
from reqloom.functions.text import SPACE, WORD, alternatives


def _q(s: str) -> str:
    return s.replace("'", "''")


_IN, _OUT = f"[{WORD}']", f"[^{WORD}']"


def _marked(markers) -> str:
    return _q(rf"(?is)^(|.*?{_OUT})({alternatives(markers)})(?:{_OUT}|$)")


def at(c: str, markers) -> str:
    p = _marked(markers)
    return f"CASE WHEN regexp_matches({c}, '{p}') THEN length(regexp_extract({c}, '{p}', 1)) ELSE -1 END"


def word(c: str, markers) -> str:
    return f"regexp_extract({c}, '{_marked(markers)}', 2)"


def lead_space(c: str) -> str:
    return f"length(regexp_extract({c}, '^[{SPACE}]*', 0))"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def sub(c: str, a: str, b: str) -> str:
    return f"substring({c}, ({a}) + 1, greatest(({b}) - ({a}), 0))"


_DET = alternatives(vocab.DETERMINERS)
_LEAD = _q(rf"(?i)^([{SPACE}]*)({alternatives(vocab.CONDITIONS)})(?:{_OUT}|$)")
_UI = _q(rf"(?is)^(|.*?{_OUT})(provide[{SPACE}]+)(.+?)([{SPACE}]+with the ability to)(?:{_OUT}|$)")
_CONJ_DET = _q(rf"(?i)([{SPACE}])(and|or)([{SPACE}]+(?:{_DET})(?:{_OUT}|$))")


def _hidden(c: str) -> str:
    """Conjunctions before a determiner replaced by as many other characters."""
    for _ in range(2):
        for w in ("and", "or"):
            p = _CONJ_DET.replace("(and|or)", f"({w})")
            c = f"regexp_replace({c}, '{p}', '\\1{'#' * len(w)}\\3', 'g')"
    return c


_SPLIT = _q(rf"(?is)^(.*?)([{SPACE}]+(?:and|or)[{SPACE}]+){_IN}")
_KINDS = " ".join(f"WHEN '{m}' THEN '{o}'" for m, o in vocab.OBLIGATION.items())

STAGES = f"""
reqs AS (SELECT ord, id, text FROM sample_reqs WHERE regexp_matches(text, '[^{SPACE}]')),
x1 AS (SELECT ord, text, length(text) AS n, regexp_extract(text, '{_LEAD}', 2) AS lm, length(regexp_extract(text, '{_LEAD}', 1)) AS ls FROM reqs),
x2 AS (SELECT *, CASE WHEN lm = '' THEN 0 ELSE ls + length(lm) END AS ll FROM x1),
x3 AS (SELECT *, CASE WHEN ll > 0 AND contains(substring(text, ll + 1), ',') THEN ll + instr(substring(text, ll + 1), ',') - 1 ELSE -1 END AS comma FROM x2),
x4 AS (SELECT *, CASE WHEN ll = 0 THEN 0 WHEN comma >= 0 THEN comma + 1 ELSE ll END AS f FROM x3),
x5 AS (SELECT *, substring(text, f + 1) AS rest FROM x4),
x6 AS (SELECT *, {at('rest', vocab.MODALS)} AS mi, {word('rest', vocab.MODALS)} AS mw FROM x5),
x7 AS (SELECT *, CASE WHEN mi >= 0 THEN f + mi ELSE n END AS ms FROM x6),
x8 AS (SELECT *, {sub('text', 'll', 'ms')} AS gap FROM x7),
x9 AS (SELECT *, CASE WHEN ll = 0 THEN -1 WHEN contains(gap, ',') THEN ll + length(gap) - instr(reverse(gap), ',')
    WHEN comma >= 0 THEN comma WHEN ({at('gap', ('then',))}) >= 0 THEN ll + {at('gap', ('then',))} ELSE -1 END AS stop FROM x8),
y1 AS (SELECT *, CASE WHEN stop < 0 THEN 0 WHEN substring(text, stop + 1, 1) = ',' THEN stop + 1 ELSE stop END AS w0 FROM x9),
y2 AS (SELECT *, CASE WHEN stop >= 0 AND regexp_matches(substring(text, w0 + 1), '{_q(rf"(?i)^[{SPACE}]*then(?:{_OUT}|$)")}')
    THEN w0 + length(regexp_extract(substring(text, w0 + 1), '(?i)^[{SPACE}]*then', 0)) ELSE w0 END AS w,
    CASE WHEN mi >= 0 THEN ms + length(mw) END AS p0 FROM y1),
y3 AS (SELECT *, coalesce(p0, w) AS p FROM y2),
y4 AS (SELECT *, regexp_replace(substring(text, p + 1), '[.;\\n\\t ]+$', '') AS x FROM y3),
y5 AS (SELECT *, {at('x', vocab.CONDITIONS)} AS ti, {word('x', vocab.CONDITIONS)} AS tm FROM y4),
y6 AS (SELECT *, CASE WHEN ti > 0 THEN substring(x, 1, ti) ELSE x END AS y FROM y5),
y7 AS (SELECT *, {at('y', vocab.CONSTRAINTS)} AS ki, {word('y', vocab.CONSTRAINTS)} AS km FROM y6),
y8 AS (SELECT *, CASE WHEN ki > 0 THEN substring(y, 1, ki) ELSE y END AS z FROM y7),
y9 AS (SELECT *, regexp_matches(z, '{_UI}') AS ui, {at('z', vocab.INTERFACE)} AS ifa FROM y8),
z1 AS (SELECT *, CASE WHEN ui THEN 'user interaction' WHEN ifa >= 0 THEN 'interface requirement' ELSE 'autonomous activity' END AS function_type,
    CASE WHEN ui THEN length(regexp_extract(z, '{_UI}', 1)) + length(regexp_extract(z, '{_UI}', 2)) ELSE -1 END AS ws,
    regexp_extract(z, '{_UI}', 3) AS who,
    CASE WHEN ui THEN length(regexp_extract(z, '{_UI}', 1)) + length(regexp_extract(z, '{_UI}', 2)) + length(regexp_extract(z, '{_UI}', 3)) + length(regexp_extract(z, '{_UI}', 4))
        WHEN ifa >= 0 THEN ifa + length({word('z', vocab.INTERFACE)}) ELSE 0 END AS ast FROM y9),
z2 AS (SELECT *, {strip('substring(z, ast + 1)')} AS a, p + ast + {lead_space('substring(z, ast + 1)')} AS a0 FROM z1),
z3 AS (SELECT *, {_hidden('a')} AS masked FROM z2),
z4 AS (SELECT *, CASE WHEN regexp_matches(masked, '{_SPLIT}') THEN length(regexp_extract(masked, '{_SPLIT}', 1)) ELSE -1 END AS si, length(regexp_extract(masked, '{_SPLIT}', 2)) AS sl FROM z3),
parts AS (SELECT ord, text, function_type, 1 AS k, CASE WHEN si >= 0 THEN substring(a, 1, si) ELSE a END AS t, a0 AS t0 FROM z4
    UNION ALL SELECT ord, text, function_type, 2, substring(a, si + sl + 1), a0 + si + sl FROM z4 WHERE si >= 0),
parts2 AS (SELECT ord, text, function_type, k, {strip('t')} AS t, t0 + {lead_space('t')} AS t0 FROM parts),
parts3 AS (SELECT *, {at('t', vocab.DETERMINERS)} AS d FROM parts2),
raw AS (
    SELECT ord, text, ls AS s, stop AS e, 'CONDITION' AS role, lower(lm) AS marker, 'pre-condition' AS kind FROM z4 WHERE stop >= 0
    UNION ALL SELECT ord, text, ms, ms + length(mw), 'MODALITY', NULL, CASE lower(mw) {_KINDS} ELSE 'unspecified' END FROM z4 WHERE mi >= 0
    UNION ALL SELECT ord, text, w, ms, 'SUBJECT', NULL, NULL FROM z4 WHERE mi >= 0
    UNION ALL SELECT ord, text, p + ti, p + length(x), 'CONDITION', lower(tm), 'post-condition' FROM z4 WHERE ti > 0
    UNION ALL SELECT ord, text, p + ki, p + length(y), 'CONSTRAINT', lower(km), NULL FROM z4 WHERE ki > 0
    UNION ALL SELECT ord, text, p + ws, p + ws + length(who), 'ACTOR', NULL, NULL FROM z4 WHERE ui
    UNION ALL SELECT ord, text, t0, CASE WHEN d > 0 THEN t0 + d ELSE t0 + length(t) END, 'PROCESS', NULL, function_type FROM parts3
    UNION ALL SELECT ord, text, t0 + d, t0 + length(t), 'OBJECT', NULL, NULL FROM parts3 WHERE d > 0),
span AS (SELECT ord, text, role, marker, kind, {sub('text', 's', 'e')} AS c, s FROM raw),
claims AS (SELECT ord, role, marker, kind, s + {lead_space('c')} AS s, s + {lead_space('c')} + length({strip('c')}) AS e FROM span WHERE {strip('c')} <> ''),
gaps AS (SELECT ord, coalesce(lag(e) OVER o, 0) AS s, s AS e FROM claims WINDOW o AS (PARTITION BY ord ORDER BY s)),
tail AS (SELECT r.ord, coalesce(max(c.e), 0) AS s, any_value(length(r.text)) AS e FROM reqs r LEFT JOIN claims c ON c.ord = r.ord GROUP BY r.ord),
spans AS (SELECT ord, s, e, role, marker, kind FROM claims UNION ALL SELECT ord, s, e, 'GLUE', NULL, NULL FROM gaps WHERE e > s
    UNION ALL SELECT ord, s, e, 'GLUE', NULL, NULL FROM tail WHERE e > s),
tiles AS (SELECT t.ord, row_number() OVER (PARTITION BY t.ord ORDER BY s) AS pos, s, e, role, marker, kind, {sub('r.text', 's', 'e')} AS words FROM spans t JOIN reqs r ON r.ord = t.ord),
terms AS (SELECT *, lower(role) || '_' || pos AS node_id FROM tiles),
elems AS (SELECT *, {strip('words')} AS elem FROM terms WHERE role <> 'GLUE' AND {strip('words')} <> ''),
core AS (SELECT *, sum(CASE WHEN role = 'PROCESS' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY pos) AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY pos) AS rn FROM terms WHERE role IN ('PROCESS', 'OBJECT'))),
acts AS (SELECT ord, CAST(max(action) AS BIGINT) AS n_actions, max(CASE WHEN action = 1 THEN e END) AS t1, min(CASE WHEN action = 2 THEN s END) AS t2 FROM core GROUP BY ord),
acts2 AS (SELECT a.ord, n_actions, CASE WHEN n_actions > 1 THEN CASE WHEN contains(' ' || {strip(f"lower({sub('r.text', 't1', 't2')})")} || ' ', ' or ') THEN 'OR' ELSE 'AND' END END AS operator
    FROM acts a JOIN reqs r ON r.ord = a.ord)"""

#: The stages before everything that reads them.
WITH = f"WITH {STAGES}"

_BREAKS = re.compile(r"([^\w-])")
_WEAK_ALTS = "|".join(_BREAKS.sub(r"\1\1", w) for w in sorted(vocab.WEAK_WORDS, key=len, reverse=True))


def weak_list(c: str) -> str:
    doubled = f"regexp_replace(lower({c}), '([^\\w-])', '\\1\\1', 'g')"
    found = f"regexp_extract_all({doubled}, '(?:^|[^\\w-])({_WEAK_ALTS})(?:$|[^\\w-])', 1)"
    return f"list_sort(list_distinct(list_transform({found}, lambda w: regexp_replace(w, '([^\\w-])[^\\w-]', '\\1', 'g'))))"


def flag(c: str, pattern: str) -> str:
    return f"regexp_matches(lower({c}), '{_q(pattern)}')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all(lower({c}), '{_q(pattern)}'))"


def hits(c: str, keys) -> str:
    return " + ".join(f"(length(lower({c})) - length(replace(lower({c}), '{k}', ''))) / {len(k)}" for k in keys)


def type_case(c: str) -> str:
    h = {t: f"({hits(c, k)})" for t, k in vocab.TYPE_KEYWORDS.items()}
    top = f"greatest({', '.join(h.values())})"
    return f"CASE WHEN {top} = 0 THEN 'functional' " + " ".join(f"WHEN {x} = {top} THEN '{t}'" for t, x in h.items()) + " END"


EARS = """SELECT r.ord, CASE WHEN bool_or(marker IN ('when', 'once', 'after', 'whenever')) OR bool_or(contains(marker, 'as soon')) THEN 'event-driven (WHEN)'
    WHEN bool_or(marker IN ('while', 'during')) OR bool_or(contains(marker, 'as long')) THEN 'state-driven (WHILE)'
    WHEN bool_or(marker IN ('if', 'unless')) OR bool_or(contains(marker, 'in case')) THEN 'unwanted behaviour (IF/THEN)'
    WHEN bool_or(marker IN ('where', 'provided', 'given')) THEN 'optional feature (WHERE)' ELSE 'ubiquitous' END AS ears_pattern
    FROM reqs r LEFT JOIN claims c ON c.ord = r.ord AND c.role = 'CONDITION' GROUP BY r.ord"""


def method_case(c: str) -> str:
    m = lambda p: f"regexp_matches({c}, '(?i){_q(p)}')"
    return f"CASE WHEN {m(vocab.METHOD_ANALYSIS)} THEN 'Analysis' WHEN {m(vocab.METHOD_DEMO)} THEN 'Demonstration' WHEN {m(vocab.METHOD_INSPECT)} THEN 'Inspection' ELSE 'Test' END"


def issues(c: str) -> str:
    w = weak_list(c)
    return f"""concat_ws('; ', CASE WHEN {count(c, vocab.CONJUNCTION)} > 1 THEN 'not atomic (split into separate requirements)' END,
        CASE WHEN {count(c, vocab.COUNTED_MODAL)} > 1 THEN 'compound (multiple modal clauses)' END,
        CASE WHEN NOT {flag(c, vocab.ANY_MODAL)} THEN 'no modality (not an obligation)' END,
        CASE WHEN len({w}) > 0 THEN 'ambiguous: ' || array_to_string({w}, ', ') END,
        CASE WHEN {flag(c, vocab.PASSIVE)} THEN 'passive voice (unclear actor)' END,
        CASE WHEN {flag(c, vocab.VAGUE)} THEN 'vague quantifier' END)"""
