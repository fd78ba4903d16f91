"""Quality smells, requirement type, condition pattern and verification method, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions import vocab
from reqloom.functions.text import SPACE, alternatives, strip
from reqloom.operators.tiling import elements, generated, terminals, with_actions

_WEAK = rf"(?<![\w-])({alternatives(vocab.WEAK_WORDS)})(?![\w-])"


def weak_words(text: Column) -> Column:
    """Sorted distinct weak words of the lower-cased text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WEAK), F.lit(1))))


def smells(text: Column) -> dict[str, Column]:
    """Boolean columns: passive_voice, missing_modality, vague_quantifier, non_atomic, compound_requirement."""
    low = F.lower(text)
    return {
        "passive_voice": low.rlike(vocab.PASSIVE),
        "missing_modality": ~low.rlike(vocab.ANY_MODAL),
        "vague_quantifier": low.rlike(vocab.VAGUE),
        "non_atomic": F.regexp_count(low, F.lit(vocab.CONJUNCTION)) > 1,
        "compound_requirement": F.regexp_count(low, F.lit(vocab.COUNTED_MODAL)) > 1,
    }


def requirement_type(text: Column) -> Column:
    """The class with most keyword hits (substrings), the first of those that tie; functional without any."""
    low = F.lower(text)
    # most keywords are not there, which is quickly seen
    times = lambda k: F.when(low.contains(k), (F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).otherwise(0.0)
    hits = lambda keys: sum(map(times, keys), F.lit(0.0))
    # made once: the most hits, then the earliest class
    ranked = F.array(*(F.struct(hits(keys).alias("hits"), F.lit(-i).alias("turn"), F.lit(t).alias("name")) for i, (t, keys) in enumerate(vocab.TYPE_KEYWORDS.items())))
    best = F.array_max(ranked)
    return F.element_at(F.transform(F.array(best), lambda x: F.when(x["hits"] > 0, x["name"]).otherwise("functional")), 1)


def ears_pattern(claims: Column) -> Column:
    """Pattern of the statement's conditions, by the markers in its CONDITION claims."""
    marks = F.transform(F.filter(claims, lambda x: x["role"] == "CONDITION"), lambda x: x["marker"])
    line = F.array_join(marks, " ")
    any_of = lambda *m: F.arrays_overlap(marks, F.array(*(F.lit(x) for x in m)))
    return (
        F.when(any_of("when", "once", "after", "whenever") | line.contains("as soon"), "event-driven (WHEN)")
        .when(any_of("while", "during") | line.contains("as long"), "state-driven (WHILE)")
        .when(any_of("if", "unless") | line.contains("in case"), "unwanted behaviour (IF/THEN)")
        .when(any_of("where", "provided", "given"), "optional feature (WHERE)")
        .otherwise("ubiquitous")
    )


def verification_method(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("(?i)" + vocab.METHOD_ANALYSIS), "Analysis").when(t.rlike("(?i)" + vocab.METHOD_DEMO), "Demonstration").when(t.rlike("(?i)" + vocab.METHOD_INSPECT), "Inspection").otherwise("Test")


def negated(text: Column) -> Column:
    return text.rlike("(?i)" + vocab.NEGATED)


def gate_issues(text: Column) -> Column:
    """Array of issues in fixed order; empty where the statement passes."""
    s, weak = smells(text), weak_words(text)
    return F.array_compact(
        F.array(
            F.when(s["non_atomic"], "not atomic (split into separate requirements)"),
            F.when(s["compound_requirement"], "compound (multiple modal clauses)"),
            F.when(s["missing_modality"], "no modality (not an obligation)"),
            F.when(F.size(weak) > 0, F.concat(F.lit("ambiguous: "), F.array_join(weak, ", "))),
            F.when(s["passive_voice"], "passive voice (unclear actor)"),
            F.when(s["vague_quantifier"], "vague quantifier"),
        )
    )


def role_list(tiles: Column, text: Column, role: str) -> Column:
    """Texts of a role's elements in text order."""
    words = F.transform(F.filter(tiles, lambda x: x["role"] == role), lambda x: strip(F.substr(text, x["start"] + 1, x["end"] - x["start"])))
    return F.filter(words, lambda w: w != "")


def role_texts(tiles: Column, text: Column, role: str) -> Column:
    """Texts of a role's elements in text order, joined by " | "."""
    return F.array_join(role_list(tiles, text, role), " | ")


def flat_table(tiled: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per statement: ``keep``, type, pattern, round trip, elements by role, weak words and atomicity."""
    c = F.col(text)
    roles = [role_texts(F.col("tiles"), c, r).alias(r.lower()) for r in vocab.ELEMENT_ROLES]
    return tiled.select(
        *keep, requirement_type(c).alias("type"), ears_pattern(F.col("claims")).alias("ears_pattern"), (generated(c, F.col("tiles")) == c).alias("roundtrip_ok"),
        F.lit("").alias("error"), *roles, F.array_join(weak_words(c), ", ").alias("weak_words"), smells(c)["non_atomic"].alias("non_atomic"),
    )


def kpis(tiled: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, n_elements, coverage_pct, quality_score, obligation, n_actions, operator, n_words)."""
    c = F.col(text)
    s = smells(c)
    score = F.greatest(F.lit(0), 100 - 20 * sum((x.cast("int") for x in s.values()), F.lit(0)) - 10 * F.size(weak_words(c)))
    real = F.filter("tiles", lambda x: (x["role"] != "GLUE") & (strip(F.substr(c, x["start"] + 1, x["end"] - x["start"])) != ""))
    chars = F.aggregate(real, F.lit(0), lambda acc, x: acc + x["end"] - x["start"])
    force = F.get(F.filter(real, lambda x: x["role"] == "MODALITY"), F.lit(0))["kind"]
    words = F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")
    return with_actions(tiled, text).select(
        key, F.size(real).cast("long").alias("n_elements"), F.when(F.length(c) > 0, F.round(100.0 * chars / F.length(c), 1)).otherwise(0.0).alias("coverage_pct"),
        score.cast("long").alias("quality_score"), F.coalesce(force, F.lit("none")).alias("obligation"), F.size(words).cast("long").alias("n_words"),
        "n_actions", F.coalesce("operator", F.lit("")).alias("operator"),
    )


def semantic_rows(tiled: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    return elements(terminals(tiled, key, text))
