"""Problem 2: records that are the same but for typography.

A canonical key is computed natively per row. Keys that hold at least a thousandth of all rows are found exactly from
partial counts; their rows are aggregated in two levels, by key and salt and then by key, all others in one level. The
representative of a set of copies is its row with the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators.skew import cold_part, find_hot, hot_part, lookup_join, salted
from reqloom.session import Scratch

SALTS = 64
#: Texts with at least so many labelled fields are compared field by field.
MIN_FIELDS = 3

_LETTER = r"[\p{L}\p{Nd}]"
_NOISE = rf"(?!(?<=\p{{Nd}})\.(?=\p{{Nd}}))(?!(?<!{_LETTER})-(?=\p{{Nd}}))[^\p{{L}}\p{{Nd}}]"
_BLANK = r"^[\s\p{Z}\x{200B}\x{FEFF}]*$"
_BREAK = r"[;|\r\n]+"
_FIELD = r"(?s)^[^\p{L}\p{Nd}]*([\p{L}\p{Nd}][^:=]*)[:=](.*)$"


def canonical_text(c: Column) -> Column:
    """Letters and digits in lower case, points between digits, and hyphens that make a number negative."""
    return F.regexp_replace(F.lower(c), _NOISE, "")


def canonical_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{Nd}}]", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(_BLANK)


def _join_fields(fields: Column) -> Column:
    """Fields (label, value) as one string, whatever their order."""
    each = F.transform(fields, lambda f: F.concat(canonical_text(f["label"]), F.lit("\x01"), canonical_text(F.coalesce(f["value"], F.lit("")))))
    return F.array_join(F.array_sort(each), "\x02")


def canonical_record(c: Column) -> Column:
    """The text's canonical form: of its fields where all of it is labelled fields, else of the whole.

    Fields are a JSON object, or pieces divided by ``;``, ``|`` or line breaks that each have a label before the first
    ``:`` or ``=``; at least MIN_FIELDS of them.
    """
    obj = F.from_json(c, "map<string,string>")
    from_obj = F.transform(F.map_entries(obj), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value")))
    pieces = F.filter(F.split(c, _BREAK), lambda p: ~p.rlike(_BLANK))
    from_text = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, _FIELD, 1).alias("label"), F.regexp_extract(p, _FIELD, 2).alias("value")))
    like_json = c.rlike(r"(?s)^\s*\{.*\}\s*$")
    labelled = (F.size(pieces) >= MIN_FIELDS) & F.forall(pieces, lambda p: p.rlike(_FIELD))
    fielded = F.concat(F.lit("F"), F.when(like_json & (F.size(obj) >= MIN_FIELDS), _join_fields(from_obj)).when(~like_json & labelled, _join_fields(from_text)))
    return F.coalesce(fielded, F.concat(F.lit("T"), canonical_text(c)))


def _grouped(rows: DataFrame, salts: int) -> tuple[Scratch, DataFrame, DataFrame, DataFrame | None]:
    scratch = Scratch(rows.sparkSession, "typography")
    ok = rows.filter(~is_blank(F.col("id")) & ~is_blank(F.col("text")))
    key = F.unhex(F.sha2(F.concat_ws("\x00", canonical_id(F.col("id")), canonical_record(F.col("text"))), 256))
    keyed = scratch.put(ok.select("ord", key.alias("key")), "keyed")
    hot = find_hot(scratch, keyed.groupBy("key").count(), "key", keyed.count())
    first, n = F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_copies")
    groups = cold_part(keyed, "key", hot).groupBy("key").agg(first, n)
    if hot is not None:
        merge = [F.min("first_ord").alias("first_ord"), F.sum("n_copies").alias("n_copies")]
        groups = groups.unionByName(salted(hot_part(keyed, "key", hot), ["key"], salts, [first, n], merge, F.col("ord")))
    return scratch, keyed, scratch.put(groups, "groups"), hot


def typographic_copies(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(first_ord, copy_ord): every copy but the first with the first of its set.

    ``rows`` has ``ord`` (unique), ``id`` and ``text``; other columns are not read. Rows with a null or blank id or
    text are left out; texts of punctuation alone agree with each other; an empty table gives an empty result.
    """
    _, keyed, groups, hot = _grouped(rows, salts)
    repeated = groups.filter("n_copies > 1").select("key", "first_ord")
    return lookup_join(keyed, repeated, "key", hot).filter("ord <> first_ord").select("first_ord", F.col("ord").alias("copy_ord"))


def collapse_typography(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(ord, id, text, n_copies): one row for each record, the one with the smallest ``ord`` of its copies."""
    _, _, groups, _ = _grouped(rows, salts)
    return rows.select("ord", "id", "text").join(groups.select(F.col("first_ord").alias("ord"), "n_copies"), "ord")
