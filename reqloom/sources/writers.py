"""Writers of requirement sets and trace matrices; every one writes where the rows lie, in parallel.

Formats with one root (ReqIF) get their frame as first and last lines of a range-sorted text output: the files, read in
the order of their names, are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.text import escape_xml, shorten, strip
from reqloom.operators.propgraph import write as write_lines

_REQIF_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<REQ-IF xmlns="http://www.omg.org/spec/ReqIF/20110401/reqif.xsd"><THE-HEADER><REQ-IF-HEADER IDENTIFIER="header"><REQ-IF-VERSION>1.0</REQ-IF-VERSION><TITLE>{title}</TITLE></REQ-IF-HEADER></THE-HEADER>
<CORE-CONTENT><REQ-IF-CONTENT><DATATYPES><DATATYPE-DEFINITION-STRING IDENTIFIER="DT-STRING" LONG-NAME="String"/></DATATYPES>
<SPEC-TYPES><SPEC-OBJECT-TYPE IDENTIFIER="ST-REQ" LONG-NAME="Requirement"><SPEC-ATTRIBUTES>
<ATTRIBUTE-DEFINITION-STRING IDENTIFIER="AD-ID" LONG-NAME="ReqID"><TYPE><DATATYPE-DEFINITION-STRING-REF>DT-STRING</DATATYPE-DEFINITION-STRING-REF></TYPE></ATTRIBUTE-DEFINITION-STRING>
<ATTRIBUTE-DEFINITION-STRING IDENTIFIER="AD-TEXT" LONG-NAME="ReqText"><TYPE><DATATYPE-DEFINITION-STRING-REF>DT-STRING</DATATYPE-DEFINITION-STRING-REF></TYPE></ATTRIBUTE-DEFINITION-STRING>
</SPEC-ATTRIBUTES></SPEC-OBJECT-TYPE></SPEC-TYPES><SPEC-OBJECTS>"""
_REQIF_TAIL = "</SPEC-OBJECTS></REQ-IF-CONTENT></CORE-CONTENT></REQ-IF>"


def _attribute(value: Column) -> Column:
    """A value inside an XML attribute: line ends and tabs as references, characters XML cannot hold left out."""
    c = escape_xml(F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))
    for char, ref in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def reqif_objects(items: DataFrame) -> DataFrame:
    """(sort, line): a spec object for each item (ord, id, text), in order; without an id REQ- and ``ord`` in three digits."""
    key = F.coalesce(F.nullif(strip(F.col("id")), F.lit("")), F.format_string("REQ-%03d", F.col("ord")))
    value = lambda c, ref: F.concat(F.lit('<ATTRIBUTE-VALUE-STRING THE-VALUE="'), _attribute(c), F.lit(f'"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>{ref}</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>'))
    line = F.concat(F.lit('<SPEC-OBJECT IDENTIFIER="OBJ-'), F.col("ord").cast("string"), F.lit('"><VALUES>'), value(key, "AD-ID"), value(F.coalesce("text", F.lit("")), "AD-TEXT"), F.lit("</VALUES><TYPE><SPEC-OBJECT-TYPE-REF>ST-REQ</SPEC-OBJECT-TYPE-REF></TYPE></SPEC-OBJECT>"))
    return items.select(F.lpad(F.col("ord").cast("string"), 20, "0").alias("sort"), line.alias("line"))


def write_reqif(items: DataFrame, path: str, title: str = "requirements") -> None:
    head, tail = _REQIF_HEAD.format(title=title).split("\n"), [_REQIF_TAIL]
    ends = items.sparkSession.createDataFrame([(0, f"{i:04d}", x) for i, x in enumerate(head)] + [(2, "", x) for x in tail], "part int, sort string, line string")
    write_lines(reqif_objects(items).select(F.lit(1).alias("part"), "sort", "line").unionByName(ends), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file; arrays and maps as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON records, one per line; nulls are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def matrix_rows(status: DataFrame, allocations: DataFrame, items: DataFrame, method: Column, issues: Column) -> DataFrame:
    """Rows of the trace matrix with texts ready to print.

    ``status`` (item, status, quality_pass), ``allocations`` (item, element, link_type, confidence), ``items`` (item,
    req_id, text, rationale, verification_status). Elements of an item are joined in alphabetical order, "-" for none.
    """
    by = allocations.groupBy("item").agg(
        F.array_join(F.array_sort(F.collect_set("element")), "; ").alias("allocated"),
        F.array_join(F.array_sort(F.collect_set("link_type")), "; ").alias("link_types"),
        F.max("confidence").alias("confidence"),
    )
    d = items.join(status, "item").join(by, "item", "left")
    return d.select(
        "item", "req_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nullif("allocated", F.lit("")), F.lit("-")).alias("allocated"), F.coalesce(F.nullif("link_types", F.lit("")), F.lit("-")).alias("link_types"),
        F.col("status").alias("trace_status"), method.alias("method"), F.coalesce("verification_status", F.lit("")).alias("verification_status"), F.when(F.col("quality_pass"), "PASS").otherwise("FAIL").alias("quality"),
        F.array_join(issues, "; ").alias("issues"), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.coalesce("rationale", F.lit("")).alias("rationale"),
    )


def markdown_line(rows: DataFrame) -> DataFrame:
    """(item, line): table rows in Markdown; texts of more than 70 characters are cut, bars and line ends masked."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), r"\|", "\\\\|")
    cells = [F.col("req_id"), shorten(F.col("text"), 70, "\u2026"), F.col("allocated"), F.col("trace_status"), F.col("method"), F.col("quality")]
    return rows.select("item", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |")).alias("line"))
