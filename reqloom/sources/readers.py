"""Readers of requirement sets: CSV, JSON, JSON lines, plain text, Excel, ReqIF; all give (ord, id, text, meta)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions.text import column_name, is_blank
from reqloom.functions.vocab import RESERVED_COLUMNS

SCHEMA = "ord long, id string, text string, meta map<string,string>"


def normalise(df: DataFrame, text: str = "text", id_: str = "id") -> DataFrame:
    """Requirement rows of any table: normalised names, blank texts dropped, other columns as metadata without nulls."""
    df = df.toDF(*(column_name(c) for c in df.columns))
    text, id_ = column_name(text), column_name(id_)
    if text not in df.columns:
        raise ValueError(f"there is no column {text!r}; found: {', '.join(df.columns)}")
    extra = [c for c in df.columns if c not in (text, id_)]
    meta = F.create_map(*(x for c in extra for x in (F.lit(c), F.col(c).cast("string")))) if extra else F.create_map().cast("map<string,string>")
    key = F.col(id_).cast("string") if id_ in df.columns else F.lit(None).cast("string")
    rows = df.select(key.alias("id"), F.col(text).cast("string").alias("text"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("meta"))
    return rows.filter(~is_blank(F.col("text"))).select(F.monotonically_increasing_id().alias("ord"), "id", "text", "meta")


def read_csv(spark: SparkSession, path: str, text: str = "text", id_: str = "id") -> DataFrame:
    """CSV with a header; all values are read as text, only empty ones are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return normalise(raw, text, id_)


def read_json(spark: SparkSession, path: str, text: str = "text", id_: str = "id") -> DataFrame:
    """A JSON document: an array of objects, an object of objects by id, or an object of texts by id."""
    whole = spark.read.option("wholetext", True).text(path)
    c = F.trim("value")
    rows = whole.select(F.when(c.startswith("["), F.from_json(c, "array<map<string,string>>")).otherwise(F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.map_concat(F.create_map(F.lit(id_), e["key"]), F.when(F.trim(e["value"]).startswith("{"), F.from_json(e["value"], "map<string,string>")).otherwise(F.create_map(F.lit(text), e["value"]))))).alias("rows"))
    unknown = F.raise_error(F.lit("a JSON set is an array of objects, or an object of objects or texts by id")).cast("array<map<string,string>>")
    each = rows.select(F.posexplode(F.coalesce("rows", unknown)).alias("ord", "m"))
    named = each.select("ord", F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.regexp_replace(F.lower(F.trim(e["key"])), r"[\s\-]+", "_").alias("k"), e["value"].alias("v")))).alias("m"))
    keys = F.array(F.lit(column_name(text)), F.lit(column_name(id_)))
    out = named.select(F.col("ord").cast("long").alias("ord"), F.col("m")[column_name(id_)].alias("id"), F.col("m")[column_name(text)].alias("text"), F.map_filter("m", lambda k, v: ~F.array_contains(keys, k) & v.isNotNull()).alias("meta"))
    return out.filter(~is_blank(F.col("text")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labelled spans: (text, spans)."""
    return spark.read.schema("text string, spans array<struct<start:int,end:int,role:string>>").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One requirement per non-blank line."""
    lines = spark.read.text(path).select(F.trim("value").alias("text"))
    return normalise(lines)


def _sheet(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet of a workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", ns):
                col = 0
                for ch in re.match(r"[A-Z]*", c.get("r", "A")).group():
                    col = col * 26 + ord(ch) - 64
                v = c.find("m:v", ns)
                inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells[col] = shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else None)
            out.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
        return out


def read_excel(spark: SparkSession, path: str, text: str = "text", id_: str = "id") -> DataFrame:
    """The first sheet of workbooks, read where the files lie; its first row names the columns."""
    tn, idn = column_name(text), column_name(id_)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                rows = _sheet(bytes(data))
                names = [column_name(x or "") for x in rows[0]] if rows else []
                recs = []
                for i, r in enumerate(rows[1:]):
                    d = dict(zip(names, r, strict=False))
                    recs.append((i, d.pop(idn, None), d.pop(tn, None), {k: v for k, v in d.items() if v is not None and k}))
                yield pd.DataFrame(recs, columns=["ord", "id", "text", "meta"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA).filter(~is_blank(F.col("text")))


def reqif_rows(data: bytes) -> list[tuple]:
    """(id, text, meta) of the spec objects of a ReqIF document; string attributes only, rows without text left out."""
    root = ElementTree.fromstring(data)
    tag = lambda e: e.tag.rpartition("}")[2]
    names = {e.get("IDENTIFIER"): (e.get("LONG-NAME") or e.get("IDENTIFIER") or "") for e in root.iter() if tag(e) == "ATTRIBUTE-DEFINITION-STRING"}
    out = []
    for obj in (e for e in root.iter() if tag(e) == "SPEC-OBJECT"):
        got: dict[str, str] = {}
        for v in (e for e in obj.iter() if tag(e) == "ATTRIBUTE-VALUE-STRING"):
            ref = next((e.text for e in v.iter() if tag(e) == "ATTRIBUTE-DEFINITION-STRING-REF"), None)
            got[ref or ""] = v.get("THE-VALUE") or ""
        rid = text = None
        meta = {}
        for ref, value in got.items():
            name = names.get(ref, ref).lower()
            if name in ("reqid", "id") or ref == "AD-ID":
                rid = value
            elif name in ("reqtext", "text") or ref == "AD-TEXT":
                text = value
            else:
                meta[column_name(name)] = value
        if text and text.strip():
            out.append((rid, text, meta))
    return out


def read_reqif(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                yield pd.DataFrame([(i, *r) for i, r in enumerate(reqif_rows(bytes(data)))], columns=["ord", "id", "text", "meta"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension."""
    ext = path.rpartition(".")[2].lower()
    readers = {"csv": read_csv, "json": read_json, "xlsx": read_excel, "reqif": read_reqif, "xml": read_reqif, "txt": read_text}
    if ext == "xls":
        raise ValueError("the old binary workbook format is not read; save it as xlsx")
    if ext not in readers:
        raise ValueError(f"no reader for {path!r}")
    return readers[ext](spark, path)


def read_content(spark: SparkSession, content: str | bytes, name: str, base64: bool = False, text: str = "text", id_: str = "id") -> DataFrame:
    """A requirement set whose content is in memory already; ``name`` tells the format by its extension.

    ``base64``: the content is encoded so (workbooks sent as text). Formats and results are those of ``read_items``.
    """
    import base64 as b64
    import csv
    import json

    data = b64.b64decode(content) if base64 else content.encode("utf-8") if isinstance(content, str) else content
    ext = name.rpartition(".")[2].lower()
    if ext in ("reqif", "xml"):
        rows = reqif_rows(data)
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    if ext == "xlsx":
        grid = _sheet(data)
    elif ext == "csv":
        grid = [[x or None for x in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""))]
    elif ext == "txt":
        grid = [[text], *([line.strip()] for line in data.decode("utf-8-sig").splitlines())]
    elif ext == "json":
        doc = json.loads(data)
        if isinstance(doc, dict):
            doc = [{id_: k, **(v if isinstance(v, dict) else {text: v})} for k, v in doc.items()]
        if not isinstance(doc, list) or not all(isinstance(d, dict) for d in doc):
            raise ValueError("a JSON set is an array of objects, or an object of objects or texts by id")
        names = list(dict.fromkeys(k for d in doc for k in d))
        as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        grid = [names, *([as_text(d.get(n)) for n in names] for d in doc)]
    else:
        raise ValueError(f"no reader for {name!r}")
    names = [column_name(x or "") for x in grid[0]] if grid else []
    tn, idn = column_name(text), column_name(id_)
    if tn not in names:
        raise ValueError(f"there is no column {tn!r}; found: {', '.join(names)}")
    out = []
    for i, r in enumerate(grid[1:]):
        d = dict(zip(names, r, strict=False))
        out.append((i, d.pop(idn, None), d.pop(tn, None), {k: v for k, v in d.items() if v is not None and k}))
    return spark.createDataFrame(out, SCHEMA).filter(~is_blank(F.col("text")))


def meta_columns(df: DataFrame) -> DataFrame:
    """Metadata spread into columns; names that results use are prefixed with attr_."""
    # one row per metadata name
    keys = [r.k for r in df.select("ord", F.explode(F.map_keys("meta")).alias("k")).groupBy("k").agg(F.min("ord").alias("o")).orderBy("o", "k").collect()]
    cols = [F.coalesce(F.col("meta")[k], F.lit("")).alias(f"attr_{k}" if k in RESERVED_COLUMNS else k) for k in keys]
    return df.select("ord", "id", "text", *cols)


def with_ids(df: DataFrame) -> DataFrame:
    """REQ-n for rows without an id, by their order; an id that comes again gets as many asterisks as make it unique."""
    from reqloom.operators.requirement_set import distinct_ids
    from reqloom.operators.trace import numbered

    n = numbered(df, "ord").withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("REQ-"), "n"))).drop("n")
    return distinct_ids(n)
