"""Readers of system models: the textual notation, XMI, Turtle and zipped projects. Each file gives elements
(kind = "element") and relations (kind = "relation"); parsing is sequential within a file and parallel over files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions.vocab import KEYWORD_ROLES, RDF_RELATIONS, RDF_ROLES
from reqloom.operators.model import map_role, relation_type

COLUMNS = ["path", "ord", "kind", "xmi_id", "name", "element_type", "stereotype", "doc", "req_text", "req_id", "package", "source_id", "target_id", "rel_type"]
SCHEMA = "path string, ord long, kind string, " + ", ".join(f"{c} string" for c in COLUMNS[3:])

_COMMENT = re.compile(r"(?<!doc )(?<!doc)/\*.*?\*/|//[^\n]*", re.S)
_DOC = re.compile(r"doc\s*/\*(.*?)\*/", re.S)
_DECL = re.compile(r"\b(package|requirement|part|action|attribute|state|port|interface|connection|transition|require\s+constraint|assume\s+constraint)\b(\s+def)?\s+(?:<[^>]*>\s*)?('[^']+'|[A-Za-z_]\w*)|([{}])")
_TEXT = re.compile(r'text\s*(?:=|:>>)?\s*"([^"]*)"')


def textual_rows(text: str) -> list[dict]:
    """Declarations of the textual notation in order, with their package and the nearest comment before them."""
    blank = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    docs = [(m.end(), " ".join(m.group(1).split())) for m in _DOC.finditer(text)]
    quiet = _DOC.sub(lambda m: " " * len(m.group()), blank)
    out, packages, depth = [], [], 0
    pending = None
    for m in _DECL.finditer(quiet):
        if m.group(4) == "{":
            depth += 1
            if pending:
                packages.append((depth, pending))
                pending = None
            continue
        if m.group(4) == "}":
            packages = [(d, p) for d, p in packages if d < depth]
            depth -= 1
            continue
        key = re.sub(r"\s+", "_", m.group(1)) + ("_def" if m.group(2) else "")
        name = m.group(3).strip("'")
        if key == "package":
            pending = name
            continue
        near = [d for end, d in docs if 0 <= m.start() - end <= 250]
        row = {"name": name, "element_type": key, "doc": near[-1] if near else "", "package": packages[-1][1] if packages else "", "xmi_id": name}
        if key.startswith("requirement"):
            t = _TEXT.search(text, m.end(), m.end() + 800)
            row |= {"req_id": name, "req_text": t.group(1) if t else row["doc"], "stereotype": "Requirement"}
        elif key not in KEYWORD_ROLES:
            continue
        out.append({"kind": "element", **row})
    return out


#: Types of elements that may come without one.
_UNTYPED = {"ownedAttribute": "uml:Property", "ownedPort": "uml:Port", "ownedBehavior": "uml:Activity", "subvertex": "uml:State", "region": "uml:Region"}


def xmi_rows(data: str | bytes) -> list[dict]:
    """Elements, stereotypes applied to them by a base_ attribute, trace relations and compositions of an XMI document."""
    root = ElementTree.fromstring(data)
    local = lambda t: t.rpartition("}")[2]
    # xmi:type and xmi:id; a plain ``type`` names the type of a property and is something else
    attr = lambda e, n: next((v for k, v in e.attrib.items() if k.startswith("{") and local(k) == n), "") or next((v for k, v in e.attrib.items() if k == f"xmi:{n}"), "")
    elements: dict[str, dict] = {}
    links: dict[str, dict] = {}
    parts = []

    def walk(e, package: str) -> None:
        for c in e:
            tag, kind, xid, name = local(c.tag), attr(c, "type"), attr(c, "id"), c.get("name", "")
            inner = package
            if kind in ("uml:Package", "uml:Model"):
                inner = name or package
            elif kind in ("uml:Abstraction", "uml:Realization", "uml:Usage", "uml:Dependency"):
                ends = [x.split() + [attr(y, "idref") for y in c if local(y.tag) == side] for side, x in (("client", c.get("client", "")), ("supplier", c.get("supplier", "")))]
                links[xid] = {"name": name, "ends": ends, "stereotype": ""}
            elif xid and (kind.startswith("uml:") or tag in _UNTYPED) and tag in ("packagedElement", "ownedAttribute", "nestedClassifier", "ownedBehavior", "subvertex", "ownedPort", "node", "region"):
                doc = " ".join(y.get("body", "") or (y.findtext("body") or "") for y in c if local(y.tag) == "ownedComment").strip()
                elements[xid] = {"xmi_id": xid, "name": name, "element_type": kind or _UNTYPED[tag], "package": package, "doc": doc}
                if tag in ("ownedAttribute", "ownedPort") and c.get("type"):
                    parts.append((attr(e, "id"), c.get("type"), name))
            walk(c, inner)

    walk(root, root.get("name", "") if attr(root, "type") in ("uml:Package", "uml:Model") or local(root.tag) in ("Package", "Model") else "")
    for e in root.iter():
        for k, base in e.attrib.items():
            if local(k).startswith("base_"):
                stereo = local(e.tag)
                if base in elements:
                    elements[base] |= {"stereotype": stereo, "req_id": e.get("id") or e.get("Id") or "", "req_text": e.get("text") or e.get("Text") or ""}
                elif base in links:
                    links[base]["stereotype"] = stereo
    out = [{"kind": "element", **e} for e in elements.values()]
    for xid, link in links.items():
        out += [{"kind": "relation", "xmi_id": xid, "name": link["name"], "source_id": a, "target_id": b, "rel_type": link["stereotype"]} for a in link["ends"][0] for b in link["ends"][1] if a and b]
    out += [{"kind": "relation", "xmi_id": "", "name": n, "source_id": a, "target_id": b, "rel_type": "composition"} for a, b, n in parts if b in elements and n]
    return out


_TOKEN = re.compile(r'\s+|#[^\n]*|("""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*")(?:@[\w-]+|\^\^(?:<[^>]*>|[\w:.-]+))?|<[^>]*>|[;,.\[\]()](?=\s|$|[;,.\[\]()])|@?[^\s;,\[\]()<>"]+?(?=\s|[;,\[\]()]|\.\s|\.$|$)')


def turtle_triples(text: str) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) by local names; literals without their quotes."""
    local = lambda t: re.split(r"[#/:]", t.strip("<>"))[-1]
    tokens = [m.group() for m in _TOKEN.finditer(text) if m.group().strip() and not m.group().startswith("#")]
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].lower() in ("@prefix", "@base", "prefix", "base"):
            while i < len(tokens) and tokens[i] != "." and not (tokens[i].startswith("<")):
                i += 1
            i += 1
            if i < len(tokens) and tokens[i] == ".":
                i += 1
            continue
        subject, i = local(tokens[i]), i + 1
        predicate = None
        while i < len(tokens) and tokens[i] != ".":
            t = tokens[i]
            if t == ";":
                predicate = None
            elif t != ",":
                if predicate is None:
                    predicate = "type" if t == "a" else local(t)
                elif t.startswith('"'):
                    body = re.match(r'"""((?:.|\n)*?)"""|"((?:[^"\\]|\\.)*)"', t)
                    out.append((subject, predicate, (body.group(1) or body.group(2) or "").replace('\\"', '"').replace("\\n", "\n")))
                else:
                    out.append((subject, predicate, local(t)))
            i += 1
        i += 1
    return out


def turtle_rows(text: str) -> list[dict]:
    """Elements and relations of an RDF model; types are followed upwards to a known one, rings guarded."""
    triples = turtle_triples(text)
    roles = {t: r for r, ts in RDF_ROLES.items() for t in ts}
    up = {s: o for s, p, o in triples if p == "subClassOf"}
    props: dict[str, dict[str, str]] = {}
    types: dict[str, str] = {}
    for s, p, o in triples:
        if p == "type":
            seen = set()
            while o.lower() not in roles and o in up and o not in seen:
                seen.add(o)
                o = up[o]
            if o.lower() in roles:
                types.setdefault(s, o)
        else:
            props.setdefault(s, {}).setdefault(p.lower(), o)
    out = []
    for s, t in types.items():
        q = props.get(s, {})
        out.append({"kind": "element", "xmi_id": s, "name": q.get("label", s), "element_type": t, "stereotype": t, "doc": q.get("comment", ""), "req_id": q.get("id", q.get("reqid", "")), "req_text": q.get("text", q.get("reqtext", "")), "package": ""})
    for s, p, o in triples:
        verb = RDF_RELATIONS.get(p.lower())
        if verb and s in types and o in types:
            out.append({"kind": "relation", "xmi_id": "", "name": "", "source_id": s, "target_id": o, "rel_type": verb})
    return out


def model_rows(path: str, data: bytes) -> list[dict]:
    """Rows of one model file, its format told by extension and content."""
    if data[:4] == b"PK\x03\x04" or path.endswith(".mdzip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            main = [n for n in names if n.endswith(("uml_model.model", "uml_model.shared_model"))]
            merged: dict[str, dict] = {}
            for i, n in enumerate(main or names):
                body = z.read(n)
                if main or (body.lstrip()[:1] == b"<" and b"xmi" in body.lower()):
                    for k, r in enumerate(xmi_rows(body)):
                        # parts of one project: of an id in several parts the first counts
                        merged.setdefault(r["xmi_id"] or f"{i} {k}", r)
            return list(merged.values())
    text = data.decode("utf-8", "replace")
    if path.endswith((".ttl", ".turtle")) or text.lstrip().startswith("@prefix"):
        return turtle_rows(text)
    if path.endswith(".sysml") or not text.lstrip().startswith("<"):
        if not (rows := textual_rows(text)):
            raise ValueError(f"{path}: no declaration found")
        return rows
    return xmi_rows(data)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Tagged rows of all model files under a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                rows = pd.DataFrame([{"path": p, "ord": i, **r} for i, r in enumerate(model_rows(p, bytes(data)))])
                yield rows.reindex(columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def elements_of(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    return rows.filter("kind = 'element'").select("ord", "xmi_id", "name", "element_type", F.coalesce("stereotype", F.lit("")).alias("stereotype"), map_role(F.col("element_type"), F.col("stereotype"), overrides).alias("role"), "doc", "req_text", "req_id", "package")


def relations_of(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    return rows.filter("kind = 'relation'").select("ord", "xmi_id", "source_id", "target_id", relation_type(F.col("rel_type"), overrides).alias("rel_type"), "name")
