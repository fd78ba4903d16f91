import glob
import json
from xml.etree import ElementTree

import pytest

from reqloom.operators import model, propgraph
from reqloom.operators import requirement_set as rs
from reqloom.sources import models, readers, writers

ROWS = [
    (1, "R1", "The mixer shall heat the bowl and the panel shall show the weight."),
    (2, "R1", 'The "big" panel <must> light & ring.'), (3, None, "The fan shall stop."), (4, "R1*", "The fan\tshall run\nwithin 2 s."), (5, "E", " "), (6, "N", None),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, "ord long, id string, text string")


@pytest.fixture(scope="module")
def reqs(items):
    return rs.requirement_set(items).cache()


def _text(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_sets_are_divided_and_ids_are_unique(reqs):
    got = [(r.ord, r.part, r.id, r.text) for r in reqs.orderBy("ord", "part").collect()]
    assert [x[:3] for x in got] == [(1, 1, "R1-1"), (1, 2, "R1-2"), (2, 1, "R1"), (3, 1, "REQ-3"), (4, 1, "R1*")]
    table = rs.set_table(reqs).orderBy("ord", "part").collect()
    assert table[1].subject == "the panel" and all(r.roundtrip_ok for r in table)


def test_ids_with_asterisks_of_their_own(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["A", "A*", "A", "B", "A*", ""])], "ord long, id string")
    assert [r.id for r in rs.distinct_ids(df).orderBy("ord").collect()] == ["A", "A*", "A**", "B", "A***", ""]
    assert rs.distinct_ids(df.limit(0)).count() == 0


def _graph(spark, reqs):
    nodes = rs.set_nodes(reqs).unionByName(rs.element_nodes(reqs))
    matches = spark.createDataFrame([("R1-1", "R1", "SUBJECT", 0.75), ("R1-1", "R1", "SUBJECT", 0.7), ("R1", "REQ-3", "OBJECT", 1.0)], "a string, b string, role string, score double")
    return nodes, rs.element_edges(reqs).unionByName(rs.similarity_edges(matches))


def test_graphml_is_read_by_a_standard_parser(spark, reqs, tmp_path):
    nodes, edges = _graph(spark, reqs)
    propgraph.write(propgraph.document(nodes, edges, "graphml"), str(tmp_path / "g"))
    root = ElementTree.fromstring(_text(tmp_path / "g").encode())
    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    declared = {k.get("id") for k in root.findall("g:key", ns)}
    used = {d.get("key") for d in root.iter("{http://graphml.graphdrawing.org/xmlns}data")}
    assert used <= declared and len(declared) == len(root.findall("g:key", ns))
    ids = [n.get("id") for n in root.iter("{http://graphml.graphdrawing.org/xmlns}node")]
    assert len(ids) == len(set(ids)) == nodes.count()
    ends = {(e.get("source"), e.get("target")) for e in root.iter("{http://graphml.graphdrawing.org/xmlns}edge")}
    assert {x for e in ends for x in e} <= set(ids) and ("R1-1", "R1") in ends
    texts = {d.text for n in root.iter("{http://graphml.graphdrawing.org/xmlns}node") if n.get("id") == "R1" for d in n if d.get("key") == "text"}
    assert texts == {'The "big" panel <must> light & ring.'}


def test_turtle_is_read_back(spark, reqs, tmp_path):
    nodes, edges = _graph(spark, reqs)
    propgraph.write(propgraph.document(nodes, edges, "turtle"), str(tmp_path / "g"))
    triples = models.turtle_triples(_text(tmp_path / "g"))
    assert ("R1", "text", 'The "big" panel <must> light & ring.') in triples
    assert sum(p == "type" for _, p, _ in triples) == nodes.count() and ("R1_1", "SIMILAR_SUBJECT", "R1") in triples


@pytest.mark.parametrize(("form", "first", "last"), [("dot", "digraph g {", "}"), ("mermaid", "flowchart LR", None), ("cypher", None, None)])
def test_other_formats(spark, reqs, tmp_path, form, first, last):
    nodes, edges = _graph(spark, reqs)
    propgraph.write(propgraph.document(nodes, edges, form), str(tmp_path / "g"))
    got = _text(tmp_path / "g").splitlines()
    assert (first is None or got[0] == first) and (last is None or got[-1] == last)
    body = [x for x in got if x not in (first, last, "  rankdir=LR;")]
    assert len(body) == nodes.count() + edges.count() and sum("SIMILAR_" in x for x in body) == 2
    with pytest.raises(ValueError):
        propgraph.lines(nodes, edges, "nothing")


def test_reqif_comes_back(spark, items, tmp_path):
    writers.write_reqif(items.filter("text IS NOT NULL"), str(tmp_path / "out"), "my set")
    (tmp_path / "a.reqif").write_text(_text(tmp_path / "out"), encoding="utf-8")
    got = {(r.id, r.text) for r in readers.read_items(spark, str(tmp_path / "a.reqif")).collect()}
    assert got == {(i or f"REQ-{o:03d}", t) for o, i, t in ROWS if t and t.strip()}


def test_csv_and_json_come_back(spark, reqs, tmp_path):
    flat = rs.set_table(reqs)
    writers.write_csv(flat, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == flat.columns and {r.text for r in back.collect()} == {r.text for r in flat.collect()}
    writers.write_json(flat, str(tmp_path / "j"))
    assert {(r.id, r.text) for r in spark.read.json(str(tmp_path / "j")).collect()} == {(r.id, r.text) for r in flat.collect()}


def test_summary_and_tree(reqs):
    s = {r.id: r.summary for r in rs.summary(reqs, "id").collect()}
    assert s["R1-2"].splitlines()[-2:] == ["- PROCESS: show [autonomous activity]", "- OBJECT: the weight"] and "type: " in s["R1-2"]
    t = {r.id: json.loads(r.tree) for r in rs.nested(reqs, "id").collect()}
    assert [x["role"] for x in t["R1-2"]["actions"][0]] == ["PROCESS", "OBJECT"] and "OBJECT" not in [x["role"] for x in t["R1-2"]["elements"]]


def test_markdown(spark):
    rows = spark.createDataFrame([(1, "A|B", "x" * 80, "-", "Gap", "Test", "PASS"), (2, None, "a\nb", "e", "Verified", "Test", "FAIL")], "item long, req_id string, text string, allocated string, trace_status string, method string, quality string")
    got = {r.item: r.line for r in writers.markdown_line(rows).collect()}
    assert got[1] == "| A\\|B | " + "x" * 67 + "… | - | Gap | Test | PASS |" and got[2] == "|  | a b | e | Verified | Test | FAIL |"


def test_upward_types_without_a_bound(spark):
    n = 40
    elements = spark.createDataFrame([(f"e{i}", "Block" if i == n else "") for i in range(n + 1)] + [("a", ""), ("b", ""), ("z", "")], "xmi_id string, stereotype string")
    relations = spark.createDataFrame([(f"e{i}", f"e{i + 1}", "generalization") for i in range(n)] + [("a", "b", "generalization"), ("b", "a", "generalization"), ("z", "gone", "generalization")], "source_id string, target_id string, rel_type string")
    got = {r.xmi_id: (r.found, r.steps) for r in model.resolve_upwards(elements, relations).collect()}
    assert got == {f"e{i}": ("Block", n - i) for i in range(n + 1)}
    assert model.resolve_upwards(elements, relations.limit(0)).count() == 1


def test_properties_without_a_type_of_their_own(spark):
    doc = """<uml:Model xmlns:xmi="http://www.omg.org/spec/XMI/20131001" xmlns:uml="u" xmi:id="m" name="plant">
    <packagedElement xmi:type="uml:Class" xmi:id="t" name="Tank"><ownedAttribute xmi:id="p" name="level"/><ownedAttribute xmi:id="q" name="lid" type="l" aggregation="composite"/></packagedElement>
    <packagedElement xmi:type="uml:Class" xmi:id="l" name="Lid"/></uml:Model>"""
    rows = models.xmi_rows(doc)
    assert {(r["name"], r["element_type"], r["package"]) for r in rows if r["kind"] == "element"} == {("Tank", "uml:Class", "plant"), ("level", "uml:Property", "plant"), ("lid", "uml:Property", "plant"), ("Lid", "uml:Class", "plant")}
    assert [(r["source_id"], r["target_id"], r["rel_type"]) for r in rows if r["kind"] == "relation"] == [("t", "l", "composition")]


def test_parts_of_a_project_are_merged(tmp_path):
    import io
    import zipfile

    part = '<xmi:XMI xmlns:xmi="x" xmlns:uml="u">{pad}<packagedElement xmi:type="uml:Class" xmi:id="a" name="A"/></xmi:XMI>'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("one.xml", part.format(pad="<!--" + " " * 5000 + "-->"))
        f.writestr("two.xml", part.format(pad=""))
        f.writestr("note.txt", "nothing")
    assert [r["xmi_id"] for r in models.model_rows("x.mdzip", z.getvalue())] == ["a"]


def test_empty_sets(spark, reqs):
    none = reqs.limit(0)
    assert rs.set_table(none).count() == rs.element_nodes(none).count() == rs.summary(none, "id").count() == 0
    d = propgraph.document(rs.set_nodes(none), rs.element_edges(none), "dot")
    assert [r.line for r in d.orderBy("part", "sort").collect()] == ["digraph g {", "  rankdir=LR;", "}"]
