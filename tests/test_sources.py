import io
import json
import zipfile

import pytest

from reqloom.sources import models, readers


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Text,Safety Level,Type\nR1,"a, b",high,x\nR2,,low,\n,c,,y\n')
    got = readers.read_items(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r.id, r.text, r.meta) for r in got] == [("R1", "a, b", {"safety_level": "high", "type": "x"}), (None, "c", {"type": "y"})]
    cols = readers.meta_columns(readers.read_csv(spark, str(tmp_path / "a.csv"))).columns
    assert "attr_type" in cols and "safety_level" in cols
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), text="nothing")


@pytest.mark.parametrize("doc", [[{"id": "R1", "text": "t", "Owner": "o"}], {"R1": {"text": "t", "Owner": "o"}}, {"R1": "t"}])
def test_json(spark, tmp_path, doc):
    (tmp_path / "a.json").write_text(json.dumps(doc))
    r = readers.read_items(spark, str(tmp_path / "a.json")).collect()
    assert [(x.id, x.text) for x in r] == [("R1", "t")]


def test_unknown_shapes_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('"only a text"')
    with pytest.raises(Exception, match="JSON set"):
        readers.read_items(spark, str(tmp_path / "a.json")).collect()
    with pytest.raises(ValueError, match="no declaration"):
        models.model_rows("a.sysml", b"// nothing here\n")
    with pytest.raises(ValueError, match="xlsx"):
        readers.read_items(spark, "a.xls")


def test_text_and_ids(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \none\n")
    rows = readers.with_ids(readers.read_items(spark, str(tmp_path / "a.txt"))).orderBy("ord").collect()
    assert [(r.id, r.text) for r in rows] == [("REQ-1", "one"), ("REQ-2", "two"), ("REQ-3", "one")]


def test_reqif(spark, tmp_path):
    (tmp_path / "a.reqif").write_text(
        '<REQ-IF xmlns="x"><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="D1" LONG-NAME="ReqID"/><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="D2" LONG-NAME="ReqText"/><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="D3" LONG-NAME="Rationale"/>'
        '<SPEC-OBJECT><VALUES><ATTRIBUTE-VALUE-STRING THE-VALUE="S1"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>D1</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>'
        '<ATTRIBUTE-VALUE-STRING THE-VALUE="words"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>D2</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>'
        '<ATTRIBUTE-VALUE-STRING THE-VALUE="why"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>D3</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING></VALUES></SPEC-OBJECT></REQ-IF>'
    )
    assert [(r.id, r.text, r.meta) for r in readers.read_items(spark, str(tmp_path / "a.reqif")).collect()] == [("S1", "words", {"rationale": "why"})]


XMI = """<xmi:XMI xmlns:xmi="x" xmlns:uml="u" xmlns:p="p"><uml:Model xmi:id="m" name="M"><packagedElement xmi:type="uml:Package" xmi:id="k" name="P">
<packagedElement xmi:type="uml:Class" xmi:id="b1" name="Brake"><ownedAttribute xmi:type="uml:Property" xmi:id="a1" name="disc" type="b2"/></packagedElement>
<packagedElement xmi:type="uml:Class" xmi:id="b2" name="Disc"/><packagedElement xmi:type="uml:Class" xmi:id="r1" name="Stop"/>
<packagedElement xmi:type="uml:Abstraction" xmi:id="x1" client="b1" supplier="r1"/></packagedElement></uml:Model>
<p:Block xmi:id="s1" base_Class="b1"/><p:SafetyRequirement xmi:id="s2" base_Class="r1" id="SR-1" text="shall stop"/><p:verifies xmi:id="s3" base_Abstraction="x1"/></xmi:XMI>"""
TTL = '@prefix : <http://x#> .\n:Brake a :Block ; :label "Brake" ; :satisfies :R1 .\n:MyReq :subClassOf :Requirement .\n:R1 a :MyReq ; :id "SR-1" ; :text "shall \\"stop\\"." .\n'


def test_models(spark, tmp_path):
    (tmp_path / "a.xmi").write_text(XMI)
    (tmp_path / "b.ttl").write_text(TTL)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("com.x.uml_model.model", XMI)
    (tmp_path / "c.mdzip").write_bytes(z.getvalue())
    (tmp_path / "d.sysml").write_text('package P {\n doc /* the brake */\n part def Brake { port p; }\n requirement def R1 { text = "shall stop"; }\n}')
    rows = models.read_models(spark, str(tmp_path)).cache()
    count = {r[0].rsplit("/", 1)[1]: r[1] for r in rows.groupBy("path").count().collect()}
    assert count["a.xmi"] == count["c.mdzip"] == 6
    e = {(r.name, r.role) for r in models.elements_of(rows).collect()}
    assert {("Brake", "SUBJECT"), ("Stop", "CONSTRAINT"), ("R1", "CONSTRAINT"), ("p", "ACTOR")} <= e
    rel = {(r.source_id, r.target_id, r.rel_type) for r in models.relations_of(rows).collect()}
    assert {("b1", "r1", "satisfy"), ("b1", "b2", "composition"), ("Brake", "R1", "satisfy")} <= rel
