import base64
import json

import pytest

from reqloom.functions import inputs
from reqloom.operators import model, similarity
from reqloom.sources import readers


def test_thresholds():
    assert inputs.threshold(0.3) == 0.3 and inputs.threshold("0.5") == 0.5 and inputs.threshold("x") == 0.6 and inputs.threshold(None, 0.2) == 0.2 and inputs.threshold(float("nan")) == 0.6
    with pytest.warns(UserWarning):
        assert inputs.threshold(7) == 1.0
    with pytest.warns(UserWarning):
        assert inputs.threshold(-1) == 0.0


def test_roles():
    assert inputs.roles(" subject, Object,,subject ") == ("SUBJECT", "OBJECT") == inputs.roles(["Subject", "object"]) and inputs.roles("") == ()
    with pytest.raises(ValueError, match="WHEEL"):
        inputs.roles("subject,wheel")


def test_overrides(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"ECU": "subject", "Verifies": "Satisfy", "Odd": None, " ": "OBJECT"}))
    assert inputs.overrides(str(tmp_path / "m.json"), "Wire=object,bad,Nut=WHEEL") == ({"ecu": "SUBJECT", "wire": "OBJECT"}, {"verifies": "satisfy"})
    assert inputs.overrides({"roles": {"A": "actor", "B": "nothing"}, "relations": {"V": "trace"}}) == ({"a": "ACTOR"}, {"v": "trace"})
    assert inputs.overrides(None) == ({}, {})
    with pytest.raises(ValueError):
        inputs.overrides([1])


@pytest.mark.parametrize(
    ("name", "content"),
    [
        ("a.csv", 'ID,Text,Owner\nR1,"a, b",x\nR2,,y\n'), ("a.json", '[{"id": "R1", "text": "a, b", "Owner": "x"}, {"id": "R2", "text": " "}]'),
        ("a.json", '{"R1": {"text": "a, b", "owner": "x"}}'),
    ],
)
def test_content_in_memory(spark, name, content):
    want = [("R1", "a, b", {"owner": "x"})]
    assert [(r.id, r.text, r.meta) for r in readers.read_content(spark, content, name).collect()] == want
    coded = base64.b64encode(content.encode()).decode()
    assert [(r.id, r.text, r.meta) for r in readers.read_content(spark, coded, name, base64=True).collect()] == want


def test_content_that_cannot_be_read(spark):
    for name, content in (("a.csv", "x,y\n1,2\n"), ("a.json", "[1]"), ("a.doc", "x")):
        with pytest.raises(ValueError):
            readers.read_content(spark, content, name)
    assert [r.text for r in readers.read_content(spark, "one\n\n two ", "a.txt").orderBy("ord").collect()] == ["one", "two"]


def test_scorers():
    assert similarity.scorer("jaccard") is similarity.similar_sets and similarity.scorer("lexical") is similarity.similar_phrases
    with pytest.raises(ValueError):
        similarity.scorer("nothing")


def test_contexts_reach_two_steps(spark):
    words = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", ["z", "y"]), ("d", ["far"]), ("e", [])], "node string, w array<string>")
    step = spark.createDataFrame([(u, v) for p in ("ab", "bc", "cd") for u, v in (p, p[::-1])], "u string, v string")
    got = {}
    for r in model.word_contexts(words, step, 2).collect():
        got.setdefault(r.node, set()).add(r.w)
    assert got == {"a": {"x", "y", "z"}, "b": {"x", "y", "z", "far"}, "c": {"x", "y", "z", "far"}, "d": {"far", "z", "y"}}
