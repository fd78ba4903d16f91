from pyspark.sql import functions as F

from reqloom.functions.grammar import EARS, Grammar
from reqloom.operators import quality, split, tiling
from reqloom.operators.extract import extract, extract_with, resolve_overlaps, sanitise

FIRE = "As soon as an engine fire is detected, the engine control unit shall shut off the affected engine and activate the fire suppression system within 500 milliseconds."
TEXTS = [
    "The flight management system shall calculate the optimal cruise altitude.",
    "When the cabin altitude exceeds 14,000 feet, the oxygen system shall deploy the passenger oxygen masks within 4 seconds.",
    "While the aircraft is on the ground, the avionics suite shall provide the pilot with the ability to configure the flight plan if the parking brake is set.",
    FIRE,
    "The system shall not transmit the message during radio silence.",
    "Where dual redundancy is installed, the system should report the channel status.",
    "", "   ", "shall", "no modal here", "x" * 20000, "Ünïcode – die Anlage shall läuft \U0001f600 ok.", None,
]


def _tiled(spark, texts=TEXTS, **kw):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "ord long, text string, tiles_ string")
    return extract(df, **kw)


def test_decomposition(spark):
    got = {}
    for r in tiling.elements(tiling.terminals(_tiled(spark))).orderBy("ord", "pos").collect():
        got.setdefault(r.ord, []).append((r.role, r.text))
    assert got[0] == [("SUBJECT", "The flight management system"), ("MODALITY", "shall"), ("PROCESS", "calculate"), ("OBJECT", "the optimal cruise altitude")]
    assert ("CONDITION", "When the cabin altitude exceeds 14,000 feet") in got[1] and ("CONSTRAINT", "within 4 seconds") in got[1]
    assert ("ACTOR", "the pilot") in got[2] and ("CONDITION", "if the parking brake is set") in got[2]
    assert [x for x in got[3] if x[0] == "PROCESS"] == [("PROCESS", "shut off"), ("PROCESS", "activate")]
    assert got[5][0] == ("SUBJECT", "Where dual redundancy is installed, the system")


def test_where_opens_a_condition_in_the_other_template(spark):
    roles = [r.role for r in tiling.elements(tiling.terminals(_tiled(spark, [TEXTS[5]], g=EARS))).collect()]
    assert "CONDITION" in roles


def test_every_text_comes_back(spark):
    t = _tiled(spark).filter("text IS NOT NULL")
    assert t.filter(tiling.generated(F.col("text"), F.col("tiles")) != F.col("text")).count() == 0


def test_graphs_are_sound(spark):
    base = _tiled(spark).filter("text <> ''")
    terms = tiling.terminals(base)
    acts = tiling.actions(base)
    nodes, edges = tiling.nodes(base), tiling.edges(base)
    assert tiling.integrity_errors(nodes, edges, terms).count() == 0
    assert edges.filter("ord = 1 AND rel = 'NEXT'").count() == 11
    assert {r.operator for r in acts.filter("ord = 3").collect()} == {"AND"}
    loose = edges.limit(1).withColumn("dst", F.lit("nowhere_1"))
    assert tiling.integrity_errors(nodes, loose, terms).filter("error = 'edge to unknown node'").count() == 1


def test_bad_claims(spark):
    rows = [(1, [(-5, 3, "SUBJECT", None, None), (2, 9, "OBJECT", None, None), (10, 9999, "PROCESS", None, None), (4, 4, "ACTOR", None, None), (5, 7, "NOPE", None, None), None])]
    df = spark.createDataFrame(rows, "ord long, claims array<struct<start:int,end:int,role:string,marker:string,kind:string>>").withColumn("text", F.lit("The pump shall stop."))
    t = tiling.with_tiles(df)
    assert t.select(tiling.generated(F.col("text"), F.col("tiles"))).first()[0] == "The pump shall stop."
    kept = df.select(resolve_overlaps(sanitise(F.col("claims"), F.length("text"), ("SUBJECT", "OBJECT", "PROCESS")))).first()[0]
    assert [(x.start, x.end) for x in kept] == [(0, 3), (10, 20)]


SPLITS = [
    ("The mixer shall heat the bowl and the panel shall show the weight.", ["The mixer shall heat the bowl", "the panel shall show the weight."]),
    ("The mixer shall heat the bowl. The mixer shall ring.", ["The mixer shall heat the bowl.", "The mixer shall ring."]),
    ("The mixer shall heat the bowl, the cook shall taste the soup.", ["The mixer shall heat the bowl", "the cook shall taste the soup."]),
    ("The mixer shall heat the bowl; the mixer shall ring.", ["The mixer shall heat the bowl;", "the mixer shall ring."]),
    ("The fan shall stop within 2.5 seconds and the panel shall show the time.", ["The fan shall stop within 2.5 seconds", "the panel shall show the time."]),
    ("The mixer shall watch the bowl and the lid and the panel shall show errors.", ["The mixer shall watch the bowl and the lid", "the panel shall show errors."]),
    ("Motors must stop, and Brakes must close and lights must blink", ["Motors must stop", "Brakes must close", "lights must blink"]),
    ("It shall run and stop, as it must", ["It shall run", "stop, as it must"]),
    (FIRE, [FIRE]), (TEXTS[4], [TEXTS[4]]), ("The mixer shall ensure the cook can read the panel.", ["The mixer shall ensure the cook can read the panel."]), ("", [""]), ("shall shall", ["shall shall"]), (None, None),
]


def test_splitting(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPLITS)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", split.split_column(F.col("text")).alias("s")).collect()}
    for i, (_, want) in enumerate(SPLITS):
        assert got[i] == want


def test_other_modals_split_too(spark):
    g = Grammar(modal=("soll",), joint=("und",))
    df = spark.createDataFrame([("Die Pumpe soll laufen und Ventile soll man sehen",)], "text string")
    assert df.select(split.split_column(F.col("text"), g)).first()[0] == ["Die Pumpe soll laufen", "Ventile soll man sehen"]


def test_own_extractor(spark):
    def find(text):
        if "!" in text:
            raise ValueError("loud")
        return [{"start": 0, "end": 3, "role": "SUBJECT"}, {"start": 2, "end": 9, "role": "OBJECT"}, {"start": 5, "end": 10**6, "role": "PROCESS", "kind": "k"}, {"start": 1, "end": 2, "role": "NOPE"}, {"role": "SUBJECT"}]

    df = spark.createDataFrame([(1, "The pump stops."), (2, "Stop!"), (3, None), (4, "")], "ord long, text string")
    got = {r.ord: r for r in extract_with(df, find).collect()}
    assert [(t.start, t.end, t.role) for t in got[1].tiles] == [(0, 3, "SUBJECT"), (3, 5, "GLUE"), (5, 15, "PROCESS")] and got[1].error == ""
    assert got[2].error == "ValueError: loud" and [t.role for t in got[2].tiles] == ["GLUE"]
    assert got[3].tiles is None and got[3].error == "" and got[4].tiles == []


def test_split_ids(spark):
    df = spark.createDataFrame([("REQ-9", "The system shall open the valve and the controller shall log the event."), ("R", "One shall stop."), (None, None)], "id string, text string")
    assert sorted(r.id for r in split.split_statements(df).collect() if r.id) == ["R", "REQ-9-1", "REQ-9-2"]


def test_classes(spark):
    t = quality.flat_table(_tiled(spark), ["ord"]).orderBy("ord").collect()
    assert [r.type for r in t[:6]] == ["functional", "performance", "usability", "safety", "interface", "interface"]
    assert [r.ears_pattern for r in t[:6]] == ["ubiquitous", "event-driven (WHEN)", "state-driven (WHILE)", "event-driven (WHEN)", "state-driven (WHILE)", "ubiquitous"]
    assert t[0].weak_words == "optimal"
    s = _tiled(spark, ["The system shall not transmit."]).select(quality.smells(F.col("text"))["compound_requirement"]).first()[0]
    assert s is False


def test_composition(spark):
    cols = {"CONDITION": F.lit("When idle"), "SUBJECT": F.lit("the pump"), "MODALITY": F.lit("shall"), "PROCESS": F.lit("stop")}
    assert spark.range(1).select(split.compose(cols)).first()[0] == "When idle, the pump shall stop."
