import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import cases, graphs
from marlstone.sources import readers


@pytest.fixture
def graph(spark, tmp_path):
    tree = {"Suspected Hypertension": {"Hypertension": {"Stage 1": [], "Stage 2": []}}}
    knowledge = {"Hypertension": {"Symptoms": "headache; etc", "Risk Factors": "smoking"}, "Stage 2": "Repeated blood pressure >= 140/90 mmHg. Without organ damage"}
    (tmp_path / "Hypertension.json").write_text(json.dumps({"diagnostic": tree, "knowledge": knowledge}))
    return readers.json_trees(spark, str(tmp_path)), readers.premises(spark, str(tmp_path))


def test_corpus_and_evidence_graph(spark, graph):
    paths, premises = graph
    rows = cases.corpus(premises, paths).collect()
    assert {r["text"] for r in rows} == {"headache", "smoking", "Repeated blood pressure >= 140/90 mmHg. Without organ damage"}
    got = {r["claim"]: r for r in cases.evidence_graph(cases.corpus(premises, paths)).collect()}
    assert got["smoking"]["relation"] == "weak_support" and got["headache"]["kind"] == "clinical_finding"
    pressure = got["Repeated blood pressure >= 140/90 mmHg."]
    assert pressure["kind"] == "measurement" and pressure["anchor"] and pressure["scope"] == "child"
    assert got["Without organ damage"]["relation"] == "contradiction_or_exclusion"
    lost = premises.limit(1).withColumn("diagnosis", F.lit("Unknown"))
    with pytest.raises(Exception, match="no diagnostic path"):
        cases.corpus(lost, paths).collect()


def test_patient_queries(spark):
    rows = [("c", "Physical exam", "BP  150/95"), ("c", "chief_complaint", "headache"), ("c", "notes", "x"), ("c", "tests", " ")]
    ev = cases.patient_evidence(spark.createDataFrame(rows, "case_id string, section string, text string"))
    assert [r["evidence_id"] for r in ev.orderBy("position").collect()] == ["S-CC", "S-PE"]
    assert cases.retrieval_queries(ev).first()["query"].endswith("chief_complaint: headache\nphysical_exam: BP 150/95")
    assert {r["query"] for r in cases.finding_queries(ev).collect()} == {"chief complaint: headache", "physical exam: BP 150/95"}
    payload = spark.createDataFrame([('{"a": {"gold_label": 1}}',)], "p string")
    with pytest.raises(Exception, match="evaluation-only"):
        payload.select(cases.refuse_forbidden(F.col("p"))).collect()


def test_candidate_ranking(spark):
    choices = spark.createDataFrame([("c", "a", "Migraine", 1, "p1"), ("c", "b", "Hypertension", 2, "p2"), ("c", "s", "Suspected gout", 3, "p2")], "case_id string, candidate_id string, label string, position int, premise_id string")
    premises = spark.createDataFrame([("p1", "Symptoms", "aura nausea"), ("p2", "Diagnostic Criteria", "raised blood pressure")], "premise_id string, premise_type string, text string")
    queries = spark.createDataFrame([("c", "blood pressure raised, hypertension known")], "case_id string, query string")
    got = cases.rank_candidates(choices, premises, queries).orderBy("rank").collect()
    assert [r["candidate_id"] for r in got] == ["b", "a"] and got[1]["score"] == round(0.35 / 6 + 0.015, 6)


def test_metrics_and_judging(spark, graph):
    paths, _ = graph
    keyed = paths.filter("size(path) = 3").select(F.monotonically_increasing_id().alias("path_id"), F.transform("path", lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")).alias("path"))
    distances = graphs.path_distances(keyed, "path")
    preds = [("1", "m", "Stage 2", "Stage 2", ["k1", "X"], False), ("2", "m", "Hypertension", "Stage 1", ["K1"], False), ("3", "m", "Stage 1", "Stage 2", [], False), ("4", "m", "", "Stage 2", [], True), ("9", "m", "Gout", None, [], False), ("5", "m", "Suspected Hypertension", "Stage 1", [], False)]
    df = spark.createDataFrame([(c, m, p, ci, ["K1"], ab) for c, m, p, _, ci, ab in preds], "case_id string, mode string, predicted_label string, citations array<string>, valid_evidence_ids array<string>, abstained boolean")
    known = spark.createDataFrame([(c, g) for c, _, _, g, _, _ in preds if g], "case_id string, gold_label string")
    got = {r["case_id"]: r for r in cases.case_metrics(df, known, distances).collect()}
    assert [got[c]["hierarchy"] for c in "12345"] == [1.0, 0.75, 0.0, 0.0, 0.5] and got["9"]["hierarchy"] is None
    assert got["1"]["citations_valid"] == 0.5 and got["3"]["citations_valid"] == 0.0
    judged = cases.judge(df.join(known, "case_id"), spark.createDataFrame([("hypertension", "stage1")], "a string, b string"))
    assert {r["case_id"]: (r["decision"], r["passed"]) for r in judged.collect()} == {"1": ("identity", True), "2": ("controlled_family", True), "3": ("open", None), "4": ("abstained", False), "5": ("open", None)}


def test_observation_conventions(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 2), (0, 3, 0), (1, 2, 4)], "m int, p int, g int")
    p, r, f = cases.observation_scores(F.col("m"), F.col("p"), F.col("g"))
    assert [tuple(x) for x in rows.select(p, r, f).collect()] == [(1, 1, 1), (0, 0, 0), (0, 1, 0), (0.5, 0.25, pytest.approx(1 / 3))]


def test_incumbents_costs_gates(spark):
    pairs = spark.createDataFrame([("c", "a", 3.0, True), ("c", "b", 2.0, True), ("d", "a", 1.0, True), ("d", "b", 1.0, True), ("e", "a", 1.0, False)], "case_id string, candidate_id string, score double, cited boolean")
    assert [tuple(r) for r in cases.incumbents(pairs).collect()] == [("c", "a")]
    costs = {r["case_id"]: r["cost"] for r in cases.cost_shares(pairs, ["case_id"], "score", 8.0).collect()}
    assert costs == {"c": 5.0, "d": 2.0, "e": 1.0}
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(None).cast("int")).alias("x"))
    assert {tuple(r) for r in cases.gates(row, {"five": F.col("n") == 5, "null": F.col("x") > 1}).collect()} == {("five", True), ("null", False)}
