"""Reports on cases with nulls and empty groups, families of syndromes, presentation without ids, argument graphs by hand."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import argument_graph as G
from marlstone.operators import evaluation, retrieval, select


def test_modes_with_nulls_and_one_case(spark):
    rows = spark.createDataFrame([("d", "m", 1, None, False, True, 0.5, 1.0), ("d", "m", 0, 4.0, True, None, None, 0.0), ("d", "n", 1, None, True, False, None, 1.0)], "dataset string, mode string, exact_match int, latency_seconds double, cache_hit boolean, graph_consistent boolean, hierarchy_score double, coverage double")
    for c in evaluation.PLAIN:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    got = {(r["subset"], r["mode"]): r for r in evaluation.mode_summary(rows).collect()}
    assert set(got) == {("all", "m"), ("all", "n"), ("graph_consistent", "m")}
    m = got["all", "m"]
    assert (m["n"], m["accuracy"], m["accuracy_sd"], m["hierarchy_score"], m["selective_accuracy"], m["mean_latency_seconds"], m["citation_validity"]) == (2, 0.5, 0.5, 0.5, 1.0, None, None)
    assert got["all", "n"]["accuracy_sd"] == 0.0 and len(m) == 3 + 1 + 23


def test_judgments_all_excluded(spark):
    rows = spark.createDataFrame([("m", False, True, None, "evaluation_failure", False, " ", None)], "mode string, included boolean, passed boolean, primary_passed boolean, exclusion_reason string, abstained boolean, predicted_label string, possible array<string>")
    r = evaluation.judgment_summary(rows).first()
    assert r["family_accuracy"] is None and r["decision_counts"] == {"excluded": 1} and r["diagnostic_answer_count"] == 0 and r["single_answer_count"] == 1


def test_families(spark):
    paths = spark.createDataFrame([("Heart", ["Failure", "Suspected X", "Left"]), ("Heart", ["Failure", "Right"]), ("Heart", ["Rhythm", "Flutter"]), ("Odd Syndrome", ["A"]), ("Odd Syndrome", ["B"])], "category string, path array<string>")
    cases = [("Left", "right", True), ("Left", "Flutter", False), ("heart", "Flutter", True), ("A", "B", True), ("Left", "B", False), ("Suspected X", "Right", True), ("", "Left", False), (None, "Left", False), ("Left", "Left", True), ("nowhere", "nowhere", False)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, reference string, evaluated string")
    got = {r["i"]: r["same_family"] for r in evaluation.same_family(pairs, paths, ["i"]).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_trace_is_presented_without_ids(spark):
    schema = (
        "case_number int, candidates array<struct<diagnosis:string,arguments:array<struct<argument_id:string,patient_finding:string,application:string,rationale:string,evidence_ids:array<string>>>>>,"
        "reviews array<struct<argument_id:string,verdict:string,explanation:string,failed:array<string>,evidence_ids:array<string>>>, counterarguments array<struct<target_id:string,premise:string,conclusion:string,relation:string,evidence_ids:array<string>>>,"
        "nodes array<struct<argument_id:string,conclusion:string,premise:string>>, decision struct<selected:string,abstained:boolean,supporting:array<string>,evidence_ids:array<string>,error:string>"
    )
    row = (1, [(" Heart\n failure ", [("A1", "low  EF", "satisfies", None, ["S-1", "K1"])])], [("A1", "supported", "fits", ["x  y"], ["K1"]), ("A9", "none", None, [], [])], [("A1", "p", "c", "rebuts", [])], [("A1", "", "EF is low"), ("A2", "other", "q")], ("Heart failure", False, ["A1"], ["S-1"], None))
    got = evaluation.presented_trace(spark.createDataFrame([row, (2, [], [], [], [], None)], schema)).orderBy("case_number").collect()
    one = got[0].asDict(recursive=True)
    assert one["candidates"] == [{"diagnosis": "Heart failure", "arguments": [{"patient_finding": "low EF", "application": "satisfies", "rationale": "", "evidence_basis": ["patient evidence", "controlled-corpus evidence"]}]}]
    assert [r["diagnosis"] for r in one["reviews"]] == ["Heart failure", ""] and one["reviews"][0]["failed_critical_questions"] == ["x y"]
    assert one["counterarguments"][0]["target_diagnosis"] == "Heart failure"
    assert (one["diagnosis"], one["abstained"], one["explanation"], one["evidence_basis"], one["error_category"]) == ("Heart failure", False, "EF is low", ["patient evidence"], "")
    assert (got[1]["diagnosis"], got[1]["abstained"], got[1]["explanation"], got[1]["candidates"]) == ("", True, "", [])
    assert "A1" not in str(one) and "K1" not in str(one)


def test_argument_graph_by_hand(spark):
    cands = spark.createDataFrame([("c", "D1", "Asthma"), ("c", "D2", "Croup"), ("c", "D3", "Cold")], "case_id string, candidate_id string, diagnosis string")
    args = spark.createDataFrame([("c", "A1", "D1", ["S-1", "K1"], 1.0, True), ("c", "A2", "D1", ["S-1", "K2"], 0.0, True), ("c", "A3", "D2", ["S-1", "K1"], 0.5, True), ("c", "A4", "D2", ["S-1", "K1"], 0.5, False)], "case_id string, argument_id string, candidate_id string, evidence_ids array<string>, compatibility double, typed_valid boolean")
    revs = spark.createDataFrame([("c", "A1", "contradicted", [], [], 1), ("c", "A1", "supported", ["K1", "S-1"], [], 2), ("c", "A2", "supported", ["S-1", "K2"], [], 1), ("c", "A4", "supported", ["S-1", "K1"], ["q1", "q2"], 1)], "case_id string, argument_id string, verdict string, evidence_ids array<string>, failed array<string>, place int")
    judged = G.reviewed(args, revs, "case_id")
    why = {r["argument_id"]: r["reasons"] for r in judged.collect()}
    assert why["A1"] == [] and why["A2"] == [G.UNBOUND] and why["A3"] == [G.UNREVIEWED]
    assert why["A4"] == [G.UNGROUNDED, "Failed critical questions: q1, q2."]
    counters = spark.createDataFrame([("c", "X1", "D1", "negative_evidence", "rebuts", "shows no wheeze", "not it", ["S-1", "K1"]), ("c", "X2", "A1", "alternative_explanation", "rebuts", "p", "Croup", ["S-1", "K3"]), ("c", "X3", "D1", "exception", "undercuts", "p", "c", ["K1"]), ("c", "X4", "nobody", "exception", "undercuts", "p", "c", [])], "case_id string, counter_id string, target_id string, scheme string, relation string, premise string, conclusion string, evidence_ids array<string>")
    targets = cands.withColumn("target_id", F.col("candidate_id")).union(cands.filter("candidate_id = 'D1'").withColumn("target_id", F.lit("A1"))).select("case_id", "target_id", "candidate_id", "diagnosis")
    evidence = spark.createDataFrame([("c", "S-1", None, None, "quiet chest"), ("c", "K1", "clinical_feature", ["Lung", "Asthma"], "t"), ("c", "K3", "guideline", ["Throat", "Croup"], "t")], "case_id string, evidence_id string, role string, path array<string>, text string")
    found = G.founded(counters, targets, evidence, "case_id")
    assert {r["counter_id"]: r["compatibility"] for r in found.collect()} == {"X1": 1.0, "X2": 1.0, "X3": 0.0, "X4": 0.0}
    nodes, edges = G.build(cands, judged, found, spark.createDataFrame([("c",), ("c",)], "case_id string"), "case_id")
    kinds = {}
    for r in nodes.collect():
        kinds[r["node_type"]] = kinds.get(r["node_type"], 0) + 1
    assert kinds == {"support": 4, "diagnosis": 3, "counterargument": 4, "challenge": 3 + 2 + 1 + 3}
    rel = {}
    for r in edges.collect():
        rel.setdefault(r["relation"], set()).add((r["source"], r["target"]))
    assert rel["supports"] == {("A1", "D1"), ("A2", "D1"), ("A3", "D2"), ("A4", "D2")} and len(rel["rebuts"]) == 6 + 2
    assert {("Q-A2", "A2"), ("Q-D3", "D3"), ("Q-ABSTAIN-D1", "D1"), ("Q-X3", "X3"), ("X3", "D1")} <= rel["undercuts"]
    stand = {r["candidate_id"]: (r["supports"], r["standing"], r["undercut"]) for r in G.standing(edges, "case_id").collect()}
    assert stand == {"D1": (2, 1, True), "D2": (2, 0, True)}


def plain_allocation(routes, budget):
    """The greedy loop, one route at a time."""
    used, taken, picked = set(), [0] * len(routes), []

    def take(i):
        for k, s in enumerate(routes[i][2]):
            if s not in used:
                used.add(s)
                taken[i] += 1
                picked.append((i, k))
                return True
        return False

    for i in range(len(routes)):
        if len(picked) < budget:
            take(i)
    while len(picked) < budget:
        if not any(take(i) for i in sorted(range(len(routes)), key=lambda i: (taken[i], -routes[i][0], routes[i][1]))):
            break
    return picked


def test_budget_fold_is_the_greedy_loop(spark):
    import random

    rng, rows, want = random.Random(8), [], {}
    for q in range(60):
        routes = [(rng.randrange(1, 4), rng.randrange(20), rng.sample(range(12), rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))]
        routes = [(s, t * 100 + i, o) for i, (s, t, o) in enumerate(routes)]
        want[q] = plain_allocation(routes, 1 + q % 13)
        rows += [(q, i, k, s, few, tie, 1 + q % 13) for i, (few, tie, o) in enumerate(routes) for k, s in enumerate(o)]
    df = spark.createDataFrame(rows, "q int, route_position int, fact_position int, source_id int, siblings int, tie int, budget int")
    for budget in range(1, 14):
        got = select.allocate_facts(df.filter(F.col("budget") == budget), "q", budget).collect()
        for q in {r["q"] for r in got}:
            assert [(r["route_position"], r["fact_position"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["allocated"])] == want[q]


def test_executed_evidence_meets_on_names_and_concepts(spark):
    queries = spark.createDataFrame([(1, "LVEF is 35. BP: 150/80"), (2, "history of lvef is 30"), (3, "CT scan shows embolism today."), (4, "CT scan shows no evidence of embolism")], "query int, text string")
    premises = spark.createDataFrame([("a", "reduced LVEF <= 40"), ("b", "SBP >= 160"), ("c", "CT confirmed pulmonary embolism"), ("d", "MRI confirmed pulmonary embolism")], "premise string, text string")
    terms = spark.createDataFrame([("embolism", "C1"), ("pulmonary embolism", "C1")], "key string, concept string")
    got = {(r["query"], r["premise"]): (r["threshold_met"], r["strength"]) for r in retrieval.structured(queries, premises, terms).collect()}
    assert got == {(1, "a"): (True, 1.0), (2, "a"): (True, 0.0), (3, "c"): (False, 0.8)}


def test_routes_prefer_specific_labels_and_new_graphs(spark):
    rows = [(1, 1, "i1", "Suspected A", "g1", 9.0, ["p1"]), (1, 2, "i2", "A one", "g1", 8.0, ["p1", "p2"]), (1, 3, "i3", "A two", "g1", 7.0, ["p1"]), (1, 4, "i4", "B", "g2", 6.0, ["p3"]), (1, 5, "i5", "Suspected C", "g3", 5.0, ["p4"])]
    choices = spark.createDataFrame(rows, "query int, place int, candidate_id string, label string, graph string, route double, sources array<string>")
    strong = spark.createDataFrame([(1, "p3", True, 1.0)], "query int, premise string, threshold_met boolean, strength double")
    got = [(r["label"], r["sources"]) for r in retrieval.diverse_routes(choices, strong).orderBy("rank").collect()]
    assert got == [("B", ["p3"]), ("A one", ["p1", "p2"]), ("Suspected C", ["p4"])]


@pytest.mark.parametrize("most", [2, 3, 12])
def test_chunks_join_to_the_text(spark, most):
    from marlstone.operators import lexical

    texts = ["", "   ", "one", "  one two\n three  four five \t", "日本 語 " * 9, None]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    if most == 2:
        with pytest.raises(ValueError):
            lexical.chunk_plan(df, "d", "t", most)
        return
    rows = lexical.chunk_plan(df, "d", "t", most).orderBy("d", "chunk").collect()
    for d, t in enumerate(texts):
        own = [r for r in rows if r["d"] == d]
        assert "".join(r["body"] for r in own) == (t or "") and [r["chunk"] for r in own] == list(range(len(own)))
        assert sum(r["n_tokens"] for r in own) == len((t or "").split()) and all(r["n_tokens"] <= most - 2 for r in own)
        assert not own or sum(r["weight"] for r in own) == pytest.approx(1.0 if (t or "").strip() else 0.0)
    assert not [r for r in rows if r["d"] == 5]
