"""Typed binding: best clauses, critical questions, concepts, candidates against all pairs, ranked options, tiers."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import atoms as A
from marlstone.functions import typed
from marlstone.operators import binding

ACUTE, RISK, LEADING = "diagnostic_criterion", "risk_factor", "clinical_feature"
EJECTION = "Chamber sizes are within limits (LVEF >55%)."

#: finding, criterion, role, admissible, score, first question that fails
CASES = [
    ("fever, cough and rales", "Productive sputum is common. Fever, cough and rales; Hypoxia in one of three cases.", ACUTE, True, 1.0, None),
    ("fever, cough and rales", "Productive sputum is common; hypoxia in one of three cases.", ACUTE, False, 0.0, "concept_compatible"),
    (EJECTION, "LVEF >=50%", ACUTE, True, 1.0, None),
    ("LVEF = 41%", "LVEF≥50%", ACUTE, False, 1.0, "quantity_compatible"),
    ("Ventriculogram LVEF = 45%", "LVEF 41–49%", ACUTE, True, 1.0, None),
    ("Ventriculogram LVEF = 25%", "LVEF 41–49%", ACUTE, False, 1.0, "quantity_compatible"),
    ("Systolic pressure is 170 mmHg", "Repeated systolic pressure above 140 mmHg", ACUTE, True, 0.5, None),
    ("Systolic pressure is 120 mmHg", "Repeated systolic pressure above 140 mmHg", ACUTE, False, 0.5, "quantity_compatible"),
    ("Peak troponin more than 9 on arrival", "The peak cTnT exceeded the 99th percentile of a healthy control value", ACUTE, True, None, None),
    ("Peak troponin 0.02, as expected", "The peak troponin is above 50 ng/mL", ACUTE, False, None, "quantity_compatible"),
    ("cTropnT-0.02* CK-MB-50* cTropnT-0.35* cTropnT-0.80*", "Elevated cardiac markers, mainly troponin", ACUTE, True, None, None),
    ("cTropnT-0.02*", "Elevated cardiac markers, mainly troponin", ACUTE, False, None, "criterion_satisfied"),
    ("cTropnT-0.80* cTropnT-0.02*", "Elevated cardiac markers, mainly troponin", ACUTE, False, None, "criterion_satisfied"),
    ("cTropnT-0.02* cTropnT-0.80*", "Stable blood pressure with right ventricular enlargement on imaging and septal deviation, and elevated blood markers like troponin", ACUTE, False, None, "criterion_satisfied"),
    ("ST segment depression in V2 since the prior tracing", "ECG non-ST-elevation", ACUTE, True, 1.0, None),
    ("New concordant STD in V1.", "ECG non ST elevation", ACUTE, True, 1.0, None),
    ("Troponin negative x2", "No troponin elevation", ACUTE, True, 0.5, None),
    ("Without any murmur", "No friction rub", ACUTE, False, 0.0, "concept_compatible"),
    ("Root dimensions are normal", "Lactate is normal", ACUTE, False, 0.5, "concept_compatible"),
    ("No embolism on scan", "Embolism on scan", ACUTE, False, 1.0, "observation_present"),
    ("History of embolism", "Embolism", ACUTE, False, 1.0, "temporality_compatible"),
    ("History of embolism", "Embolism", RISK, True, 1.0, None),
    ("Heavy smoking for years", "Smoking, inherited clotting disorders", RISK, False, 0.25, "concept_compatible"),
    ("Inherited clotting", "Smoking, inherited clotting disorders", RISK, True, 0.5, None),
    ("Inherited clotting", "Smoking, inherited clotting disorders", LEADING, False, 0.5, "criterion_satisfied"),
    ("Smoking and clotting", "Smoking, inherited clotting disorders", RISK, False, 0.5, "concept_compatible"),
    ("EGD showed several erosions in the antrum.", "Endoscopy finds erosions of the gastric antrum", ACUTE, True, None, None),
    ("EGD was ordered to evaluate possible erosions in the antrum.", "Endoscopy finds erosions of the gastric antrum", ACUTE, False, None, "concept_compatible"),
    ("Bleeding", "Bleeding", "counterevidence", False, 1.0, "scheme_role_compatible"),
    ("", "Bleeding", ACUTE, False, 0.0, "concept_compatible"),
    (None, "Bleeding", ACUTE, False, 0.0, "concept_compatible"),
    ("Bleeding", None, ACUTE, False, 0.0, "concept_compatible"),
    ("Bleeding", "Bleeding", None, False, 1.0, "scheme_role_compatible"),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, finding string, criterion string, role string")
    return {r["i"]: r["a"] for r in rows.select("i", typed.assess(F.col("finding"), F.col("criterion"), F.col("role")).alias("a")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(told, i):
    *_, admissible, score, failed = CASES[i]
    failing = [q["question"] for q in told[i]["questions"] if not q["passed"]]
    assert told[i]["admissible"] is admissible
    assert bool(failing) is not admissible
    if score is not None:
        assert told[i]["score"] == pytest.approx(score)
    if failed:
        assert failed in failing


def test_questions_are_in_order_and_the_first_of_equal_clauses_wins(spark):
    got = spark.range(1).select(typed.assess(F.lit("left arm pain"), F.lit("right arm pain; pain in arm left. arm pain left"), F.lit(LEADING)).alias("a")).first()["a"]
    assert [q["question"] for q in got["questions"]] == list(A.QUESTIONS)
    assert (got["clause"], got["matched_clause"]) == (1, "pain in arm left.")


def test_comparison_with_a_prior_study_is_current(spark):
    texts = ["Since the prior tracing, worse", "compared to previous exam", "prior tracing", "History of it, now worse", "stable"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(A.temporality(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["current", "current", "historical", "current", "unspecified"]


def test_rising_names(spark):
    texts = ["cTnT-0.1* cTnT-0.2* CK-5* CK: 4*", "ALT=40* ast-30* AST-31*", "cTnT-0.1*", "K-4.1 K-5.2", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(A.atom(F.col("t"))["rising"].alias("v")).collect()
    assert [r["v"] for r in rows] == [["troponin"], ["ast"], [], [], []]


TERMS = [("pe", "c1"), ("pulmonary embolism", "c1"), ("cad", "c2"), ("coronary artery disease", "c2"), ("nste acs", "c3"), ("non st elevation", "c3")]


def test_concepts_close_synonyms_but_not_long_rules(spark):
    terms = spark.createDataFrame(TERMS, "key string, concept string")
    f = binding.findings(spark.createDataFrame([(1, "Current PE seen"), (2, "CAD today"), (3, "PE was ruled out by no means")], "f int, t string"), ["f"], "t", terms)
    rules = [(1, "Pulmonary embolism", ACUTE), (2, "Pulmonary embolism that occludes both main branches and dilates right ventricle", ACUTE), (3, "coronary artery disease", RISK)]
    c = binding.criteria(spark.createDataFrame(rules, "c int, t string, role string"), ["c"], "t", "role", terms)
    got = {(r["f"], r["c"]): r for r in binding.bind(f, c, "f", "c").collect()}
    assert {k for k, r in got.items() if r["admissible"]} == {(1, 1), (2, 3)}
    assert got[1, 2]["score"] < 0.6 and not got[1, 2]["admissible"]
    assert (2, 1) not in got


def test_candidates_lose_no_admissible_pair(spark):
    found = [(i, c[0]) for i, c in enumerate(CASES)]
    wanted = [(i, c[1], role) for i, c in enumerate(CASES) for role in [c[2]]]
    f = binding.findings(spark.createDataFrame(found, "f int, t string"), ["f"], "t")
    c = binding.criteria(spark.createDataFrame(wanted, "c int, t string, role string"), ["c"], "t", "role")
    every = spark.createDataFrame([(a, b) for a, _ in found for b, *_ in wanted], "f int, c int")
    told = {(r["f"], r["c"]): (r["admissible"], r["score"]) for r in binding.bind(f, c, "f", "c", pairs=every).collect()}
    near = {(r["f"], r["c"]): (r["admissible"], r["score"]) for r in binding.bind(f, c, "f", "c").collect()}
    assert {k for k, v in told.items() if v[0]} and all(told[k] == v for k, v in near.items())
    assert {k for k, v in told.items() if v[0] or v[1] >= 0.4} <= set(near) != set(told)


def test_a_frequent_token_alone_makes_no_pair(spark):
    """Of five tokens two must be shared, so the most frequent one is never asked for."""
    rows = [(k, f"pain unit{k} side{k}") for k in range(200)]
    f = binding.findings(spark.createDataFrame(rows, "f int, t string"), ["f"], "t")
    c = binding.criteria(spark.createDataFrame([(1, "pain unit7 side7 ward bed", ACUTE)], "c int, t string, role string"), ["c"], "t", "role")
    assert [r["f"] for r in binding.candidate_pairs(f, c, "f", "c").collect()] == [7]


def test_groups_meet_only_within(spark):
    f = binding.findings(spark.createDataFrame([("a", 1, "rash"), ("b", 2, "rash")], "g string, f int, t string"), ["g", "f"], "t")
    c = binding.criteria(spark.createDataFrame([("a", 9, "rash", ACUTE)], "g string, c int, t string, role string"), ["g", "c"], "t", "role")
    assert [(r["g"], r["f"], r["c"]) for r in binding.bind(f, c, "f", "c", within=["g"]).collect()] == [("a", 1, 9)]


def test_options_take_one_pair_a_node_first(spark):
    f = binding.findings(spark.createDataFrame([("S1", "rash on arm"), ("S2", "rash")], "f string, t string"), ["f"], "t")
    rules = [("K1", "rash on arm", LEADING, "n1"), ("K2", "rash", ACUTE, "n1"), ("K3", "rash", LEADING, "n2"), ("K4", "rash arm leg", RISK, None)]
    kept = spark.createDataFrame(rules, "c string, t string, role string, node string")
    bound = binding.bind(f, binding.criteria(kept, ["c"], "t", "role"), "f", "c").join(kept.select("c", "node"), "c")
    got = [(r["f"], r["c"]) for r in binding.ranked_options(bound, [], "f", "c", "node", 4).orderBy("place").collect()]
    assert got == [("S1", "K2"), ("S1", "K3"), ("S1", "K4"), ("S2", "K2")]


def test_second_tier_only_without_a_first(spark):
    pairs = spark.createDataFrame([(1, "S-1", "K1"), (1, "S-2", "K1"), (1, "S-2", "K2")], "case_id int, f string, c string")
    cited = spark.createDataFrame([(1, "x", "K1"), (1, "x", "S-2"), (1, "y", "K1"), (1, "y", "S-9"), (1, "z", "S-1"), (2, "x", "K1")], "case_id int, claim string, evidence_id string")
    got = sorted(tuple(r) for r in binding.cited_pairs(pairs, cited, ["case_id"], "claim", "f", "c").select("claim", "f", "c", "tier").collect())
    assert got == [("x", "S-2", "K1", 1), ("y", "S-1", "K1", 2), ("y", "S-2", "K1", 2)]


@pytest.mark.parametrize(("finding", "criterion", "candidate", "want"), [
    ("Peak troponin more than 9 on arrival", "Rest pain. The peak cTnT exceeded the 99th percentile of a healthy control value", "infarction", "exact_measurement"),
    ("Current LVEF = 35%.", "LVEF <=40%.", "failure", "exact_measurement"),
    ("Coronary angiography showed 90% stenosis.", "Endoscopy shows erosive changes.", "reflux", "semantic_review"),
    ("CT showed embolism", "Shock; CT embolism", "embolism", "exact_positive_test"),
    ("Troponin negative x2", "No troponin elevation", "infarction", "explicit_negation"),
])
def test_authority_is_read_from_the_best_clause(spark, finding, criterion, candidate, want):
    got = spark.range(1).select(typed.authority(*map(F.lit, (finding, criterion, candidate, ACUTE))).alias("v")).first()["v"]
    assert got == want
