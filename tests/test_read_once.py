"""Plans that read a text, or assess a pair, once."""

import re

from pyspark.sql import functions as F

from marlstone.functions import clinical
from marlstone.operators import argument_graph, binding, evaluation, lexical, retrieval, vectors
from marlstone.plans import binding as plans
from marlstone.plans import joins
from marlstone.sources.scratch import written
from oracle import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_token_is_cut_by_one_expression(spark):
    df = spark.createDataFrame([("Troponins hs-cTnT-14, beta-blockers/-, 120/80, biopsies, mass--",)], "t string").select(clinical.binding_tokens(F.col("t")).alias("w"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    assert df.first()["w"] == ["troponin", "troponin", "beta-blocker", "120", "biopsy", "mass"]


def test_a_filter_on_the_verdict_does_not_assess_again(spark):
    found = binding.findings(spark.createDataFrame([(1, "acute chest pain today")], "f int, t string"), ["f"], "t")
    wanted = binding.criteria(spark.createDataFrame([(7, "acute chest pain", "guideline")], "c int, t string, role string"), ["c"], "t", "role")
    bound = binding.bind(found, wanted, "f", "c").filter((F.col("score") >= 0.4) | F.col("admissible"))
    assert _plan(bound).count("coverage of the clause") == 1
    assert [(r["f"], r["c"], r["admissible"]) for r in bound.collect()] == [(1, 7, True)]


def test_bound_queries_read_written_atoms(spark):
    for df in plans._bound(spark, SMALL):
        assert "regexp" not in _plan(df)


def test_thresholds_read_only_what_stands_near_a_sign(spark):
    far = "word " * 4000
    text = f"{far}EF of{' ' * 60}x rate >= 50.5{far}of{' ' * 200}LVEF ≤\n40 b > 3c < 2 {far}5 > 6"
    row = spark.createDataFrame([(text,)], "t string").select(clinical._near_signs(F.col("t")).alias("n"), clinical.thresholds(F.col("t")).alias("x")).first()
    assert len(row["n"]) < 700
    assert [tuple(x) for x in row["x"]] == [("rate", ">=", 50.5), ("lvef", "≤", 40.0), ("word", ">", 6.0)]


def test_scores_are_dealt_to_tasks_of_bounded_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(60)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, "beta w7")], "item_id int, text string")
    want = sorted(map(tuple, lexical.bm25_scores(docs, items).collect()))
    monkeypatch.setattr(lexical, "TASK_PAIRS", 10)
    assert lexical._matched(docs, items, "doc_id", "item_id")[0].rdd.getNumPartitions() >= 12
    assert sorted(map(tuple, lexical.bm25_scores(docs, items).collect())) == want


def test_a_family_of_many_paths_is_rows_and_no_array(spark):
    paths = spark.createDataFrame([("heart", ["acs", f"leaf {i}"]) for i in range(9)] + [("lung", ["pe", "big pe"])], "category string, path array<string>")
    pairs = spark.createDataFrame([(1, "leaf 1", "acs"), (2, "leaf 1", "pe"), (3, "heart", "leaf 2"), (4, "acs", "acs"), (5, None, "acs"), (6, "leaf 1", "leaf 2")], "k int, reference string, evaluated string")
    df = evaluation.same_family(pairs, paths, ["k"])
    assert "collect_list" not in _plan(df)
    assert {r["k"]: r["same_family"] for r in df.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_standing_reads_the_edges_once(spark):
    rows = [(1, "a", "C1", "supports"), (1, "b", "C1", "supports"), (1, "Q-a", "a", "undercuts"), (1, "R-a", "a", "undercuts"), (1, "Q-C2", "C2", "undercuts"), (1, "c", "C2", "supports"), (1, "C1", "C2", "rebuts")]
    df = argument_graph.standing(spark.createDataFrame(rows, "case int, source string, target string, relation string"), "case")
    assert _plan(df).count("LogicalRDD") == 1
    assert sorted(map(tuple, df.collect())) == [(1, "C1", 2, 1, False), (1, "C2", 1, 1, True)]


def test_cited_pairs_are_joined_once(spark):
    pairs = spark.createDataFrame([(1, "S-1", "K1"), (1, "S-2", "K1"), (1, "S-3", "K2")], "case int, f string, k string")
    cited = spark.createDataFrame([(1, 0, "K1"), (1, 0, "S-1"), (1, 1, "K2"), (1, 2, "S-1")], "case int, claim int, evidence_id string")
    df = binding.cited_pairs(pairs, cited, ["case"], "claim", "f", "k")
    assert _plan(df).count("LogicalRDD") == 3
    assert sorted((r["claim"], r["f"], r["k"], r["tier"]) for r in df.collect()) == [(0, "S-1", "K1", 1), (1, "S-3", "K2", 2)]


def test_no_grouping_holds_pairs_of_users(spark):
    assert "Aggregate [a#" not in _plan(joins.shared_modality_join(spark, SMALL))


def test_nearest_keeps_few_scores_at_once(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, vectors.nearest(vecs, vecs, 4).collect()))
    monkeypatch.setattr(vectors, "CELLS", 1)
    assert sorted(map(tuple, vectors.nearest(vecs, vecs, 4).collect())) == want


def test_scored_premises_beyond_the_sources_do_not_hide_those_without(spark):
    words = ["fever cough", "nothing", "fever", "etc", "plain", "void", "bare"]
    premises = spark.createDataFrame([(i, "g", "flu", w) for i, w in enumerate(words)], "premise long, graph string, label string, text string").withColumn("weight", F.lit(1.0))
    queries = spark.createDataFrame([(1, "fever and cough")], "query long, text string")
    dense = spark.createDataFrame([], "query long, premise long, rank int")
    got = retrieval.candidate_choices(queries, premises, dense, retrieval.structured(queries, premises)).collect()
    assert [(r["place"], r["label"], r["sources"]) for r in got] == [(1, "flu", [0, 2, 1, 4])]


def _sides(spark):
    texts = ["acute chest pain today", "no fever, no cough", "History of embolism", "pain, fever 38.5 %", "CT scan showed chest embolism", "cTnT-0.1* cTnT-0.2*", "st depression in V2", "LVEF = 45 %"]
    rules = [("acute chest pain; chest pain today", "guideline"), ("no cough", "clinical_feature"), ("embolism", "risk_factor"), ("CT of the chest finds embolism", "diagnostic_criterion"), ("elevated troponin", "clinical_feature"), ("non-ST-elevation", "guideline"), ("LVEF 41-49 %; fever above 38 % with pain in both arms", "diagnostic_criterion")]
    found = binding.findings(spark.createDataFrame(list(enumerate(texts)), "f int, t string"), ["f"], "t")
    wanted = binding.criteria(spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "c int, t string, role string"), ["c"], "t", "role")
    return written(found), written(wanted)


def test_findings_stay_where_they_lie_if_criteria_are_few(spark, monkeypatch):
    found, wanted = _sides(spark)
    every = found.select("f").crossJoin(wanted.select("c"))
    kept = lambda df: sorted((r["f"], r["c"], r["admissible"], r["score"], r["clause"]) for r in df.filter("score >= 0.4 or admissible").collect())
    want = kept(binding.bind(found, wanted, "f", "c", pairs=every))
    df = binding.bind(found, wanted, "f", "c", least=0.4)
    assert "hashpartitioning(f#" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(want) >= 8 and kept(df) == want == sorted((r["f"], r["c"], r["admissible"], r["score"], r["clause"]) for r in df.collect())
    monkeypatch.setattr(binding, "KEYS_SENT", 0)
    many = binding.bind(found, wanted, "f", "c", least=0.4)
    assert "hashpartitioning(f#" in many._jdf.queryExecution().executedPlan().toString()
    assert kept(many) == want


def test_a_phrase_alone_makes_no_pair_where_it_cannot_decide(spark):
    found = binding.findings(spark.createDataFrame([(1, "chest pain")], "f int, t string"), ["f"], "t")
    rules = [(1, "chest pain with nausea, sweating, collapse and weakness", "guideline"), (2, "chest pain above 50 % with nausea, sweating, collapse and weakness", "guideline")]
    wanted = binding.criteria(spark.createDataFrame(rules, "c int, t string, role string"), ["c"], "t", "role")
    phrase = spark.range(1).select(F.explode(binding._kind("p", F.array(F.lit("chest pain")))).alias("key"))
    asked = {r["c"] for r in binding.clause_keys(found, wanted, "c").join(phrase, "key").collect()}
    assert asked == {2}


def test_options_beyond_the_places_of_a_node_are_not_shuffled(spark):
    found, wanted = _sides(spark)
    bound = binding.bind(found, wanted, "f", "c").withColumn("node", F.lit("n"))
    df = binding.ranked_options(bound, ["role"], "f", "c", "node", 2)
    assert _plan(df).count("WindowGroupLimit") == 2


def test_absence_is_taken_from_the_atom(spark):
    assert "denies|denied" not in _plan(plans.family_shortlist(spark, SMALL))


def test_labels_go_to_where_the_pairs_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("binding_authority", "asserted_diagnoses"):
            assert "SortMergeJoin" not in getattr(plans, name)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_standing_of_dealt_lines_shuffles_no_ids(spark):
    from marlstone.plans import arguments

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = arguments.argument_standing(spark, SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Exchange hashpartitioning\((.*?), 8\)", plan)
        assert 1 < len(keys) <= 4 and all("," not in k for k in keys)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, argument_graph.standing(arguments._graph(spark, SMALL)[1], "l_orderkey").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reviews_of_dealt_arguments_are_the_same(spark):
    rows = [(1, "a", "C1", ["S-1", "K1"], 1.0, True), (1, "a", "C2", ["S-1", "K1"], 0.0, True), (1, "b", "C1", ["S-2", "K1"], 1.0, False), (2, None, "C1", ["S-2"], 1.0, True), (None, "a", "C1", [], 1.0, True)]
    args = spark.createDataFrame(rows, "case int, argument_id string, candidate_id string, evidence_ids array<string>, compatibility double, typed_valid boolean")
    said = [(1, "a", "contradicted", ["S-1"], [], 1), (1, "a", "supported", ["K1", "S-1"], [], 2), (2, None, "supported", ["S-2"], [], 1), (1, "z", "supported", ["S-2"], ["q"], 1), (None, "a", "supported", [], [], 1)]
    reviews = spark.createDataFrame(said, "case int, argument_id string, verdict string, evidence_ids array<string>, failed array<string>, place int")
    columns = ("case", "argument_id", "candidate_id", "reasons", "verdict", "grounded")
    told = [sorted(map(repr, argument_graph.reviewed(args, reviews, "case", dealt).select(*columns).collect())) for dealt in (False, True)]
    assert told[0] == told[1] and len(told[0]) == 5
