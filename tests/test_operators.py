import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import binding as B
from marlstone.functions import numeric as N
from marlstone.functions import text as T
from marlstone.operators import fusion, lexical, metrics, model, select, vectors
from marlstone.operators.resolve import resolve
from marlstone.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_drop_short_words_and_stopwords(spark):
    assert one(spark, T.tokens(F.lit("The patient HAS a 2nd b Éclair-test 10"))) == ["2nd", "clair", "test", "10"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_family_key(spark):
    pairs = {"Severe COPD": "copd", "Suspected Viral Pneumonia": "pneumonia", "Strongly suspected HFrEF": "heartfailure", "Severe hypertension": "hypertension", "mild": "mild"}
    for label, key in pairs.items():
        assert one(spark, T.family_key(F.lit(label))) == key


def test_contradictions_need_different_members_of_one_group(spark):
    q = lambda s: T.qualifiers(F.lit(s))
    assert one(spark, T.contradict(q("acute bacterial pneumonia"), q("viral pneumonia")))
    assert not one(spark, T.contradict(q("acute pneumonia"), q("acute asthma")))
    assert not one(spark, T.contradict(q("pneumonia"), q("viral pneumonia")))


def test_word_windows_cover_all_words(spark):
    words = [f"w{i}" for i in range(130)]
    got = one(spark, T.word_windows(F.lit(" ".join(words)), 56, 48))
    assert [w.split()[0] for w in got] == ["w0", "w48", "w96"]
    assert set(" ".join(got).split()) == set(words)
    assert one(spark, T.word_windows(F.lit("  "))) == []


def test_stated_quantities(spark):
    got = one(spark, B.stated_quantities(F.lit("pressure above 140 mmHg, at most 3.5 mg/dl and 7")))
    assert [tuple(q) for q in got] == [(">", 140.0, "mmhg"), ("<=", 3.5, "mg/dl"), ("=", 7.0, "")]


def test_exact_binomial(spark):
    from math import comb

    for b, c in ((0, 0), (3, 1), (10, 2), (40, 35), (0, 9)):
        n = b + c
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
        assert abs(one(spark, N.exact_binomial(F.lit(b), F.lit(c))) - want) < 1e-9


def test_diminishing_takes_three(spark):
    assert one(spark, N.diminishing(F.array(*map(F.lit, (1.0, 4.0, -3.0, 2.0, 8.0))))) == 8 + 2 + 0.5


def test_bm25_is_the_formula(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "apple apple apple banana")], "item_id long, text string")
    from math import log

    avg = 5 / 3
    score = lambda df, tf, n, qtf: log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) * min(qtf, 2)
    got = {r["doc"]: r["score"] for r in lexical.bm25(docs, q).collect()}
    assert got == {1: round(score(1, 2, 3, 3) + score(2, 1, 3, 1), 6), 2: round(score(2, 1, 2, 1), 6)}


def test_margin_is_zero_alone(spark):
    df = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "z", 2.0)], "g string, r string, s double")
    got = {r["r"]: r["margin"] for r in fusion.margin(df, ["g"], "s", "r").collect()}
    assert got == {"x": 2.0, "y": -2.0, "z": 0.0}


def test_fact_allocation_is_fair_and_uses_a_source_once(spark):
    rows = [("q", r, f, s, n) for r, n, facts in ((1, 1, "abc"), (2, 3, "ade")) for f, s in enumerate(facts)]
    df = spark.createDataFrame(rows, "q string, route_position int, fact_position int, source_id string, siblings int")
    got = [(r["route_position"], r["source_id"]) for r in select.allocate_facts(df, "q", 4).orderBy("allocated").collect()]
    assert got == [(1, "a"), (2, "d"), (2, "e"), (1, "b")]


def test_greedy_match_prefers_score(spark):
    df = spark.createDataFrame([("r", 0, 0, 0.5), ("r", 0, 1, 0.9), ("r", 1, 1, 0.8), ("r", 1, 0, 0.2)], "rec string, left_pos int, right_pos int, score double")
    got = {(r["left_pos"], r["right_pos"]) for r in select.greedy_match(df, "rec", 0.35).collect()}
    assert got == {(0, 1)}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for r in vectors.nearest(df.filter("vec_id < 3"), df, 4).collect():
        s = np.round(u @ u[r["query"]], 6)
        assert r["doc"] == np.lexsort((np.arange(60), -s))[r["rank"] - 1]


def test_split_takes_rounded_shares(spark):
    df = spark.createDataFrame([("a", i) for i in range(13)] + [("b", i) for i in range(4)], "s string, k long")
    got = pd.DataFrame([tuple(r) for r in metrics.stratified_split(df, "s", "k").select("s", "k", "part").collect()], columns=["s", "k", "part"])
    dev = got[got.part == "development"].groupby("s").size().to_dict()
    assert dev == {"a": 3}


def test_resolver_ladder(spark):
    cols = "decision string, child_label string, attack boolean, attack_type string, alternative string, valid boolean, scope string, independent boolean, protected boolean, want string"
    better = "better_supported_alternative"
    rows = [
        ("supported", "c", False, "", "", None, "", False, False, "maintain"),
        ("supported", "", False, "", "", None, "", False, False, "family_fallback"),
        ("supported", "c", True, better, "D2", False, "", True, False, "abstain"),
        ("supported", "c", True, better, "D2", False, "", False, False, "maintain"),
        ("supported", "c", True, "unsupported_specificity", "", True, "", False, False, "family_fallback"),
        ("supported", "c", True, better, "D2", True, "family", False, False, "switch"),
        ("supported", "c", True, "contradiction", "", True, "family", False, False, "abstain"),
        ("inconclusive", "", False, "", "", None, "", False, True, "protected_incumbent"),
        ("inconclusive", "", True, better, "D2", True, "", True, True, "switch"),
        ("inconclusive", "", True, better, "D2", True, "", True, False, "abstain"),
        (None, None, None, None, None, None, None, None, None, "abstain"),
    ]
    assert all(r["action"] == r["want"] for r in resolve(spark.createDataFrame(rows, cols)).collect())


def test_completion_caches_and_keeps_failures(spark):
    req = spark.createDataFrame([("k1", "p1"), ("k1", "p1"), ("k2", "p2"), ("k3", "p3")], "cache_key string, prompt string")
    held = spark.createDataFrame([("k2", "old", None)], "cache_key string, answer string, error string")

    def completer(p):
        if p == "p3":
            raise ValueError("no")
        return p.upper()

    answers, new = model.complete_cached(req, held, completer)
    got = {(r["cache_key"], r["answer"], r["error"]) for r in answers.collect()}
    assert got == {("k1", "P1", None), ("k2", "old", None), ("k3", None, "ValueError: no")}
    assert new.count() == 2


def test_readers_and_sinks(spark, tmp_path):
    assert readers.json_lines(spark, str(tmp_path / "none"), "a long").count() == 0
    lines = tmp_path / "p.jsonl"
    lines.write_text('{"case_id": "1", "mode": "m", "citations": ["K1"]}\n\n{"case_id": "2", "error": "late"}\n')
    got = {r["case_id"]: r for r in readers.predictions(spark, str(lines)).collect()}
    assert got["1"]["citations"] == ["K1"] and got["1"]["predicted_label"] == "" and got["1"]["error"] is None
    assert got["2"]["citations"] == [] and got["2"]["error"] == "late" and got["2"]["latency_seconds"] == 0.0
    graphs = tmp_path / "graphs"
    graphs.mkdir()
    (graphs / "H.json").write_text(json.dumps({"diagnostic": {"Suspected H": {"H": {"H1": [], "H2": []}}}, "knowledge": {"H": {"Symptoms": "a; b", "Risk Factors": "c"}, "H1": "Repeated values; high"}}))
    nodes = {r["node"]: r for r in readers.json_trees(spark, str(graphs)).collect()}
    assert nodes["H2"]["path"] == ["Suspected H", "H", "H2"] and nodes["H2"]["parent"] == "H" and nodes["Suspected H"]["parent"] is None
    prem = {(r["diagnosis"], r["premise_type"], r["text"]) for r in readers.premises(spark, str(graphs)).collect()}
    assert prem == {("H", "Symptoms", "a"), ("H", "Symptoms", "b"), ("H", "Risk Factors", "c"), ("H1", "Diagnostic Criteria", "Repeated values"), ("H1", "Diagnostic Criteria", "high")}
    rrf = tmp_path / "M.RRF"
    rrf.write_text('C1|a "b|X|\nC2|c|Y|\n')
    assert [(r["cui"], r["term"]) for r in readers.pipe_delimited(spark, str(rrf), ["cui", "term", "src"]).orderBy("line_no").collect()] == [("C1", 'a "b'), ("C2", "c")]
    df = spark.createDataFrame([(1, "x")], "b long, a string")
    assert df.select(sinks.canonical_json(df).alias("j")).first()["j"] == '{"a":"x","b":1}'
    sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(df, str(tmp_path / "once"))
    sinks.csv(df, str(tmp_path / "csv"))
    assert readers.csv(spark, str(tmp_path / "csv"), "b long, a string").collect() == df.collect()
    with pytest.raises(ValueError):
        readers.require_tables(["a"], ["a", "b"])
    assert readers.digests(spark, str(graphs)).count() == 1
