from pyspark.sql import functions as F

from marlstone.operators import answers as A


def test_first_object(spark):
    rows = [('so: {"a": "}{", "b": {"c": "\\""}} and {"d": 1}',), ("none",), ("{open",), (None,)]
    got = [r["object"] for r in A.first_objects(spark.createDataFrame(rows, "t string").coalesce(1), "t").collect()]
    assert got == ['{"a": "}{", "b": {"c": "\\""}}', None, None, None]


def test_fences_and_closed_schemas(spark):
    rows = [('```json\n{"a": 1, "b": "x"}\n```',), ('text ```json\n{"a": 1}\n```',), ('```json\n{"a": 1}\n```\n```json\n{}\n```',), ('```json\n{"a": 1, "c": 2}\n```',)]
    df = spark.createDataFrame(rows, "t string").select(A.fenced(F.col("t")).alias("j"))
    got = [r["o"] for r in df.select(A.closed(F.col("j"), "a int, b string", ["b", "a"]).alias("o")).collect()]
    assert tuple(got[0]) == (1, "x") and got[1:] == [None, None, None]


def test_activation_keeps_owners_and_refills(spark):
    owners = spark.createDataFrame([("c", p, d, s) for p, d, s in (("p1", "D1", 1.0), ("p2", "D1", 3.0), ("p3", "D1", 2.0), ("q1", "D2", 1.0))], "case_id string, pair_id string, candidate_id string, score double")
    choices = spark.createDataFrame([("c", "D2", 1, "q1", 1), ("c", "D1", 2, "p1", 1), ("c", "D1", 2, "q1", 2), ("c", "D9", 0, "p1", 1)], "case_id string, candidate_id string, rank int, pair_id string, position int")
    got = {(r["candidate_id"], r["pair_id"], r["place"], r["refill"]) for r in A.activations(choices, owners).collect()}
    assert got == {("D2", "q1", 1, False), ("D1", "p1", 1, False), ("D1", "p2", 2, True)}


def test_parsers_close_on_failure(spark):
    cols = "decision string, candidate_id string, child_label string, pairs array<string>, foreign array<string>, allowed_children array<string>"
    rows = [("supported", "D1", "kid", ["p"], [], ["kid"]), ("supported", "D1", "other", ["p"], [], ["kid"]), ("supported", "D1", "kid", ["p"], ["q"], ["kid"]), (None, "D1", "kid", ["p"], [], ["kid"])]
    got = [(r["decision"], r["child_label"]) for r in A.differential(spark.createDataFrame(rows, cols)).collect()]
    assert got == [("supported", "kid"), ("supported", ""), ("inconclusive", ""), ("inconclusive", "")]
    cols = "attack boolean, attack_type string, alternative string, alternative_pairs array<string>, pairs array<string>"
    rows = [(True, "better_supported_alternative", "D2", ["q"], []), (True, "better_supported_alternative", "D2", [], ["p"]), (True, "contradiction", "D2", [], ["p"]), (None, "contradiction", "", [], ["p"])]
    got = [(r["attack"], r["alternative"]) for r in A.attack(spark.createDataFrame(rows, cols)).collect()]
    assert got == [(True, "D2"), (False, ""), (True, ""), (False, "")]


def test_grounding_drops_unknown_and_repeated(spark):
    args = spark.createDataFrame([("c", 1, "A", ["k1", "K1"]), ("c", 2, "a", ["K1"]), ("c", 3, "B", ["K1", "K9"]), ("c", 4, "C", [])], "case_id string, position int, claim string, evidence_ids array<string>")
    valid = spark.createDataFrame([("c", "k1 ")], "case_id string, evidence_id string")
    assert [r["position"] for r in A.grounded_arguments(args, valid).collect()] == [1]
