from pyspark.sql import functions as F

from marlstone.functions import clinical as C
from marlstone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_binding_tokens(spark):
    got = one(spark, C.binding_tokens(F.lit("Elevated hs-cTnT-24 levels, T-waves, biopsies and class II/III; glass CK-MB/5")))
    assert got == ["elevated", "troponin", "t-wave", "biopsy", "class", "ii/iii", "glass", "ck-mb"]


def test_candidate_terms(spark):
    got = one(spark, C.candidate_terms(F.lit("The patient has acute bronchitis with renal failure"), 4))
    assert got == ["acute bronchitis", "renal failure", "bronchitis", "failure"]


def test_modality_is_the_first_named(spark):
    assert one(spark, C.modality(F.lit("CT angiography of the chest"))) == "ct-angiography"
    assert one(spark, C.modality(F.lit("head ct scan and MRI"))) == "computed-tomography"
    assert one(spark, C.modality(F.lit("nothing"))) is None


def test_exclusions_and_anchors(spark):
    role = F.lit("diagnostic_criterion")
    assert one(spark, C.is_excluding(F.lit("normal ECG without changes")))
    assert not one(spark, C.is_excluding(F.lit("pain with or without fever")))
    assert one(spark, C.decisive_anchor(F.lit("MRI shows plaques"), role))
    assert not one(spark, C.decisive_anchor(F.lit("negative MRI"), role))
    assert one(spark, C.proposition_kind(F.lit("LVEF < 40 %"), role)) == "measurement"
    assert one(spark, C.relation(F.lit("smoking"), F.lit("risk_factor"))) == "weak_support"


def test_thresholds(spark):
    met = lambda q, p: one(spark, C.threshold_met(F.lit(q), F.lit(p)))
    assert met("BP: 150/95, pulse 80", "SBP >= 140 or DBP >= 90")
    assert not met("BP 120/70", "SBP >= 140")
    assert met("troponin is 0.4", "serum troponin > 0.04") and not met("ck 5", "serum troponin > 0.04")


def test_answers(spark):
    options = F.create_map(F.lit("A"), F.lit("Asthma"), F.lit("B"), F.lit("COPD"))
    assert one(spark, C.normalize_answer(F.lit("(b)."), options)) == "COPD"
    assert one(spark, C.normalize_answer(F.lit("asthma."), options)) == "Asthma"
    assert one(spark, C.normalize_answer(F.lit("The most likely diagnosis is  gout because of pain."))) == "gout"
    assert one(spark, C.identifier_list(F.array(F.lit("K1, k1,K2"), F.lit(" S-HPI ")))) == ["K1", "K2", "S-HPI"]


def test_exact_findings_pack_words(spark):
    long = " ".join(["word"] * 100) + ". Short one here."
    got = one(spark, C.exact_findings(F.lit(long)))
    assert got[-1] == "Short one here." and all(8 <= len(p) <= 240 for p in got)
    assert one(spark, C.exact_findings(F.lit("Chest pain; no fever today"))) == ["Chest pain; no fever today", "Chest pain", "no fever today"]
    assert one(spark, C.exact_findings(F.lit(None).cast("string"))) == []


def test_annotation_keys(spark):
    got = one(spark, C.annotation(F.lit("raised pressure$Input5_2")))
    assert tuple(got) == ("raised pressure", "observation", "physical_exam", 2)
    assert tuple(one(spark, C.annotation(F.lit("why$Cause")))) == ("why", "rationale", None, None)
    assert tuple(one(spark, C.annotation(F.lit("plain")))) == (None, None, None, None)


def test_paths_clauses_prompts(spark):
    path = F.array(F.lit("Suspected H"), F.lit("H"), F.lit("H1"))
    assert [one(spark, C.path_compatibility(F.lit(x), path)) for x in ("h1", "H", "suspected h", "x")] == [1.0, 0.75, 0.5, 0.0]
    assert one(spark, C.current_clauses(F.lit("History of gout. New pain; prior scan normal"))) == ["New pain"]
    assert one(spark, C.prompt_part(F.lit("a<b>body</b>c"), "<b>", "</b>")) == "body"
    assert tuple(one(spark, C.budget(F.lit(13_825)))) == (-1, False)


def test_retrieval_segments(spark):
    got = one(spark, T.retrieval_segments(F.lit("Pain today.\nECG: normal; Labs: high " + "w " * 60)))
    assert got[0] == "Pain today." and got[1] == "ECG: normal" and got[2].startswith("Labs: high") and len(got) == 4


def test_qualifiers_by_key(spark):
    assert one(spark, T.qualifiers(F.lit("known HFrEF"))) == ["reduced_ef"]
    assert one(spark, T.qualifiers(F.lit("Strongly suspected NSTEMI"))) == ["non_st_elevation", "strongly_suspected", "suspected"]
