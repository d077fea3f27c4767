"""Typed binding on cases whose answer follows from the rules, and spans against a plain version."""

import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import binding as B
from marlstone.functions import typed


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


@pytest.mark.parametrize(("finding", "criterion", "want"), [
    ("pressure 300 mmHg", "pressure 120-140 mmHg", False),
    ("pressure 130 mmHg", "pressure 120-140 mmHg", True),
    ("pressure 130", "pressure 120 to 140 mmHg", False),
    ("pressure 130 mmHg", "pressure 120–140", True),
    ("pressure above 130 mmHg", "pressure 120-140 mmHg", False),
    ("pressure 150 mmHg", "pressure at least 140 mmHg", True),
    ("pressure 150", "pressure at least 140 mmHg", False),
    ("pressure 150", "pressure is high", True),
    ("", "pressure 120-140", False),
    (None, "pressure 120-140", False),
])
def test_ranges_and_thresholds(spark, finding, criterion, want):
    assert one(spark, B.quantities_meet(F.lit(finding).cast("string"), F.lit(criterion))) == want


@pytest.mark.parametrize(("finding", "criterion", "candidate", "role", "want"), [
    ("Troponin 45 ng/ml today", "Troponin at least 40 ng/ml", "infarction", "diagnostic_criterion", "exact_measurement"),
    ("Troponin 45 ng/ml today", "Troponin at least 40 ng/ml", "infarction", "risk_factor", "semantic_review"),
    ("CT showed pulmonary embolism", "CT pulmonary embolism", "embolism", "diagnostic_criterion", "exact_positive_test"),
    ("MRI showed pulmonary embolism", "CT pulmonary embolism", "embolism", "diagnostic_criterion", "semantic_review"),
    ("History of asthma", "asthma", "asthma", "diagnostic_criterion", "semantic_review"),
    ("Patient has asthma", "asthma", "asthma", "diagnostic_criterion", "explicit_current_diagnosis"),
    ("No chest pain", "without chest pain", "asthma", "diagnostic_criterion", "explicit_negation"),
])
def test_authority(spark, finding, criterion, candidate, role, want):
    assert one(spark, typed.authority(*map(F.lit, (finding, criterion, candidate, role)))) == want


@pytest.mark.parametrize(("finding", "family", "ok", "score"), [
    ("CT showed pulmonary embolism", "Pulmonary Embolism", True, 1.0),
    ("CT ordered for pulmonary embolism", "Pulmonary Embolism", False, 1.0),
    ("CT showed embolism", "Pulmonary Embolism", False, 0.5),
    ("Pulmonary embolism", "Pulmonary Embolism", False, 1.0),
    ("CT showed no pulmonary embolism", "Pulmonary Embolism", False, 1.0),
    ("Biopsy confirmed cirrhotic liver", "cirrhosis liver", True, 1.0),
])
def test_family_tests(spark, finding, family, ok, score):
    got = one(spark, typed.family_test(F.lit(finding), F.lit(family)))
    assert (got["admissible"], got["score"]) == (ok, score)


def plain_spans(text):
    flat = lambda x: " ".join(x.split())
    out = [flat(x) for x in re.split(r"(?<=[.!?])\s+|[;:\r\n]+", text) if len(flat(x)) >= 8]
    series = {}
    for m in re.finditer(r"([A-Za-z][A-Za-z0-9/-]{1,30})\s*[-:=]\s*[<>]?\s*\d+(?:\.\d+)?\*", text):
        series.setdefault(m.group(1).lower(), []).append(m)
    for ms in series.values():
        if len(ms) >= 2:
            out.append(flat(text[ms[0].start() : ms[-1].end()]))
    return list(dict.fromkeys(x for x in out if 8 <= len(x) <= 2000))


@pytest.mark.parametrize("text", [
    "", "short", "Pain began today. It is worse now; no fever here",
    "Labs\nglucose - 140*  sodium: 130*\nglucose = 180* and sodium 128",
    "glucose:140* glucose:150* glucose:160*\nsodium=1* sodium=2.5*", "glucose - 140*",
])
def test_patient_spans(spark, text):
    assert one(spark, typed.patient_spans(F.lit(text))) == plain_spans(text)


def test_atomic_criteria(spark):
    assert one(spark, typed.atomic_criteria(F.lit("Fever.  Cough;\n pain > 3.5  days"))) == ["Fever.", "Cough", "pain > 3.5 days"]
    assert one(spark, typed.atomic_criteria(F.lit(None).cast("string"))) == [""]


def test_manifest_and_audit_log(spark, tmp_path):
    from marlstone.sources import sinks

    for n in (1, 2):
        sinks.manifest(spark.createDataFrame([(n, "x")], "cases int, run string"), str(tmp_path / "m"))
    assert [r["cases"] for r in spark.read.json(str(tmp_path / "m")).collect()] == [2]
    for start in (0, 10):
        sinks.audit_log(spark.range(start, start + 10, numPartitions=3).withColumnRenamed("id", "event"), str(tmp_path / "log"))
    rows = sorted((r["request_id"], r["event"]) for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert [e for _, e in rows] == list(range(20)) and len({i for i, _ in rows}) == 20


def test_null_parts_of_a_cache_key_count(spark):
    from marlstone.operators.model import cache_key

    rows = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a", "")], "x string, y string")
    assert rows.select(cache_key("x", "y").alias("k")).distinct().count() == 4
