"""Evaluation reports: case metrics by mode, judgments, retrieval audits, why cases failed, one family, presentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import typed
from marlstone.functions.text import label_key
from marlstone.operators.retrieval import generic

# The metrics of a case that are averaged as they stand, and the least recalls of a retrieval audit.
PLAIN = (
    "hierarchy_score", "diagnosis_family_accuracy", "coverage", "citation_validity", "observation_precision", "observation_recall", "observation_f1", "retrieval_gold_coverage", "error_rate",
    "argument_schema_validity", "argument_evidence_validity", "argument_evidence_compatibility", "argument_scheme_validity", "supported_review_grounding", "counterargument_evidence_validity",
    "valid_evidence_reference_fraction", "verifier_review_coverage", "symbolic_trace_fidelity", "argument_resolution_change_rate",
)
FAMILY_AT_3, CANDIDATE_AT_8 = 0.75, 0.80


def _rate(part: Column, whole: Column, empty: float | None = None) -> Column:
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.round(share if empty is None else F.coalesce(share, F.lit(empty)), 6)


def mode_summary(cases: DataFrame, by: Sequence[str] = ("dataset", "mode")) -> DataFrame:
    """``subset, by..., n`` and 23 figures of every group, over all cases and over the ``graph_consistent`` ones.

    ``cases`` has ``exact_match, latency_seconds, cache_hit, graph_consistent`` and the columns of ``PLAIN``.  Means pass over nulls;
    selective accuracy is that of covered cases, latency that of answers not from the cache.  Each case is read once: it counts in one or both subsets.
    """
    subsets = F.when(F.coalesce(F.col("graph_consistent").cast("boolean"), F.lit(False)), F.array(F.lit("all"), F.lit("graph_consistent"))).otherwise(F.array(F.lit("all")))
    rows = cases.withColumn("subset", F.explode(subsets))
    mean = lambda c: F.round(F.avg(c), 6)
    exact = F.col("exact_match").cast("double")
    return rows.groupBy("subset", *by).agg(
        F.count(F.lit(1)).alias("n"),
        mean(exact).alias("accuracy"),
        F.round(F.coalesce(F.stddev_pop(exact), F.lit(0.0)), 6).alias("accuracy_sd"),
        *[mean(F.col(c)).alias(c) for c in PLAIN],
        mean(F.when(F.col("coverage") > 0, exact)).alias("selective_accuracy"),
        mean(F.when(~F.col("cache_hit"), F.col("latency_seconds"))).alias("mean_latency_seconds"),
    )


def judgment_summary(judged: DataFrame, mode: str = "mode") -> DataFrame:
    """The 17 figures of every mode, with ``decision_counts`` as a map.

    ``judged`` has the mode, ``included, passed, primary_passed`` (null: as ``passed``), ``exclusion_reason, abstained, predicted_label, possible`` (labels, or null).
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    included, passed, label = F.col("included"), F.col("passed"), F.trim(F.coalesce("predicted_label", F.lit("")))
    answered = ~F.col("abstained") & (label != "")
    size = F.when(F.coalesce(F.size("possible"), F.lit(0)) > 0, F.size("possible")).otherwise((F.coalesce("predicted_label", F.lit("")) != "").cast("int"))
    primary = F.coalesce("primary_passed", "passed")
    g = judged.groupBy(mode).agg(
        F.count(F.lit(1)).alias("n"), n(included).alias("evaluated_n"), n(~included).alias("excluded_count"),
        n(F.col("exclusion_reason") == "insufficient_evidence_abstention").alias("excluded_insufficient_evidence_abstention_count"), n(F.col("exclusion_reason") == "evaluation_failure").alias("evaluation_failure_count"),
        n(answered).alias("diagnostic_answer_count"), n(included & passed).alias("family_pass_count"), n(included & primary).alias("primary_family_pass_count"),
        n(size == 1).alias("single_answer_count"), n(F.coalesce(F.size("possible"), F.lit(0)) > 1).alias("tie_count"), F.sum(size).alias("__sizes"),
        n(included & ~passed).alias("__fail"),
    )
    c = F.col
    counts = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), c(v).alias("value")) for k, v in (("excluded", "excluded_count"), ("fail", "__fail"), ("pass", "family_pass_count"))]), lambda e: e["value"] > 0)
    return g.select(
        mode, "n", "evaluated_n", "excluded_count", "excluded_insufficient_evidence_abstention_count", "evaluation_failure_count", _rate(c("evaluated_n"), c("n")).alias("accuracy_denominator_coverage"),
        "diagnostic_answer_count", _rate(c("diagnostic_answer_count"), c("n")).alias("diagnostic_coverage"), "family_pass_count", _rate(c("family_pass_count"), c("evaluated_n")).alias("family_accuracy"),
        "primary_family_pass_count", _rate(c("primary_family_pass_count"), c("evaluated_n")).alias("primary_family_accuracy"), c("diagnostic_answer_count").alias("primary_answer_count"),
        "single_answer_count", "tie_count", _rate(c("__sizes"), c("n")).alias("average_prediction_set_size"), F.map_from_entries(counts).alias("decision_counts"),
    )


def retrieval_audit(cases: DataFrame, hits: Sequence[str], sizes: Sequence[str], expected: int, family: str, graph: str, complete: str, label_free: str, failed: str) -> DataFrame:
    """One row: cases, errors, the rate of each of the ``hits``, the spread of each of the ``sizes``, and the gates.

    ``hits`` and the last five names are columns of booleans; ``family`` and ``graph`` are among the hits.  Without cases all rates are 0.
    """
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    aggs = [n.alias("case_count"), count(failed).alias("error_count"), count(complete).alias("__complete"), count(label_free).alias("__free")]
    aggs += [count(h).alias(f"{h}_count") for h in hits]
    for s in sizes:
        aggs += [F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias(f"{s}_mean"), F.coalesce(F.min(s), F.lit(0)).alias(f"{s}_least"), F.coalesce(F.max(s), F.lit(0)).alias(f"{s}_most")]
    row = cases.agg(*aggs)
    for h in hits:
        row = row.withColumn(f"{h}_rate", _rate(F.col(f"{h}_count"), F.col("case_count"), 0.0))
    gates = {
        "exact_frozen_case_set": (F.col("case_count") == expected) & (F.col("case_count") > 0), "zero_errors": F.col("error_count") == 0, "family_recall": F.col(f"{family}_rate") >= FAMILY_AT_3,
        "graph_family_recall": F.col(f"{graph}_rate") >= CANDIDATE_AT_8, "complete_provenance": F.col("__complete") == F.col("case_count"), "zero_label_leakage": F.col("__free") == F.col("case_count"),
    }
    for name, ok in gates.items():
        row = row.withColumn(name, ok)
    primary = [F.col(g) for g in gates if g != "family_recall"]
    every = primary[0]
    for p in primary[1:]:
        every = every & p
    return row.withColumn("development_authorized", every).drop("__complete", "__free")


def failure_bucket(c: DataFrame) -> Column:
    """Why a case was not answered: the first rule that fits.

    ``c`` has ``abstained, error, abstention_category, resolver_action, direct_decision, candidate_id, decisive_pairs, bad_citations, graph_label,
    graph_candidates, active_graph_candidates`` (counts), ``attack, attack_type, attack_valid, protected``.
    """
    text = lambda n: F.coalesce(c[n], F.lit(""))
    flag = lambda n: F.coalesce(c[n], F.lit(False))
    many = lambda n: F.coalesce(c[n], F.lit(0)) > 0
    declined = text("direct_decision").isin("none_of_supplied_candidates", "insufficient")
    missing = (
        F.when(many("bad_citations"), "protected_graph_missing_bad_graph_citations")
        .when(many("graph_candidates") & ~many("active_graph_candidates"), "protected_graph_missing_graph_candidate_inactive")
        .when(text("graph_label") == "", "direct_declined_no_graph_anchor")
        .otherwise("direct_declined_no_supported_family")
    )
    return (
        F.when(~flag("abstained"), "resolved")
        .when(text("error") != "", "execution_failure")
        .when(text("abstention_category") != "insufficient_evidence", F.coalesce(F.nullif(text("abstention_category"), F.lit("")), F.lit("other_abstention")))
        .when(text("resolver_action") != "abstain", F.coalesce(F.nullif(text("resolver_action"), F.lit("")), F.lit("non_abstain")))
        .when(~declined, "other_abstention_reason")
        .when(text("candidate_id") == "", missing)
        .when(~many("decisive_pairs"), "direct_declined_no_decisive_pairs")
        .when(flag("attack") & ~flag("attack_valid"), "attack_validation_failed")
        .when(flag("attack") & (text("attack_type") != "") & ~flag("protected"), "no_protected_incumbent_after_attack")
        .otherwise("direct_declined_no_protected")
    )


def same_family(pairs: DataFrame, paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, same_family`` of each pair of labels ``reference, evaluated``.

    ``paths`` has ``category, path``.  Two labels that a graph both has are of one family if either is its category, if any of their paths share a
    node that is not merely suspected, or if the category is a syndrome.  Labels meet on (category, node), a category standing for all its paths.
    """
    named = paths.select(F.col("category").alias("__c"), label_key(F.col("category")).alias("__ck"), F.transform("path", lambda x: label_key(x)).alias("__all"), F.transform(F.filter("path", lambda x: ~generic(x)), lambda x: label_key(x)).alias("__up"))
    # two nodes of one path each, so a place of many paths is many rows and never one array
    met = named.select("__c", F.explode("__all").alias("__k"), "__up").select("__c", "__k", F.explode("__up").alias("__x")).distinct()
    nodes = named.select("__c", "__ck", F.explode("__all").alias("__k")).union(named.select("__c", "__ck", F.col("__ck").alias("__k"))).distinct()
    sizes = met.groupBy("__c", "__k").agg(F.count(F.lit(1)).alias("__n"))
    per = nodes.join(sizes, ["__c", "__k"], "left").select("__c", "__k", (F.col("__k") == F.col("__ck")).alias("__whole"), F.coalesce("__n", F.lit(0)).alias("__n"))
    side = lambda p: per.select("__c", *[F.col(f"__{c}").alias(f"__{p}{c}") for c in ("k", "whole", "n")])
    key = lambda c: label_key(F.coalesce(F.col(c), F.lit("")))
    labelled = pairs.select(*keys, key("reference").alias("__rk"), key("evaluated").alias("__ek"))
    asked = labelled.select("__rk", "__ek").distinct().filter("__rk <> '' and __ek <> ''")
    both = asked.join(side("r"), "__rk").join(side("e"), ["__ek", "__c"])
    plain = F.col("__rwhole") | F.col("__ewhole") | F.contains(F.lower("__c"), F.lit("syndrome"))
    # the label with fewer neighbours lists them; the other is only asked
    fewer = F.col("__rn") <= F.col("__en")
    open_ = both.filter(~plain).select("__rk", "__ek", "__c", F.when(fewer, F.col("__rk")).otherwise(F.col("__ek")).alias("__k"), F.when(fewer, F.col("__ek")).otherwise(F.col("__rk")).alias("__o"))
    shared = open_.join(met, ["__c", "__k"]).join(met.withColumnRenamed("__k", "__o"), ["__c", "__o", "__x"], "left_semi")
    found = both.filter(plain).select("__rk", "__ek").union(shared.select("__rk", "__ek")).distinct().withColumn("__same", F.lit(True))
    return labelled.join(found, ["__rk", "__ek"], "left").select(*keys, F.coalesce("__same", F.lit(False)).alias("same_family"))


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def presented_prediction(p: DataFrame) -> DataFrame:
    """``case_number, method, diagnosis, abstained, explanation, evidence_basis, error_category``: an answer without identifiers or gold."""
    return p.select("case_number", _clean(p["mode"]).alias("method"), _clean(p["predicted_label"]).alias("diagnosis"), F.coalesce(p["abstained"], F.lit(False)).alias("abstained"), _clean(p["reasoning"]).alias("explanation"), typed.evidence_basis(p["citations"]).alias("evidence_basis"), typed.error_category(p["error"]).alias("error_category"))


def presented_trace(t: DataFrame) -> DataFrame:
    """``case_number, candidates, reviews, counterarguments, diagnosis, abstained, explanation, evidence_basis, error_category``: a trace to read, without ids.

    ``t`` has ``case_number``; ``candidates`` array<struct<diagnosis, arguments: array<struct<argument_id, patient_finding, application, rationale, evidence_ids>>>>; ``reviews``
    array<struct<argument_id, verdict, explanation, failed, evidence_ids>>; ``counterarguments`` array<struct<target_id, premise, conclusion, relation, evidence_ids>>; ``nodes``
    array<struct<argument_id, conclusion, premise>>; ``decision`` struct<selected, abstained, supporting array<string>, evidence_ids, error>.  Nested lists
    stay nested: ids are looked up in a map of the row's own arguments.
    """
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.flatten(F.transform("candidates", lambda c: F.transform(c["arguments"], lambda a: F.struct(a["argument_id"].alias("key"), _clean(c["diagnosis"]).alias("value")))))
    of = F.map_from_entries(F.coalesce(F.array_distinct(entries), none))
    t = t.withColumn("__of", of)
    name = lambda i: F.coalesce(F.try_element_at("__of", F.coalesce(i, F.lit(""))), F.lit(""))
    candidates = F.transform("candidates", lambda c: F.struct(_clean(c["diagnosis"]).alias("diagnosis"), F.transform(c["arguments"], lambda a: F.struct(_clean(a["patient_finding"]).alias("patient_finding"), _clean(a["application"]).alias("application"), _clean(a["rationale"]).alias("rationale"), typed.evidence_basis(a["evidence_ids"]).alias("evidence_basis"))).alias("arguments")))
    reviews = F.transform("reviews", lambda r: F.struct(name(r["argument_id"]).alias("diagnosis"), _clean(r["verdict"]).alias("verdict"), _clean(r["explanation"]).alias("explanation"), F.transform(r["failed"], lambda x: _clean(x)).alias("failed_critical_questions"), typed.evidence_basis(r["evidence_ids"]).alias("evidence_basis")))
    counters = F.transform("counterarguments", lambda r: F.struct(name(r["target_id"]).alias("target_diagnosis"), _clean(r["premise"]).alias("premise"), _clean(r["conclusion"]).alias("conclusion"), _clean(r["relation"]).alias("relation"), typed.evidence_basis(r["evidence_ids"]).alias("evidence_basis")))
    chosen = F.filter("nodes", lambda n: F.array_contains(F.coalesce(F.col("decision.supporting"), F.array().cast("array<string>")), n["argument_id"]))
    said = F.trim(F.array_join(F.transform(chosen, lambda n: _clean(F.coalesce(F.nullif(n["conclusion"], F.lit("")), n["premise"]))), " "))
    return t.select("case_number", candidates.alias("candidates"), reviews.alias("reviews"), counters.alias("counterarguments"), _clean(F.col("decision.selected")).alias("diagnosis"), F.coalesce("decision.abstained", F.lit(True)).alias("abstained"), F.coalesce(said, F.lit("")).alias("explanation"), typed.evidence_basis(F.coalesce("decision.evidence_ids", F.array().cast("array<string>"))).alias("evidence_basis"), typed.error_category(F.col("decision.error")).alias("error_category"))
