"""Queries on evaluation reports: lines of orders as evaluated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import evaluation
from marlstone.plans.graphs import _PATHS, _paths
from marlstone.plans.registry import query, table

#: Each metric is a digit of a number made of the line's columns, null for one digit in ten.
_DIGITS = {c: (k + 2, k % 5 + 3) for k, c in enumerate(evaluation.PLAIN)}
_METRICS = ", ".join(f"CASE WHEN (l_partkey * {a} + l_orderkey) % 10 = {b} THEN NULL ELSE ((l_partkey * {a} + l_suppkey) % 5) / 4.0::DOUBLE END AS {c}" for c, (a, b) in _DIGITS.items())
_LINES = f"(SELECT l_returnflag AS dataset, l_linestatus AS mode, (l_suppkey % 3 > 0)::INT AS exact_match, l_quantity / 10.0::DOUBLE AS latency, l_partkey % 4 = 0 AS cache_hit, l_linenumber % 2 = 0 AS consistent, {_METRICS} FROM lineitem)"


@query("mode_summary", f"""WITH c AS (SELECT 'all' AS subset, * FROM {_LINES} UNION ALL SELECT 'graph_consistent', * FROM {_LINES} WHERE consistent)
SELECT subset, dataset, mode, count(*) AS n, round(avg(exact_match), 6) AS accuracy, round(coalesce(stddev_pop(exact_match), 0), 6) AS accuracy_sd, {', '.join(f'round(avg({c}), 6) AS {c}' for c in evaluation.PLAIN)},
round(avg(exact_match) FILTER (coverage > 0), 6) AS selective_accuracy, round(avg(latency) FILTER (NOT cache_hit), 6) AS mean_latency_seconds FROM c GROUP BY ALL""")
def mode_summary(spark, sf_dir):
    """23 figures of each return flag and line status, over all lines and over every other."""
    col = F.col
    metric = lambda a, b: F.when((col("l_partkey") * a + col("l_orderkey")) % 10 != b, ((col("l_partkey") * a + col("l_suppkey")) % 5) / 4.0)
    plain = [metric(a, b).alias(c) for c, (a, b) in _DIGITS.items()]
    cases = table(spark, sf_dir, "lineitem").select(col("l_returnflag").alias("dataset"), col("l_linestatus").alias("mode"), (col("l_suppkey") % 3 > 0).cast("int").alias("exact_match"), (col("l_quantity") / 10.0).alias("latency_seconds"), (col("l_partkey") % 4 == 0).alias("cache_hit"), (col("l_linenumber") % 2 == 0).alias("graph_consistent"), *plain)
    return evaluation.mode_summary(cases)


_JUDGED = """(SELECT o_orderpriority AS mode, o_orderkey % 5 > 0 AS included, o_totalprice > 150000 AS passed, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice > 200000 END AS primary_passed, CASE o_orderkey % 10 WHEN 0 THEN 'insufficient_evidence_abstention' WHEN 5 THEN 'evaluation_failure' END AS reason,
o_orderstatus = 'P' AS abstained, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE o_orderstatus END AS label, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_custkey % 4 - 1 END AS possible FROM orders)"""


@query("judgment_summary", f"""WITH j AS (SELECT *, NOT abstained AND label <> '' AS answered, CASE WHEN possible > 0 THEN possible ELSE (label <> '')::INT END AS size FROM {_JUDGED})
SELECT mode, count(*) AS n, count(*) FILTER (included) AS evaluated_n, count(*) FILTER (NOT included) AS excluded_count, count(*) FILTER (reason = 'insufficient_evidence_abstention') AS excluded_insufficient_evidence_abstention_count, count(*) FILTER (reason = 'evaluation_failure') AS evaluation_failure_count,
round(avg(included::INT), 6) AS accuracy_denominator_coverage, count(*) FILTER (answered) AS diagnostic_answer_count, round(avg(answered::INT), 6) AS diagnostic_coverage, count(*) FILTER (included AND passed) AS family_pass_count, round(avg(passed::INT) FILTER (included), 6) AS family_accuracy,
count(*) FILTER (included AND coalesce(primary_passed, passed)) AS primary_family_pass_count, round(avg(coalesce(primary_passed, passed)::INT) FILTER (included), 6) AS primary_family_accuracy, count(*) FILTER (answered) AS primary_answer_count, count(*) FILTER (size = 1) AS single_answer_count, count(*) FILTER (possible > 1) AS tie_count, round(avg(size), 6) AS average_prediction_set_size,
array_to_string(list_filter([CASE WHEN count(*) FILTER (NOT included) > 0 THEN 'excluded=' || count(*) FILTER (NOT included) END, CASE WHEN count(*) FILTER (included AND NOT passed) > 0 THEN 'fail=' || count(*) FILTER (included AND NOT passed) END, CASE WHEN count(*) FILTER (included AND passed) > 0 THEN 'pass=' || count(*) FILTER (included AND passed) END], lambda x: x IS NOT NULL), ',') AS decisions FROM j GROUP BY mode""")
def judgment_summary(spark, sf_dir):
    """17 figures of each order priority; orders as judged answers."""
    c = F.col
    reason = F.when(c("o_orderkey") % 10 == 0, "insufficient_evidence_abstention").when(c("o_orderkey") % 10 == 5, "evaluation_failure")
    several = F.when(c("o_custkey") % 4 == 0, 0).otherwise(c("o_custkey") % 4 - 1).cast("int")
    judged = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("mode"), (c("o_orderkey") % 5 > 0).alias("included"), (c("o_totalprice") > 150000).alias("passed"), F.when(c("o_custkey") % 3 == 0, c("o_totalprice") > 200000).alias("primary_passed"), reason.alias("exclusion_reason"), (c("o_orderstatus") == "P").alias("abstained"), F.when(c("o_custkey") % 7 == 0, "").otherwise(c("o_orderstatus")).alias("predicted_label"), F.array_repeat("o_orderstatus", several).alias("possible"))
    told = evaluation.judgment_summary(judged)
    return told.withColumn("decisions", F.array_join(F.transform(F.map_entries("decision_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")).drop("decision_counts")


_BUCKETS = """(SELECT o_orderkey, o_orderstatus <> 'F' AS abstained, CASE WHEN o_custkey % 11 = 0 THEN 'late' ELSE '' END AS error, CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'other_kind' ELSE 'insufficient_evidence' END AS category, CASE WHEN o_orderkey % 6 = 0 THEN 'switch' WHEN o_orderkey % 13 = 0 THEN '' ELSE 'abstain' END AS action,
CASE o_orderkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'insufficient' ELSE 'none_of_supplied_candidates' END AS decision, CASE WHEN o_custkey % 2 = 0 THEN 'D1' ELSE '' END AS candidate, o_totalprice > 100000 AS pairs, o_totalprice > 250000 AS bad, o_custkey % 3 > 0 AS anchored, o_orderkey % 5 > 1 AS attack, o_totalprice > 180000 AS valid, o_orderkey % 7 > 2 AS safe FROM orders)"""


@query("failure_profile", f"""WITH b AS (SELECT CASE WHEN NOT abstained THEN 'resolved' WHEN error <> '' THEN 'execution_failure' WHEN category = '' THEN 'other_abstention' WHEN category <> 'insufficient_evidence' THEN category WHEN action = '' THEN 'non_abstain' WHEN action <> 'abstain' THEN action WHEN decision = 'supported' THEN 'other_abstention_reason'
WHEN candidate = '' AND bad THEN 'protected_graph_missing_bad_graph_citations' WHEN candidate = '' AND anchored AND NOT pairs THEN 'protected_graph_missing_graph_candidate_inactive' WHEN candidate = '' AND NOT anchored THEN 'direct_declined_no_graph_anchor' WHEN candidate = '' THEN 'direct_declined_no_supported_family'
WHEN NOT pairs THEN 'direct_declined_no_decisive_pairs' WHEN attack AND NOT valid THEN 'attack_validation_failed' WHEN attack AND NOT safe THEN 'no_protected_incumbent_after_attack' ELSE 'direct_declined_no_protected' END AS bucket FROM {_BUCKETS})
SELECT bucket, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bucket""")
def failure_profile(spark, sf_dir):
    """Every order in the bucket of the first rule that explains why it was not answered."""
    from pyspark.sql import Window

    c = F.col
    o = table(spark, sf_dir, "orders")
    k, u, price = c("o_orderkey"), c("o_custkey"), c("o_totalprice")
    states = o.select(
        (c("o_orderstatus") != "F").alias("abstained"), F.when(u % 11 == 0, "late").alias("error"), F.when(u % 5 == 0, "").when(u % 5 == 1, "other_kind").otherwise("insufficient_evidence").alias("abstention_category"),
        F.when(k % 6 == 0, "switch").when(k % 13 != 0, "abstain").alias("resolver_action"), F.when(k % 4 == 0, "supported").when(k % 4 == 1, "insufficient").otherwise("none_of_supplied_candidates").alias("direct_decision"),
        F.when(u % 2 == 0, "D1").alias("candidate_id"), (price > 100000).cast("int").alias("decisive_pairs"), F.when(price > 250000, 2).alias("bad_citations"), F.when(u % 3 > 0, "anchor").alias("graph_label"),
        (u % 3 > 0).cast("int").alias("graph_candidates"), (price > 100000).cast("int").alias("active_graph_candidates"), (k % 5 > 1).alias("attack"), F.lit("contradiction").alias("attack_type"), (price > 180000).alias("attack_valid"), (k % 7 > 2).alias("protected"),
    )
    n = states.groupBy(evaluation.failure_bucket(states).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("bucket", "n", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("retrieval_audit", """WITH c AS (SELECT l_quantity > 8 AS family, l_extendedprice > 5000 AS candidate, l_discount < 0.09 AS graph, l_linenumber AS routes, l_quantity::INT AS facts, l_tax >= 0 AS whole, l_suppkey >= 0 AS free, FALSE AS failed FROM lineitem),
r AS (SELECT count(*) AS case_count, count(*) FILTER (failed) AS error_count, count(*) FILTER (family) AS family_count, count(*) FILTER (candidate) AS candidate_count, count(*) FILTER (graph) AS graph_count, round(avg(routes), 6) AS routes_mean, min(routes) AS routes_least, max(routes) AS routes_most, round(avg(facts), 6) AS facts_mean, min(facts) AS facts_least, max(facts) AS facts_most, bool_and(whole) AS complete_provenance, bool_and(free) AS zero_label_leakage FROM c)
SELECT *, round(family_count::DOUBLE / case_count, 6) AS family_rate, round(candidate_count::DOUBLE / case_count, 6) AS candidate_rate, round(graph_count::DOUBLE / case_count, 6) AS graph_rate, case_count = 60000 AS exact_frozen_case_set, error_count = 0 AS zero_errors, round(family_count::DOUBLE / case_count, 6) >= 0.75 AS family_recall, round(graph_count::DOUBLE / case_count, 6) >= 0.8 AS graph_family_recall,
case_count = 60000 AND error_count = 0 AND round(graph_count::DOUBLE / case_count, 6) >= 0.8 AND complete_provenance AND zero_label_leakage AS development_authorized FROM r""")
def retrieval_audit(spark, sf_dir):
    """Lines as retrieved cases: three recalls, two spreads and the gates in one row."""
    c = F.col
    cases = table(spark, sf_dir, "lineitem").select((c("l_quantity") > 8).alias("family"), (c("l_extendedprice") > 5000).alias("candidate"), (c("l_discount") < 0.09).alias("graph"), c("l_linenumber").alias("routes"), c("l_quantity").cast("int").alias("facts"), (c("l_tax") >= 0).alias("whole"), (c("l_suppkey") >= 0).alias("free"), F.lit(False).alias("failed"))
    return evaluation.retrieval_audit(cases, ["family", "candidate", "graph"], ["routes", "facts"], 60_000, "family", "graph", "whole", "free", "failed")


@query("same_family", f"""WITH p AS (SELECT path[1] AS category, path[2:3] AS path FROM {_PATHS}), s AS (SELECT c_custkey, s_name, n_name, r_name, (c_custkey * 7) % (SELECT count(*) FROM supplier) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_suppkey = (c_custkey * 7) % (SELECT count(*) FROM supplier))
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN EXISTS (SELECT 1 FROM p WHERE p.path[2] = s_name AND p.category = s.r_name) ELSE EXISTS (SELECT 1 FROM p WHERE p.path[2] = s_name AND p.path[1] = s.n_name) END AS same_family FROM s""")
def same_family(spark, sf_dir):
    """A supplier and a customer's nation, or for every third its region: of one family if the supplier lies in it."""
    paths = _paths(spark, sf_dir).select(F.col("r_name").alias("category"), F.array("n_name", "s_name").alias("path"))
    n = table(spark, sf_dir, "supplier").count()
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7) % n).alias("s_suppkey"))
    pairs = cust.join(place, F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    pairs = pairs.select("c_custkey", F.col("s_name").alias("reference"), F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("evaluated"))
    return evaluation.same_family(pairs, paths, ["c_custkey"])
