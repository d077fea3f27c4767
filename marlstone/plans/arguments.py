"""Queries on argument graphs: orders as cases, their suppliers as candidates, lines as arguments and counterarguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import argument_graph as G
from marlstone.plans.registry import query, table

_BASE = """li AS (SELECT l_orderkey, l_linenumber, 'A' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS argument_id, 'C' || (l_suppkey % 5) AS candidate_id, ['S-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'K' || (l_partkey % 7)] AS evidence_ids, CASE WHEN l_discount > 0.02 THEN l_discount * 10 ELSE 0 END::DOUBLE AS compatibility,
  l_quantity > 5 AS typed_valid, l_tax > 0.01 AS scheme_valid, l_returnflag, l_linestatus, l_partkey, l_suppkey, l_quantity FROM lineitem),
args AS (SELECT * FROM li WHERE l_returnflag <> 'R'), cands AS (SELECT DISTINCT l_orderkey, candidate_id FROM li),
rev AS (SELECT l_orderkey, argument_id, CASE WHEN l_linestatus = 'F' THEN 'supported' WHEN l_quantity > 40 THEN 'contradicted' ELSE 'insufficient' END AS verdict, l_quantity <= 35 AS cites_all, l_partkey % 11 = 0 AS failing FROM args WHERE l_suppkey % 6 > 0),
a AS (SELECT args.*, verdict, verdict IS NOT NULL AS seen, coalesce(failing, false) AS failing, coalesce(verdict = 'supported' AND cites_all AND NOT failing AND typed_valid, false) AS grounded FROM args LEFT JOIN rev USING (l_orderkey, argument_id)),
w AS (SELECT *, compatibility <= 0 OR NOT seen OR (verdict = 'supported' AND NOT grounded) OR verdict <> 'supported' OR failing AS challenged FROM a),
ct AS (SELECT l_orderkey, l_linenumber, 'X' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS counter_id, candidate_id AS target_id, candidate_id, CASE l_linenumber % 3 WHEN 0 THEN 'alternative_explanation' WHEN 1 THEN 'negative_evidence' ELSE 'exception' END AS scheme, CASE WHEN l_quantity > 10 THEN 'rebuts' ELSE 'undercuts' END AS relation,
  'C' || (l_partkey % 5) AS conclusion, l_partkey % 7 AS k, l_quantity, l_suppkey FROM li WHERE l_returnflag = 'R'),
cv AS (SELECT *, k > 0 AS valid_id, CASE WHEN target_id = 'C' || (k % 5) THEN 1.0 WHEN target_id = 'C' || ((k + 1) % 5) THEN 0.75 ELSE 0.0 END::DOUBLE AS own, CASE WHEN conclusion = 'C' || (k % 5) THEN 1.0 WHEN conclusion = 'C' || ((k + 1) % 5) THEN 0.75 ELSE 0.0 END::DOUBLE AS other,
  ['counterevidence', 'clinical_feature', 'diagnostic_criterion', 'risk_factor', 'guideline', 'counterevidence', 'clinical_feature'][k + 1] AS role FROM ct),
cf AS (SELECT *, CASE WHEN NOT valid_id THEN 0 WHEN scheme = 'alternative_explanation' THEN CASE WHEN relation = 'rebuts' AND own = 0 AND role <> 'counterevidence' THEN other ELSE 0 END
  WHEN scheme = 'negative_evidence' THEN CASE WHEN role IN ('clinical_feature', 'diagnostic_criterion', 'counterevidence') AND l_suppkey % 2 = 0 THEN own ELSE 0 END ELSE CASE WHEN role <> 'counterevidence' THEN own ELSE 0 END END::DOUBLE AS compat FROM cv),
out AS (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'P')"""

_EDGES = f"""{_BASE}, e AS (SELECT l_orderkey, argument_id AS source, candidate_id AS target, 'supports' AS relation FROM w UNION ALL SELECT l_orderkey, 'Q-' || argument_id, argument_id, 'undercuts' FROM w WHERE challenged
UNION ALL SELECT l_orderkey, 'Q-' || candidate_id, candidate_id, 'undercuts' FROM cands WHERE NOT EXISTS (SELECT 1 FROM args WHERE args.l_orderkey = cands.l_orderkey AND args.candidate_id = cands.candidate_id)
UNION ALL SELECT l_orderkey, 'Q-ABSTAIN-' || candidate_id, candidate_id, 'undercuts' FROM cands JOIN out USING (l_orderkey)
UNION ALL SELECT l_orderkey, counter_id, target_id, relation FROM cf UNION ALL SELECT l_orderkey, 'Q-' || counter_id, counter_id, 'undercuts' FROM cf WHERE compat <= 0
UNION ALL SELECT x.l_orderkey, x.candidate_id, y.candidate_id, 'rebuts' FROM cands x JOIN cands y ON x.l_orderkey = y.l_orderkey AND x.candidate_id <> y.candidate_id)"""


def _claims(lines, orders, dealt=False):
    """Lines as claims, arguments, reviewed arguments, counterarguments and abstaining cases; ``dealt`` lines are dealt by order."""
    t = lambda c, m: (F.col(c) % m).cast("string")
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    li = lines.withColumn("candidate_id", F.concat(F.lit("C"), t("l_suppkey", 5)))
    ids = F.array(F.concat(F.lit("S-"), name), F.concat(F.lit("K"), t("l_partkey", 7)))
    compat = F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 10).otherwise(0).cast("double")
    rows = li.select("l_orderkey", "l_linenumber", "candidate_id", ids.alias("evidence_ids"), compat.alias("compatibility"), (F.col("l_quantity") > 5).alias("typed_valid"), (F.col("l_tax") > 0.01).alias("scheme_valid"), "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity")
    args = rows.filter("l_returnflag <> 'R'").withColumn("argument_id", F.concat(F.lit("A"), name))
    verdict = F.when(F.col("l_linestatus") == "F", "supported").when(F.col("l_quantity") > 40, "contradicted").otherwise("insufficient")
    failed = F.when(F.col("l_partkey") % 11 == 0, F.array(F.lit("temporality_compatible"))).otherwise(F.array().cast("array<string>"))
    cited = F.when(F.col("l_quantity") <= 35, F.col("evidence_ids")).otherwise(F.slice("evidence_ids", 1, 1))
    reviews = args.filter("l_suppkey % 6 > 0").select("l_orderkey", "argument_id", verdict.alias("verdict"), cited.alias("evidence_ids"), failed.alias("failed"), F.lit(1).alias("place"))
    needed = ("l_orderkey", "argument_id", "candidate_id", "evidence_ids", "compatibility", "typed_valid")
    judged = G.reviewed(args.select(*needed) if dealt else args.drop("l_linenumber"), reviews, "l_orderkey", dealt)
    n = F.col("l_linenumber") % 3
    scheme = F.when(n == 0, "alternative_explanation").when(n == 1, "negative_evidence").otherwise("exception")
    premise = F.when(F.col("l_suppkey") % 2 == 0, "shows no sign of it").otherwise("shows signs of it")
    counters = rows.filter("l_returnflag = 'R'").select("l_orderkey", F.concat(F.lit("X"), name).alias("counter_id"), F.col("candidate_id").alias("target_id"), scheme.alias("scheme"), F.when(F.col("l_quantity") > 10, "rebuts").otherwise("undercuts").alias("relation"), premise.alias("premise"), F.concat(F.lit("C"), t("l_partkey", 5)).alias("conclusion"), "evidence_ids")
    out = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows, args, judged, counters, out


def _case(spark, sf_dir):
    """Candidates, reviewed arguments, founded counterarguments and abstaining cases of all orders."""
    rows, args, judged, counters, out = _claims(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    candidates = rows.select("l_orderkey", "candidate_id", F.col("candidate_id").alias("diagnosis")).distinct()
    kinds = F.array(*map(F.lit, ("counterevidence", "clinical_feature", "diagnostic_criterion", "risk_factor", "guideline", "counterevidence", "clinical_feature")))
    used = rows.select("l_orderkey", F.explode("evidence_ids").alias("evidence_id")).distinct().filter("evidence_id <> 'K0'")
    k = F.when(F.startswith("evidence_id", F.lit("K")), F.substring("evidence_id", 2, 9).cast("int"))
    path = F.when(k.isNotNull(), F.array(F.concat(F.lit("C"), ((k + 1) % 5).cast("string")), F.concat(F.lit("C"), (k % 5).cast("string"))))
    evidence = used.select("l_orderkey", "evidence_id", F.get(kinds, k).alias("role"), path.alias("path"), F.when(k.isNull(), "seen").alias("text"))
    targets = candidates.select("l_orderkey", F.col("candidate_id").alias("target_id"), "candidate_id", "diagnosis")
    return candidates, judged, G.founded(counters, targets, evidence, "l_orderkey"), out, args


def _graph(spark, sf_dir):
    *parts, args = _case(spark, sf_dir)
    return G.build(*parts, "l_orderkey", args.select("l_orderkey", "candidate_id"))


@query("argument_relations", f"WITH {_EDGES} SELECT * FROM e")
def argument_relations(spark, sf_dir):
    """Supports, undercuts and rebuts of every order's graph."""
    return _graph(spark, sf_dir)[1]


@query("argument_nodes", f"""WITH {_BASE} SELECT l_orderkey, argument_id AS node_id, 'support' AS node_type, candidate_id, round(compatibility, 6) AS compatibility FROM w UNION ALL SELECT l_orderkey, 'Q-' || argument_id, 'challenge', candidate_id, 0 FROM w WHERE challenged
UNION ALL SELECT l_orderkey, candidate_id, 'diagnosis', candidate_id, 0 FROM cands UNION ALL SELECT l_orderkey, 'Q-ABSTAIN-' || candidate_id, 'challenge', candidate_id, 0 FROM cands JOIN out USING (l_orderkey)
UNION ALL SELECT l_orderkey, 'Q-' || candidate_id, 'challenge', candidate_id, 0 FROM cands WHERE NOT EXISTS (SELECT 1 FROM args WHERE args.l_orderkey = cands.l_orderkey AND args.candidate_id = cands.candidate_id)
UNION ALL SELECT l_orderkey, counter_id, 'counterargument', candidate_id, compat FROM cf UNION ALL SELECT l_orderkey, 'Q-' || counter_id, 'challenge', candidate_id, 0 FROM cf WHERE compat <= 0""")
def argument_nodes(spark, sf_dir):
    """Nodes of every order's graph by kind, with how well their evidence fits."""
    nodes = _graph(spark, sf_dir)[0]
    return nodes.select("l_orderkey", "node_id", "node_type", "candidate_id", F.round("compatibility", 6).alias("compatibility"))


@query("argument_standing", f"""WITH {_EDGES}, u AS (SELECT DISTINCT l_orderkey, target FROM e WHERE relation = 'undercuts')
SELECT l_orderkey, e.target AS candidate_id, count(*) AS supports, count(*) FILTER (a.target IS NULL) AS standing, any_value(c.target) IS NOT NULL AS undercut FROM e LEFT JOIN u a ON a.l_orderkey = e.l_orderkey AND a.target = e.source LEFT JOIN u c ON c.l_orderkey = e.l_orderkey AND c.target = e.target WHERE relation = 'supports' GROUP BY e.l_orderkey, e.target""".replace("SELECT l_orderkey, e.target", "SELECT e.l_orderkey, e.target"))
def argument_standing(spark, sf_dir):
    """Supports of each candidate that nothing undercuts."""
    # dealt by order as numbers, before the ids are made of them
    _, _, judged, counters, out = _claims(table(spark, sf_dir, "lineitem").repartition("l_orderkey"), table(spark, sf_dir, "orders"), dealt=True)
    return G.standing(G.deciding_edges(judged, counters, out, "l_orderkey"), "l_orderkey")


@query("graph_quality", f"""WITH {_BASE}, p AS (SELECT l_orderkey, count(*) AS raw, count(*) FILTER (l_returnflag = 'R') AS invalid FROM li GROUP BY 1),
g AS (SELECT l_orderkey, count(*)::DOUBLE AS n, count(*) FILTER (compatibility > 0) AS bound, count(verdict) AS seen, sum(compatibility) AS total, count(*) FILTER (scheme_valid) AS schemes, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (grounded) AS grounded, count(*) FILTER (typed_valid) AS typed, 2 * count(*) AS refs, count(*) + count(*) FILTER (evidence_ids[2] <> 'K0') AS good FROM a GROUP BY 1),
k AS (SELECT l_orderkey, count(*)::DOUBLE AS counters, count(*) FILTER (compat > 0) AS founded FROM cf GROUP BY 1)
SELECT l_orderkey, round(coalesce((raw - invalid)::DOUBLE / nullif(raw, 0), 1), 6) AS argument_schema_validity, round(coalesce(bound / n, 0), 6) AS argument_evidence_validity, round(coalesce(seen / n, 0), 6) AS verifier_review_coverage, round(coalesce(good::DOUBLE / refs, 0), 6) AS valid_evidence_reference_fraction,
round(coalesce(total / n, 0), 6) AS argument_evidence_compatibility, round(coalesce(schemes / n, 0), 6) AS argument_scheme_validity, round(coalesce(grounded::DOUBLE / nullif(supported, 0), 1), 6) AS supported_review_grounding, round(coalesce(founded / counters, 1), 6) AS counterargument_evidence_validity, round(coalesce(typed / n, 1), 6) AS typed_binding_validity
FROM p LEFT JOIN g USING (l_orderkey) LEFT JOIN k USING (l_orderkey)""")
def graph_quality(spark, sf_dir):
    """Nine ratios of every order's graph; returned lines count as invalid proposals."""
    _, judged, counters, _, args = _case(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem")
    proposals = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("l_returnflag") == "R").alias("invalid"))
    references = args.select("l_orderkey", F.explode("evidence_ids").alias("i")).select("l_orderkey", (F.col("i") != "K0").alias("is_valid"))
    return G.quality(judged, references, counters, proposals, "l_orderkey")
