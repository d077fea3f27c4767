"""Queries on findings, criteria and answers: atoms, binding, activation, namespaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import binding as B
from marlstone.functions import typed
from marlstone.operators import answers
from marlstone.plans.registry import query, table

_KINDS = "(SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Risk Factors' WHEN 'MEDIUM' THEN 'Diagnostic Criteria' WHEN 'LARGE' THEN 'Symptoms' WHEN 'PROMO' THEN 'Exclusion: contraindication' ELSE p_type END AS kind, p_name FROM part)"


@query("knowledge_roles", f"""SELECT p_partkey, kind, CASE WHEN regexp_matches(lower(kind), 'exclude|contra|negative') THEN 'counterevidence' WHEN regexp_matches(lower(kind), 'criterion|criteria|test|result') THEN 'diagnostic_criterion'
WHEN regexp_matches(lower(kind), 'symptom|sign|feature|presentation') THEN 'clinical_feature' WHEN contains(lower(kind), 'risk') THEN 'risk_factor' ELSE 'guideline' END AS role FROM {_KINDS}""")
def knowledge_roles(spark, sf_dir):
    kind = F.col("p_type")
    for name, value in (("SMALL", "Risk Factors"), ("MEDIUM", "Diagnostic Criteria"), ("LARGE", "Symptoms"), ("PROMO", "Exclusion: contraindication")):
        kind = F.when(F.col("p_type") == name, value).otherwise(kind)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind")).withColumn("role", B.role(F.col("kind")))


_FINDINGS = """(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'No evidence of elevated pressure' WHEN 1 THEN 'History of pressure ' || (o_orderkey % 200) || ' mmHg' WHEN 2 THEN 'Currently pressure is ' || (o_orderkey % 200) || ' mmHg'
WHEN 3 THEN 'CT scan showed pressure ' || (o_orderkey % 150) WHEN 4 THEN 'CT scan ordered; possible pressure above ' || (o_orderkey % 90) || ' mmHg' ELSE 'Pressure at least ' || (o_orderkey % 120) || '.5 mmHg now' END AS finding FROM orders)"""


def _findings(spark, sf_dir):
    k = F.col("o_orderkey")
    num = lambda m: (k % m).cast("string")
    texts = [
        F.lit("No evidence of elevated pressure"),
        F.concat(F.lit("History of pressure "), num(200), F.lit(" mmHg")),
        F.concat(F.lit("Currently pressure is "), num(200), F.lit(" mmHg")),
        F.concat(F.lit("CT scan showed pressure "), num(150)),
        F.concat(F.lit("CT scan ordered; possible pressure above "), num(90), F.lit(" mmHg")),
    ]
    finding = F.concat(F.lit("Pressure at least "), num(120), F.lit(".5 mmHg now"))
    for i, t in enumerate(texts):
        finding = F.when(k % 6 == i, t).otherwise(finding)
    return table(spark, sf_dir, "orders").select("o_orderkey", finding.alias("finding"))


@query("evidence_namespaces", """SELECT o_orderkey, CASE WHEN starts_with(id, 'S-') THEN 'patient' WHEN starts_with(id, 'K') THEN 'knowledge' WHEN starts_with(id, 'P-') THEN 'pair' ELSE 'other' END AS namespace FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'S-' WHEN 1 THEN 'KFA-' WHEN 2 THEN 'K' WHEN 3 THEN 'P-D' ELSE 'X' END || o_orderkey AS id FROM orders)""")
def evidence_namespaces(spark, sf_dir):
    """Identifiers by prefix, in an order in which the shorter knowledge prefix wins."""
    k = F.col("o_orderkey")
    ident = F.concat(F.when(k % 5 == 0, "S-").when(k % 5 == 1, "KFA-").when(k % 5 == 2, "K").when(k % 5 == 3, "P-D").otherwise("X"), k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ident.alias("id")).select("o_orderkey", typed.namespace(F.col("id")).alias("namespace"))


@query("activation_refill", """WITH w AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 3 = 0 AS named FROM orders),
c AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey), o_orderstatus) AS n FROM w WHERE named GROUP BY 1, 2),
r AS (SELECT o_custkey, o_orderstatus, o_orderkey, named, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY NOT named, CASE WHEN named THEN o_orderkey END, o_totalprice DESC, o_orderkey) AS place FROM w JOIN (SELECT o_custkey, o_orderstatus FROM c WHERE n <= 2) USING (o_custkey, o_orderstatus))
SELECT o_custkey, o_orderstatus, o_orderkey, place, NOT named AS refill FROM r WHERE place <= 2""")
def activation_refill(spark, sf_dir):
    """A customer's first two order states that were named, each with two orders: those named, then its dearest others."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("candidate_id"), F.col("o_orderkey").alias("pair_id"), F.col("o_totalprice").alias("score"))
    named = o.filter("pair_id % 3 = 0").select("case_id", "candidate_id", "pair_id", F.col("pair_id").alias("rank"), F.col("pair_id").alias("position"))
    got = answers.activations(named, o, 2, 2)
    return got.select(F.col("case_id").alias("o_custkey"), F.col("candidate_id").alias("o_orderstatus"), F.col("pair_id").alias("o_orderkey"), "place", "refill")


@query("anchor_score", """WITH b AS (SELECT l_suppkey, l_orderkey, arg_max({'p': l_extendedprice, 'q': l_quantity}, ({'p': l_extendedprice, 'n': -l_linenumber})) AS best FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(max(best.q) * 100 + sum((best.q > 25)::INT) * 10 + count(*), 4) AS anchor FROM b GROUP BY l_suppkey""")
def anchor_score(spark, sf_dir):
    """The best record per (candidate, patient), then strongest * 100 + independent * 10 + count."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max_by("l_quantity", F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("n"))).alias("q"))
    return best.groupBy("l_suppkey").agg(F.round(F.max("q") * 100 + F.sum((F.col("q") > 25).cast("int")) * 10 + F.count(F.lit(1)), 4).alias("anchor"))


@query("citation_validity", """SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: upper(x) IN ('THE', 'THAT', 'AND', 'DES', 'UND'))) AS valid, len(regexp_extract_all(text, '[A-Za-z]{3,}')) AS cited,
round(coalesce(len(list_filter(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: upper(x) IN ('THE', 'THAT', 'AND', 'DES', 'UND')))::DOUBLE / nullif(len(regexp_extract_all(text, '[A-Za-z]{3,}')), 0), 0), 6) AS validity FROM conversations""")
def citation_validity(spark, sf_dir):
    """Share of cited identifiers, whatever their case, that are known; 0 without any."""
    cited = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    valid = F.filter(cited, lambda x: F.upper(x).isin("THE", "THAT", "AND", "DES", "UND"))
    rate = F.coalesce(F.try_divide(F.size(valid).cast("double"), F.size(cited).cast("double")), F.lit(0.0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(valid).cast("long").alias("valid"), F.size(cited).cast("long").alias("cited"), F.round(rate, 6).alias("validity"))


@query("resume_pending", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) FILTER (role IN ('user', 'assistant')) = 2 AND count(*) >= 4)")
def resume_pending(spark, sf_dir):
    """Cases that are not complete in every output and would run again."""
    c = table(spark, sf_dir, "conversations")
    done = c.groupBy("conv_id").agg(F.countDistinct(F.when(F.col("role").isin("user", "assistant"), F.col("role"))).alias("sides"), F.count(F.lit(1)).alias("turns")).filter("sides = 2 AND turns >= 4")
    return c.select("conv_id").distinct().join(done, "conv_id", "left_anti")


@query("chunk_plan", "SELECT doc_id, k AS chunk, k * 510 AS start_word, least((k + 1) * 510, n) AS end_word FROM (SELECT doc_id, n, unnest(range(0, ((n + 509) // 510)))::INT AS k FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::INT AS n FROM documents))")
def chunk_plan(spark, sf_dir):
    """Contiguous ranges of at most 510 words that lose nothing: the plan for a 512-token encoder."""
    n = F.size(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    ranges = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 510).cast("int"))).otherwise(F.array().cast("array<int>"))
    plan = table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(ranges).alias("chunk"))
    return plan.select("doc_id", "chunk", (F.col("chunk") * 510).alias("start_word"), F.least((F.col("chunk") + 1) * 510, F.col("n")).alias("end_word"))


@query("label_frequency", "SELECT source, lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY source, lang")
def label_frequency(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source")
    return n.select("source", "lang", "n", F.round(F.col("n") / F.sum("n").over(by), 6).alias("share"), F.row_number().over(by.orderBy(F.col("n").desc(), "lang")).alias("place"))
