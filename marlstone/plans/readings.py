"""Queries on readings of prose and on decisions over cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import binding, clinical
from marlstone.functions import text as T
from marlstone.operators import answers, cases
from marlstone.plans.graphs import _PATHS, _paths
from marlstone.plans.records import _FINDINGS, _findings
from marlstone.plans.registry import query, table
from marlstone.plans.texts import _LABELS, _case, _labels

_TESTS = """(SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'CT angiography of the ' WHEN 1 THEN 'MRI and biopsy of the ' WHEN 2 THEN 'normal ECG without the ' WHEN 3 THEN 'Echo with or without ' WHEN 4 THEN 'V/Q lung scan for '
 WHEN 5 THEN 'culture or PCR, together with ' WHEN 6 THEN 'level > 40 mg/dl in ' ELSE 'plain ' END || p_name AS claim, CASE p_type WHEN 'SMALL' THEN 'risk_factor' WHEN 'LARGE' THEN 'guideline' WHEN 'PROMO' THEN 'clinical_feature' ELSE 'diagnostic_criterion' END AS role FROM part)"""


def _claims(spark, sf_dir):
    starts = ["CT angiography of the ", "MRI and biopsy of the ", "normal ECG without the ", "Echo with or without ", "V/Q lung scan for ", "culture or PCR, together with ", "level > 40 mg/dl in ", "plain "]
    start = F.get(F.array(*map(F.lit, starts)), (F.col("p_size") % 8).cast("int"))
    role = F.when(F.col("p_type") == "SMALL", "risk_factor").when(F.col("p_type") == "LARGE", "guideline").when(F.col("p_type") == "PROMO", "clinical_feature").otherwise("diagnostic_criterion")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(start, "p_name").alias("claim"), role.alias("role"))


def _first(patterns, column):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for n, p in patterns) + " END"


_ANCHORS = " || ".join(f"CASE WHEN regexp_matches(claim, '(?i){p}') THEN ',{n}' ELSE '' END" for n, p in clinical.ANCHOR_MODALITIES)
_EXCLUDES = f"(regexp_matches(claim, '{clinical.EXCLUDING}') AND NOT regexp_matches(claim, '{clinical.NOT_EXCLUDING}'))"


@query("modality_tags", f"SELECT p_partkey, coalesce({_first(clinical.MODALITIES, 'claim')}, '') AS modality, ltrim({_ANCHORS}, ',') AS anchors FROM {_TESTS}")
def modality_tags(spark, sf_dir):
    c = F.col("claim")
    return _claims(spark, sf_dir).select("p_partkey", F.coalesce(clinical.modality(c), F.lit("")).alias("modality"), F.array_join(clinical.anchor_modalities(c), ",").alias("anchors"))


@query("propositions", f"""SELECT p_partkey, CASE WHEN role = 'risk_factor' THEN 'risk_context' WHEN role = 'guideline' THEN 'guideline' WHEN regexp_matches(claim, '{clinical.MEASUREMENT}') THEN 'measurement' WHEN regexp_matches(claim, '{clinical.TEST}') THEN 'diagnostic_test' ELSE 'clinical_finding' END AS kind,
CASE WHEN {_EXCLUDES} THEN 'contradiction_or_exclusion' WHEN role = 'risk_factor' THEN 'weak_support' WHEN role = 'guideline' THEN 'authority' ELSE 'direct_support' END AS relation, regexp_matches(claim, '{clinical.CONJUNCTION}') AS conjunctive,
role = 'diagnostic_criterion' AND NOT {_EXCLUDES} AND (length({_ANCHORS}) > 0 OR regexp_matches(claim, '{clinical.MEASUREMENT}')) AS anchor FROM {_TESTS}""")
def propositions(spark, sf_dir):
    c, r = F.col("claim"), F.col("role")
    return _claims(spark, sf_dir).select("p_partkey", clinical.proposition_kind(c, r).alias("kind"), clinical.relation(c, r).alias("relation"), clinical.conjunctive(c).alias("conjunctive"), clinical.decisive_anchor(c, r).alias("anchor"))


@query("normalized_answers", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Asthma' WHEN 1 THEN c_mktsegment WHEN 2 THEN c_mktsegment WHEN 3 THEN lower(c_mktsegment) || ' fever' WHEN 4 THEN 'COPD' ELSE c_mktsegment END AS answer FROM customer""")
def normalized_answers(spark, sf_dir):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    raw = F.when(k % 6 == 0, F.lit(" (a) ")).when(k % 6 == 1, F.concat(F.lit("Diagnosis:  "), seg, F.lit("."))).when(k % 6 == 2, F.concat(F.lit("The most likely diagnosis is "), seg, F.lit(" because of it"))).when(k % 6 == 3, F.concat(F.lower(seg), F.lit("  fever "))).when(k % 6 == 4, F.lit("copd.")).otherwise(F.concat(F.lit("The clinical presentation is most consistent with "), seg, F.lit(" given that")))
    options = F.create_map(F.lit("A"), F.lit("Asthma"), F.lit("B"), F.lit("COPD"))
    return table(spark, sf_dir, "customer").select("c_custkey", clinical.normalize_answer(raw, options).alias("answer"))


@query("path_compatibility", f"SELECT path_id, CASE path_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM {_PATHS}")
def path_compatibility(spark, sf_dir):
    """A label against a root-to-leaf path: its end, the step before, further up, or not on it."""
    label = F.when(F.col("path_id") % 4 == 0, F.lower("s_name")).when(F.col("path_id") % 4 == 1, F.concat(F.lit(" "), "n_name")).when(F.col("path_id") % 4 == 2, F.col("r_name")).otherwise("elsewhere")
    return _paths(spark, sf_dir).select("path_id", clinical.path_compatibility(label, F.col("path")).alias("score"))


_FAMILY = f"""k AS (SELECT p_partkey, label, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS raw FROM {_LABELS}),
l AS (SELECT *, coalesce({_case("raw", T.KEY_ALIASES)}, raw) AS lex FROM k)"""


@query("label_matches", f"""WITH {_FAMILY}, p AS (SELECT p_partkey, lex, lead(lex) OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS gold FROM l)
SELECT p_partkey, CASE WHEN lex = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact FROM p WHERE gold IS NOT NULL""")
def label_matches(spark, sf_dir):
    """Exact match of each label with the next of the same four."""
    from pyspark.sql import Window

    following = F.lead("label").over(Window.partitionBy(F.floor(F.col("p_partkey") / 4)).orderBy("p_partkey"))
    rows = _labels(spark, sf_dir).withColumn("gold", following).filter("gold IS NOT NULL")
    return rows.select("p_partkey", cases.exact_match(F.col("label"), F.col("gold")).alias("exact"))


@query("incumbents", """WITH p AS (SELECT o_custkey, o_orderpriority, max(floor(o_totalprice / 50000)) AS score FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL), t AS (SELECT *, max(score) OVER (PARTITION BY o_custkey) AS top FROM p)
SELECT o_custkey AS case_id, min(o_orderpriority) AS candidate_id FROM t WHERE score = top GROUP BY o_custkey HAVING count(*) = 1""")
def incumbents(spark, sf_dir):
    """The one best cited candidate of a case; a tie protects none."""
    pairs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("candidate_id")).agg(F.max(F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 50000))).alias("score"))
    return cases.incumbents(pairs.withColumn("cited", F.col("score").isNotNull()))


@query("cost_shares", "SELECT event_type, count(*) AS calls, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS cost FROM events GROUP BY event_type")
def cost_shares(spark, sf_dir):
    shares = cases.cost_shares(table(spark, sf_dir, "events").withColumn("one", F.lit(1)), ["event_type"], "one", 100.0)
    return shares.select("event_type", "calls", F.round("share", 6).alias("share"), F.round("cost", 4).alias("cost"))


@query("gate_rows", "SELECT 'docs' AS gate, count(*) >= 100 AS passed FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) = 20 FROM documents UNION ALL SELECT 'no null text', count(*) FILTER (text IS NULL) = 0 FROM documents UNION ALL SELECT 'long', min(n_chars) > 1000000 FROM documents")
def gate_rows(spark, sf_dir):
    row = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"), F.count_if(F.col("text").isNull()).alias("nulls"), F.min("n_chars").alias("least"))
    return cases.gates(row, {"docs": F.col("n") >= 100, "sources": F.col("s") == 20, "no null text": F.col("nulls") == 0, "long": F.col("least") > 1_000_000})


@query("grounded_arguments", """WITH a AS (SELECT user_id AS case_id, event_id AS position, event_type AS claim, list_sort(list_distinct([(props->>'$.k')::INT % 5, (props->>'$.k')::INT // 5 % 5])) AS ids FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY case_id, claim, ids ORDER BY position) AS n FROM a WHERE NOT list_has_any(ids, [4]))
SELECT case_id, position, claim FROM g WHERE n = 1""")
def grounded_arguments(spark, sf_dir):
    """Arguments whose evidence is all known, the first of each claim and evidence set."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("int")
    ids = F.array(F.concat(F.lit("k"), (k % 5).cast("string")), F.concat(F.lit(" K"), (F.floor(k / 5) % 5).cast("string")))
    args = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("position"), F.col("event_type").alias("claim"), ids.alias("evidence_ids"))
    valid = e.select(F.col("user_id").alias("case_id")).distinct().withColumn("evidence_id", F.explode(F.array(*[F.lit(f"K{i}") for i in range(4)])))
    return answers.grounded_arguments(args, valid).select("case_id", "position", "claim")


@query("completed_findings", f"SELECT o_orderkey, length(finding) AS n, o_orderkey % 6 IN (0, 3) AS completed FROM {_FINDINGS}")
def completed_findings(spark, sf_dir):
    """Findings that report a finished test, and the length of each as one exact finding."""
    f = F.col("finding")
    return _findings(spark, sf_dir).select("o_orderkey", F.length(F.get(clinical.exact_findings(f), F.lit(0))).cast("long").alias("n"), binding.completed_result(f).alias("completed"))


@query("json_objects")
def json_objects(spark, sf_dir):
    """The first JSON object in each answer."""
    said = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Answer: ```json\n"), "props", F.lit("\n```")).alias("answer"))
    return answers.first_objects(said, "answer").select("event_id", "object")
