"""Queries on evidence bundles, question sets and packages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import bundles
from marlstone.plans.registry import query, table

_TERMS = ", ".join(f"('{k}', '{v}')" for k, v in bundles.QUERY_TERMS.items())
_SECTIONS = list(bundles.SECTION_IDS)


@query("query_terms", f"""WITH terms(k, term) AS (VALUES {_TERMS}),
l AS (SELECT c_custkey, trim(regexp_replace(CASE c_custkey % 6 WHEN 0 THEN 'Suspected ' || c_mktsegment WHEN 1 THEN 'strongly  suspected Massive PE' WHEN 2 THEN 'Suspected Epilepsy' WHEN 3 THEN 'HFrEF' WHEN 4 THEN 'suspected thyroid nodules' ELSE c_name END, '\\s+', ' ', 'g')) AS flat FROM customer),
s AS (SELECT *, regexp_replace(flat, '^(strongly suspected|suspected) ', '', 'i') AS sure FROM l)
SELECT c_custkey, coalesce(a.term, b.term, sure) AS term FROM s LEFT JOIN terms a ON a.k = regexp_replace(lower(flat), '[^a-z0-9]+', '', 'g') LEFT JOIN terms b ON b.k = regexp_replace(lower(sure), '[^a-z0-9]+', '', 'g')""")
def query_terms(spark, sf_dir):
    """Terms to look up for labels of each kind: suspected, renamed by key, and plain."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey") % 6
    label = F.when(n == 0, F.concat(F.lit("Suspected "), "c_mktsegment")).when(n == 1, "strongly  suspected Massive PE").when(n == 2, "Suspected Epilepsy").when(n == 3, "HFrEF").when(n == 4, "suspected thyroid nodules").otherwise(F.col("c_name"))
    return c.select("c_custkey", bundles.query_term(label).alias("term"))


@query("corpus_order", "SELECT n_regionkey AS graph_id, n_name AS node_id, n_nationkey FROM nation ORDER BY 1, 2")
def corpus_order(spark, sf_dir):
    return bundles.corpus_order(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_name").alias("node_id"), "n_nationkey"))


@query("bundle_text", """WITH f AS (SELECT o_orderkey, l_linenumber, 'K' || l_linenumber AS k, strftime(l_shipdate, '%Y-%m') AS d, l_returnflag AS t, l_linestatus AS x FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.05),
w AS (SELECT *, k || ' --supports--> ' || d || ' | type=' || t || ' | premise=' || x || chr(10) || 'PATH ' || k || ': ' || d || ' -> ' || t AS g, k || ' | diagnosis=' || d || ' | premise_type=' || t || ' | premise=' || x AS l FROM f)
SELECT o_orderkey, coalesce(string_agg(g, chr(10) ORDER BY l_linenumber, g), 'nothing retrieved') AS graph, coalesce(string_agg(l, chr(10) ORDER BY l_linenumber, l), 'nothing retrieved') AS flat FROM w GROUP BY o_orderkey""")
def bundle_text(spark, sf_dir):
    """Discounted lines of each order as facts, rendered as a graph and flat."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    facts = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").withColumnRenamed("l_orderkey", "o_orderkey")
    month = F.date_format("l_shipdate", "yyyy-MM")
    parts = (F.concat(F.lit("K"), "l_linenumber"), month, F.col("l_returnflag"), F.col("l_linestatus"))
    as_graph = bundles.render(orders, facts, "o_orderkey", "l_linenumber", bundles.graph_lines(*parts, F.array(month, "l_returnflag")), "nothing retrieved")
    as_flat = bundles.render(orders, facts, "o_orderkey", "l_linenumber", bundles.flat_line(*parts), "nothing retrieved")
    return as_graph.withColumnRenamed("bundle", "graph").join(as_flat.withColumnRenamed("bundle", "flat"), "o_orderkey")


@query("fixed_bundle", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
o AS (SELECT l_orderkey, 1 AS stage, n AS a, 0 AS b, 0 AS c, n AS rank, l_partkey % 50 AS s FROM l
UNION ALL SELECT l_orderkey, 3, n, 2, 0, n, l_suppkey % 50 FROM l
UNION ALL SELECT l_orderkey, 2, 1, l_quantity::BIGINT, n, n, (l_partkey + l_suppkey) % 50 FROM l),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey, s ORDER BY stage, a, b, c) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY stage, a, b, c) AS place FROM u)
SELECT l_orderkey, place, 'K' || place AS evidence_id, s AS source_id, rank, round(1.0::DOUBLE / rank, 6) AS score FROM p WHERE stage = 1 OR place <= 12""")
def fixed_bundle(spark, sf_dir):
    """Lines as candidates with two sources each, and one sibling behind every line."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(within)).select("l_orderkey", "rank", "l_partkey", "l_suppkey", "l_quantity")
    two = F.posexplode(F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50)).alias("position", "source_id")
    siblings = lines.select("l_orderkey", F.col("rank").alias("family_rank"), F.col("rank").alias("representative_rank"), (F.col("rank") + F.col("l_quantity")).cast("long").alias("candidate_rank"), F.col("l_partkey").alias("candidate_id"), F.array((F.col("l_partkey") + F.col("l_suppkey")) % 50).alias("sources"))
    return bundles.fixed_bundle(lines.select("l_orderkey", "rank", two), siblings, "l_orderkey", 12)


@query("binding_problems", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey AS source_id, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p.p_partkey IS NULL THEN 'unknown source' WHEN o.o_orderkey IS NULL THEN 'not allowed' WHEN l_suppkey % 3 > 0 THEN 'unsupported' END AS problem
FROM b LEFT JOIN part p ON p.p_partkey = b.source_id AND p.p_size > 5 LEFT JOIN orders o ON o.o_orderkey = b.l_orderkey AND o.o_orderstatus <> 'P'""")
def binding_problems(spark, sf_dir):
    """Lines bound to parts: the part must be in the corpus, the order open to it, the label on the part's path."""
    lines = table(spark, sf_dir, "lineitem")
    bound = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_id"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("On Path")).otherwise(F.lit("elsewhere")).alias("label"))
    corpus = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("source_id"), F.array("p_name", F.lit("on-path")).alias("diagnostic_path"))
    allowed = lines.select("l_orderkey", F.col("l_partkey").alias("source_id")).join(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return bundles.binding_problems(bound, corpus, allowed, "l_orderkey").select("l_orderkey", "l_linenumber", "problem")


@query("question_set", f"""WITH n AS (SELECT UNNEST({_SECTIONS}) AS section, UNNEST({list(bundles.SECTION_IDS.values())}) AS id, UNNEST(range({len(_SECTIONS)})) AS turn),
e AS (SELECT conv_id, string_agg(id, ',' ORDER BY turn) AS ids, sha256(string_agg(text, chr(10) ORDER BY turn)) AS texts_sha256, count(*) AS n FROM conversations JOIN n USING (turn) WHERE trim(text) <> '' AND role = 'user' GROUP BY conv_id)
SELECT c.conv_id AS case_id, coalesce(e.n, 0) AS n_evidence, e.ids AS evidence_ids, texts_sha256, CASE WHEN d.doc_id IS NULL THEN 'missing case' WHEN e.n IS NULL THEN 'no evidence' END AS problem, d.lang AS gold_label
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN e ON e.conv_id = c.conv_id""")
def question_set(spark, sf_dir):
    """Conversations as cases, a user's first turns as sections, documents of the same number as gold."""
    turns = table(spark, sf_dir, "conversations")
    sections = turns.filter("role = 'user'").select(F.col("conv_id").alias("case_id"), F.get(F.array(*map(F.lit, _SECTIONS)), F.col("turn").cast("int")).alias("section"), "text")
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("gold_label"), F.col("source").alias("gold_category"))
    got = bundles.question_set(cases, sections, turns.select(F.col("conv_id").alias("case_id")), "Name the diagnosis.")
    none = F.col("evidence").isNull()
    ids, texts = F.array_join("evidence.evidence_id", ","), F.sha2(F.array_join("evidence.text", "\n").cast("binary"), 256)
    return got.select("case_id", F.when(none, 0).otherwise(F.size("evidence")).cast("long").alias("n_evidence"), ids.alias("evidence_ids"), F.when(~none, texts).alias("texts_sha256"), "problem", "gold_label")


@query("package_gate", """SELECT sum((s_suppkey IS NULL)::INT)::BIGINT AS extra, sum((c_custkey IS NULL)::INT)::BIGINT AS missing, sum((c_custkey IS NOT NULL AND s_suppkey IS NOT NULL AND c_nationkey <> s_nationkey)::INT)::BIGINT AS changed,
sum((s_suppkey IS NULL OR c_custkey IS NULL OR c_nationkey <> s_nationkey)::INT) = 0 AS may_run FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def package_gate(spark, sf_dir):
    """Customers as files, suppliers of the same number as the manifest."""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.sha2(F.col("c_nationkey").cast("string"), 256).alias("sha256"))
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("sha256"))
    return bundles.package_gate(files, listed)


@query("family_child_facts", """WITH r AS (SELECT DISTINCT o_custkey, o_orderstatus || o_orderpriority AS graph_id FROM orders WHERE o_totalprice > 200000)
SELECT o_custkey, place, 'KF' || place AS evidence_id, graph_id, source_id FROM (SELECT o.o_custkey, graph_id, o_orderkey AS source_id, row_number() OVER (PARTITION BY o.o_custkey ORDER BY graph_id, [o_orderstatus, o_orderpriority], o_totalprice, o_orderkey) AS place FROM orders o JOIN r ON r.o_custkey = o.o_custkey AND graph_id = o_orderstatus || o_orderpriority)""")
def family_child_facts(spark, sf_dir):
    """A customer's orders of the kinds of its large ones: all facts of the selected families that it may cite."""
    o = table(spark, sf_dir, "orders").withColumn("graph_id", F.concat("o_orderstatus", "o_orderpriority"))
    premises = o.select("graph_id", F.array("o_orderstatus", "o_orderpriority").alias("diagnostic_path"), F.col("o_totalprice").alias("node_id"), F.col("o_orderkey").alias("source_id"))
    return bundles.family_child_facts(premises, o.filter("o_totalprice > 200000"), o.select("o_custkey", F.col("o_orderkey").alias("source_id")), "o_custkey")
