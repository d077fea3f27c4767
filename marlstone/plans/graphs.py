"""Queries on hierarchies, argument graphs and terminology."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import graphs
from marlstone.plans.registry import query, table

_PATHS = "(SELECT s_suppkey AS path_id, [r_name, n_name, s_name] AS path FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)"


def _paths(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("path_id"), F.array("r_name", "n_name", "s_name").alias("path"), "r_name", "n_name", "s_name")


@query("hier_distance", f"""WITH e AS (SELECT path_id, unnest(path) AS a, unnest(range(3)) AS i FROM {_PATHS}), d AS (SELECT x.a, y.a AS b, min(abs(x.i - y.i))::INT AS distance FROM e x JOIN e y USING (path_id) WHERE x.i <> y.i GROUP BY ALL)
SELECT a, b, distance, CASE WHEN distance = 1 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS score FROM d""")
def hier_distance(spark, sf_dir):
    d = graphs.path_distances(_paths(spark, sf_dir), "path")
    return d.select("a", "b", "distance", graphs.hierarchy_score(F.col("distance")).alias("score"))


@query("hier_recursive", """WITH RECURSIVE e AS (SELECT DISTINCT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey),
w AS (SELECT r_name AS root, r_name AS node, 0 AS depth, r_name AS path FROM region UNION ALL SELECT root, child, depth + 1, path || ' > ' || child FROM w JOIN e ON node = parent)
SELECT root, node, depth, path FROM w""")
def hier_recursive(spark, sf_dir):
    """All nodes under each region with their paths; the hierarchy has three levels."""
    p = _paths(spark, sf_dir)
    edges = p.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).distinct().union(p.select("n_name", "s_name"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    edges = nations.distinct().union(p.select("n_name", "s_name"))
    return graphs.walk(edges, table(spark, sf_dir, "region").select(F.col("r_name").alias("root")), 2)


@query("family_overlap", """WITH p AS (SELECT n_name, s_nationkey, n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey = b.s_nationkey AS same_nation, (1 + (a.s_nationkey = b.s_nationkey)::INT)::INT AS shared FROM p a JOIN p b ON a.n_regionkey = b.n_regionkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey % 100 = 0""")
def family_overlap(spark, sf_dir):
    """Suppliers divisible by 100 with all others of a shared ancestor."""
    p = _paths(spark, sf_dir).select("path_id", F.array("r_name", "n_name").alias("up"), "r_name", "n_name")
    a = p.filter("path_id % 100 = 0").select(F.col("path_id").alias("a"), F.col("up").alias("ua"), "r_name", F.col("n_name").alias("na"))
    b = p.select(F.col("path_id").alias("b"), F.col("up").alias("ub"), "r_name", F.col("n_name").alias("nb"))
    return a.join(b, "r_name").filter("a <> b").select("a", "b", (F.col("na") == F.col("nb")).alias("same_nation"), F.size(F.array_intersect("ua", "ub")).alias("shared"))


@query("argument_edges", """WITH c AS (SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.o_orderpriority AS source, b.o_orderpriority AS target, 'rebuts' AS relation FROM c a JOIN c b USING (o_custkey) WHERE a.score > b.score OR (a.score = b.score AND a.o_orderpriority < b.o_orderpriority)""")
def argument_edges(spark, sf_dir):
    """Each customer's order priorities as rival claims, the stronger against the weaker."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return graphs.rebuttals(c, "o_custkey", "o_orderpriority", "score")


@query("argument_quality", """WITH c AS (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS undercut, sum((l_linestatus = 'F')::INT) AS grounded, sum((l_linestatus = 'F' AND l_returnflag <> 'R')::INT) AS standing FROM lineitem GROUP BY 1)
SELECT l_orderkey, n, round(coalesce(grounded::DOUBLE / nullif(n, 0), 1), 6) AS grounding, round(coalesce(standing::DOUBLE / nullif(grounded, 0), 0), 6) AS survival, round(coalesce((grounded - standing)::DOUBLE / nullif(undercut, 0), 1), 6) AS precision FROM c""")
def argument_quality(spark, sf_dir):
    """Ratios with their own defaults for an empty denominator, 1 for some and 0 for others."""
    rf, ls = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(rf.cast("int")).alias("undercut"), F.sum(ls.cast("int")).alias("grounded"), F.sum((ls & ~rf).cast("int")).alias("standing"))
    ratio = lambda x, y, default: F.round(F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(default)), 6)
    return c.select("l_orderkey", "n", ratio(F.col("grounded"), F.col("n"), 1.0).alias("grounding"), ratio(F.col("standing"), F.col("grounded"), 0.0).alias("survival"), ratio(F.col("grounded") - F.col("standing"), F.col("undercut"), 1.0).alias("precision"))


_TERMS = """(SELECT 'C' || lpad((p_partkey % 40)::VARCHAR, 4, '0') AS concept, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_type || ')' ELSE '' END AS term, p_brand AS source, (p_size % 5)::INT AS source_rank, (p_partkey % 2)::INT AS preferred FROM part)"""
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    term = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""))
    rows = p.select(F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 40).cast("string"), 4, "0")).alias("concept"), term.alias("term"), F.col("p_brand").alias("source"), (F.col("p_size") % 5).cast("int").alias("source_rank"), (F.col("p_partkey") % 2).cast("int").alias("preferred"))
    return graphs.terminology(rows)


@query("term_lookup", f"""WITH t AS (SELECT *, {_KEY.format("term")} AS key FROM {_TERMS}), q AS (SELECT DISTINCT p_name AS query, {_KEY.format("p_name")} AS key FROM part)
SELECT query, concept, term, source, source_rank, preferred FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY source_rank, preferred DESC, length(term) DESC, term, concept) AS n FROM q JOIN t USING (key)) WHERE n = 1""".replace("source, source_rank", "min_source AS source, source_rank").replace("FROM q JOIN t USING (key)", "FROM (SELECT query, concept, term, source_rank, preferred, min(source) AS min_source FROM q JOIN t USING (key) GROUP BY ALL)"))
def term_lookup(spark, sf_dir):
    terms = _terms(spark, sf_dir).groupBy("key", "concept", "term", "source_rank", "preferred").agg(F.min("source").alias("source"))
    return graphs.best_match(terms, table(spark, sf_dir, "part"), "p_name").select("query", "concept", "term", "source", "source_rank", "preferred")


@query("concept_alias", f"""WITH g AS (SELECT concept, term, min(source_rank) AS r, max(preferred) AS p FROM {_TERMS} GROUP BY ALL)
SELECT concept, term, place FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY r, p DESC, length(term), term) AS place FROM g) WHERE place <= 5""")
def concept_alias(spark, sf_dir):
    return graphs.aliases(_terms(spark, sf_dir), 5)


@query("term_subset", f"""WITH t AS (SELECT *, {_KEY.format("term")} AS key FROM {_TERMS})
SELECT concept, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM t WHERE concept IN (SELECT concept FROM t WHERE key IN (SELECT {_KEY.format("p_name")} FROM part WHERE p_partkey % 100 = 0)) GROUP BY concept""")
def term_subset(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.col("p_name").alias("wanted"))
    return graphs.subset(_terms(spark, sf_dir), wanted).groupBy("concept").agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("term").alias("distinct_terms"))


@query("crosswalk", f"""WITH t AS (SELECT DISTINCT concept, {_KEY.format("term")} AS key FROM {_TERMS}), q AS (SELECT p_partkey, {_KEY.format("p_name || ' ' || p_type")} AS full_key, {_KEY.format("p_name")} AS name_key FROM part),
x AS (SELECT p_partkey, min(f.concept) AS exact, min(n.concept) AS by_name FROM q LEFT JOIN t f ON f.key = full_key LEFT JOIN t n ON n.key = name_key GROUP BY p_partkey)
SELECT p_partkey, coalesce(exact, by_name) AS concept, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN by_name IS NOT NULL THEN 'name' ELSE 'none' END AS match_type FROM x""")
def crosswalk(spark, sf_dir):
    """Labels to concepts, by the whole label, else by its name; the smallest concept wins."""
    first = _terms(spark, sf_dir).groupBy("key").agg(F.min("concept").alias("concept"))
    from marlstone.functions.text import term_key

    q = table(spark, sf_dir, "part").select("p_partkey", term_key(F.concat_ws(" ", "p_name", "p_type")).alias("full_key"), term_key(F.col("p_name")).alias("name_key"))
    x = q.join(first.select(F.col("key").alias("full_key"), F.col("concept").alias("exact")), "full_key", "left").join(first.select(F.col("key").alias("name_key"), F.col("concept").alias("by_name")), "name_key", "left")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return x.select("p_partkey", F.coalesce("exact", "by_name").alias("concept"), kind.alias("match_type"))


@query("first_semantic_type", f"SELECT concept, arg_min(source, (p_partkey)) AS first_source, arg_max(source, p_partkey) AS last_source FROM (SELECT p_partkey, 'C' || lpad((p_partkey % 40)::VARCHAR, 4, '0') AS concept, p_brand AS source FROM part) GROUP BY concept")
def first_semantic_type(spark, sf_dir):
    """First and last row of each concept in file order, which a line number carries."""
    p = table(spark, sf_dir, "part").withColumn("concept", F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 40).cast("string"), 4, "0")))
    return p.groupBy("concept").agg(F.min_by("p_brand", "p_partkey").alias("first_source"), F.max_by("p_brand", "p_partkey").alias("last_source"))


@query("ancestor_label", f"SELECT n_name, count(*) AS members, min(r_name) AS ancestor FROM (SELECT path[1] AS r_name, path[2] AS n_name FROM {_PATHS}) GROUP BY n_name")
def ancestor_label(spark, sf_dir):
    """The last label that all of a family's paths share above the family."""
    p = _paths(spark, sf_dir)
    return p.groupBy("n_name").agg(F.count(F.lit(1)).alias("members"), F.min(F.element_at("path", 1)).alias("ancestor"))


@query("concept_categories", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'diagnosis' WHEN 'LARGE' THEN 'anatomy' ELSE CASE WHEN p_size < 25 THEN 'procedure' END END AS category FROM part")
def concept_categories(spark, sf_dir):
    """A semantic type's category beats its vocabulary's."""
    kind = F.when(F.col("p_type") == "SMALL", "Disease or Syndrome").when(F.col("p_type") == "LARGE", "Body Part, Organ, or Organ Component").otherwise("Gene")
    vocabulary = F.when(F.col("p_size") < 25, "CPT").otherwise("ABC")
    return table(spark, sf_dir, "part").select("p_partkey", graphs.category(kind, vocabulary, {"CPT": "procedure"}).alias("category"))


@query("concept_keys", f"""WITH t AS (SELECT concept, term, source_rank, preferred, {_KEY.format("term")} AS key FROM {_TERMS}), l AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'Unheard ' || p_partkey ELSE p_name END AS label FROM part),
m AS (SELECT label, concept FROM (SELECT label, concept, row_number() OVER (PARTITION BY label ORDER BY source_rank, preferred DESC, length(term) DESC, term, concept) AS n FROM (SELECT *, {_KEY.format("label")} AS key FROM l) JOIN t USING (key)) WHERE n = 1)
SELECT label, CASE WHEN concept IS NOT NULL THEN 'cui:' || lower(concept) ELSE regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') END AS diagnosis_key FROM l LEFT JOIN m USING (label)""")
def concept_keys(spark, sf_dir):
    """Labels by their concept, others by their letters."""
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Unheard "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return graphs.diagnosis_keys(_terms(spark, sf_dir), table(spark, sf_dir, "part").select(label.alias("l")), "l")


@query("concept_expansion", f"""WITH t AS (SELECT concept, term, source_rank, preferred, {_KEY.format("term")} AS key FROM {_TERMS}), q AS (SELECT DISTINCT p_size, p_name AS query, {_KEY.format("p_name")} AS key FROM part),
m AS (SELECT query, concept FROM (SELECT query, concept, row_number() OVER (PARTITION BY query ORDER BY source_rank, preferred DESC, length(term) DESC, term, concept) AS n FROM (SELECT DISTINCT query, key FROM q) JOIN t USING (key)) WHERE n = 1),
g AS (SELECT concept, term, min(source_rank) AS r, max(preferred) AS p FROM {_TERMS} GROUP BY ALL), a AS (SELECT concept, term FROM (SELECT concept, term, row_number() OVER (PARTITION BY concept ORDER BY r, p DESC, length(term), term) AS place FROM g) WHERE place <= 5)
SELECT DISTINCT p_size, term FROM q JOIN m USING (query) JOIN a USING (concept)""")
def concept_expansion(spark, sf_dir):
    """Other names of the concepts that a group's part names stand for."""
    return graphs.expand(_terms(spark, sf_dir), table(spark, sf_dir, "part").select("p_size", "p_name"), "p_size", "p_name")
