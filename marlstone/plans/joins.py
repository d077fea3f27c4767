"""Queries on joins, set operations and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import holds, tokens
from marlstone.operators.lexical import BROADCAST_TERMS
from marlstone.operators.model import cache_key
from marlstone.plans.ranking import toks
from marlstone.plans.registry import query, table, texts


@query("threshold_join", """WITH t AS (SELECT p_brand, avg(p_retailprice) AS price, max(p_size) AS top FROM part GROUP BY p_brand)
SELECT t.p_brand, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part USING_P JOIN t ON part.p_brand = t.p_brand AND l_extendedprice / l_quantity > t.price AND p_size < t.top GROUP BY t.p_brand""".replace("USING_P", "ON l_partkey = p_partkey"))
def threshold_join(spark, sf_dir):
    """Lines whose unit price is over their brand's mean price: an equi-join with inequalities on top."""
    part = table(spark, sf_dir, "part")
    limits = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), F.max("p_size").alias("top"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(part.select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    met = holds(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(">"), F.col("price")) & holds(F.col("p_size"), F.lit("<"), F.col("top"))
    return lines.join(limits, "p_brand").filter(met).groupBy("p_brand").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


_BANDS = [("low", 0.0, 100000.0), ("mid", 100000.0, 300000.0), ("high", 300000.0, 1e12)]


@query("range_bind", """WITH b(band, lo, hi) AS (VALUES ('low', 0.0, 100000.0), ('mid', 100000.0, 300000.0), ('high', 300000.0, 1e12))
SELECT band, o_orderstatus, count(*) AS orders FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY ALL""")
def range_bind(spark, sf_dir):
    """Orders bound to the band that holds their price; three constant bands need no join."""
    band = F.lit(None).cast("string")
    for name, low, high in _BANDS:
        band = F.when((F.col("o_totalprice") >= low) & (F.col("o_totalprice") < high), F.lit(name)).otherwise(band)
    return table(spark, sf_dir, "orders").select(band.alias("band"), "o_orderstatus").filter("band IS NOT NULL").groupBy("band", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("theta_best_match", f"""WITH q AS (SELECT item_id, list_distinct({toks("text")}) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct({toks("text")}) AS t FROM documents),
x AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT item_id, unnest(t) AS term FROM q) JOIN (SELECT doc_id, unnest(t) AS term FROM d) USING (term) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(shared::DOUBLE / len(q.t), 6) AS coverage, round(shared::DOUBLE / (len(q.t) + len(d.t) - shared), 6) AS jaccard FROM x JOIN q USING (item_id) JOIN d USING (doc_id))
SELECT item_id, doc_id, coverage, jaccard, coverage >= 0.75 AS admissible FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, jaccard DESC, doc_id) AS n FROM s) WHERE n = 1""")
def theta_best_match(spark, sf_dir):
    """Each item's best document by covered tokens; pairs meet on a shared token, never as a product."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
    d = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
    terms = q.select("item_id", F.size("t").alias("nq"), F.explode("t").alias("term"))
    wanted = terms.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    each = d.select("doc_id", F.size("t").alias("nd"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    shared = each.join(terms, "term").groupBy("item_id", "doc_id", "nq", "nd").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.select("item_id", "doc_id", F.round(F.col("shared") / F.col("nq"), 6).alias("coverage"), F.round(F.col("shared") / (F.col("nq") + F.col("nd") - F.col("shared")), 6).alias("jaccard"))
    order = Window.partitionBy("item_id").orderBy(F.col("coverage").desc(), F.col("jaccard").desc(), "doc_id")
    return scored.withColumn("n", F.row_number().over(order)).filter("n = 1").select("item_id", "doc_id", "coverage", "jaccard", (F.col("coverage") >= 0.75).alias("admissible"))


@query("jaccard_pairs", f"""WITH t AS (SELECT item_id, list_distinct({toks("text")}) AS t FROM benchmark), e AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM t)
SELECT a.item_id AS a, b.item_id AS b, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM e a JOIN e b ON a.term = b.term AND a.item_id < b.item_id GROUP BY ALL HAVING jaccard >= 0.05""")
def jaccard_pairs(spark, sf_dir):
    """Pairs of items with a token set similarity of 0.05 or more, through their shared tokens."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("t"))
    e = t.select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    a, b = e.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "term"), e.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "term")
    shared = a.join(b, "term").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard")).filter("jaccard >= 0.05")


@query("left_enrich", "SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(top, 0) AS top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def left_enrich(spark, sf_dir):
    """A left join on an aggregate, with defaults where nothing matches."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    joined = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("seed_graph_expand", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def seed_graph_expand(spark, sf_dir):
    """All lines of the orders that have a seed line: a semi-join back to the group."""
    lines = table(spark, sf_dir, "lineitem")
    seeds = lines.filter("l_quantity >= 50").select("l_orderkey").distinct()
    return lines.join(seeds, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("full_outer_keys", "SELECT coalesce(c, s) AS nation, customers, suppliers FROM (SELECT c_nationkey AS c, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS s, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c = s")
def full_outer_keys(spark, sf_dir):
    """Both sides' keys, with what each side has; the check of two sets against each other."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full")


@query("leaf_nodes", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def leaf_nodes(spark, sf_dir):
    """Nodes that no edge starts from."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("missing_graph", "SELECT p_brand, count(*) AS missing FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) GROUP BY p_brand")
def missing_graph(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select("l_partkey").distinct()
    return table(spark, sf_dir, "part").join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").groupBy("p_brand").agg(F.count(F.lit(1)).alias("missing"))


@query("set_ops", """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'left only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    left, right = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    parts = {
        "both": c.filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).intersect(right),
        "left only": left.subtract(s.filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))),
        "either": left.union(right).distinct(),
    }
    counted = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return counted[0].union(counted[1]).union(counted[2])


@query("fk_gate", "SELECT 'lineitem.order' AS gate, count(*) AS broken, count(*) = 0 AS passed FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.customer', count(*), count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fk_gate(spark, sf_dir):
    """References without a target; a gate passes when there is none."""

    def gate(name, child, key, parent, target):
        broken = table(spark, sf_dir, child).join(table(spark, sf_dir, parent), F.col(key) == F.col(target), "left_anti")
        return broken.agg(F.lit(name).alias("gate"), F.count(F.lit(1)).alias("broken"), (F.count(F.lit(1)) == 0).alias("passed"))

    return gate("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey").union(gate("orders.customer", "orders", "o_custkey", "customer", "c_custkey"))


@query("allowlist_gate", "SELECT o_orderpriority, count(*) AS orders, sum((o_orderstatus NOT IN ('F', 'O'))::INT)::BIGINT AS outside, bool_and(o_orderstatus IN ('F', 'O')) AS passed FROM orders GROUP BY o_orderpriority")
def allowlist_gate(spark, sf_dir):
    allowed = F.col("o_orderstatus").isin("F", "O")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum((~allowed).cast("int")).alias("outside"), F.bool_and(allowed).alias("passed"))


@query("strict_binding", """SELECT o_orderkey, count(*) AS claims, sum((s_nationkey = c_nationkey)::INT)::BIGINT AS bound, bool_or(s_nationkey = c_nationkey) AS any_bound, bool_and(s_nationkey = c_nationkey) AS all_bound
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_orderkey HAVING bool_or(s_nationkey = c_nationkey)""")
def strict_binding(spark, sf_dir):
    """Lenient (some) and strict (all) binding of an order's lines to suppliers of the customer's nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    li, s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    same = F.col("s_nationkey") == F.col("c_nationkey")
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("claims"), F.sum(same.cast("int")).alias("bound"), F.bool_or(same).alias("any_bound"), F.bool_and(same).alias("all_bound")).filter("any_bound")


@query("shared_modality_join", """WITH k AS (SELECT user_id, event_type, list_sort(list(DISTINCT (props->>'$.k')::INT % 10)) AS ks FROM events WHERE value > 150 GROUP BY ALL)
SELECT a.user_id AS a, b.user_id AS b, a.event_type, len(list_intersect(a.ks, b.ks)) AS shared FROM k a JOIN k b ON a.event_type = b.event_type AND a.user_id <> b.user_id AND list_has_any(a.ks, b.ks) WHERE a.user_id % 100 = 0""")
def shared_modality_join(spark, sf_dir):
    """The stated query set, users divisible by 100, against all others of the same event type whose key sets meet."""
    # what two users share, their key sets share: counted once a pair of sets, then told to the users, so no grouping holds pairs of users
    sets = _user_sets(spark, sf_dir)
    kinds, asked = sets.select("event_type", "ks").distinct(), sets.filter("user_id % 100 = 0")
    side = lambda df, name: df.select("event_type", F.col("ks").alias(name), F.explode("ks").alias("k"))
    shared = side(asked.select("event_type", "ks").distinct(), "ka").join(side(kinds, "kb"), ["event_type", "k"]).groupBy("event_type", "ka", "kb").agg(F.count(F.lit(1)).alias("shared"))
    wanted = asked.select("event_type", F.col("ks").alias("ka"), F.col("user_id").alias("a")).join(shared, ["event_type", "ka"])
    met = wanted.join(sets.select("event_type", F.col("ks").alias("kb"), F.col("user_id").alias("b")), ["event_type", "kb"]).filter("a <> b")
    return met.select("a", "b", "event_type", "shared")


def _user_keys(spark, sf_dir):
    """Distinct (user, type, key): pairs of users meet on type and key, never on the type alone."""
    return table(spark, sf_dir, "events").filter("value > 150").select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).distinct()


@query("shared_modality_pairs", """WITH k AS (SELECT user_id, event_type, list_sort(list(DISTINCT (props->>'$.k')::INT % 10)) AS ks FROM events WHERE value > 150 GROUP BY ALL),
c AS (SELECT event_type, ks, min(user_id) AS class, count(*) AS users FROM k GROUP BY ALL)
SELECT a.event_type, a.class AS class_a, b.class AS class_b, len(list_intersect(a.ks, b.ks)) AS shared, CASE WHEN a.class = b.class THEN a.users * (a.users - 1) // 2 ELSE a.users * b.users END AS pairs FROM c a JOIN c b ON a.event_type = b.event_type AND a.class <= b.class AND list_has_any(a.ks, b.ks) WHERE a.class < b.class OR a.users > 1""")
def shared_modality_pairs(spark, sf_dir):
    """All pairs of users of one event type whose key sets meet, as pairs of classes of users with equal sets, by their smallest users.

    ``pairs`` counts the users' pairs behind a row; ``shared_modality_classes`` says who is in a class.  There are as many classes as
    different sets, not as users, so no pair of users is ever made.
    """
    c = _user_classes(spark, sf_dir).groupBy("event_type", "class").agg(F.first("ks").alias("ks"), F.count(F.lit(1)).alias("users"))
    k = c.select("event_type", "class", "users", F.explode("ks").alias("k"))
    met = k.withColumnsRenamed({"class": "class_a", "users": "users_a"}).join(k.withColumnsRenamed({"class": "class_b", "users": "users_b"}), ["event_type", "k"]).filter("class_a <= class_b")
    rows = met.groupBy("event_type", "class_a", "class_b").agg(F.count(F.lit(1)).alias("shared"), F.first("users_a").alias("a"), F.first("users_b").alias("b"))
    pairs = F.when(F.col("class_a") == F.col("class_b"), F.expr("a * (a - 1) div 2")).otherwise(F.col("a") * F.col("b"))
    return rows.withColumn("pairs", pairs).filter("pairs > 0").select("event_type", "class_a", "class_b", "shared", "pairs")


@query("shared_modality_classes", """WITH k AS (SELECT user_id, event_type, list_sort(list(DISTINCT (props->>'$.k')::INT % 10)) AS ks FROM events WHERE value > 150 GROUP BY ALL)
SELECT user_id, event_type, min(user_id) OVER (PARTITION BY event_type, ks) AS class FROM k""")
def shared_modality_classes(spark, sf_dir):
    """Each user's class: the smallest user of the event type with the same key set."""
    return _user_classes(spark, sf_dir).select("user_id", "event_type", "class")


def _user_sets(spark, sf_dir):
    return _user_keys(spark, sf_dir).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set("k")).alias("ks"))


def _user_classes(spark, sf_dir):
    sets = _user_sets(spark, sf_dir)
    lowest = sets.groupBy("event_type", "ks").agg(F.min("user_id").alias("class"))
    return sets.join(lowest, ["event_type", "ks"])


@query("cache_misses", "SELECT doc_id, sha256(coalesce(lang, chr(1)) || chr(0) || coalesce(text, chr(1))) AS cache_key FROM documents WHERE sha256(coalesce(lang, chr(1)) || chr(0) || coalesce(text, chr(1))) NOT IN (SELECT sha256(coalesce(lang, chr(1)) || chr(0) || coalesce(text, chr(1))) FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark, sf_dir):
    """Requests whose content hash is not among the answers held (those of even ids)."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", cache_key("lang", "text").alias("cache_key"))
    return keyed.join(keyed.filter("doc_id % 2 = 0").select("cache_key").distinct(), "cache_key", "left_anti").select("doc_id", "cache_key")


@query("hash_join_check", """WITH p AS (SELECT doc_id, sha256(text) AS digest, quality FROM documents JOIN labels USING (doc_id)), j AS (SELECT sha256(text) AS digest, min(doc_id) AS case_id FROM documents GROUP BY 1)
SELECT p.doc_id, j.case_id, p.doc_id <> j.case_id AS mismatch, quality FROM p JOIN j USING (digest)""")
def hash_join_check(spark, sf_dir):
    """Labels joined to the first document of the same content, and whether the ids differ."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("case_id"))
    judged = docs.join(table(spark, sf_dir, "labels"), "doc_id").join(first, "digest")
    return judged.select("doc_id", "case_id", (F.col("doc_id") != F.col("case_id")).alias("mismatch"), "quality")


@query("greedy_match")
def greedy_match(spark, sf_dir):
    """One-to-one matches of each conversation's user turns with its assistant turns by shared tokens."""
    from marlstone.operators.select import greedy_match as match

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(tokens(F.col("text"))).alias("t"))
    side = lambda role, p: c.filter(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{p}_pos"), F.size("t").alias(f"{p}_n"), F.explode("t").alias("term"))
    shared = side("user", "left").join(side("assistant", "right"), ["conv_id", "term"]).groupBy("conv_id", "left_pos", "right_pos", "left_n", "right_n").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.select("conv_id", "left_pos", "right_pos", (F.col("shared") / (F.col("left_n") + F.col("right_n") - F.col("shared"))).alias("score"))
    return match(scored, "conv_id", 0.02)
