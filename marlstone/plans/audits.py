"""Queries on audits, gates, run comparisons, inventories and typed binding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import typed
from marlstone.operators import audits, inventory
from marlstone.plans.registry import query, table

_LABELLED = "(SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("corpus_audit", """WITH a AS (SELECT count(*) AS records, count(DISTINCT source) AS graphs, count(DISTINCT source) FILTER (lang = 'en') AS extension_graphs, sum((coalesce(lang, '') = '')::INT)::BIGINT AS missing_provenance, count(DISTINCT text) AS chunks, sum((coalesce(text, '') = '')::INT)::BIGINT AS blank FROM documents),
g AS (SELECT *, graphs = 20 AS graph_count_ok, extension_graphs = 20 AS extension_count_ok, missing_provenance = 0 AS provenance_ok, chunks = records AS unique_chunks_ok, blank = 0 AS text_ok FROM a)
SELECT *, graph_count_ok AND extension_count_ok AND provenance_ok AND unique_chunks_ok AND text_ok AS all_gates_pass FROM g""")
def corpus_audit(spark, sf_dir):
    """Documents as premises of their source: counts and gates in one row."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("text").alias("source_chunk_id"), F.col("source").alias("graph_id"), F.col("lang").alias("node_id"), "text", F.array("source", "lang").alias("diagnostic_path"), (F.col("lang") == "en").alias("is_extension"))
    return audits.corpus_audit(rows, 20, 20)


@query("evidence_audit", """SELECT l_returnflag, l_linestatus, count(*) AS nodes, count(DISTINCT l_suppkey) AS diagnoses, sum((l_quantity > 45)::INT)::BIGINT AS decisive, sum((l_quantity > 45 AND l_discount > 0)::INT)::BIGINT AS decisive_bound, bool_and(NOT l_quantity > 45 OR l_discount > 0) AS all_bound FROM lineitem GROUP BY ALL""")
def evidence_audit(spark, sf_dir):
    return audits.evidence_audit(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey", F.col("l_quantity") > 45, F.col("l_discount") > 0)


@query("boundary_audit", """SELECT role, count(*) AS requests, max(length(text)) AS longest, sum(length(text))::BIGINT AS tokens, sum((length(text) > 300)::INT)::BIGINT AS over_limit, sum((trim(text) = '')::INT)::BIGINT AS failed, sum((length(text) > 300 OR trim(text) = '')::INT) = 0 AS passed FROM conversations GROUP BY role""")
def boundary_audit(spark, sf_dir):
    return audits.boundary_audit(table(spark, sf_dir, "conversations"), ["role"], F.length("text"), 300, F.trim("text") == "")


@query("prompt_audit", "SELECT conv_id, count(*) AS prompts, min(length(text)) AS least, max(length(text)) AS most, count(DISTINCT role) AS schemas, sha256(string_agg(sha256(text), chr(10) ORDER BY turn)) AS sequence_sha256 FROM conversations GROUP BY conv_id")
def prompt_audit(spark, sf_dir):
    return audits.prompt_audit(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")


@query("crosstab", f"SELECT lang, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS n00, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS n01, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS n10, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS n11 FROM {_LABELLED} GROUP BY lang")
def crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return audits.crosstab(rows, ["lang"], "quality", "toxic")


@query("run_comparison", """WITH r AS (SELECT event_type, (value > 100)::INT::DOUBLE AS v, user_id, event_id % 2 = 0 AS first FROM events),
m AS (SELECT event_type, avg(v) FILTER (first) AS b, avg(v) FILTER (NOT first) AS a, least(count(DISTINCT user_id) FILTER (first), count(DISTINCT user_id) FILTER (NOT first)) AS n FROM r GROUP BY event_type)
SELECT event_type, round(b, 6) AS before, round(a, 6) AS after, n, round(a - b, 6) AS change, round(1.0::DOUBLE / n, 6) AS noise_floor, abs(a - b) > 1.0::DOUBLE / n AS beyond_noise FROM m""")
def run_comparison(spark, sf_dir):
    """Two runs, told apart by the event's parity, compared on the share of high values."""
    e = table(spark, sf_dir, "events").withColumn("high", (F.col("value") > 100).cast("double"))
    first = F.col("event_id") % 2 == 0
    got = audits.compare_runs(e, ["event_type"], first, ~first, "high", "user_id")
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("before", "after", "change", "noise_floor")], "n", "beyond_noise")


@query("partition_check", """WITH p AS (SELECT user_id AS k, count(DISTINCT event_type) AS parts FROM events GROUP BY 1), w AS (SELECT DISTINCT c_custkey AS k FROM customer),
b AS (SELECT w.k IS NOT NULL AS inside, coalesce(parts, 0) AS n FROM w FULL JOIN p ON w.k = p.k)
SELECT sum(inside::INT)::BIGINT AS keys, sum((inside AND n > 0)::INT)::BIGINT AS covered, sum((n > 1)::INT)::BIGINT AS shared, sum((inside AND n = 0)::INT)::BIGINT AS uncovered, sum((NOT inside)::INT)::BIGINT AS "foreign", sum((n > 1 OR NOT inside OR n = 0)::INT) = 0 AS is_partition FROM b""")
def partition_check(spark, sf_dir):
    """Whether event types part the customers."""
    parts = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_type")
    return audits.partition_check(parts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "event_type", "k")


@query("manifest_gate", """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 'nation' END, CASE WHEN (c_acctbal > 0) IS DISTINCT FROM (s_acctbal > 0) THEN 'in_credit' END], lambda x: x IS NOT NULL), ',') AS differing,
c_nationkey IS NOT DISTINCT FROM s_nationkey AND (c_acctbal > 0) IS NOT DISTINCT FROM (s_acctbal > 0) AS may_resume FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def manifest_gate(spark, sf_dir):
    """Customers and suppliers of one number as a run's held and asked manifests."""
    held = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("in_credit"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("in_credit"))
    got = audits.manifest_gate(held, asked, "c_custkey", ["nation", "in_credit"])
    return got.select("c_custkey", F.array_join("differing", ",").alias("differing"), "may_resume")


@query("record_hashes", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS prediction_sha256, sha256('{"p_name":"' || p_name || '","p_type":"' || p_type || '"}') AS dropped_sha256 FROM part""")
def record_hashes(spark, sf_dir):
    """Digests of the frozen fields, and of fields that are dropped for it."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name", "p_type")
    hashed = part.withColumn("prediction_sha256", audits.record_hash(part, ["p_partkey", "p_brand", "p_size"]))
    return audits.replace_by_digest(hashed, ["p_name", "p_type"]).select("p_partkey", "prediction_sha256", "dropped_sha256")


@query("log_spans", """WITH k AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS kind FROM events),
n AS (SELECT *, lead(kind) OVER w AS k2, lead(ts) OVER w AS t2 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind))
SELECT user_id, CASE WHEN k2 IN ('completed', 'failed') THEN k2 ELSE 'open' END AS status, CASE WHEN k2 IN ('completed', 'failed') THEN (epoch_us(t2) - epoch_us(ts)) // 1000 END AS duration_ms FROM n WHERE kind = 'started'""")
def log_spans(spark, sf_dir):
    """Views as started spans, ended by the user's next purchase or error."""
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return audits.event_log(e, "user_id", "ts", "kind").select("user_id", "status", "duration_ms")


@query("answer_states", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'invalid duplicate candidate assessment' WHEN 2 THEN 'invalid structured response' WHEN 3 THEN 'invalid evidence binding' ELSE 'technical stage failure' END AS error_category,
CASE WHEN o_orderkey % 3 = 0 THEN 'not_abstained' WHEN o_orderkey % 5 <> 0 THEN 'execution_failure' WHEN o_orderkey % 2 = 0 THEN 'insufficient_evidence' ELSE 'other_abstention' END AS abstention,
CASE WHEN o_orderkey % 2 = 0 THEN 'patient evidence' ELSE '' END || CASE WHEN o_orderkey % 6 = 0 THEN '+' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'controlled-corpus evidence' ELSE '' END AS basis FROM orders""")
def answer_states(spark, sf_dir):
    """What went wrong with an answer, why it abstained, and on what kinds of evidence it rests."""
    k = F.col("o_orderkey")
    error = F.when(k % 5 == 1, "Duplicate diagnosis in JSON").when(k % 5 == 2, "bad JSON, no evidence").when(k % 5 == 3, "Citation not allowed").when(k % 5 == 4, "timeout").otherwise("")
    ids = F.array(F.when(k % 2 == 0, "S-HPI-1").otherwise("X"), F.when(k % 3 == 0, "KFA-1").otherwise("P-1"))
    action = F.when(k % 2 == 0, "abstain").otherwise("maintain")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", typed.error_category(error).alias("error_category"), typed.abstention_category(k % 3 != 0, error, F.lit(""), action).alias("abstention"), F.array_join(typed.evidence_basis(ids), "+").alias("basis"))


@query("source_extracts", r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS s, CASE doc_id % 3 WHEN 0 THEN lower(trim(regexp_replace(substr(text, 10, 20), '[ \t\n\x0B\f\r]+', ' ', 'g'))) WHEN 1 THEN lower(trim(regexp_replace(substr(text, 10, 4), '[ \t\n\x0B\f\r]+', ' ', 'g'))) ELSE 'not in any text' END AS e FROM documents)
SELECT doc_id, length(e) >= 8 AND contains(s, e) AS holds FROM t""")
def source_extracts(spark, sf_dir):
    """Extracts of a text in capitals, too short ones, and some that are not in it."""
    k, t = F.col("doc_id"), F.col("text")
    extract = F.when(k % 3 == 0, F.substring(t, 10, 20)).when(k % 3 == 1, F.substring(t, 10, 4)).otherwise("Not in any text")
    return table(spark, sf_dir, "documents").select("doc_id", typed.contains_extract(t, extract).alias("holds"))


@query("mode_positions", """SELECT conv_id, turn, position, ['direct', 'basic', 'graph', 'argument'][position + 1] AS mode FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations)""")
def mode_positions(spark, sf_dir):
    return audits.mode_by_position(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["direct", "basic", "graph", "argument"]).select("conv_id", "turn", "position", "mode")


@query("graph_path_sets", """SELECT graph_id, count(*) AS paths, string_agg(lang || '>' || size, ';' ORDER BY lang, size) AS listed FROM (SELECT DISTINCT source AS graph_id, lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size FROM documents) GROUP BY graph_id""")
def graph_path_sets(spark, sf_dir):
    """Each source's distinct (lang, size) paths, in order."""
    size = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("graph_id"), F.array("lang", size).alias("diagnostic_path"))
    return audits.graph_paths(rows).select("graph_id", F.size("paths").cast("long").alias("paths"), F.array_join(F.transform("paths", lambda p: F.array_join(p, ">")), ";").alias("listed"))


@query("gold_coverage", """WITH f AS (SELECT l_orderkey, lower(p_type) AS label, lower(p_brand) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'promo' ELSE 'small' END AS gold FROM orders)
SELECT o_orderkey, coalesce(max((label = gold)::INT), 0)::DOUBLE AS gold_coverage FROM g LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def gold_coverage(spark, sf_dir):
    """Whether some part of an order has the wanted type, as its label or in its path."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    facts = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("label"), F.array("p_type").alias("path"))
    gold = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Promo").otherwise("Small").alias("gold_label"))
    return audits.gold_coverage(facts, gold, "o_orderkey", "label", "path")


@query("relevant_paths", """WITH n AS (SELECT n_nationkey, r_name, lower(n_name) AS nation, CASE n_nationkey % 2 WHEN 0 THEN lower(substr(n_name, 1, 3)) ELSE lower(r_name) END AS needle, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT a.n_nationkey AS id, b.r_name || '>' || upper(b.nation) AS path, min(b.n_nationkey) AS o FROM n a JOIN n b USING (n_regionkey) WHERE contains(b.nation, a.needle) OR contains(a.needle, b.nation) OR contains(lower(b.r_name), a.needle) OR contains(a.needle, lower(b.r_name)) GROUP BY ALL)
SELECT id, path, place FROM (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY o) AS place FROM m) WHERE place <= 3""")
def relevant_paths(spark, sf_dir):
    """Region and nation as paths; a nation's needle is its first letters or its region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    needle = F.when(F.col("n_nationkey") % 2 == 0, F.substring("n_name", 1, 3)).otherwise(F.col("r_name"))
    asked = n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("graph"), needle.alias("reference"), F.lit("").alias("evaluated"))
    paths = n.select(F.col("n_regionkey").alias("graph"), F.array("r_name", F.upper("n_name")).alias("path"), "n_nationkey")
    return audits.relevant_paths(paths, asked, "id", "path", "n_nationkey", 3).select("id", F.array_join("path", ">").alias("path"), "place")


@query("atomic_facts", r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS atom, i FROM (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '[;\r\n]+')) AS x, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '[;\r\n]+'), 1) AS i FROM conversations)),
p AS (SELECT conv_id, turn, atom, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM c WHERE atom <> '')
SELECT conv_id, turn, atom, 'KFA-' || substr(sha256(conv_id || '|' || turn || '|' || k || '|' || atom), 1, 16) AS atom_id FROM p""")
def atomic_facts(spark, sf_dir):
    """Clauses of each turn, named by conversation, turn, place and text."""
    facts = table(spark, sf_dir, "conversations").filter(F.trim("text") != "").select("conv_id", "turn", "text", F.col("conv_id").cast("string").alias("evidence_id"), F.col("turn").cast("string").alias("node_id"))
    return inventory.atomic_facts(facts).select("conv_id", "turn", "atom", "atom_id")


@query("argument_compatibility", """WITH c AS (SELECT l_orderkey, ['clinical_sign', 'diagnostic_criterion', 'risk_factor', 'guideline_authority'][1 + l_orderkey % 4] AS scheme, CASE WHEN l_linenumber % 3 = 0 THEN 'S-' ELSE 'K' END AS ns, l_quantity > 2 AS ok, l_discount AS comp,
CASE WHEN l_suppkey % 9 = 0 THEN 'other' ELSE ['clinical_feature', 'diagnostic_criterion', 'risk_factor', 'guideline'][1 + l_orderkey % 4] END AS role, ['clinical_feature', 'diagnostic_criterion', 'risk_factor', 'guideline'][1 + l_orderkey % 4] AS wanted FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_and(ok) AND bool_and(ns = 'S-' OR role = wanted) AND (bool_or(ns = 'S-') OR scheme = 'guideline_authority') THEN coalesce(min(comp) FILTER (ns = 'K'), 0) ELSE 0 END AS compatibility FROM c GROUP BY l_orderkey, scheme""")
def argument_compatibility(spark, sf_dir):
    k = F.col("l_orderkey")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (k % 4).cast("int"))
    scheme, role = pick("clinical_sign", "diagnostic_criterion", "risk_factor", "guideline_authority"), pick("clinical_feature", "diagnostic_criterion", "risk_factor", "guideline")
    name = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "S-").otherwise("K"), F.col("l_linenumber").cast("string"))
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", scheme.alias("scheme"), name.alias("evidence_id"), (F.col("l_quantity") > 2).alias("is_valid"), F.col("l_discount").alias("compatibility"), F.when(F.col("l_suppkey") % 9 == 0, "other").otherwise(role).alias("role"))
    return inventory.argument_compatibility(cited, "l_orderkey")


@query("shape_signal", """WITH c AS (SELECT l_orderkey, l_quantity > 25 AS active, l_returnflag = o_orderstatus OR l_linestatus = o_orderstatus AS named, len(list_intersect(['s' || (l_suppkey % 3), 'p' || (l_partkey % 3)], ['s1', 'p2'])) AS shared FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, sum(named::INT)::BIGINT AS graph_candidates, sum((named AND active)::INT)::BIGINT AS active_graph_candidates, sum(active::INT)::BIGINT AS active, sum(CASE WHEN active THEN shared ELSE 0 END)::BIGINT AS active_overlap, sum(CASE WHEN named THEN shared ELSE 0 END)::BIGINT AS graph_overlap FROM c GROUP BY l_orderkey""")
def shape_signal(spark, sf_dir):
    """Lines of an order as candidates, its status as the graph's label."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.xxhash64("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("candidate_id"), F.col("l_returnflag").alias("diagnosis"), F.array("l_linestatus").alias("path"), (F.col("l_quantity") > 25).alias("active"), F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string"))).alias("evidence"))
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("graph_label"), F.array(F.lit("s1"), F.lit("p2")).alias("citations"))
    return inventory.shape_signal(li, labels, "l_orderkey")


@query("claim_aliases", "SELECT l_suppkey, l_partkey AS node_id, l_orderkey * 10 + l_linenumber AS claim_id, min(l_orderkey * 10 + l_linenumber) OVER w AS alias_of, count(*) OVER w AS claims FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey)")
def claim_aliases(spark, sf_dir):
    """Lines of one supplier and part are claims on one node."""
    claims = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("node_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"))
    return inventory.claim_aliases(claims, "l_suppkey")


@query("trace_profile", "SELECT d.doc_id, lang, source, quality, toxic, l.doc_id IS NOT NULL AS has_graph_row, t.doc_id IS NOT NULL AS has_adjudication FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) t USING (doc_id)".replace("quality, toxic", "quality, t.toxic AS toxic"))
def trace_profile(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return inventory.trace_profile(docs.select("doc_id", "lang"), docs.select("doc_id", "source"), labels.select("doc_id", "quality"), labels.filter("toxic = 1").select("doc_id", "toxic"), "doc_id")


_FACTS = "(SELECT l_suppkey, p_brand, p_type, l_extendedprice, l_quantity, l_discount, l_returnflag, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _facts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    li = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return li.select("l_suppkey", "p_brand", "p_type", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k"))


@query("candidate_inventory", f"""WITH e AS (SELECT l_suppkey, p_brand AS diagnosis, max(l_extendedprice) AS score, min(k) AS rank, count(*) AS facts FROM {_FACTS} GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, rank) AS place FROM e),
s AS (SELECT *, max(CASE WHEN diagnosis = 'Brand#12' THEN place END) OVER (PARTITION BY l_suppkey) AS own FROM p)
SELECT l_suppkey, diagnosis, score, rank, facts, least(place, 4) AS place FROM s WHERE place <= CASE WHEN coalesce(own, 0) > 4 THEN 3 ELSE 4 END OR diagnosis = 'Brand#12'""")
def candidate_inventory(spark, sf_dir):
    """Four brands of each supplier by their dearest line; the seed's brand takes the last place if it is not among them."""
    facts = _facts(spark, sf_dir).select("l_suppkey", F.col("p_brand").alias("diagnosis"), F.col("l_extendedprice").alias("score"), F.col("k").alias("rank"), F.lit("brand#12").alias("seed"))
    return inventory.candidate_inventory(facts, "l_suppkey", "seed", 4).select("l_suppkey", "diagnosis", "score", "rank", "facts", "place")


@query("family_inventory", f"SELECT * FROM (SELECT l_suppkey, p_type, max(l_extendedprice) AS score, count(*) AS facts, count(DISTINCT p_brand) AS children, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, p_type) AS place FROM {_FACTS} GROUP BY 1, 2) WHERE place <= 3")
def family_inventory(spark, sf_dir):
    facts = _facts(spark, sf_dir).select("l_suppkey", "p_type", F.col("p_brand").alias("diagnosis"), F.col("l_extendedprice").alias("score"))
    return inventory.family_inventory(facts, "l_suppkey", "p_type", 3)


@query("hybrid_routes", f"""WITH x AS (SELECT *, CASE p_type WHEN 'PROMO' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS weight, l_discount >= 0.09 AS met, l_returnflag = 'R' AND l_quantity > 45 AS event FROM {_FACTS}),
s AS (SELECT l_suppkey, k, r FROM (SELECT l_suppkey, k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, k) AS r FROM x) WHERE r <= 64), d AS (SELECT l_suppkey, k, r FROM (SELECT l_suppkey, k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, k) AS r FROM x) WHERE r <= 64),
f AS (SELECT l_suppkey, k, (coalesce(1.0::DOUBLE / (20.0::DOUBLE + s.r), 0) + coalesce(1.0::DOUBLE / (20.0::DOUBLE + d.r), 0)) * weight + CASE WHEN met THEN 0.08::DOUBLE ELSE 0 END AS score FROM (SELECT coalesce(s.l_suppkey, d.l_suppkey) AS l_suppkey, coalesce(s.k, d.k) AS k, s.r AS sr, d.r AS dr FROM s FULL JOIN d ON s.l_suppkey = d.l_suppkey AND s.k = d.k) j JOIN x USING (l_suppkey, k) LEFT JOIN s USING (l_suppkey, k) LEFT JOIN d USING (l_suppkey, k)),
b AS (SELECT l_suppkey, max(score) + 1 AS floor FROM f GROUP BY 1),
a AS (SELECT l_suppkey, p_brand, p_type, k, greatest(coalesce(score, 0), CASE WHEN met THEN floor WHEN event THEN floor * 0.8::DOUBLE ELSE 0 END) AS score FROM x LEFT JOIN f USING (l_suppkey, k) JOIN b USING (l_suppkey) WHERE score IS NOT NULL OR met OR event),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, k) AS r FROM a) WHERE r <= 48),
g AS (SELECT l_suppkey, p_brand, sum(CASE n WHEN 1 THEN score WHEN 2 THEN 0.5::DOUBLE * score ELSE 0.25::DOUBLE * score END) AS g FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_brand ORDER BY score DESC) AS n FROM sd) WHERE n <= 3 GROUP BY 1, 2),
gg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(g, 9) DESC, p_brand) AS r FROM g) WHERE r <= 5),
o AS (SELECT l_suppkey, p_brand, p_type, sum(CASE n WHEN 1 THEN score WHEN 2 THEN 0.5::DOUBLE * score ELSE 0.25::DOUBLE * score END) AS own FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_brand, p_type ORDER BY score DESC) AS n FROM a) WHERE n <= 3 GROUP BY 1, 2, 3),
m AS (SELECT l_suppkey, p_brand, p_type, own, g, own - coalesce(CASE WHEN row_number() OVER w = 1 THEN lead(own) OVER w ELSE first_value(own) OVER w END, own) AS margin FROM o JOIN gg USING (l_suppkey, p_brand) WINDOW w AS (PARTITION BY l_suppkey, p_brand ORDER BY own DESC, p_type)),
t AS (SELECT l_suppkey, p_brand, p_type, round(own + 0.35::DOUBLE * g + 0.10::DOUBLE * (p_type = 'PROMO')::INT + 0.40::DOUBLE * margin, 6) AS route FROM m)
SELECT l_suppkey, p_brand, p_type, route FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY route DESC, lower(p_type), p_brand) AS place FROM t) WHERE place <= 8""")
def hybrid_routes(spark, sf_dir):
    """Both rankings fused, executable facts raised above the rest, and the eight best routes of the best graphs, for each supplier as the question."""
    facts = _facts(spark, sf_dir)
    rank = lambda c: facts.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col(c).desc(), "k"))).filter("rank <= 64")
    told = facts.select("l_suppkey", "k", F.when(F.col("p_type") == "PROMO", 1.2).otherwise(1.0).alias("weight"), (F.col("l_discount") >= 0.09).alias("threshold_met"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("event_met"))
    fused = inventory.fuse(rank("l_extendedprice"), rank("l_quantity"), told, ["l_suppkey", "k"])
    raised = inventory.structured_floor(fused, told, ["l_suppkey", "k"], ["l_suppkey"]).join(facts.select("l_suppkey", "k", "p_brand", "p_type"), ["l_suppkey", "k"])
    routes = inventory.hybrid_candidates(raised, ["l_suppkey"], "p_brand", "p_type", "k", (F.col("p_type") == "PROMO").cast("double"), 48, 5, 8)
    return routes.select("l_suppkey", "p_brand", "p_type", "route")
