"""Queries on evaluation: summaries, tests, intervals, splits, profiles and the resolver."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import Z95, wilson
from marlstone.operators import metrics
from marlstone.operators.resolve import resolution_basis, resolve
from marlstone.plans.registry import query, table

_LABELLED = "(SELECT doc_id, source, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query("hash_split", f"""WITH h AS (SELECT doc_id, source, sha256('17:' || doc_id) AS h FROM {_LABELLED}),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM h)
SELECT doc_id, source, CASE WHEN n >= 5 AND k <= greatest(1, round_even(n * 0.2, 0)) THEN 'development' ELSE 'test' END AS part FROM r""")
def hash_split(spark, sf_dir):
    return metrics.stratified_split(_labelled(spark, sf_dir).select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "part")


@query("seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('17:' || o_orderkey), o_orderkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    """Fifty orders in the order of a seeded hash: the sampling operator."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(metrics.hash_order(17, F.col("o_orderkey")), "o_orderkey").limit(50)


@query("metrics_summary", f"""WITH b AS (SELECT 'all' AS scope, * FROM {_LABELLED} UNION ALL SELECT 'subset', * FROM {_LABELLED} WHERE toxic = 0)
SELECT scope, lang, count(*) AS n, round(avg(quality), 6) AS quality_mean, round(coalesce(stddev_pop(quality), 0), 6) AS quality_sd, round(avg(n_chars), 6) AS n_chars_mean, round(coalesce(stddev_pop(n_chars), 0), 6) AS n_chars_sd FROM b GROUP BY scope, lang""")
def metrics_summary(spark, sf_dir):
    return metrics.summarize(_labelled(spark, sf_dir), ["lang"], ["quality", "n_chars"], F.col("toxic") == 0)


@query("quantiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 4) AS p025, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.975), 4) AS p975 FROM orders GROUP BY o_orderpriority")
def quantiles(spark, sf_dir):
    """Interpolated quantiles."""
    p = {"p025": 0.025, "p50": 0.5, "p975": 0.975}
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.round(F.percentile("o_totalprice", q), 4).alias(n) for n, q in p.items()])


@query("wilson", f"""WITH r AS (SELECT lang, count(*)::DOUBLE AS n, avg(quality)::DOUBLE AS p, {Z95}::DOUBLE AS z FROM {_LABELLED} GROUP BY lang)
SELECT lang, n::BIGINT AS n, round(p, 6) AS rate, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low,
round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM r""")
def wilson_interval(spark, sf_dir):
    r = _labelled(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return r.select("lang", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_PAIRED = f"""p AS (SELECT lang, count(*) AS pairs, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS base_only, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS other_only FROM {_LABELLED} GROUP BY lang),
t AS (SELECT *, CASE WHEN base_only + other_only = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(base_only, other_only) + 1),
  lambda i: exp(lgamma(base_only + other_only + 1) - lgamma(i + 1) - lgamma(base_only + other_only - i + 1) - (base_only + other_only) * ln(2::DOUBLE))))) END AS p FROM p)"""


@query("paired_exact", f"WITH {_PAIRED} SELECT lang, pairs, base_only, other_only, round(p, 6) AS p_value FROM t")
def paired_exact(spark, sf_dir):
    """Exact test of quality against toxicity on all labelled documents, by language."""
    return metrics.paired_counts(_labelled(spark, sf_dir), ["lang"], "quality", "toxic")


@query("holm", f"""WITH {_PAIRED}, s AS (SELECT lang, round(p, 6) AS p_value, (count(*) OVER () - row_number() OVER (ORDER BY round(p, 6), lang) + 1) * round(p, 6) AS step FROM t)
SELECT lang, p_value, round(least(max(step) OVER (ORDER BY p_value, lang ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS p_holm FROM s""")
def holm(spark, sf_dir):
    tests = paired_exact(spark, sf_dir).select("lang", "p_value")
    return metrics.holm(tests, "p_value", "lang").select("lang", "p_value", F.round("p_holm", 6).alias("p_holm"))


@query("bootstrap_ci", f"""WITH d AS (SELECT lang, quality, b, ('0x' || substr(md5('17:' || b || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {_LABELLED}, range(1, 201) r(b)),
w AS (SELECT lang, b, quality, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT + (u >= 0.9963401531726563::DOUBLE)::INT + (u >= 0.9994058151824183::DOUBLE)::INT + (u >= 0.999916758850712::DOUBLE)::INT AS w FROM d),
m AS (SELECT lang, b, sum(w * quality)::DOUBLE / nullif(sum(w), 0) AS m FROM w GROUP BY lang, b)
SELECT lang, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY lang""")
def bootstrap_ci(spark, sf_dir):
    return metrics.bootstrap(_labelled(spark, sf_dir), ["lang"], "doc_id", "quality")


@query("pivot_mode", "SELECT user_id, sum(value) FILTER (event_type = 'view') AS view, sum(value) FILTER (event_type = 'click') AS click, sum(value) FILTER (event_type = 'purchase') AS purchase FROM (SELECT user_id, event_type, round(sum(value), 2) AS value FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL) GROUP BY user_id")
def pivot_mode(spark, sf_dir):
    """One row a user, one column an event type, from a fixed list."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.round(F.sum("value"), 2))


_LATEST = "(SELECT user_id, event_type AS mode, arg_max((value > 100)::INT, (ts, event_id)) AS label FROM events GROUP BY ALL)"


@query("agreement_matrix", f"WITH l AS {_LATEST} SELECT a.mode AS a, b.mode AS b, count(*) AS cases, round(avg((a.label = b.label)::INT), 6) AS agreement FROM l a JOIN l b USING (user_id) WHERE a.mode < b.mode GROUP BY ALL")
def agreement_matrix(spark, sf_dir):
    """Event types compared on whether each user's last value was high."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", F.col("event_type").alias("mode")).agg(F.max_by((F.col("value") > 100).cast("int"), F.struct("ts", "event_id")).alias("label"))
    return metrics.agreement(last, "user_id", "mode", "label")


@query("label_stability", f"""WITH a AS (SELECT user_id, mode, label FROM {_LATEST}), b AS (SELECT user_id, event_type AS mode, arg_min((value > 100)::INT, (ts, event_id)) AS label FROM events GROUP BY ALL)
SELECT mode, count(*) AS cases, sum((a.label <> b.label)::INT)::BIGINT AS changed, round(1.0::DOUBLE / count(*), 6) AS noise_floor FROM a JOIN b USING (user_id, mode) GROUP BY mode""")
def label_stability(spark, sf_dir):
    """Changed labels between a first and a last run, beside the smallest difference that can show."""
    e = table(spark, sf_dir, "events").withColumn("high", (F.col("value") > 100).cast("int"))
    at = F.struct("ts", "event_id")
    runs = e.groupBy("user_id", F.col("event_type").alias("mode")).agg(F.max_by("high", at).alias("last"), F.min_by("high", at).alias("first"))
    return runs.groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), F.sum((F.col("first") != F.col("last")).cast("int")).alias("changed"), F.round(1.0 / F.count(F.lit(1)), 6).alias("noise_floor"))


@query("share_of_total", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount)) / sum(sum(l_extendedprice * (1 - l_discount))) OVER (), 6) AS share FROM lineitem GROUP BY ALL")
def share_of_total(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return r.select("l_returnflag", "l_linestatus", F.round("r", 2).alias("revenue"), F.round(F.col("r") / F.sum("r").over(Window.partitionBy()), 6).alias("share"))


@query("defensible_rate", r"""WITH c AS (SELECT lang, quality, regexp_extract_all(text, '(https?://\S+|\b[A-Z]{2,}\b)') AS cites FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS answers, sum((quality = 1 AND len(list_filter(cites, lambda x: starts_with(x, 'http'))) > 0)::INT)::BIGINT AS defensible, round(avg((quality = 1 AND len(list_filter(cites, lambda x: starts_with(x, 'http'))) > 0)::INT), 6) AS rate FROM c GROUP BY lang""")
def defensible_rate(spark, sf_dir):
    """Accepted answers with a citation of the right kind."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cites = F.regexp_extract_all("text", F.lit(r"(https?://\S+|\b[A-Z]{2,}\b)"), F.lit(1))
    ok = ((F.col("quality") == 1) & F.exists(cites, lambda x: F.startswith(x, F.lit("http")))).cast("int")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("answers"), F.sum(ok).alias("defensible"), F.round(F.avg(ok), 6).alias("rate"))


@query("bucket_profile", """SELECT bucket, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN event_type = 'error' AND value > 100 THEN 'severe error' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND value < 1 THEN 'empty purchase'
WHEN event_type IN ('view', 'click') THEN 'browsing' ELSE 'other' END AS bucket FROM events) GROUP BY bucket""")
def bucket_profile(spark, sf_dir):
    """Ordered rules put each event in one bucket; counts and shares."""
    kind, value = F.col("event_type"), F.col("value")
    bucket = F.when((kind == "error") & (value > 100), "severe error").when(kind == "error", "error").when((kind == "purchase") & (value < 1), "empty purchase").when(kind.isin("view", "click"), "browsing").otherwise("other")
    n = table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("bucket", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


_STATES = """(SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 150) THEN 'supported' ELSE 'inconclusive' END AS decision, CASE WHEN bool_or(event_type = 'view' AND value > 200) THEN 'child' ELSE '' END AS child_label,
bool_or(event_type = 'error' AND value > 150) AS attack, CASE user_id % 3 WHEN 0 THEN 'better_supported_alternative' WHEN 1 THEN 'unsupported_specificity' ELSE 'contradiction' END AS attack_type, CASE WHEN user_id % 6 < 4 THEN 'D2' ELSE '' END AS alternative,
CASE WHEN user_id % 5 = 0 THEN NULL ELSE bool_or(event_type = 'signup' AND value > 150) END AS valid, CASE WHEN user_id % 7 = 0 THEN 'child_only' ELSE 'family' END AS scope, bool_or(event_type = 'click' AND value > 150) AS independent, bool_or(event_type = 'view' AND value > 220) AS protected FROM events GROUP BY user_id)"""


@query("resolver_case", f"""WITH t AS (SELECT *, (NOT attack OR NOT coalesce(valid, FALSE)) AS survives, attack_type = 'better_supported_alternative' AND alternative <> '' AS better FROM {_STATES}),
r AS (SELECT user_id, attack AND coalesce(valid, FALSE) AS challenged, CASE
 WHEN decision <> 'supported' AND protected AND survives THEN 'protected_incumbent' WHEN decision <> 'supported' AND protected AND coalesce(valid, FALSE) AND better AND independent THEN 'switch' WHEN decision <> 'supported' THEN 'abstain'
 WHEN attack AND valid IS NOT NULL AND NOT valid AND better AND independent THEN 'abstain' WHEN survives AND child_label <> '' THEN 'maintain' WHEN survives THEN 'family_fallback'
 WHEN attack_type = 'unsupported_specificity' OR scope = 'child_only' THEN 'family_fallback' WHEN better THEN 'switch' ELSE 'abstain' END AS action FROM t)
SELECT user_id, action, CASE WHEN action = 'abstain' THEN 'abstain' WHEN action IN ('maintain', 'switch') AND challenged THEN 'confident' WHEN action = 'maintain' THEN 'clean_pass' WHEN action IN ('protected_incumbent', 'family_fallback') THEN 'evidence_rescue' ELSE 'other' END AS basis FROM r""")
def resolver_case(spark, sf_dir):
    """The decision ladder over one state a user."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    seen = lambda k, least: F.bool_or((kind == k) & (value > least))
    flags = table(spark, sf_dir, "events").groupBy("user_id").agg(seen("purchase", 150).alias("sup"), seen("view", 200).alias("child"), seen("error", 150).alias("attack"), seen("signup", 150).alias("val"), seen("click", 150).alias("independent"), seen("view", 220).alias("protected"))
    states = flags.select(
        "user_id", "attack", "independent", "protected",
        F.when(F.col("sup"), "supported").otherwise("inconclusive").alias("decision"),
        F.when(F.col("child"), "child").otherwise("").alias("child_label"),
        F.when(user % 3 == 0, "better_supported_alternative").when(user % 3 == 1, "unsupported_specificity").otherwise("contradiction").alias("attack_type"),
        F.when(user % 6 < 4, "D2").otherwise("").alias("alternative"),
        F.when(user % 5 != 0, F.col("val")).alias("valid"),
        F.when(user % 7 == 0, "child_only").otherwise("family").alias("scope"),
    )
    return resolve(states).select("user_id", "action", resolution_basis(F.col("action"), F.col("challenged")).alias("basis"))


@query("serial_rise", "SELECT user_id, event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, count(*) >= 2 AND arg_max(value, (ts, event_id)) > arg_min(value, (ts, event_id)) AS rising FROM events GROUP BY user_id, event_type")
def serial_rise(spark, sf_dir):
    """Two values or more of a series, the last above the first."""
    at = F.struct("ts", "event_id")
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    return s.withColumn("rising", (F.col("n") >= 2) & (F.col("last_value") > F.col("first_value")))


@query("dataset_audit", "SELECT count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, sum((n_chars < 100)::INT)::BIGINT AS short, sum((text IS NULL OR trim(text) = '')::INT)::BIGINT AS blank, min(n_chars) AS least, round(avg(n_chars), 4) AS mean, max(n_chars) AS most FROM documents")
def dataset_audit(spark, sf_dir):
    short, blank = F.col("n_chars") < 100, F.col("text").isNull() | (F.trim("text") == "")
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.sum(short.cast("int")).alias("short"), F.sum(blank.cast("int")).alias("blank"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("most"))


@query("judge_summary", f"""SELECT lang, count(*) AS judged, sum(quality)::BIGINT AS passed, sum((toxic = 1)::INT)::BIGINT AS excluded, coalesce(round(sum((quality = 1 AND toxic = 0)::INT)::DOUBLE / nullif(sum((toxic = 0)::INT), 0), 6), 0) AS accuracy FROM {_LABELLED} GROUP BY lang""")
def judge_summary(spark, sf_dir):
    """Counts by verdict and the accuracy among the included, 0 where none is."""
    ok, included = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 0
    rate = F.coalesce(F.round(F.try_divide(F.sum(ok.cast("int")).cast("double"), F.sum(included.cast("int")).cast("double")), 6), F.lit(0.0))
    return _labelled(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("judged"), F.sum("quality").alias("passed"), F.sum((F.col("toxic") == 1).cast("int")).alias("excluded"), rate.alias("accuracy"))
