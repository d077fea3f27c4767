"""Queries on text functions: segments, windows, keys, quantities, redaction, identifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.numeric import jaccard
from marlstone.plans.ranking import toks
from marlstone.plans.registry import query, table


@query("segments", r"SELECT doc_id, pos, segment FROM (SELECT doc_id, unnest(s) AS segment, unnest(range(len(s)))::INT AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[;\r\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents))")
def segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.clauses(F.col("text"))).alias("pos", "segment"))


@query("word_windows", r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(0, greatest(ceil((len(w) - 56) / 48.0)::INT, 0) + 1))::INT AS pos FROM w WHERE len(w) > 0)
SELECT item_id, pos, array_to_string(w[pos * 48 + 1 : pos * 48 + 56], ' ') AS window_text FROM s""")
def word_windows(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.word_windows(F.col("text"))).alias("pos", "window_text"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: trim(x, ' ') <> ''))::INT AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query("sections_union", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS record, count(*) AS sections FROM conversations GROUP BY conv_id")
def sections_union(spark, sf_dir):
    """A record from its sections in order; a conversation is a bounded list of turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("record"), F.count(F.lit(1)).alias("sections"))


@query("first_k_per_section", "SELECT conv_id, turn, role, excerpt FROM (SELECT conv_id, turn, role, excerpt, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, role, substr(text, 1, 600) AS excerpt, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k <= 2) WHERE n <= 6")
def first_k_per_section(spark, sf_dir):
    """At most two excerpts of 600 characters a section, and six a record."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring("text", 1, 600).alias("excerpt"))
    two = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).filter("k <= 2")
    return two.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("n <= 6").select("conv_id", "turn", "role", "excerpt")


@query("candidate_terms", f"""WITH t AS (SELECT item_id, {toks("text")} AS t FROM benchmark),
g AS (SELECT item_id, n, array_to_string(t[i : i + n - 1], ' ') AS term FROM (SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, range(1, 5) r(n) WHERE len(t) >= n)),
s AS (SELECT item_id, term, any_value(n) AS n_words, count(*) AS times, any_value(n) * count(*) AS score FROM g GROUP BY item_id, term)
SELECT item_id, term, n_words, times, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, length(term) DESC, term) AS rank FROM s) WHERE rank <= 10""")
def candidate_terms(spark, sf_dir):
    """The ten best runs of one to four tokens of each item: words times occurrences, longer ones first."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.ngrams(T.tokens(F.col("text")))).alias("term"))
    n_words = (F.size(F.split("term", " "))).cast("long")
    s = t.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("n_words", n_words).withColumn("score", F.col("n_words") * F.col("times"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.length("term").desc(), "term")
    return s.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("item_id", "term", "n_words", "times", "score", "rank")


@query("label_keys", r"""SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS label, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '', 'g') AS key,
coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug, 'candidate:' || substr(sha256(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')), 1, 20) AS candidate_id FROM part""")
def label_keys(spark, sf_dir):
    full = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_label(F.col("p_name")).alias("label"), T.label_key(full).alias("key"), T.slug(full).alias("slug"), T.content_id("candidate:", T.label_key(F.col("p_name"))).alias("candidate_id"))


_LABELS = """(SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Mild COPD' WHEN 'MEDIUM' THEN 'Suspected viral pneumonia' WHEN 'LARGE' THEN 'Severe ' || p_name
 WHEN 'ECONOMY' THEN 'HFrEF' WHEN 'PROMO' THEN 'Strongly suspected NSTEMI' ELSE 'Acute ' || p_name END AS label FROM part)"""


def _labels(spark, sf_dir):
    by_type = {"SMALL": F.lit("Mild COPD"), "MEDIUM": F.lit("Suspected viral pneumonia"), "LARGE": F.concat(F.lit("Severe "), "p_name"), "ECONOMY": F.lit("HFrEF"), "PROMO": F.lit("Strongly suspected NSTEMI")}
    label = F.concat(F.lit("Acute "), "p_name")
    for kind, value in by_type.items():
        label = F.when(F.col("p_type") == kind, value).otherwise(label)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


def _case(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


@query("family_keys", f"""WITH k AS (SELECT p_partkey, label, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS raw FROM {_LABELS}),
l AS (SELECT *, coalesce({_case("raw", T.KEY_ALIASES)}, raw) AS lex FROM k),
s AS (SELECT *, CASE WHEN starts_with(lex, 'stronglysuspected') THEN substr(lex, 18) WHEN starts_with(lex, 'suspected') THEN substr(lex, 10) ELSE lex END AS bare FROM l),
v AS (SELECT *, CASE WHEN starts_with(bare, 'verysevere') AND bare <> 'verysevere' THEN substr(bare, 11) WHEN starts_with(bare, 'moderate') AND bare <> 'moderate' THEN substr(bare, 9)
  WHEN starts_with(bare, 'severe') AND bare <> 'severe' THEN substr(bare, 7) WHEN starts_with(bare, 'mild') AND bare <> 'mild' THEN substr(bare, 5) ELSE bare END AS stem FROM s)
SELECT p_partkey, label, lex AS lexical_key, coalesce({_case("bare", T.FAMILY_ALIASES)}, {_case("stem", T.FAMILY_ALIASES)}, stem) AS family_key FROM v""")
def family_keys(spark, sf_dir):
    return _labels(spark, sf_dir).select("p_partkey", "label", T.lexical_key(F.col("label")).alias("lexical_key"), T.family_key(F.col("label")).alias("family_key"))


_WORDS = ", ".join(f"CASE WHEN contains(' ' || w || ' ', ' {w} ') THEN '{q}' END" for w, q in T.QUALIFIERS.items())
_PHRASES = ", ".join(f"CASE WHEN contains(' ' || w || ' ', '{p}') THEN '{q}' END" for p, q in T.QUALIFIER_PHRASES.items())
_BY_KEY = f"list_filter(string_split(array_to_string(list_filter(list_transform(list_append(string_split(replace(regexp_replace(lower(label), '[^a-z0-9-]+', ' ', 'g'), '-', ''), ' '), {_case("regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')", T.KEY_ALIASES)[:-4]} ELSE regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') END), lambda k: {_case("k", T.KEY_QUALIFIERS)}), lambda x: x IS NOT NULL), ','), ','), lambda x: x <> '')"
_CLASH = " OR ".join(f"(len(list_intersect(a, {list(g)})) > 0 AND len(list_intersect(b, {list(g)})) > 0 AND list_sort(list_intersect(a, {list(g)})) <> list_sort(list_intersect(b, {list(g)})))" for g in T.CONTRADICTIONS)


@query("modifier_conflict", f"""WITH w AS (SELECT p_partkey, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS w FROM {_LABELS}),
q AS (SELECT p_partkey, list_sort(list_distinct(list_concat(list_filter([{_WORDS}, {_PHRASES}, CASE WHEN starts_with(w, 'strongly suspected') THEN 'strongly_suspected' END, CASE WHEN starts_with(w, 'suspected') OR starts_with(w, 'strongly suspected') THEN 'suspected' END], lambda x: x IS NOT NULL), {_BY_KEY}))) AS a FROM w),
b AS (SELECT p_partkey, a, lead(a, 1) OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS b FROM q)
SELECT p_partkey, array_to_string(a, ',') AS modifiers, coalesce({_CLASH}, FALSE) AS conflict FROM b""")
def modifier_conflict(spark, sf_dir):
    """Qualifiers of each label, and whether they clash with the next one's of the same ten."""
    q = _labels(spark, sf_dir).select("p_partkey", T.qualifiers(F.col("label")).alias("a"))
    following = F.lead("a").over(Window.partitionBy(F.floor(F.col("p_partkey") / 10)).orderBy("p_partkey"))
    return q.withColumn("b", following).select("p_partkey", F.array_join("a", ",").alias("modifiers"), F.coalesce(T.contradict(F.col("a"), F.col("b")), F.lit(False)).alias("conflict"))


@query("quantity_extract", r"""WITH e AS (SELECT page_id, lower(html) AS h FROM pages),
x AS (SELECT page_id, regexp_extract_all(h, '(>=|<=|>|<|=)?\s*(\d+(?:\.\d+)?)\s*(%|[a-z]+)?', 1) AS op, regexp_extract_all(h, '(>=|<=|>|<|=)?\s*(\d+(?:\.\d+)?)\s*(%|[a-z]+)?', 2) AS v, regexp_extract_all(h, '(>=|<=|>|<|=)?\s*(\d+(?:\.\d+)?)\s*(%|[a-z]+)?', 3) AS u FROM e)
SELECT page_id, pos, op, value, unit FROM (SELECT page_id, unnest(range(len(v)))::INT AS pos, coalesce(unnest(op), '') AS op, unnest(v)::DOUBLE AS value, coalesce(unnest(u), '') AS unit FROM x)""")
def quantity_extract(spark, sf_dir):
    q = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.quantities(F.col("html"))).alias("pos", "q"))
    return q.select("page_id", "pos", F.coalesce("q.op", F.lit("")).alias("op"), F.col("q.value").alias("value"), F.coalesce("q.unit", F.lit("")).alias("unit"))


@query("exact_dup_hash", "SELECT 'doc:' || substr(sha256(text), 1, 20) AS id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dup_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_id("doc:", F.col("text")).alias("id"))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


_SECRETS = ["https?://[^\\s\"'<>]+", "#[0-9]+", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"]


@query("redact", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || ' ' || html, 'https?://[^\s"''<>]+', 'internal reference', 'g'), '#[0-9]+', 'internal reference', 'g'), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 'internal reference', 'g') AS clean,
NOT regexp_matches(regexp_replace(url || ' ' || html, 'https?://[^\s"''<>]+', '', 'g'), 'https?://') AS safe FROM pages""")
def redact(spark, sf_dir):
    """References replaced, and a check that none is left."""
    full = F.concat_ws(" ", "url", "html")
    clean = T.redact(full, _SECRETS)
    return table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"), (~F.regexp_like(clean, F.lit("https?://"))).alias("safe"))


@query("ordered_dedup", "SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_dedup(spark, sf_dir):
    """Roles of a conversation in order of first appearance."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(T.ordered_distinct(F.transform(turns, lambda x: x["role"])), ",").alias("roles"))


@query("json_keys", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys, (props->>'$.k')::BIGINT AS k FROM events")
def json_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("forbidden_keys", """SELECT event_type, count(*) AS events, sum(regexp_matches(props, '"(gold|label|answer)"\\s*:')::INT)::BIGINT AS leaking, sum(regexp_matches(props, '"(k)"\\s*:')::INT)::BIGINT AS with_k FROM events GROUP BY event_type""")
def forbidden_keys(spark, sf_dir):
    """Payloads that carry a key that must not be there."""
    hit = lambda keys: F.sum(T.has_json_key(F.col("props"), keys).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), hit(["gold", "label", "answer"]).alias("leaking"), hit(["k"]).alias("with_k"))


@query("token_overlap", f"WITH t AS (SELECT conv_id, turn, list_distinct({toks('text')}) AS t FROM conversations), p AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(t, b))) = 0 THEN 0 ELSE len(list_intersect(t, b))::DOUBLE / len(list_distinct(list_concat(t, b))) END, 6) AS overlap FROM p WHERE b IS NOT NULL")
def token_overlap(spark, sf_dir):
    """Jaccard of each turn's tokens with the turn before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("b", before).filter("b IS NOT NULL").select("conv_id", "turn", F.round(jaccard(F.col("t"), F.col("b")), 6).alias("overlap"))
