"""Queries on the chain of retrieval, hierarchies of any depth, common prefixes, chunk plans and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.operators import graphs, lexical, metrics, retrieval, vectors
from marlstone.plans.graphs import _PATHS, _paths
from marlstone.plans.ranking import toks
from marlstone.plans.registry import query, table, texts
from marlstone.sources.scratch import written

_DOCS = "(SELECT doc_id, source, lang, coalesce(text, '') || '. ' || source || ' > ' || (doc_id % 50) AS text FROM documents)"
_ITEMS = "(SELECT item_id, text || '. src' || (item_id % 20) || ' = ' || item_id || CASE WHEN item_id % 3 = 0 THEN ' previously' ELSE '' END AS text FROM benchmark)"
_CHOICES = f"""d AS (SELECT doc_id AS doc, source AS graph, CASE WHEN doc_id % 9 = 0 THEN 'Suspected ' || lang ELSE lang || ' ' || (doc_id % 4) END AS label, {toks("text")} AS t FROM {_DOCS}),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM d), p AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT item_id AS query, {toks("text")} AS t FROM {_ITEMS}), q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(t) AS term FROM i) GROUP BY ALL),
b AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) * least(qtf, 2)), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY query, doc),
sp AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS sr FROM b WHERE score > 0),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS cos FROM v a JOIN benchmark ON item_id = a.vec_id, v b JOIN documents ON doc_id = b.vec_id),
de AS (SELECT query, doc, dr FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY cos DESC, doc) AS dr FROM c) WHERE dr <= 64),
ev AS (SELECT item_id AS query, doc_id AS doc, item_id % 3 > 0 AS now FROM benchmark, documents WHERE source = 'src' || (item_id % 20) AND item_id > doc_id % 50),
fu AS (SELECT *, (coalesce(1.0::DOUBLE / (20.0::DOUBLE + sr), 0) + coalesce(1.0::DOUBLE / (20.0::DOUBLE + dr), 0)) * (1 / sqrt(greatest(greatest(len(t), 1) / 64.0::DOUBLE, 1.0::DOUBLE))) + CASE WHEN now IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END AS score FROM sp FULL JOIN de USING (query, doc) JOIN d USING (doc) LEFT JOIN ev USING (query, doc)),
fl AS (SELECT query, max(score) + 1 AS floor FROM fu GROUP BY query), st AS (SELECT query, doc FROM ev WHERE now),
ra AS (SELECT coalesce(fu.query, st.query) AS query, coalesce(fu.doc, st.doc) AS doc, greatest(coalesce(score, 0), CASE WHEN st.doc IS NOT NULL THEN coalesce(floor, 1) ELSE 0 END) AS score FROM fu FULL JOIN st ON fu.query = st.query AND fu.doc = st.doc LEFT JOIN fl ON fl.query = coalesce(fu.query, st.query)),
se AS (SELECT query, doc FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM fu) WHERE r <= 24 UNION SELECT query, doc FROM st),
sd AS (SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM se JOIN ra USING (query, doc)) WHERE r <= 24),
g AS (SELECT query, graph, sum(CASE n WHEN 1 THEN score WHEN 2 THEN 0.5::DOUBLE * score ELSE 0.25::DOUBLE * score END) AS g FROM (SELECT query, graph, score, row_number() OVER (PARTITION BY query, graph ORDER BY score DESC) AS n FROM sd JOIN d USING (doc)) WHERE n <= 3 GROUP BY ALL),
gg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY g DESC, graph) AS r FROM g) WHERE r <= 12),
m AS (SELECT gg.query, graph, label, g, d.doc AS doc, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY gg.query, graph, label ORDER BY coalesce(score, 0) DESC, d.doc) AS n FROM gg JOIN d USING (graph) LEFT JOIN ra ON ra.query = gg.query AND ra.doc = d.doc WHERE NOT starts_with(label, 'Suspected ')),
o AS (SELECT query, graph, label, any_value(g) AS g, coalesce(sum(CASE n WHEN 1 THEN score WHEN 2 THEN 0.5::DOUBLE * score WHEN 3 THEN 0.25::DOUBLE * score END), 0) AS own, list(doc ORDER BY n) FILTER (n <= 4) AS sources FROM m GROUP BY ALL),
w AS (SELECT *, own - coalesce(CASE WHEN row_number() OVER x = 1 THEN lead(own) OVER x ELSE first_value(own) OVER x END, own) AS margin FROM o WINDOW x AS (PARTITION BY query, graph ORDER BY own DESC, label)),
r AS (SELECT w.*, round(own + 0.35::DOUBLE * g + 0.10::DOUBLE * len(list_intersect(list_distinct({toks("label")}), t))::DOUBLE / greatest(len(list_distinct({toks("label")})), 1) + 0.40::DOUBLE * margin, 9) AS route, 'candidate:' || substr(sha256(regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')), 1, 20) AS candidate_id FROM w JOIN i USING (query)),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY route DESC, lower(label), candidate_id, graph) AS place FROM r) WHERE place <= 32)"""


def _chain(spark, sf_dir):
    """Choices and executed evidence: items as queries, documents as premises of their source, labelled by language and id, cosine neighbours by id."""
    docs = texts(spark, sf_dir, "doc_id", "source", "lang", "text")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(". "), "source", F.lit(" > "), (F.col("doc_id") % 50).cast("string"))
    label = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Suspected "), "lang")).otherwise(F.concat("lang", F.lit(" "), (F.col("doc_id") % 4).cast("string")))
    premises = docs.select(F.col("doc_id").alias("premise"), F.col("source").alias("graph"), label.alias("label"), text.alias("text")).withColumn("weight", lexical.length_weight(F.size(tokens(F.col("text")))))
    items = table(spark, sf_dir, "benchmark")
    said = F.concat("text", F.lit(". src"), (F.col("item_id") % 20).cast("string"), F.lit(" = "), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 0, " previously").otherwise(""))
    queries = items.select(F.col("item_id").alias("query"), said.alias("text"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked, held = vecs.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), vecs.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    dense = written(vectors.nearest(asked, held, 64).select("query", F.col("doc").alias("premise"), "rank"))
    evidence = retrieval.structured(queries, premises)
    return retrieval.candidate_choices(queries, premises, dense, evidence), evidence


@query("candidate_choices", f"WITH {_CHOICES} SELECT query, place, candidate_id, label, graph, round(route, 6) AS route, array_to_string(sources, ',') AS sources FROM ch")
def candidate_choices(spark, sf_dir):
    """Ranked routes of the graphs that the best seeds name, from real rankings of texts and vectors."""
    choices, _ = _chain(spark, sf_dir)
    return choices.select("query", "place", "candidate_id", "label", "graph", F.round("route", 6).alias("route"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("route_order", f"""WITH {_CHOICES}, x AS (SELECT query, place, max(CASE WHEN st.doc IS NOT NULL THEN 1 ELSE 0 END) AS strong FROM (SELECT query, place, unnest(sources) AS doc FROM ch) LEFT JOIN st USING (query, doc) GROUP BY ALL),
n AS (SELECT ch.*, strong, row_number() OVER (PARTITION BY query, graph ORDER BY strong DESC, place) AS n FROM ch JOIN x USING (query, place))
SELECT query, rank, candidate_id, label, graph, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n > 1, strong DESC, place) AS rank FROM n) WHERE rank <= 8""")
def route_order(spark, sf_dir):
    """The eight routes of each item; every one keeps a source, as routes do not share any."""
    return retrieval.diverse_routes(*_chain(spark, sf_dir)).drop("sources")


@query("route_facts")
def route_facts(spark, sf_dir):
    """The routes with their twelve sources."""
    return retrieval.diverse_routes(*_chain(spark, sf_dir)).select("query", "rank", F.posexplode("sources").alias("position", "premise"))


@query("hierarchy_closure", f"""WITH RECURSIVE e AS (SELECT DISTINCT path[1] AS parent, path[2] AS child FROM {_PATHS} UNION SELECT DISTINCT path[2], path[3] FROM {_PATHS}),
w AS (SELECT parent AS ancestor, child AS node, 1 AS distance FROM e UNION ALL SELECT ancestor, child, distance + 1 FROM w JOIN e ON node = parent) SELECT ancestor, node, min(distance)::INT AS distance FROM w GROUP BY ALL""")
def hierarchy_closure(spark, sf_dir):
    """Every place below every other, at any depth."""
    p = _paths(spark, sf_dir)
    return graphs.closure(p.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).union(p.select("n_name", "s_name")).distinct())


@query("shared_ancestors", f"""WITH p AS (SELECT path_id % 13 AS bucket, path FROM {_PATHS}), k AS (SELECT bucket, i, count(DISTINCT path[1:i]) AS kinds, any_value(path[1:i]) AS prefix FROM p, range(1, 4) r(i) GROUP BY ALL),
b AS (SELECT bucket, coalesce(max(i) FILTER (kinds = 1), 0) AS deep FROM k GROUP BY bucket) SELECT b.bucket, deep::INT AS depth, prefix[deep] AS label FROM b LEFT JOIN k ON k.bucket = b.bucket AND k.i = deep""")
def shared_ancestors(spark, sf_dir):
    """The deepest place that all suppliers of a bucket lie in."""
    found = graphs.shared_ancestors(_paths(spark, sf_dir).withColumn("bucket", F.col("path_id") % 13), ["bucket"], "path")
    return found.select("bucket", F.size("prefix").alias("depth"), "label")


@query("token_chunks", r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+') AS p FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, text, p, unnest(range(0, greatest((len(p) + 509) // 510, 1))) AS chunk FROM p),
t AS (SELECT doc_id, chunk, len(p) AS total, p[chunk * 510 + 1:chunk * 510 + 510] AS own, array_to_string(p[chunk * 510 + 1:chunk * 510 + 510], '') || CASE WHEN chunk = greatest((len(p) + 509) // 510, 1) - 1 THEN substr(text, length(array_to_string(p, '')) + 1) ELSE '' END AS body FROM c)
SELECT doc_id, chunk::INT AS chunk, len(own)::INT AS n_tokens, round(len(own)::DOUBLE / greatest(total, 1), 6) AS weight, length(body)::INT AS n_chars, sha256(body) AS digest FROM t""")
def token_chunks(spark, sf_dir):
    """Chunks of 510 tokens, a token being a word with the blanks before it; they join to the whole text."""
    docs = texts(spark, sf_dir, "doc_id", "text").filter("text is not null")
    return lexical.chunk_plan(docs, "doc_id", "text", 512).select("doc_id", "chunk", "n_tokens", F.round("weight", 6).alias("weight"), F.length("body").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """Toxicity less quality of all labelled documents, by language, with resampled intervals."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.paired_bootstrap(rows, "lang", "doc_id", "quality", "toxic")
