"""Queries on lexical ranking, fusion and route selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import STOPWORDS, tokens
from marlstone.operators import fusion, lexical, select
from marlstone.plans.registry import query, table, texts

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def toks(text: str) -> str:
    """SQL for the tokens of a text."""
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda x: len(x) > 1 AND NOT list_contains([{_STOP}], x))"


_POSTINGS = f"""
d AS (SELECT doc_id AS doc, {toks("text")} AS t FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM d),
p AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query, term, count(*) AS qtf FROM (SELECT item_id, unnest({toks("text")}) AS term FROM benchmark) GROUP BY ALL)"""

_BM25 = f"""{_POSTINGS},
b AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) * least(qtf, 2)), 6) AS score
      FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY query, doc)"""


@query("bm25_topk", f"WITH {_BM25} SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b WHERE score > 0) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(texts(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), 5)


@query("idf_overlap_rank", f"""WITH {_POSTINGS},
u AS (SELECT doc, len(list_distinct(t)) AS n_terms FROM d),
b AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * least(tf, 2) * least(qtf, 2)) / sqrt(any_value(n_terms)), 6) AS score
      FROM p JOIN f USING (term) JOIN q USING (term) JOIN u USING (doc), s GROUP BY query, doc)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b) WHERE rank <= 5""")
def idf_overlap_rank(spark, sf_dir):
    return lexical.idf_overlap(texts(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), 5)


@query("token_stats", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, round(1 / sqrt(greatest(greatest(len(t), 1) / 64.0::DOUBLE, 1.0::DOUBLE)), 6) AS length_weight FROM (SELECT doc_id, {toks('text')} AS t FROM documents)")
def token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.round(lexical.length_weight(F.size("t")), 6).alias("length_weight"))


@query("term_df", f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY term")
def term_df(spark, sf_dir):
    p = lexical.postings(texts(spark, sf_dir, "doc_id", "text"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


_DENSE = """
c AS (SELECT q.vec_id AS query, v.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cos
      FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q, embeddings v),
e AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(cos, 6) DESC, doc) AS rank FROM c)"""


@query("rrf_hybrid", f"""WITH {_BM25}, {_DENSE},
l AS (SELECT query, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b WHERE score > 0) WHERE rank <= 20),
r AS (SELECT query, doc, l.rank AS sparse_rank, e.rank AS dense_rank, coalesce(1.0::DOUBLE / (20 + l.rank), 0) + coalesce(0.5::DOUBLE / (20 + e.rank), 0) AS score
      FROM l FULL JOIN (SELECT * FROM e WHERE rank <= 20) e USING (query, doc))
SELECT query, doc, sparse_rank, dense_rank, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM r) WHERE place <= 10""")
def rrf_hybrid(spark, sf_dir):
    """Sparse and dense neighbours of each benchmark item, fused by reciprocal rank."""
    from marlstone.operators import vectors

    bench, emb = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    sparse = lexical.bm25(texts(spark, sf_dir, "doc_id", "text"), bench, 20)
    asked = emb.join(F.broadcast(bench.select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi")
    dense = vectors.nearest(asked, emb, 20)
    fused = fusion.rrf(sparse, dense, ["query", "doc"], 1.0, 0.5)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
    return fused.withColumn("place", place).filter("place <= 10").select("query", "doc", "sparse_rank", "dense_rank", F.round("score", 6).alias("score"), "place")


_EVIDENCE = f"""{_BM25},
m AS (SELECT b.query, source, lang, doc, score FROM b JOIN documents ON doc = doc_id WHERE score > 0),
g AS (SELECT query, source, sum(CASE rn WHEN 1 THEN score WHEN 2 THEN 0.5::DOUBLE * score ELSE 0.25::DOUBLE * score END) AS graph
      FROM (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC) AS rn FROM m) WHERE rn <= 3 GROUP BY query, source),
o AS (SELECT query, source, lang, sum(CASE rn WHEN 1 THEN score WHEN 2 THEN 0.5::DOUBLE * score ELSE 0.25::DOUBLE * score END) AS own
      FROM (SELECT *, row_number() OVER (PARTITION BY query, source, lang ORDER BY score DESC) AS rn FROM m) WHERE rn <= 3 GROUP BY query, source, lang)"""


def _scored_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = lexical.bm25_scores(texts(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return scored.join(docs.select(F.col("doc_id").alias("doc"), "source", "lang"), "doc")


@query("multi_evidence", f"WITH {_EVIDENCE} SELECT query, source, round(graph, 3) AS evidence FROM g")
def multi_evidence(spark, sf_dir):
    """Each source's evidence for each item: its three best documents, with falling weights."""
    scored = fusion.evidence_score(_scored_documents(spark, sf_dir), ["query", "source"], "score")
    return scored.select("query", "source", F.round("evidence", 3).alias("evidence"))


@query("route_score", f"""WITH {_EVIDENCE},
r AS (SELECT query, source, lang, own, graph, own - coalesce(CASE WHEN row_number() OVER w = 1 THEN lead(own) OVER w ELSE first_value(own) OVER w END, own) AS margin
      FROM o JOIN g USING (query, source) WINDOW w AS (PARTITION BY query, source ORDER BY own DESC, lang))
SELECT query, source, lang, round(own + 0.35::DOUBLE * graph + 0.10::DOUBLE * (CASE WHEN lang = 'en' THEN 1 ELSE 0 END) + 0.40::DOUBLE * margin, 4) AS route FROM r""")
def route_score(spark, sf_dir):
    """(source, lang) routes by own evidence, the source's, and the margin over the source's other routes."""
    levels = fusion.evidence_levels(_scored_documents(spark, sf_dir), ["query", "source"], "lang", "score")
    routes = fusion.margin(levels, ["query", "source"], "own", "lang")
    overlap = (F.col("lang") == "en").cast("double")
    return routes.select("query", "source", "lang", F.round(fusion.route_score(F.col("own"), F.col("graph"), overlap, F.col("margin")), 4).alias("route"))


@query("diverse_routes", f"""WITH {_DENSE},
n AS (SELECT query, doc, rank, label FROM e JOIN embeddings ON doc = vec_id WHERE rank <= 64),
f AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY rank) AS k FROM n)
SELECT query, doc, label, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (k > 1)::INT, rank) AS place FROM f) WHERE place <= 8""")
def diverse_routes(spark, sf_dir):
    """Of 64 neighbours: the first of each label, then the rest by rank, eight in all."""
    from marlstone.operators import vectors

    bench, emb = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    asked = emb.join(F.broadcast(bench.select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi")
    near = vectors.nearest(asked, emb, 64).join(emb.select(F.col("vec_id").alias("doc"), "label"), "doc")
    return select.cover_then_fill(near, ["query"], "label", [F.col("rank")], 8).select("query", "doc", "label", "rank", "place")


@query("round_robin_siblings", """WITH t AS (SELECT c_nationkey AS grp, c_mktsegment AS family, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT *, row_number() OVER (PARTITION BY grp, family ORDER BY o_totalprice DESC, o_orderkey) AS depth FROM t)
SELECT grp, family, o_orderkey, depth, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY depth, family) AS place FROM d) WHERE place <= 12""")
def round_robin_siblings(spark, sf_dir):
    """Per nation, orders of each market segment in turn, dearest first."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("family"), "o_orderkey", "o_totalprice")
    turns = select.round_robin(rows, ["grp"], "family", [F.col("o_totalprice").desc(), F.col("o_orderkey")], [F.col("family")], 12)
    return turns.select("grp", "family", "o_orderkey", "depth", "place")


@query("node_diverse_topk", """WITH t AS (SELECT l_suppkey, p_brand, l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_brand ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM t)
SELECT l_suppkey, p_brand, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (k > 1)::INT, l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM f) WHERE place <= 8""")
def node_diverse_topk(spark, sf_dir):
    """Per supplier, the dearest line of each brand first, then the rest, eight in all."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return select.cover_then_fill(rows, ["l_suppkey"], "p_brand", order, 8).select("l_suppkey", "p_brand", "l_orderkey", "l_linenumber", "place")


@query("fact_budget")
def fact_budget(spark, sf_dir):
    """Twelve lines per order priority over its statuses as routes; a supplier is used once."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    status = Window.partitionBy("o_orderpriority", "o_orderstatus").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    short = rows.withColumn("fact_position", F.row_number().over(status)).filter("fact_position <= 12")
    routes = short.select("o_orderpriority", F.dense_rank().over(Window.partitionBy("o_orderpriority").orderBy("o_orderstatus")).alias("route_position"), "fact_position", F.col("l_suppkey").alias("source_id"), F.lit(1).alias("siblings"))
    return select.allocate_facts(routes, "o_orderpriority", 12)
