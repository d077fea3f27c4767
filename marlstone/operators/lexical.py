"""Lexical ranking: postings, statistics, BM25 and idf-overlap scores, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.sources.scratch import written

K1, B = 1.2, 0.75
MAX_QUERY_TF = 2
#: Query terms are few; they are broadcast below this count and joined otherwise.
BROADCAST_TERMS = 100_000
#: Pairs of a query and a document that one task sums, if every document met every query.
TASK_PAIRS = 4_000_000


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, doc_len, term, tf``; documents without tokens have none."""
    toks = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("toks"))
    each = toks.select("doc", F.size("toks").alias("doc_len"), F.explode("toks").alias("term"))
    return each.groupBy("doc", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query: str = "item_id", text: str = "text") -> DataFrame:
    """``query, term, qtf``."""
    return queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))


#: Stands among a document's tokens once, so that documents without any are counted too; no token is empty.
_MARK = ""


def _matched(docs: DataFrame, queries: DataFrame, doc: str, query: str) -> tuple[DataFrame, int, float]:
    """Postings of the queries' terms, ``doc, doc_len, n_terms, term, tf, df, query, qtf``, a row a query, and corpus totals.

    They are dealt by document to so many tasks that each sums ``TASK_PAIRS`` pairs at most, however many documents there are.

    Texts are cut into tokens once: only tokens that some query has, and a mark for each document, leave the map side, and
    what they come to is written.  Frequencies, totals and scores are read from that.
    """
    terms = query_terms(queries, query)
    wanted = written(terms.select("term").distinct().union(terms.sparkSession.createDataFrame([(_MARK,)], "term string")))
    few = wanted.count() <= BROADCAST_TERMS
    if few:
        wanted = F.broadcast(wanted)
    toks = docs.select(F.col(doc).alias("doc"), tokens(F.col("text")).alias("toks"))
    # sizes are taken before the rows are made, or they would be taken again for each
    sized = toks.select("doc", "toks", F.size("toks").alias("doc_len"), F.size(F.array_distinct("toks")).alias("n_terms"))
    each = sized.select("doc", "doc_len", "n_terms", F.explode(F.array_append("toks", F.lit(_MARK))).alias("term")).join(wanted, "term", "left_semi")
    counted = written(each.repartition("doc").groupBy("doc", "doc_len", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf")))
    marks, tf = counted.filter(F.col("term") == _MARK), counted.filter(F.col("term") != _MARK)
    total = marks.agg(F.sum("tf").alias("n"), (F.sum(F.col("doc_len") * F.col("tf")) / F.sum("tf")).alias("avg_len")).first()
    asked = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms, "term")
    n, width = total["n"] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(width, -(-n * terms.select("query").distinct().count() // TASK_PAIRS))
    met = tf.repartition(tasks, "doc").join(F.broadcast(asked), "term") if few else tf.join(asked, "term").repartition(tasks, "doc")
    return met, n, total["avg_len"] or 1.0


def top_k(scored: DataFrame, k: int, group: str, score: str, tie: str) -> DataFrame:
    """The k best rows of each group, with ``rank``; ties by ``tie``."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """``query, doc, score`` of every document with a positive score."""
    met, n, avg_len = _matched(docs, queries, doc, query)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("doc_len") / F.lit(float(avg_len))))
    part = idf * saturated * F.least(F.col("qtf"), F.lit(MAX_QUERY_TF))
    scored = met.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.filter("score > 0")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """``query, doc, score, rank`` of the k best documents with a positive score."""
    return top_k(bm25_scores(docs, queries, doc, query), k, "query", "score", "doc")


def idf_overlap(docs: DataFrame, queries: DataFrame, k: int = 5, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """Idf of shared terms times frequencies capped at 2, over the root of the document's distinct terms."""
    met, n, _ = _matched(docs, queries, doc, query)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.least(F.col("tf"), F.lit(2)) * F.least(F.col("qtf"), F.lit(2))
    summed = met.groupBy("query", "doc").agg(F.sum(part).alias("total"), F.max("n_terms").alias("n_terms"))
    scored = summed.select("query", "doc", F.round(F.col("total") / F.sqrt(F.col("n_terms")), 6).alias("score"))
    return top_k(scored, k, "query", "score", "doc")


def candidate_score(position: Column, compatibility: Column, label_overlap: Column, sources: Column) -> Column:
    """The upstream rank as a prior, plus lexical compatibility, label overlap and a little for more sources."""
    return 0.35 / (5.0 + position) + F.greatest(compatibility, F.lit(0.0)) + 0.35 * label_overlap + 0.015 * F.least(sources, F.lit(4))


def length_weight(n_tokens: Column) -> Column:
    """1 up to 64 tokens, falling with the root of the length beyond."""
    return 1 / F.sqrt(F.greatest(F.greatest(n_tokens, F.lit(1)) / 64.0, F.lit(1.0)))


def blank_tokens(text: Column) -> Column:
    """Pieces of a text, each a word with the blanks before it."""
    return F.regexp_extract_all(text, F.lit(r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+"), F.lit(0))


def chunk_plan(docs: DataFrame, doc: str, text: str, most: int, pieces=blank_tokens, reserved: int = 2) -> DataFrame:
    """``doc, chunk, n_tokens, weight, body``: a text in chunks of ``most - reserved`` tokens, in order, that join to the whole text.

    ``pieces`` cuts a text into tokens that stand one after another from its start; what follows the last belongs to the last chunk.
    ``weight`` is the chunk's share of the tokens, for a mean over chunks.  A text without tokens is one chunk; null texts have none.
    """
    room = most - reserved
    if room < 1:
        raise ValueError("no room for a token")
    cut = docs.filter(F.col(text).isNotNull()).select(doc, F.col(text).alias("__t"), pieces(F.col(text)).alias("__p"))
    n = F.greatest(F.ceil(F.size("__p") / room), F.lit(1)).cast("int")
    each = cut.withColumn("__n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("chunk"))
    own = F.slice("__p", F.col("chunk") * room + 1, F.lit(room))
    rest = F.when(F.col("chunk") == F.col("__n") - 1, F.substring("__t", F.length(F.array_join("__p", "")) + 1, F.length("__t"))).otherwise("")
    return each.select(doc, "chunk", F.size(own).alias("n_tokens"), (F.size(own) / F.greatest(F.size("__p"), F.lit(1))).alias("weight"), F.concat(F.array_join(own, ""), rest).alias("body"))
