"""Queries on the embedding vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import vectors
from marlstone.plans.registry import query, table

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_ASKED = "SELECT * FROM embeddings WHERE vec_id % 100 = 0"


def _asked(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 100 == 0)


@query("cosine_topk", f"""SELECT query, doc, score, rank FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank
FROM (SELECT q.vec_id AS query, v.vec_id AS doc, round({_COS}, 6) AS score FROM ({_ASKED}) q, embeddings v)) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    return vectors.nearest(_asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10)


_POOLED = f"""p AS (SELECT q.label AS query, v.vec_id AS doc, max({_COS}) AS top, avg({_COS}) AS mean FROM ({_ASKED}) q, embeddings v GROUP BY 1, 2)"""


def _pooled(spark, sf_dir):
    """Per query label and vector: the highest and the mean cosine over the label's query vectors."""
    return vectors.pooled(_asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), "label")


@query("pooled_nn", f"WITH {_POOLED} SELECT query, doc, top, mean, rank FROM (SELECT query, doc, round(top, 6) AS top, round(mean, 6) AS mean, row_number() OVER (PARTITION BY query ORDER BY round(top, 6) DESC, round(mean, 6) DESC, doc) AS rank FROM p) WHERE rank <= 8")
def pooled_nn(spark, sf_dir):
    p = _pooled(spark, sf_dir).select("query", "doc", F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"))
    order = Window.partitionBy("query").orderBy(F.col("top").desc(), F.col("mean").desc(), "doc")
    return p.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")


@query("hubness_adjusted", f"""WITH {_POOLED},
u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS unit FROM embeddings),
c AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(unit) AS x, unnest(range(len(unit))) AS pos FROM u) GROUP BY pos)),
h AS (SELECT vec_id AS doc, list_dot_product(unit, mean) AS hubness FROM u, c)
SELECT query, doc, adjusted, rank FROM (SELECT query, doc, adjusted, row_number() OVER (PARTITION BY query ORDER BY adjusted DESC, doc) AS rank
FROM (SELECT query, doc, round(top - 0.15::DOUBLE * hubness + 0.10::DOUBLE * (top - mean), 6) AS adjusted FROM p JOIN h USING (doc))) WHERE rank <= 8""")
def hubness_adjusted(spark, sf_dir):
    """Pooled neighbours, less a share of their hubness, plus a share of their margin over the mean."""
    hub = vectors.hubness(table(spark, sf_dir, "embeddings")).withColumnRenamed("vec_id", "doc")
    adjusted = F.col("top") - 0.15 * F.col("hubness") + 0.10 * (F.col("top") - F.col("mean"))
    scored = _pooled(spark, sf_dir).join(hub, "doc").select("query", "doc", F.round(adjusted, 6).alias("adjusted"))
    order = Window.partitionBy("query").orderBy(F.col("adjusted").desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")


@query("label_centroid", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings) GROUP BY label, pos")
def label_centroid(spark, sf_dir):
    c = vectors.centroid(table(spark, sf_dir, "embeddings"), ["label"])
    return c.select("label", "pos", F.round("mean", 6).alias("mean"))


@query("weighted_mean_vec", """WITH e AS (SELECT label, greatest(vec_id % 7, 1)::DOUBLE AS w, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings),
m AS (SELECT label, pos, sum(x * w) / sum(w) AS m FROM e GROUP BY label, pos)
SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m""")
def weighted_mean_vec(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").withColumn("weight", F.col("vec_id") % 7)
    return vectors.weighted_mean(emb, ["label"], "weight").select("label", "pos", F.round("x", 6).alias("x"))


@query("recall_at_k", f"""WITH n AS (SELECT query, doc, rank FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank
FROM (SELECT q.vec_id AS query, v.vec_id AS doc, round({_COS}, 6) AS score FROM ({_ASKED}) q, embeddings v)) WHERE rank <= 9),
h AS (SELECT n.query, max((rank <= 4 AND a.label = b.label AND n.query <> n.doc)::INT) AS at3, max((a.label = b.label AND n.query <> n.doc)::INT) AS at8 FROM n JOIN embeddings a ON n.query = a.vec_id JOIN embeddings b ON n.doc = b.vec_id GROUP BY n.query)
SELECT count(*) AS queries, round(avg(at3), 6) AS recall_3, round(avg(at8), 6) AS recall_8, avg(at3) >= 0.75 AS gate_3, avg(at8) >= 0.80 AS gate_8 FROM h""")
def recall_at_k(spark, sf_dir):
    """How often a neighbour of the same label is among the first three and eight, and two gates on that."""
    emb = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(_asked(spark, sf_dir), emb, 9)
    labels = emb.select(F.col("vec_id").alias("doc"), F.col("label").alias("doc_label"))
    asked = _asked(spark, sf_dir).select(F.col("vec_id").alias("query"), "label")
    same = (F.col("label") == F.col("doc_label")) & (F.col("query") != F.col("doc"))
    hits = near.join(labels, "doc").join(F.broadcast(asked), "query").groupBy("query").agg(F.max((same & (F.col("rank") <= 4)).cast("int")).alias("at3"), F.max(same.cast("int")).alias("at8"))
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("at3"), 6).alias("recall_3"), F.round(F.avg("at8"), 6).alias("recall_8"), (F.avg("at3") >= 0.75).alias("gate_3"), (F.avg("at8") >= 0.80).alias("gate_8"))
