"""Rank fusion, evidence scores per group, and margins between routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import diminishing

RRF_CONSTANT = 20.0


def reciprocal_rank(rank: Column, weight: float = 1.0, constant: float = RRF_CONSTANT) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(constant) + rank), F.lit(0.0))


def rrf(sparse: DataFrame, dense: DataFrame, keys: list[str], sparse_weight: float = 1.0, dense_weight: float = 1.0) -> DataFrame:
    """Full outer join of two rankings on ``keys``; a missing rank adds nothing."""
    a, b = sparse.select(*keys, F.col("rank").alias("sparse_rank")), dense.select(*keys, F.col("rank").alias("dense_rank"))
    return a.join(b, keys, "full").withColumn("score", reciprocal_rank(F.col("sparse_rank"), sparse_weight) + reciprocal_rank(F.col("dense_rank"), dense_weight))


def evidence_score(scored: DataFrame, by: list[str], score: str, out: str = "evidence") -> DataFrame:
    """Diminishing sum of each group's three best scores.

    Ranks prune to three rows a group before anything is collected, so a group of any size is bounded.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc())
    top = scored.filter(F.col(score) > 0).withColumn("__r", F.row_number().over(order)).filter("__r <= 3")
    return top.groupBy(*by).agg(diminishing(F.collect_list(score)).alias(out))


def evidence_levels(scored: DataFrame, by: list[str], sub: str, score: str, whole: str = "graph", own: str = "own") -> DataFrame:
    """``by..., sub, own, whole``: the diminishing sums of each ``sub`` and of all of its ``by``, in one pass.

    The three best of a group are among the three best of its parts, so rows are dealt by ``by`` once, pruned to three a part, and
    both sums come from these.
    """
    order = Window.partitionBy(*by, sub).orderBy(F.col(score).desc())
    width = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.filter(F.col(score) > 0).select(*by, sub, score).repartition(width, *by)
    parts = dealt.withColumn("__r", F.row_number().over(order)).filter("__r <= 3").groupBy(*by, sub).agg(F.collect_list(score).alias("__s"))
    every = F.flatten(F.collect_list("__s").over(Window.partitionBy(*by)))
    return parts.withColumn("__all", every).select(*by, sub, diminishing(F.col("__s")).alias(own), diminishing(F.col("__all")).alias(whole))


def margin(scored: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """Add ``margin``: own score less the best other of the group, 0 if there is none."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    ranked = scored.withColumn("__r", F.row_number().over(order)).withColumn("__next", F.lead(score).over(order))
    best = F.first(score).over(order)
    other = F.when(F.col("__r") == 1, F.col("__next")).otherwise(best)
    return ranked.withColumn("margin", F.coalesce(F.col(score) - other, F.lit(0.0))).drop("__r", "__next")


def route_score(own: Column, graph: Column, overlap: Column, margin_: Column) -> Column:
    """Own evidence, with weights for the graph's, the label's overlap and the margin."""
    return own + 0.35 * graph + 0.10 * overlap + 0.40 * margin_
