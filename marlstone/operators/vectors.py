"""Vector search: exact nearest neighbours, hubness, pooling, centroids, weighted means.

The corpus is read once in its own partitions; only the queries move, in a broadcast whose size is
checked (queries x dimensions), else in blocks.  Each corpus partition keeps its k best per query
before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.functions.numeric import norm

#: Queries of one broadcast (bounded: block x dimensions), and of one matrix product.
QUERY_BLOCK, PRODUCT = 32_768, 1024
#: Scores that a task of ``nearest`` holds at once.
CELLS = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", decimals: int = 6) -> DataFrame:
    """``query, doc, score, rank``: the k corpus vectors of highest cosine for each query vector.

    Scores are rounded, ties go to the smaller id.  Queries come in blocks; per corpus batch a block
    is one matrix product, of which k rows a query leave the task.
    """
    blocks = queries.select(F.col(vec_id).alias("query"), F.col(vector).alias("v")).toLocalIterator()
    spark, found, block = queries.sparkSession, None, []

    def search(rows: list) -> DataFrame:
        ids = np.array([r["query"] for r in rows], np.int64)
        mat = np.array([r["v"] for r in rows], np.float64)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for b in batches:
                m = _matrix(b.column(1))
                if not len(m):
                    continue
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                own = b.column(0).to_numpy()
                by_id = np.argsort(own, kind="stable")
                step = max(1, min(PRODUCT, CELLS // len(m)))
                for at in range(0, len(q), step):
                    scores = np.round(q[at : at + step] @ m.T, decimals)[:, by_id]
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    cols = [np.repeat(q_ids[at : at + step], best.shape[1]), own[by_id][best].ravel(), np.take_along_axis(scores, best, 1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "doc", "score"])

        return corpus.select(vec_id, vector).mapInArrow(run, "query long, doc long, score double")

    for r in blocks:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part = search(block)
            found, block = part if found is None else found.union(part), []
    if block or found is None:
        part = search(block) if block else corpus.limit(0).select(F.col(vec_id).alias("query"), F.col(vec_id).alias("doc"), F.lit(0.0).alias("score"))
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, *columns: str) -> Iterator[list]:
    """Rows of the queries, ``QUERY_BLOCK`` at a time."""
    block: list = []
    for r in queries.select(*columns).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def pooled(queries: DataFrame, corpus: DataFrame, group: str, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, doc, top, mean``: for each group of query vectors, the highest and the mean cosine of every corpus vector.

    A block of queries is broadcast; each task makes the products and keeps one row a group and vector, so as many rows
    leave it as there are groups, not queries.  Null groups are left out.
    """
    spark, kind = queries.sparkSession, queries.schema[group].dataType.simpleString()
    arrow = to_arrow_type(queries.schema[group].dataType)
    found = None
    for rows in _query_blocks(queries.filter(F.col(group).isNotNull()), group, vector):
        names = sorted({r[group] for r in rows})
        at = {g: k for k, g in enumerate(names)}
        of = np.array([at[r[group]] for r in rows])
        mat = np.array([r[vector] for r in rows], np.float64)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
        order = np.argsort(of, kind="stable")
        shared = spark.sparkContext.broadcast((names, np.searchsorted(of[order], np.arange(len(names))), np.bincount(of), mat[order]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, starts, sizes, q = shared.value
            for b in batches:
                m = _matrix(b.column(1))
                if not len(m):
                    continue
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                for low in range(0, len(m), PRODUCT):
                    scores = q @ m[low : low + PRODUCT].T
                    n = scores.shape[1]
                    top, total = np.maximum.reduceat(scores, starts, axis=0), np.add.reduceat(scores, starts, axis=0)
                    docs = np.tile(b.column(0).to_numpy()[low : low + PRODUCT], len(names))
                    groups = pa.array(names, arrow).take(pa.array(np.repeat(np.arange(len(names)), n)))
                    yield pa.RecordBatch.from_arrays([groups, pa.array(docs), pa.array(top.ravel()), pa.array(total.ravel()), pa.array(np.repeat(sizes, n).astype(np.int64))], ["query", "doc", "top", "total", "n"])

        part = corpus.select(vec_id, vector).mapInArrow(run, f"query {kind}, doc long, top double, total double, n long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"query {kind}, doc long, top double, mean double")
    one = F.col("n") > 0  # blocks of one group meet again; a single block needs no shuffle
    merged = found if queries.filter(F.col(group).isNotNull()).count() <= QUERY_BLOCK else found.groupBy("query", "doc").agg(F.max("top").alias("top"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return merged.filter(one).select("query", "doc", "top", (F.col("total") / F.col("n")).alias("mean"))


def positions(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row per component: ``pos`` and ``x`` (double) beside the other columns."""
    return df.select("*", F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double")).drop(vector)


def centroid(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group, one row per component: ``by..., pos, mean``."""
    return positions(df.select(*by, vector), vector).groupBy(*by, "pos").agg(F.avg("x").alias("mean"))


def weighted_mean(df: DataFrame, by: list[str], weight: str, vector: str = "embedding") -> DataFrame:
    """Weighted mean of each group's vectors, scaled to length 1: ``by..., pos, x``; weights are at least 1."""
    w = F.greatest(F.col(weight), F.lit(1)).cast("double")
    means = positions(df.select(*by, w.alias("__w"), vector), vector).groupBy(*by, "pos").agg((F.sum(F.col("x") * F.col("__w")) / F.sum("__w")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*by)))
    return means.select(*by, "pos", F.try_divide(F.col("m"), length).alias("x"))


def unit_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    n = norm(F.col(vector))
    return df.filter(n > 0).select(vec_id, F.transform(vector, lambda x: x.cast("double") / n).alias("unit"))


def hubness(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, hubness``: each unit vector's product with the mean of all unit vectors.

    The mean is one vector; it is computed by component and then held as a literal of fixed size.
    """
    units = unit_vectors(df, vec_id, vector)
    mean = [r["mean"] for r in centroid(units, [], "unit").orderBy("pos").collect()]
    products = F.zip_with("unit", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a * b)
    return units.select(vec_id, F.aggregate(products, F.lit(0.0), lambda s, x: s + x).alias("hubness"))
