"""Hard-negative mining: exact inner products of blocks of anchors with all rows.

A block of anchors is broadcast, its size bounded in bytes, and multiplied with each batch of rows where it lies.
Products of floored components are whole numbers, exact in float64 below 2^53.  The first pass keeps
each anchor's best positives; the second, which knows their scores, its best negatives in each positive's window.
Both keep lists of a fixed length that merge, within a task as across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.batches import tidy
from marlstone.llm.common import freed_shuffles, materialize, scratch_dir
from marlstone.sources.readers import spread

#: Bytes of anchor vectors in one broadcast, and scores of one product.
BLOCK_BYTES, PRODUCT = 16 << 20, 1 << 20
SCALE = 256.0
#: Scores beyond this count as this; a hundred times it still fits a long.
MOST = 1 << 56
TOP = 5
#: A negative's score is at least this share, in percent, of the positive's.
LEAST = 80
_PAIRS = "anchor_id long, positive_id long, positive_score long, id long, score long"


def usable(vectors: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, label, v`` of the rows that take part: those with an id, a label and finite components only."""
    whole = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & whole)
    return rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v")).filter(F.col("label").isNotNull())


def floored(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``floor(256 * x)``, cut or filled with zeros to ``width`` components."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for k, at in enumerate(np.cumsum(lengths) - lengths):
        n = min(lengths[k], width)
        out[k, :n] = flat[at : at + n]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, as longs: in float64 where no sum can reach 2^53, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * np.abs(a).max() * np.abs(b).max() < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


class Best:
    """The first ``TOP`` entries of each slot by score, highest first, then id; an id counts once, at its highest score."""

    def __init__(self, slots: int) -> None:
        none = np.zeros(0, np.int64)
        self.rows, self.least = (none, none, none), np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        fits = score >= self.least[slot]
        if not fits.any():
            return
        slot, score, ident = (np.concatenate([old, new[fits]]) for old, new in zip(self.rows, (slot, score, ident)))
        order = np.lexsort((-score, ident, slot))
        s, i = slot[order], ident[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        order = order[first]
        order = order[np.lexsort((ident[order], -score[order], slot[order]))]
        s = slot[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        order = order[place < TOP]
        self.rows = slot[order], score[order], ident[order]
        last = order[place[place < TOP] == TOP - 1]
        self.least[slot[last]] = score[last]


def _scored(batches: Iterator[pa.RecordBatch], m: np.ndarray) -> Iterator[tuple]:
    """For each piece of a product of all anchors ``m`` with the rows: the first anchor's place, scores, ids, labels."""
    for b in batches:
        if not b.num_rows or not len(m):
            continue
        ids, labels, own = b.column(0).to_numpy(), b.column(1).to_numpy(), floored(b.column(2), m.shape[1])
        step = max(1, PRODUCT // b.num_rows)
        for at in range(0, len(m), step):
            yield at, products(m[at : at + step], own), ids, labels


def positives(rows: DataFrame, block) -> DataFrame:
    """``anchor_id, id, score, rank``: the first rows of each anchor's label, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, own, m = block.value
        best = Best(len(anchors))
        for at, scores, ids, labels in _scored(batches, m):
            to = at + len(scores)
            a, b = np.nonzero((own[at:to, None] == labels) & (anchors[at:to, None] != ids) & (scores >= best.least[at:to, None]))
            best.add(a + at, scores[a, b], ids[b])
        slot, score, ident = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[slot], ident, score)], ["anchor_id", "id", "score"])

    return _first(rows.mapInArrow(tidy(run), "anchor_id long, id long, score long"), ["anchor_id"])


def negatives(rows: DataFrame, block, known) -> DataFrame:
    """``anchor_id, positive_id, positive_score, id, score, rank``: the first rows of other labels in each positive's window.

    ``known`` holds the ids and scores of each anchor's positives, and how many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, own, m = block.value
        p_ids, p_scores, several = known.value
        there = np.arange(TOP) < several[:, None]
        low = np.where(there, -(-LEAST * p_scores // 100), np.iinfo(np.int64).max)
        high = np.where(there, p_scores, np.iinfo(np.int64).min)
        best = Best(len(anchors) * TOP)
        for at, scores, ids, labels in _scored(batches, m):
            to = at + len(scores)
            inside = (scores >= low[at:to].min(axis=1)[:, None]) & (scores <= high[at:to].max(axis=1)[:, None])
            a, b = np.nonzero(inside & (own[at:to, None] != labels))
            s = scores[a, b]
            a += at
            for j in range(TOP):
                fits = (s >= low[a, j]) & (s <= high[a, j])
                best.add(a[fits] * TOP + j, s[fits], ids[b[fits]])
        slot, score, ident = best.rows
        a, j = slot // TOP, slot % TOP
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[a], p_ids[a, j], p_scores[a, j], ident, score)], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    return _first(rows.mapInArrow(tidy(run), _PAIRS), ["anchor_id", "positive_id", "positive_score"])


def _first(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first ``TOP`` of each of ``keys``, from the lists of all tasks; dealt by anchor once."""
    one = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor_id").groupBy(*keys, "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def _blocks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the anchors, ``BLOCK_BYTES`` at a time."""
    held: list = []
    width = 0

    def block():
        vectors = pa.array([r["v"] for r in held], pa.list_(pa.float64()))
        return np.array([r["id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), floored(vectors, width)

    for r in anchors.toLocalIterator():
        if held and (len(held) + 1) * 8 * max(width, len(r["v"])) > BLOCK_BYTES:
            yield block()
            held, width = [], 0
        held.append(r)
        width = max(width, len(r["v"]))
    if held:
        yield block()


def mine(rows: DataFrame, asked: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows ``asked`` of ``usable`` rows.

    Scores are inner products of ``floor(256 * x)``; the shorter of two vectors is filled with zeros, so an empty one
    scores 0.  An anchor's positives are its first five other rows of its label; each has the first five
    rows of other labels whose score is from 80 % of its own to its own.  Ties go to the smaller id.
    Rows are told apart by id: of candidates of one id the one that scores highest counts, of anchors of one id the one of
    the smallest label and vector, and none is a candidate for itself.  A positive without negatives has no row; no rows give none.
    Only blocks of anchors, with five positives each, pass through the driver.
    """
    spark = rows.sparkSession
    anchors = materialize(rows.filter(asked).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    rows = spread(rows)
    found = []
    for ids, labels, m in _blocks(anchors):
        block = spark.sparkContext.broadcast((ids, labels, m))
        with freed_shuffles(spark):
            told = positives(rows, block).toArrow()
        at = np.searchsorted(ids[by := np.argsort(ids)], told["anchor_id"].to_numpy())
        a, j = by[at], told["rank"].to_numpy() - 1
        p_ids, p_scores, several = np.zeros((len(ids), TOP), np.int64), np.zeros((len(ids), TOP), np.int64), np.bincount(a, minlength=len(ids))
        p_ids[a, j], p_scores[a, j] = told["id"].to_numpy(), told["score"].to_numpy()
        known = spark.sparkContext.broadcast((p_ids, p_scores, several))
        path = scratch_dir(spark)
        with freed_shuffles(spark):
            negatives(rows, block, known).write.parquet(path)
        found.append(path)
        block.destroy()
        known.destroy()
    names = ("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    schema = f"{_PAIRS}, rank int"
    out = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return out.select(*names)
