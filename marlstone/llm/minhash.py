"""Near duplicates by MinHash: fast similarity sketches, banding, and exact verification on whole shingle sets.

A sketch has ``COORDINATES`` coordinates, filled in rounds.  In each of the first ``COORDINATES`` rounds every
shingle is hashed to one coordinate and offers its value there, in each of the rest all shingles are offered to the one
coordinate of that round, so all are filled; earlier rounds win, and the sketch ends with the first
round after which none is empty.  Two sets agree in a coordinate as often as they are similar, with
the concentration of independent draws, at a cost of about ``t log t + n`` instead of ``t n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import tidy
from marlstone.llm.common import materialize, maybe_broadcast, settled
from marlstone.llm.simhash import CELL, _whole_groups, components, shingles_of, text_key

WORDS = 2
LEAST_PERCENT = 80
#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 28, about 4e-7; a more similar one is missed more rarely.
BANDS, BAND_ROWS = 28, 4
COORDINATES = BANDS * BAND_ROWS
#: Bands that take part in each round of stars; the last has all.
ROUNDS = (4, 12, BANDS)
#: A bucket's name ends in its band.
_BAND_BITS = 5
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def sketch_of(s: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The ``t`` coordinates of the set of hashes ``s``, which isn't empty: round and value of each winner."""
    out = np.full(t, _FULL, np.uint64)
    at = 0
    while at < 2 * t:
        rounds = np.arange(at, min(2 * t, at + 1 + 4 * t // len(s)), dtype=np.uint64)[:, None]
        h = _mixed(s[None, :] + (rounds + np.uint64(1)) * _ODD)
        place = np.where(rounds < t, ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32), rounds % np.uint64(t))
        np.minimum.at(out, place.ravel().astype(np.int64), ((rounds << np.uint64(32)) | (h >> np.uint64(32))).ravel())
        at += len(rounds)
        if (out != _FULL).all():
            break
    return out


def buckets_of(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A hash of each band's coordinates that ends in the band's number."""
    bands = sketch.reshape(-1, rows)
    at = np.arange(len(bands), dtype=np.uint64)
    h = (at + np.uint64(1)) * _ODD
    for k in range(rows):
        h = _mixed(h + bands[:, k])
    return (h << np.uint64(_BAND_BITS)) | at


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes."""
    at = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(np.bitwise_xor.reduce(_mixed(s + at * _ODD), initial=np.uint64(len(s))))


def parity_of(s: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of the hashes ``s`` fall on each; four to eight a hash, a power of two and at least 64."""
    bits = 1 << max(6, (4 * len(s) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketched(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``doc_id, n, key, text_key, buckets`` of every row: set size, set key, text key and 64-bit bucket names.

    Of rows without words n is 0, and key and buckets are null.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}  # copies often lie together

        def of(name: int, body: bytes) -> tuple:
            if name not in last:
                if len(last) >= 256:
                    last.clear()
                s = shingles_of(body, words)
                last[name] = (len(s), set_key(s), buckets_of(sketch_of(s)).tobytes()) if len(s) else (0, None, None)
            return last[name]

        for b in batches:
            rows = [of(k.as_py(), t.as_py()) for k, t in zip(b.column("text_key"), b.column("text"))]
            n, key, buckets = zip(*rows) if rows else ((),) * 3
            keys = pa.array([k if k is None or k < 1 << 63 else k - (1 << 64) for k in key], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), keys, b.column("text_key"), pa.array(buckets, pa.binary())], ["doc_id", "n", "key", "text_key", "buckets"])

    return plain.mapInArrow(tidy(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n long, key long, text_key long, buckets binary")


def banded(nodes: DataFrame) -> DataFrame:
    """``bucket, key``: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 2048) for at in range(0, b.num_rows, 2048)):
                buckets = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.repeat(part.column(0).to_numpy(), len(buckets) // part.num_rows))], ["bucket", "key"])

    return nodes.select("key", "buckets").mapInArrow(tidy(run), "bucket long, key long")


def with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the ``root`` of each key, itself if it has no other."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    return members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def several(rooted: DataFrame, turn: int) -> DataFrame:
    """``bucket, pivot, pivot_root`` of the buckets with several roots; the pivot is the node of the smallest hash."""
    first = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "root")).alias("pivot")
    found = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), first)
    return materialize(found.filter("low < high").select("bucket", F.col("pivot.key").alias("pivot"), F.col("pivot.root").alias("pivot_root")))


def whole_texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``key, text``: a text of each of the nodes ``wanted`` (key, text_key)."""
    plain = docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found = plain.join(wanted.hint("merge"), "text_key").dropDuplicates(["text_key"])
    return materialize(found.select("key", "text"))


def _shared_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 times what both sets hold is at least 80 times what either does."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * LEAST_PERCENT:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= (len(a) + len(b) - both) * LEAST_PERCENT


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, all_texts: bool, cell: int = CELL) -> DataFrame:
    """``u, v, linked`` of each pair: whether the whole sets of both texts share enough.

    A text goes once to the v of each of its pairs, and once to its own as a v.  A v of more than ``cell`` pairs is dealt to several
    cells, each with a copy of its text; a cell's rows come with v's text first, of which the set is kept.
    ``all_texts`` says that most texts have a pair, so they are not looked up by a broadcast.
    """
    cuts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / cell).cast("long").alias("cuts"))
    dealt = pairs.join(materialize(cuts), "v").withColumn("cell", F.pmod(F.xxhash64("u"), F.col("cuts")))
    members = dealt.select(F.col("u").alias("key"), "v", "cell", F.lit(True).alias("member"))
    own = cuts.select(F.col("v").alias("key"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cell"), F.lit(False).alias("member"))
    roles = materialize(members.union(own))
    wanted = roles.hint("merge") if all_texts else maybe_broadcast(roles, roles.count())
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.join(wanted, "key").select("v", "cell", "member", "key", "text").repartition(width, "v", "cell").sortWithinPartitions("v", "cell", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for b in batches:
            told: tuple[list, list, list] = [], [], []
            for v, member, u, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                s = shingles_of(text.as_py(), words)
                if member:
                    for column, x in zip(told, (u, v, _shared_enough(s, first))):
                        column.append(x)
                else:
                    first = s
            yield pa.RecordBatch.from_arrays([pa.array(told[0], pa.int64()), pa.array(told[1], pa.int64()), pa.array(told[2], pa.bool_())], ["u", "v", "linked"])

    return materialize(rows.mapInArrow(tidy(run), "u long, v long, linked boolean"))


def marked_texts(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``key, n, parity`` of the texts of the nodes ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(parity_of, sets), pa.binary())], ["key", "n", "parity"])

    own = texts.join(maybe_broadcast(wanted, wanted.count()), "key", "left_semi")
    return materialize(own.select("key", "text").mapInArrow(tidy(run), "key long, n long, parity binary"))


class _Parities:
    """Parities of a run of rows, those of one length in one matrix."""

    def __init__(self, parities: list[bytes]) -> None:
        self.lengths = np.array([len(p) // 8 for p in parities])
        self.at, self.rows = np.zeros(len(parities), np.int64), {}
        for size in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == size)
            self.at[own] = np.arange(len(own))
            self.rows[size] = np.frombuffer(b"".join(parities[k] for k in own), np.uint64).reshape(len(own), size)

    def differing(self, x: int, y: np.ndarray) -> np.ndarray:
        """How many parity bits of row x and each of the rows y differ; the longer of two is folded to the shorter's length."""
        out = np.empty(len(y), np.int64)
        for size in np.unique(self.lengths[y]):
            some = np.flatnonzero(self.lengths[y] == size)
            theirs, own = self.rows[size][self.at[y[some]]], self.rows[self.lengths[x]][self.at[x]]
            while theirs.shape[1] > len(own):
                theirs = theirs[:, : theirs.shape[1] // 2] ^ theirs[:, theirs.shape[1] // 2 :]
            while len(own) > theirs.shape[1]:
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]
            out[some] = np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64)
        return out


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots whose sizes and parities allow 0.8, of rows sorted by cell; equal sides but 0 meet elsewhere.

    A pair comes from the first band that it shares.  Each parity bit that differs takes a shingle that only one set has,
    so no pair that shares enough is passed over.
    """
    for cell, bucket, key, root, n, side, buckets, parities in _whole_groups(batches, 4 * CELL):
        names = np.frombuffer(b"".join(buckets), np.int64).reshape(len(buckets), -1)
        bits = _Parities(list(parities))
        band = bucket & ((1 << _BAND_BITS) - 1)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for low, high in zip(starts, [*starts[1:], len(cell)]):
            found = []
            for x in range(low, high - 1):
                y = np.arange(x + 1, high)
                y = y[(root[y] != root[x]) & ((side[y] != side[x]) | (side[x] == 0)) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * LEAST_PERCENT)]
                y = y[(names[y] == names[x]).argmax(axis=1) == band[x]] if len(y) else y
                y = y[bits.differing(x, y) * (100 + LEAST_PERCENT) <= (n[y] + n[x]) * (100 - LEAST_PERCENT)] if len(y) else y
                if len(y):
                    found.append(np.stack([np.full(len(y), key[x]), key[y]]))
            if found:
                u, v = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def left_over(members: DataFrame, roots: DataFrame | None, nodes: DataFrame, texts: DataFrame, words: int, cell: int = CELL) -> DataFrame:
    """All pairs ``u, v`` of different roots that share a bucket and may share enough.

    A bucket of more than ``cell`` rows is dealt to a triangular grid of cells, in which each two rows meet once.
    """
    rooted = with_roots(members, roots)
    found = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high")
    cuts = materialize(found.select("bucket", F.ceil(F.col("rows") / cell).cast("long").alias("cuts")))
    own = materialize(rooted.join(cuts, "bucket"))
    marks = marked_texts(texts, own.select("key").distinct(), words).join(nodes.select("key", "buckets"), "key")
    dealt = own.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    side = F.when(F.col("other") == F.col("mine"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side")
    name = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")
    rows = dealt.select(name, "bucket", "key", "root", side).join(materialize(marks), "key").select("cell", "bucket", "key", "root", "n", "side", "buckets", "parity")
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(tidy(_possible), "u long, v long")
    return met.distinct()


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, cell: int = CELL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    A document's set has its distinct ``words``-word shingles, A-Z lower-cased; with fewer words, the whole sequence as
    one.  Sets that share at least 0.8 of all their shingles are linked, and so are equal ones; candidates
    share a band of their sketches, and whole sets decide.  A null or blank text has an empty set and no link.
    ``component_id`` is the smallest id reachable.  Rows without an id take part; they get the smallest id of
    their component, null if it has none, and are then kept.  Repeated rows get one answer each; no rows give none.

    Rounds of stars come first: each bucket's nodes are paired with one pivot, confirmed links are
    contracted, and buckets within one component drop out, so a group of copies gives pairs in proportion to its size.
    What is left of each bucket is then compared by parities, all pairs between components, and confirmed.
    """
    marked = linked(docs, doc_id, text, words, cell)
    lowest = materialize(marked.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    found = marked.filter("root is not null").join(lowest, "root").select("doc_id", "n", "component_id")
    out = found.unionByName(marked.filter("root is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, cell: int = CELL) -> DataFrame:
    """``doc_id, n, text_key, root`` of every row: set size, the text's key, and a long that is the same throughout a component.

    Links are those of ``near_components``; rows without words have no root.
    """
    return settled(docs.sparkSession, lambda: _linked(docs, doc_id, text, words, cell))


def _linked(docs: DataFrame, doc_id: str, text: str, words: int, cell: int) -> DataFrame:
    marked = materialize(sketched(docs, doc_id, text, words))
    nodes = materialize(marked.filter("key is not null").groupBy("key").agg(F.min("text_key").alias("text_key"), F.first("buckets").alias("buckets")))
    every = banded(nodes)
    shared = materialize(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    members = materialize(every.join(shared, "bucket"))
    wanted = materialize(members.select("key").distinct().join(nodes.select("key", "text_key"), "key"))
    texts = whole_texts(docs, wanted, text)
    roots, refused = None, None
    for turn, width in enumerate(ROUNDS):
        rooted = with_roots(members.filter(F.col("bucket").bitwiseAND((1 << _BAND_BITS) - 1) < width), roots)
        met = materialize(rooted.join(several(rooted, turn), "bucket"))
        pairs = met.filter("root <> pivot_root").select(F.col("key").alias("u"), F.col("pivot").alias("v")).distinct()
        roots, refused = _joined(pairs, texts, words, roots, refused, turn == 0)
        members = met.select("bucket", "key") if width == BANDS else members
    roots, _ = _joined(left_over(members, roots, nodes, texts, words, cell), texts, words, roots, refused)
    rooted = materialize(with_roots(nodes.select("key"), roots))
    return marked.join(rooted, "key", "left").select("doc_id", "n", "text_key", "root")


def _joined(pairs: DataFrame, texts: DataFrame, words: int, roots: DataFrame | None, refused: DataFrame | None, all_texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Components with the confirmed ones of ``pairs``, and all pairs refused so far, either way round, which are not asked again."""
    fresh = pairs if refused is None else pairs.join(refused, ["u", "v"], "left_anti")
    told = confirmed(materialize(fresh), texts, words, all_texts)
    links, no = told.filter("linked").select("u", "v"), told.filter("not linked").select("u", "v")
    no = no.union(no.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if roots is not None:
        links = links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return components(links), no if refused is None else refused.union(no)
