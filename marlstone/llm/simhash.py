"""SimHash fingerprints and their near-duplicate components by the generalised pigeonhole principle.

Bits that vary together are grouped into m partitions.  Two fingerprints within ``radius`` bits differ
by at most t_i bits in some partition i, for any integer thresholds t_i >= -1 with sum
``radius - m + 1``; -1 leaves a partition out.  Each fingerprint picks its own thresholds by dynamic
programming on estimated candidate counts, probes the values within t_i of its own in partition i,
and candidates are verified on all 64 bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import Memo, held, tidy, word_lists
from marlstone.llm.common import BROADCAST_ROWS, freed_shuffles, let, lower_ascii, materialize, maybe_broadcast, null_safe, settled, word_array

BITS = 64
RADIUS = 3
SHINGLE_WORDS = 3
#: Fingerprints of one bucket that one cell compares; larger buckets are cut into a grid of cells.
CELL = 4096
#: So many links, 16 bytes each, one task joins at once.
ONE_TASK = 1 << 20
_PIECE = 11
_SEED = 42
#: A probe is a row that is shuffled and sorted, about a microsecond; comparing a candidate takes 10 ns.
_PROBE_COST = 100.0
#: Thresholds that would probe more values of one partition than this are never chosen.
_MOST_PROBES = 100_000
#: Bits of a text's parity; up to about twice as many shingles they tell texts apart before these are compared whole.
PARITY = 1024
#: Shingles are ordered by how often about so many documents hold them; the order affects time, not results.
_SAMPLE = 8192
_MOST_COMMON = 1 << 20
#: Texts whose shingles a task holds at once.
_ROWS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint_of(data: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the ``words``-word shingles of ``data``, A-Z lower-cased; 0 without words."""
    total, counts, tail = 0, np.zeros(BITS, np.int64), []
    for part in word_lists(data.lower()):
        run = tail + part
        if len(run) >= words:
            joined = map(b" ".join, zip(*(itertools.islice(run, k, None) for k in range(words))))
            n = len(run) - words + 1
            h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(_SEED)), np.uint64, n)
            total += n
            for at in range(0, n, 1 << 14):
                block = h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            tail = run[len(run) - words + 1 :]
        else:
            tail = run
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), _SEED)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, key: str | None = None) -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits) of every row; null text counts as empty.

    If ``key`` names a column of longs, it follows as ``key``.
    """
    more = [F.col(key).alias("key")] if key else []
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_of(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *(["key"] if key else [])])

    return plain.mapInArrow(tidy(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long{', key long' if key else ''}")


def _ball(width: int, radius: int) -> int:
    """How many values of ``width`` bits lie within ``radius`` bits of one; none for a negative radius."""
    return sum(math.comb(width, d) for d in range(radius + 1))


def partitions_for(n: int, radius: int) -> int:
    """The number of partitions whose probes and candidates cost least for ``n`` evenly spread fingerprints.

    Numbers that need more than ``_MOST_PROBES`` probes of one partition are passed over; radius + 1
    partitions never do.
    """

    def cost(m: int) -> float:
        total = 0.0
        for i in range(m):
            width, t = BITS // m + (i < BITS % m), (radius - m + 1) // m + (i >= m - (radius - m + 1) % m)
            probes = _ball(width, t)
            total += math.inf if probes > _MOST_PROBES else probes * (_PROBE_COST + n / 2.0**width)
        return total

    return min(range(1, radius + 2), key=cost)


def _summed(df: DataFrame, count) -> dict[int, int]:
    """Sums over all fingerprints of ``count``, an array of fixed length, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = count(b.column(0).to_numpy().view(np.uint64))
            total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at].astype(np.int64))], ["place", "n"])

    rows = df.select("fp").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {r["place"]: r["n"] for r in rows}


def _co_counts(fps: np.ndarray) -> np.ndarray:
    total = np.zeros((BITS, BITS))
    for at in range(0, len(fps), 1 << 14):
        bits = np.unpackbits(fps[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += bits.T @ bits
    return total.ravel().astype(np.int64)


def group_bits(co: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows from a free bit by the free bit most correlated with it."""
    ones = np.diag(co) / max(n, 1)
    cov = co / max(n, 1) - np.outer(ones, ones)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def take_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _pieces(groups: list[list[int]]) -> list[list[list[int]]]:
    """Each group cut into pieces narrow enough for a full histogram."""
    return [[g[k : k + _PIECE] for k in range(0, len(g), _PIECE)] for g in groups]


class Plan:
    """How to probe: bit groups, piece histograms over all fingerprints, and the radius."""

    def __init__(self, groups: list[list[int]], hist: dict[int, int], n: int, radius: int) -> None:
        self.groups, self.radius, self.n = groups, radius, n
        self.pieces = _pieces(groups)
        self.masks = []
        for g in groups:
            by_distance, total = [[0]], 1
            for d in range(1, radius + 1):
                total += math.comb(len(g), d)
                if total > _MOST_PROBES:
                    break
                by_distance.append([sum(1 << b for b in c) for c in itertools.combinations(range(len(g)), d)])
            self.masks.append([np.array(x, np.uint64) for x in by_distance])
        # share of fingerprints at each distance from each value of each piece
        self.near, at = [], 0
        for pieces in self.pieces:
            own = []
            for bits in pieces:
                h = np.zeros(1 << len(bits))
                for v in range(len(h)):
                    h[v] = hist.get(at + v, 0)
                at += len(h)
                table = np.zeros((radius + 1, len(h)))
                table[0] = h / max(n, 1)
                for d in range(1, radius + 1):
                    for c in itertools.combinations(range(len(bits)), d):
                        table[d] += table[0][np.arange(len(h)) ^ sum(1 << b for b in c)]
                own.append(table)
            self.near.append(own)

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """Estimated cost of partition i at threshold t - 1, an array [i, t, fingerprint]."""
        out = np.zeros((len(self.groups), self.radius + 2, len(fps)))
        for i, pieces in enumerate(self.pieces):
            share = None
            for bits, table in zip(pieces, self.near[i]):
                got = table[:, take_bits(fps, bits).astype(np.int64)]
                share = got if share is None else np.array([sum(share[a] * got[d - a] for a in range(d + 1)) for d in range(self.radius + 1)])
            within = np.cumsum(share, axis=0) * self.n
            probes = np.cumsum([len(x) for x in self.masks[i]])
            out[i, 1 : len(probes) + 1] = within[: len(probes)] + _PROBE_COST * probes[:, None]
            out[i, len(probes) + 1 :] = np.inf
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds [i, fingerprint], by dynamic programming over the partitions."""
        m, want = len(self.groups), self.radius + 1  # sum of (t_i + 1) is radius + 1
        cost = self.costs(fps)
        best, choice = np.full((want + 1, len(fps)), np.inf), []
        best[0] = 0
        for i in range(m):
            options = np.full((want + 1, want + 1, len(fps)), np.inf)
            for s in range(want + 1):
                for t in range(min(s, self.radius + 1) + 1):
                    options[s, t] = best[s - t] + cost[i, t]
            choice.append(options.argmin(axis=1))
            best = options.min(axis=1)
        if not np.isfinite(best[want]).all():
            raise ValueError(f"{m} partitions cannot cover {self.radius} bits with {_MOST_PROBES} probes each")
        out, left, all_ = np.zeros((m, len(fps)), np.int64), np.full(len(fps), want), np.arange(len(fps))
        for i in range(m - 1, -1, -1):
            t = choice[i][left, all_]
            out[i] = t - 1
            left = left - t
        return out

    def rows(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(partition, keys, places in ``fps``, role): role 1 is kept in the bucket, 2 probes it, 3 does both."""
        t = self.thresholds(fps)
        for i, bits in enumerate(self.groups):
            keys = take_bits(fps, bits)
            for role, chosen in ((3, t[i] >= 0), (1, t[i] < 0)):
                if chosen.any():
                    yield i, keys[chosen], np.flatnonzero(chosen), role
            for d in range(1, len(self.masks[i])):
                chosen = t[i] >= d
                if chosen.any() and len(self.masks[i][d]):
                    k = (keys[chosen][:, None] ^ self.masks[i][d][None, :]).ravel()
                    yield i, k, np.repeat(np.flatnonzero(chosen), len(self.masks[i][d])), 2


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) with the same components as the links (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _closest(ra: np.ndarray, rb: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the links (a, b, bits), the closest between each two of the components ra and rb, with the latter."""
    low, high = np.minimum(ra, rb), np.maximum(ra, rb)
    order = np.lexsort((b, a, d, high, low))
    order = order[low[order] != high[order]]
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    keep = order[new]
    return low[keep], high[keep], a[keep], b[keep], d[keep]


def _matches(group: np.ndarray, fp: np.ndarray, root: np.ndarray | None, role: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Links within ``radius`` bits of probes and kept fingerprints of the same group; rows are sorted by group.

    Without ``root`` as stars (member, smallest); with it the closest link between each two roots.
    """
    kept, probe = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    first = np.searchsorted(group[kept], group[probe], "left")
    count = np.searchsorted(group[kept], group[probe], "right") - first
    ends, at = np.cumsum(count), 0
    none = np.zeros(0, np.uint64)
    found = [(none,) * (2 if root is None else 5)]
    while at < len(probe):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
        n = count[at:to]
        x = np.repeat(probe[at:to], n)
        y = kept[np.arange(len(x)) - np.repeat(ends[at:to] - n - done, n) + np.repeat(first[at:to], n)]
        d = np.bitwise_count(fp[x] ^ fp[y])
        near = np.flatnonzero((d <= radius) & (fp[x] < fp[y]))
        if len(near):
            x, y = x[near], y[near]
            if root is None:
                found.append(spanning(fp[x], fp[y]))
            else:
                found.append(_closest(root[x], root[y], fp[x], fp[y], d[near].astype(np.uint64)))
        at = to
    joined = tuple(map(np.concatenate, zip(*found)))
    return spanning(*joined) if root is None else _closest(*joined)


def bit_matrix(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have each two bits set."""
    co = _summed(fps, _co_counts)
    return fps.count(), np.array([co.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL, matrix: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """Links of the distinct ``fp`` of ``fps`` within ``radius`` bits.

    If ``fps`` has no column ``root``: ``u, v`` (u > v) with the components of all such pairs.  If it
    has: ``ru, rv, u, v, bits``, for each task the closest pair between two different roots.
    Buckets of more than ``cell`` fingerprints are dealt to a grid of cells, so that each pair still
    meets in one cell and no task holds more than a cell's share.
    """
    rooted = "root" in fps.columns
    own = ["fp", "root"] if rooted else ["fp"]
    fps = fps.select(*own)
    n, co = matrix or bit_matrix(fps)
    groups = group_bits(co, n, partitions_for(n, radius))
    pieces = [p for g in _pieces(groups) for p in g]

    def histogram(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(take_bits(x, p).astype(np.int64), minlength=1 << len(p)) for p in pieces])

    plan = Plan(groups, _summed(fps, histogram), n, radius)
    extra = ", root long" if rooted else ""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                for i, keys, of, role in plan.rows(all_fps[at : at + 2048]):
                    cols = [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), role, np.int8)), *[c.slice(at, 2048).take(pa.array(of)) for c in b.columns]]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "key", "role", *own])

    rows = fps.mapInArrow(tidy(probe), f"part int, key long, role byte, fp long{extra}")
    kept = fps.select("fp").mapInArrow(lambda batches: _own_rows(batches, groups), "part int, key long")
    hot = materialize(kept.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).withColumn("cuts", F.ceil(F.col("n") / F.lit(cell)).cast("int")).drop("n"))
    if hot.limit(1).count():
        cuts, mine = F.coalesce(F.col("cuts"), F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce(F.col("cuts"), F.lit(1)))
        every = F.sequence(F.lit(0).cast("long"), (cuts - 1).cast("long"))
        as_kept = F.when(F.col("role").bitwiseAND(1) > 0, F.transform(every, lambda j: F.struct((mine * cuts + j).alias("cell"), F.lit(1).cast("byte").alias("role"))))
        as_probe = F.when(F.col("role").bitwiseAND(2) > 0, F.transform(every, lambda j: F.struct((j * cuts + mine).alias("cell"), F.lit(2).cast("byte").alias("role"))))
        one = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.col("role").alias("role")))
        empty = F.array().cast("array<struct<cell:bigint,role:tinyint>>")
        cells = F.when(F.col("cuts").isNull(), one).otherwise(F.concat(F.coalesce(as_kept, empty), F.coalesce(as_probe, empty)))
        rows = rows.join(hot, ["part", "key"], "left").select("part", "key", *own, F.explode(cells).alias("c")).select("part", "key", F.col("c.role").alias("role"), *own, F.col("c.cell").alias("cell"))
    else:
        rows = rows.withColumn("cell", F.lit(0).cast("long"))
    order = ["part", "key", "cell", "role", *own]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            part, key, where, role, fp = cols[:5]
            new = np.ones(len(key), bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (where[1:] != where[:-1])
            got = _matches(np.cumsum(new), fp.view(np.uint64), cols[5].view(np.uint64) if rooted else None, role, radius)
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in got], ["ru", "rv", "u", "v", "bits"] if rooted else ["u", "v"])

        for b in batches:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in order))
            if sum(len(x[0]) for x in held) < 1 << 18:
                continue
            cols = tuple(map(np.concatenate, zip(*held)))
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))  # rows are sorted: the last key may go on in the next batch
            if cut:
                yield from flush(tuple(c[:cut] for c in cols))
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield from flush(tuple(map(np.concatenate, zip(*held))))

    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*order).repartition(width, "part", "key", "cell").sortWithinPartitions("part", "key", "cell")
    if rooted:
        return dealt.mapInArrow(tidy(match), "ru long, rv long, u long, v long, bits long")
    # in one function, as each mapInArrow of a stage has workers of its own
    return dealt.mapInArrow(tidy(lambda batches: _contract(match(batches))), "u long, v long")


def _own_rows(batches: Iterator[pa.RecordBatch], groups: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        for i, bits in enumerate(groups):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(take_bits(fps, bits).view(np.int64))], ["part", "key"])


def _contract(batches: Iterator[pa.RecordBatch], most: int = ONE_TASK) -> Iterator[pa.RecordBatch]:
    """Star links (member, smallest member) that join what the links of each run of ``most`` rows join."""
    held_: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        u, v = spanning(*(np.concatenate([b.column(k).to_numpy() for b in held_]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held_.append(b)
        if sum(x.num_rows for x in held_) >= most:
            yield from flush()
            held_.clear()
    if held_:
        yield from flush()


def components(edges: DataFrame, one_task: int = ONE_TASK, contracted: bool = False) -> DataFrame:
    """``node, root`` of every node of ``edges`` (u, v) but the roots themselves: the smallest node it reaches.

    Each task first replaces its own links by stars, unless they are ``contracted``.  Up to ``one_task`` links are then joined by one
    task; more, by alternating large-star and small-star rounds, each written to the shared folder,
    until the set of links no longer changes.  Smallest neighbours are written before they are joined
    back, so that the join reads two plain tables and a hot node's rows can be split.
    """
    return settled(edges.sparkSession, lambda: _components(edges, one_task, contracted))


def _components(edges: DataFrame, one_task: int, contracted: bool) -> DataFrame:
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    if not contracted:
        edges = edges.mapInArrow(tidy(_contract), "u long, v long")
    edges = materialize(edges.distinct())
    if edges.count() <= one_task:
        # rows of a task are few enough to be one run, whatever the batches
        whole = edges.coalesce(1).mapInArrow(lambda batches: _contract(batches, one_task + 1), "u long, v long")
        return whole.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        sign = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == seen or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.filter("u <> v").distinct())


def shingle_set(text: Column, words: int) -> Column:
    """31-bit hashes of the distinct ``words``-word shingles of a text, A-Z lower-cased."""

    def hashed(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]).bitwiseAND(0x7FFFFFFF).cast("int"))
        whole = F.array(F.xxhash64(w).bitwiseAND(0x7FFFFFFF).cast("int"))
        return F.when(F.size(w) >= words, F.slice(each, 1, F.greatest(F.size(w) - (words - 1), F.lit(1)))).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(let(word_array(lower_ascii(text)), hashed))


def text_key(text: Column) -> Column:
    """A long that stands for a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles_of(data: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``data`` that ``shingle_set`` has."""
    memo = held(("simhash word",), lambda: Memo(lambda w: xxhash.xxh64_intdigest(w, _SEED), 1 << 17))
    found, tail, first = [], np.zeros(0, np.uint64), []
    for part in word_lists(data.lower()):
        run = np.concatenate([tail, np.fromiter(map(memo.__getitem__, part), np.uint64, len(part))])
        if len(first) < words:
            first += part[: words - len(first)]
        if len(run) >= words:
            n, h = len(run) - words + 1, np.zeros(len(run) - words + 1, np.uint64)
            for k in range(words):
                h = (h ^ (h >> np.uint64(32))) * _ODD + run[k : k + n]
            found.append((h ^ (h >> np.uint64(29))) * _ODD)
        tail = run[max(len(run) - words + 1, 0) :]
    if not found and first:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(first), _SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else tail[:0]


def prefix_of(s: np.ndarray, least: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The rarest of the shingles ``s``, so many that any set with ``least`` of all shingles in common has one of its own among them."""
    keep = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, times[at], 0)))]
    return s[:keep]


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches sorted by the first one, in runs that never cut a value of it."""
    kept: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
        if sum(len(x[0]) for x in kept) < most:
            continue
        cols = tuple(map(np.concatenate, zip(*kept)))
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield tuple(c[:cut] for c in cols)
        kept = [tuple(c[cut:] for c in cols)]
    if kept:
        yield tuple(map(np.concatenate, zip(*kept)))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key, the first column, among a task's rows, in small batches; a copied text is worked on once a task."""
    seen: set[int] = set()
    for b in batches:
        keys = b.column(0).to_pylist()
        new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        for at in range(0, len(new), _ROWS):
            yield b.take(pa.array(new[at : at + _ROWS]))


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``token, key, size, at`` sorted by the first two, one for each key of every token with several keys.

    Only a batch and the row before it are held, however many rows a token has.
    """
    last, told = None, False
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate(x) for x in zip(last, cols)]
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        cols = [c[new] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        known = told and len(several) == 1
        if told:
            several[0] = False
        last, told = [c[-1:] for c in cols], known or bool(several[-1])
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in cols], ["token", "key", "size", "at"])


def _size_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs ``u, v`` of the keys of a token whose roots differ and which may share ``least``; rows are sorted by token, size.

    Two sets meet first in the first token that both prefixes have; what either has from there on bounds
    what they share, as do their sizes and parities.  So a token of many texts that differ gives no
    pairs, though each two of them are compared.  Rows of the same ``side`` but 0 meet in another cell.
    """
    for token, size, key, root, at, odd, side in _whole_groups(batches):
        bits = np.frombuffer(b"".join(odd), np.uint64).reshape(len(odd), -1)
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        group = np.cumsum(new) << 32
        count = np.searchsorted(group + size, group + np.floor(size / least + 1e-6).astype(np.int64), "right") - np.arange(len(token)) - 1
        ends, done, found = np.cumsum(count), 0, []
        while done < len(token):
            before = ends[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(ends, before + (1 << 18), "right")))
            n = count[done:to]
            x = np.repeat(np.arange(done, to), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(ends[done:to] - n - before, n)
            need = (size[x].astype(np.int64) + size[y]) * (least / (1 + least)) - 1e-9
            fits = (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 0)) & (np.minimum(size[x] - at[x], size[y] - at[y]) >= need)
            x, y = x[fits], y[fits]
            for k in range(0, len(x), 1 << 15):
                i, j = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                ok = may_share(bits[i], size[i], bits[j], size[j], least)
                i, j = key[i[ok]], key[j[ok]]
                if len(i):
                    found.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1))
            done = to
        if found:  # a passage's tokens name the same pairs
            u, v = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def parity_of(s: np.ndarray) -> bytes:
    """``PARITY`` bits, each telling whether an odd number of the shingles ``s`` falls on it."""
    odd = np.bincount(((s >> np.uint64(8)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_share(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m shingles with parities a and b, rows of longs, can share ``least``: each bit that differs takes a shingle that only one set has."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return differ <= (n.astype(np.int64) + m) * ((1 - least) / (1 + least)) + 1e-9


def _in_cells(met: DataFrame, cell: int) -> DataFrame:
    """``met`` with ``side``: rows of a token of over ``cell`` rows go to the cells of a triangular grid, in which each two still meet once.

    ``token`` then names the cell.  Off the diagonal only rows of different sides are to be compared; elsewhere the side is 0.
    """
    hot = materialize(met.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).withColumn("cuts", F.ceil(F.col("n") / F.lit(cell)).cast("long")).drop("n"))
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if not found:
        return met.withColumn("side", F.lit(0))
    cuts = F.coalesce(F.col("cuts"), F.lit(1).cast("long"))
    own = met.join(maybe_broadcast(hot, found), "token", "left").withColumn("mine", F.pmod(F.xxhash64("key"), cuts))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)))
    side = F.when(F.col("other") == F.col("mine"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    name = F.when(F.col("cuts").isNull(), F.col("token")).otherwise(F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")))
    return dealt.select(name.alias("token"), "key", "size", "at", side.alias("side"))


def shared_pairs(docs: DataFrame, roots: DataFrame, text: str, words: int, least: float, n: int, cell: int = CELL) -> DataFrame:
    """Pairs ``u, v`` of text keys of different roots; all pairs that share ``least`` of their shingles are among them.

    Exact prefix filter: all sets are put in one order, rare shingles first, and sets that share
    ``least`` meet in their first ``1 - least``.  Of the pairs that meet, those stay whose places in
    the order and parities allow ``least``.  ``roots`` has ``key, root``; ``n`` is about the number of texts.
    A token in the prefixes of more than ``cell`` texts is dealt to a grid of cells, so that no task
    compares more than a cell's share.
    """
    return settled(docs.sparkSession, lambda: _shared_pairs(docs, roots, text, words, least, n, cell))


def _shared_pairs(docs: DataFrame, roots: DataFrame, text: str, words: int, least: float, n: int, cell: int) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.select(text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _first_seen(batches):
            for t in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles_of(t.as_py(), words).view(np.int64))], ["token"])

    sample = plain.filter(F.pmod(F.col("key"), F.lit(max(1, n // _SAMPLE))) == 0).mapInArrow(tidy(every), "token long")
    with freed_shuffles(spark):
        often = sample.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n")).limit(_MOST_COMMON).toArrow()
    common, times = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[order], times[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _first_seen(batches):
            sets = [shingles_of(t.as_py(), words) for t in b.column(1)]
            tokens = [prefix_of(s, least, *shared.value) if len(s) else s for s in sets]
            each = np.array([len(t) for t in tokens], np.int64)
            size = np.repeat(np.array([len(s) for s in sets], np.int32), each)
            if len(size):
                key, at = np.repeat(b.column(0).to_numpy(), each), np.concatenate([np.arange(k, dtype=np.int32) for k in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(key), pa.array(size), pa.array(at)], ["token", "key", "size", "at"])

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _first_seen(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((parity_of(shingles_of(t.as_py(), words)) for t in b.column(1)), pa.binary())], ["key", "odd"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = plain.mapInArrow(tidy(prefixes), "token long, key long, size int, at int").repartition(width, "token").sortWithinPartitions("token", "key")
    met = materialize(rows.mapInArrow(tidy(_shared_rows), "token long, key long, size int, at int"))
    wanted = materialize(met.select("key").distinct())
    marks = plain.join(maybe_broadcast(wanted, wanted.count()), "key", "left_semi").mapInArrow(tidy(parities), "key long, odd binary")
    marks = materialize(marks.groupBy("key").agg(F.first("odd").alias("odd")).join(roots, "key"))
    dealt = _in_cells(met, cell).join(marks, "key").select("token", "size", "key", "root", "at", "odd", "side").repartition(width, "token").sortWithinPartitions("token", "size")
    return dealt.mapInArrow(tidy(lambda batches: _size_pairs(batches, least)), "u long, v long").distinct()


def verified(pairs: DataFrame, names: DataFrame, docs: DataFrame, text: str, words: int, least: float) -> DataFrame:
    """The pairs ``u, v`` of nodes whose texts share at least ``least`` of their shingles.

    ``names`` has ``node, key``: the key of the text a node stands for; only texts of some pair are read whole.
    """
    return settled(docs.sparkSession, lambda: _verified(pairs, names, docs, text, words, least))


def _verified(pairs: DataFrame, names: DataFrame, docs: DataFrame, text: str, words: int, least: float) -> DataFrame:
    nodes = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(names, "node"))
    plain = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    wanted = maybe_broadcast(nodes.select("key").distinct(), nodes.count())
    sets = plain.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")).select("key", shingle_set(F.col("text"), words).alias("s"))
    known = materialize(nodes.join(sets, "key").select("node", "s"))
    a, b = known.select(F.col("node").alias("u"), F.col("s").alias("su")), known.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.filter(shared >= least * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, wide: tuple[int, ...] = (), least: float = 0.8, verify_words: int = 5, exact: bool | None = None) -> DataFrame:
    """``doc_id, fp, component_id, key, root`` of every row of ``docs``; ``key`` is the text's, ``root`` the same throughout a component.

    Fingerprints within ``radius`` bits are linked, equal ones too; ``component_id`` is the smallest
    id reachable.  With ``wide`` or ``exact``, so are all texts that share at least ``least`` of all their
    ``verify_words``-word shingles.  Each of ``wide``, in rising order, first links the components whose
    closest fingerprints differ in so many bits at most, if their texts pass; what has joined at fewer
    bits counts as one.  That is quick but misses pairs, so all texts of components that are still apart
    then meet by an exact prefix filter.
    Null and empty texts have fingerprint 0, linked like any other; rows with a null id take part and
    get their component's smallest id that isn't null; repeated rows get one answer each; no rows
    give none.  Other columns are ignored.
    """
    return settled(docs.sparkSession, lambda: _near_components(docs, doc_id, text, words, radius, wide, least, verify_words, wide if exact is None else exact))


def _near_components(docs: DataFrame, doc_id: str, text: str, words: int, radius: int, wide: tuple[int, ...], least: float, verify_words: int, exact) -> DataFrame:
    marked = materialize(fingerprints(docs.withColumn("__h_key", text_key(F.col(text))), doc_id, text, words, "__h_key"))
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("key").alias("key")))
    matrix = bit_matrix(fps)
    roots = components(links(fps, radius, matrix=matrix), contracted=True)

    def rooted() -> DataFrame:
        return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))

    def joined_by(more: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    for reach in wide:
        near = links(materialize(rooted()), reach, matrix=matrix)
        pairs = materialize(near.groupBy("ru", "rv").agg(F.min(F.struct("bits", "u", "v")).alias("best")).select("best.u", "best.v"))
        roots = joined_by(verified(pairs, fps.select(F.col("fp").alias("node"), "key"), docs, text, verify_words, least))
    if exact:
        keys = materialize(marked.select("fp", "key").distinct().join(rooted(), "fp").select("key", "root"))
        pairs = shared_pairs(docs, keys, text, verify_words, least, matrix[0])
        more = verified(pairs, keys.select(F.col("key").alias("node"), "key"), docs, text, verify_words, least)
        u, v = keys.select(F.col("key").alias("u"), F.col("root").alias("ru")), keys.select(F.col("key").alias("v"), F.col("root").alias("rv"))
        roots = joined_by(more.join(u, "u").join(v, "v").select("ru", "rv").distinct())
    joined = materialize(rooted())
    lowest = materialize(joined.groupBy("root").agg(F.min("low").alias("component_id")))
    named = joined.join(lowest, "root").select("fp", "component_id", "root")
    return null_safe(marked.select("doc_id", "fp", "key"), named, ["fp"]).select("doc_id", "fp", "component_id", "key", "root")
