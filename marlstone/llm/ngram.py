"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

The model is a set of files of sorted 64-bit hashes with counts beside them, no text:

    pairs-*   keys of word pairs, their counts as u8 (255: see the exceptions), exceptions
    words-*   word hashes, token counts u64, distinct left neighbours u32, and how many distinct
              right neighbours were seen once, twice, and more often (u32 each)

Both kinds are cut in parts by hash bits, so nothing is gathered in one task and each word or pair is
looked up in one file.  Discounts and totals are a few numbers on the driver.
"""

from __future__ import annotations

import math
import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import held, word_lists
from marlstone.llm.common import scratch_dir

#: Stand for the start and the end of a text.
START, END = np.uint64(1), np.uint64(2)
_BUFFER = 1 << 21
_SCORE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    x = (u ^ (u >> np.uint64(31))) * _MIX + v
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def token_runs(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the text's tokens, A-Z lower-cased, in pieces; the last piece ends with END."""
    for words in word_lists(text.lower()):
        yield hash_words(words)
    yield np.array([END])


def _sum_pairs(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], n[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return u[at], v[at], np.add.reduceat(n, at) if len(at) else n


def _sum_by(key: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], [np.add.reduceat(c[order], at) if len(at) else c for c in cols]


@dataclass
class Grid:
    """Word hashes by their top bits into ``side`` bands; pairs into side x side cells.

    A very common word's pairs are spread over ``side`` cells by the other word.
    """

    side: int

    def band(self, h: np.ndarray) -> np.ndarray:
        mixed = (h ^ (h >> np.uint64(33))) * _MIX
        return ((mixed >> np.uint64(32)) * np.uint64(self.side) >> np.uint64(32)).astype(np.int64)

    def cell(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.band(u) * self.side + self.band(v)


def _frame(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _write(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, each from a multiple of 8 bytes, with their sizes in the file's head."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    store.create_dir(place.rpartition("/")[0])
    with store.open_output_stream(place) as sink:
        sink.write(np.array([len(arrays), *map(len, arrays)], "<u8").tobytes())
        for a in arrays:
            raw = _frame(a)
            sink.write(raw + bytes(-len(raw) % 8))


def _map(uri: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is copied and unlinked once mapped."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(place, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile(delete=False) as copy, store.open_input_stream(place) as source:
            shutil.copyfileobj(source, copy)
        raw = np.memmap(copy.name, np.uint8, "r")
        os.unlink(copy.name)
    sizes = raw[8 : 8 + 8 * len(kinds)].view("<u8")
    out, at = [], 8 + 8 * len(kinds)
    for n, kind in zip(sizes, kinds):
        size = int(n) * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


_PAIR_KINDS = ["<u8", "u1", "<u8", "<u8"]
_WORD_KINDS = ["<u8", "<u8", "<u4", "<u4", "<u4", "<u4"]


@dataclass
class Model:
    side: int
    bands: int
    pair_files: dict[int, str]
    word_files: dict[int, str]
    pair_counts: list[int]  # distinct pairs seen once, twice, three and four times
    left_counts: list[int]  # words with one, two, three and four distinct left neighbours, and with three or more
    pair_types: int
    words: int
    tokens: int
    texts: int
    discounts: list[float] = field(default_factory=list)
    left_discounts: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.discounts = modified_discounts(self.pair_counts)
        self.left_discounts = modified_discounts(self.left_counts[:4])


def modified_discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of counts 1 to 4 (Chen and Goodman).

    Where a number of counts is zero the estimate doesn't exist, and half a count, one and one and a
    half stand in; each is held between 0 and its count.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] and n[k] else k / 2
        out.append(min(max(d, 0.0), float(k)))
    return out


def count(docs: DataFrame, text: str = "text", out_dir: str | None = None) -> Model:
    """Count all texts of ``docs`` (null: empty) into model files under a new shared folder.

    Pairs are summed within a task's buffer, dealt to the cells of a grid, and summed there.  Each cell
    writes its pairs and passes on each word's part of the neighbour counts; those are dealt again by
    word, summed, and written.  Only paths and totals come to the driver.
    """
    spark = docs.sparkSession
    out_dir = out_dir or scratch_dir(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = Grid(max(1, math.isqrt(width)))
    cells, bands = grid.side**2, max(1, width)
    by_word = Grid(bands)
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, waiting = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            u, v = np.concatenate(us), np.concatenate(vs)
            u, v, n = _sum_pairs(u, v, np.ones(len(u), np.int64))
            n = n.astype(np.uint32)
            cell = grid.cell(u, v)
            order = np.argsort(cell, kind="stable")
            edges = np.searchsorted(cell[order], np.arange(cells + 1))
            for c in range(cells):
                own = order[edges[c] : edges[c + 1]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *[pa.array([_frame(x[own])], pa.binary()) for x in (u, v, n)]], ["cell", "u", "v", "n"])

        for b in batches:
            for t in b.column(0):
                last = np.array([START])
                for run in token_runs(t.as_py()):
                    if len(run):
                        us += [last, run[:-1]]
                        vs.append(run)
                        last = run[-1:]
                        waiting += len(run)
                    if waiting >= _BUFFER:
                        yield from emit()
                        us, vs, waiting = [], [], 0
        if waiting:
            yield from emit()

    def totals(kind: str, part: int, path: str, numbers: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([kind]), pa.array([part], pa.int32()), pa.array([path]), pa.array([numbers], pa.list_(pa.int64())), pa.array([None], pa.binary()), pa.array([None], pa.binary())], names)

    names = ["band", "kind", "part", "path", "numbers", "key", "cols"]
    schema = "band int, kind string, part int, path string, numbers array<long>, key binary, cols binary"

    def per_group(batches: Iterator[pa.RecordBatch], by: int, done) -> Iterator[pa.RecordBatch]:
        """``done(group, rows)`` for each run of rows with one value in column ``by``."""
        group, rows = None, []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if rows and row[by] != group:
                    yield from done(group, rows)
                    rows = []
                group = row[by]
                rows.append(row)
        if rows:
            yield from done(group, rows)

    def write_pairs(cell: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        u, v, n = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((1, np.uint64), (2, np.uint64), (3, np.uint32)))
        u, v, n = _sum_pairs(u, v, n.astype(np.int64))
        key = pair_keys(u, v)
        order = np.argsort(key)
        key, count_ = key[order], n[order]
        big = count_ >= 255
        path = f"{out_dir}/pairs-{cell:05d}-{TaskContext.get().taskAttemptId()}"
        _write(path, [key, np.minimum(count_, 255).astype(np.uint8), key[big], count_[big].astype(np.uint64)])
        yield totals("pairs", cell, path, [len(n), *[int((n == k).sum()) for k in (1, 2, 3, 4)]])
        one = np.ones(len(n), np.int64)
        right, sums = _sum_by(u, [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)])
        left, got = _sum_by(v, [n, one])
        key = np.concatenate([left, right])
        zeros = lambda x: np.zeros(len(x), np.int64)
        key, cols = _sum_by(key, [np.concatenate(x) for x in ((got[0], zeros(right)), (got[1], zeros(right)), (zeros(left), sums[0]), (zeros(left), sums[1]), (zeros(left), sums[2]))])
        band = by_word.band(key)
        order = np.argsort(band, kind="stable")
        edges = np.searchsorted(band[order], np.arange(bands + 1))
        for w in range(bands):
            own = order[edges[w] : edges[w + 1]]
            if len(own):
                packed = b"".join([_frame(cols[0][own].astype(np.uint64)), *[_frame(c[own].astype(np.uint32)) for c in cols[1:]]])
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array(["words"]), pa.array([cell], pa.int32()), pa.array([""]), pa.array([[]], pa.list_(pa.int64())), pa.array([_frame(key[own])], pa.binary()), pa.array([packed], pa.binary())], names)

    def write_words(band: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if band < 0:  # what the cells report
            for r in rows:
                yield totals(*r[1:5])
            return
        keys, cols = [], [[], [], [], [], []]
        for r in rows:
            key = np.frombuffer(r[5], np.uint64)
            keys.append(key)
            m = len(key)
            cols[0].append(np.frombuffer(r[6], np.uint64, m).astype(np.int64))
            for k in range(4):
                cols[k + 1].append(np.frombuffer(r[6], np.uint32, m, 8 * m + 4 * m * k).astype(np.int64))
        key, got = _sum_by(np.concatenate(keys), [np.concatenate(c) for c in cols])
        path = f"{out_dir}/words-{band:05d}-{TaskContext.get().taskAttemptId()}"
        _write(path, [key, got[0].astype(np.uint64), *[c.astype(np.uint32) for c in got[1:]]])
        seen = got[0] > 0
        texts = got[0][key == END]
        yield totals("words", band, path, [int(seen.sum()), int(got[0].sum()), int(texts[0]) if len(texts) else 0, *[int((got[1] == k).sum()) for k in (1, 2, 3, 4)], int((got[1] > 2).sum())])

    dealt = plain.mapInArrow(pairs, "cell int, u binary, v binary, n binary").repartition(width, "cell").sortWithinPartitions("cell")
    parts = dealt.mapInArrow(lambda bs: per_group(bs, 0, write_pairs), schema)
    final = parts.repartition(width, "band", F.when(F.col("band") < 0, F.col("part"))).sortWithinPartitions("band").mapInArrow(lambda bs: per_group(bs, 0, write_words), schema)
    pair_files, word_files, p, w = {}, {}, np.zeros(5, np.int64), np.zeros(8, np.int64)
    for r in final.select("kind", "part", "path", "numbers").collect():
        (pair_files if r["kind"] == "pairs" else word_files)[r["part"]] = r["path"]
        if r["kind"] == "pairs":
            p += np.array(r["numbers"])
        else:
            w += np.array(r["numbers"])
    return Model(grid.side, bands, pair_files, word_files, [int(x) for x in p[1:]], [int(x) for x in w[3:]], int(p[0]), int(w[0]), int(w[1]), int(w[2]))


class Lookup:
    """The mapped files of a model, as arrays of numbers for arrays of hashes."""

    def __init__(self, model: Model) -> None:
        self.m, self.grid, self.by_word = model, Grid(model.side), Grid(model.bands)
        self.pairs = {k: held(("ngram", p), lambda p=p: _map(p, _PAIR_KINDS)) for k, p in model.pair_files.items()}
        self.words = {k: held(("ngram", p), lambda p=p: _map(p, _WORD_KINDS)) for k, p in model.word_files.items()}

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each of the sorted ``want`` in the sorted ``keys``, and whether it is there."""
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        return at, keys[at] == want if len(keys) else np.zeros(len(want), bool)

    def word_numbers(self, words: np.ndarray) -> np.ndarray:
        """[token count, left neighbours, right ones seen once, twice, more] for each distinct word hash."""
        out, band = np.zeros((5, len(words)), np.int64), self.by_word.band(words)
        order = np.lexsort((words, band))
        edges = np.searchsorted(band[order], np.arange(self.by_word.side + 1))
        for k, arrays in self.words.items():
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                at, hit = self._find(arrays[0], words[own])
                for c in range(5):
                    out[c, own[hit]] = arrays[c + 1][at[hit]]
        return out

    def pair_numbers(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Count of each pair."""
        out, key, cell = np.zeros(len(u), np.int64), pair_keys(u, v), self.grid.cell(u, v)
        order = np.lexsort((key, cell))
        edges = np.searchsorted(cell[order], np.arange(self.grid.side**2 + 1))
        for k, (keys, counts, big, big_counts) in self.pairs.items():
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                at, hit = self._find(keys, key[own])
                got = counts[at[hit]].astype(np.int64)
                many = got == 255
                if many.any():
                    got[many] = big_counts[np.searchsorted(big, key[own[hit][many]])]
                out[own[hit]] = got
        return out

    def log10(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(v | u), and the token count of v."""
        m = self.m
        words, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        numbers = self.word_numbers(words)
        of_u, of_v = numbers[:, at[: len(u)]], numbers[:, at[len(u) :]]
        d, e = np.array([0.0, *m.discounts]), np.array([0.0, *m.left_discounts])
        types = max(m.pair_types, 1)
        left_once, left_twice, _, _, left_more = m.left_counts
        spare = (e[1] * left_once + e[2] * left_twice + e[3] * left_more) / types if m.pair_types else 1.0
        low = np.maximum(of_v[1] - e[np.minimum(of_v[1], 3)], 0) / types + spare / (m.words + 1)
        seen_u = np.where(u == START, m.texts, of_u[0])
        seen_u = np.where(u == END, 0, seen_u)
        c = self.pair_numbers(u, v)
        backed = (d[1] * of_u[2] + d[2] * of_u[3] + d[3] * of_u[4]) / np.maximum(seen_u, 1)
        p = np.where(seen_u > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(seen_u, 1) + backed * low, low)
        return np.log10(p), of_v[0]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row.

    ``score`` is the model's log10 probability of the tokens and the end; ``base_score`` that of an
    add-a-half unigram model.  A null text counts as empty and has the end token alone; a model of no
    texts gives every token the same probability; repeated rows get an answer each.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        n, total = model.tokens, model.tokens + 0.5 * (model.words + 1)
        for b in batches:
            sums = np.zeros((4, len(b)))
            us, vs, owner, waiting = [], [], [], 0

            def settle() -> None:
                u, v, of = np.concatenate(us), np.concatenate(vs), np.concatenate(owner)
                logs, c = look.log10(u, v)
                base = np.log10((c + 0.5) / total)
                for k, x in enumerate((None, c > 0, base, logs)):
                    sums[k] += np.bincount(of, x, len(b))

            for k, t in enumerate(b.column(1)):
                last = np.array([START])
                for part in token_runs(t.as_py()):
                    if len(part):
                        us += [last, part[:-1]]
                        vs.append(part)
                        owner.append(np.full(len(part), k))
                        last, waiting = part[-1:], waiting + len(part)
                    if waiting >= _SCORE:
                        settle()
                        us, vs, owner, waiting = [], [], [], 0
            if waiting:
                settle()
            tokens = sums[0].astype(np.int64)
            cols = [b.column(0), pa.array(tokens), pa.array(sums[1].astype(np.int64)), pa.array(np.full(len(b), n, np.int64)), pa.array(sums[2]), pa.array(sums[3]), pa.array(10 ** np.minimum(-sums[3] / np.maximum(tokens, 1), 300))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return plain.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
