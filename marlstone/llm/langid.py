"""Language identification with a bit-sliced Bloom filter that maps n-grams to language bitmasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import tidy
from marlstone.llm.common import materialize, maybe_broadcast

#: A gram belongs to a language if its rate there is at least this share of its highest rate.
SHARE = 0.2
#: Slots of the filter: eight for each gram of the fullest language, within these bounds, but four at
#: least, so that no language fills more than about 53 % of them or has more than 15 % false positives.
MIN_SLOTS, MAX_SLOTS = 1 << 14, 1 << 22
HASHES = 3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_FLUSH = 100_000
_SLICE = 1 << 18
_BLOCK = 1 << 16


def letters(text: str) -> str:
    """Lower-cased letters with one space between, before and after words; empty without letters."""
    plain = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    return plain if any(map(str.isalpha, plain)) else ""


def grams_of(plain: str) -> np.ndarray:
    """Every three code points in a row, but those with a space in the middle, packed into a long."""
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    packed = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return packed[c[1:-1] != 32]


def slots_of(grams: np.ndarray, slots: int) -> np.ndarray:
    """The filter slots of each gram, an array [hash, gram]; ``slots`` is a power of two."""
    shift = np.uint64(64 - (slots.bit_length() - 1))
    g = grams.view(np.uint64)
    g = g ^ (g >> np.uint64(29))
    return ((g[None, :] * _MULTIPLIERS[:HASHES, None]) >> shift).astype(np.int64)


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, gram, n`` over all rows whose text and language are not null."""
    plain = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(words: Counter, name: str) -> pa.RecordBatch:
        spelled = [f" {w} " for w in words]
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) for w in spelled])
        c = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        packed = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        inside = c[1:-1] != 32
        grams, at = np.unique(packed[inside], return_inverse=True)
        n = np.bincount(at, times[1:-1][inside], len(grams)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                words.setdefault(name, Counter()).update(letters(t.as_py()).split())
            if sum(map(len, words.values())) > _FLUSH:
                yield from (count(w, name) for name, w in words.items() if w)
                words = {}
        yield from (count(w, name) for name, w in words.items() if w)

    return plain.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Languages, the table of bitmasks, and each language's share of filled slots."""

    def __init__(self, langs: list[str], table: np.ndarray, false_rate: np.ndarray | None = None) -> None:
        self.langs, self.table, self.false_rate = langs, table, false_rate
        if false_rate is None:
            filled = np.zeros(len(langs))
            for at in range(0, len(table), 1 << 20):
                part = table[at : at + (1 << 20)]
                filled += [np.count_nonzero(part[:, k // 64] & np.uint64(1 << (k % 64))) for k in range(len(langs))]
            self.false_rate = (filled / max(len(table), 1)) ** HASHES

    def hits(self, plain: str) -> tuple[np.ndarray, int]:
        """How many grams of ``plain`` each language's filter holds, and how many grams there are."""
        found, total = np.zeros(len(self.langs)), 0
        for at in range(0, len(plain), _SLICE):
            grams = grams_of(plain[at : at + _SLICE + 2])
            if not len(grams):
                continue
            where = slots_of(grams, len(self.table))
            masks = self.table[where[0]]
            for w in where[1:]:
                masks = masks & self.table[w]
            for k in range(len(self.langs)):
                found[k] += np.count_nonzero(masks[:, k // 64] & np.uint64(1 << (k % 64)))
            total += len(grams)
        return found, total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language with most grams after taking off the expected false positives, its share among
        all languages, and the share of the text's grams that it has."""
        plain = letters(text) if text else ""
        if not plain or not self.langs:
            return "und", 0.0, 0.0
        found, total = self.hits(plain)
        real = np.clip((found / max(total, 1) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(real.argmax())
        return self.langs[best], float(real[best] / real.sum()) if real.sum() else 0.0, float(real[best])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> Filter:
    """Learn the filter from all rows of ``docs`` with a text and a language.

    The driver gets the languages (the most common first) and the table in blocks of slots.  It grows
    with the fullest language: past ``MAX_SLOTS``, four to eight slots a gram, each of one byte for up to
    eight languages and of eight bytes for up to 64.
    """
    counts = materialize(gram_counts(docs, text, lang))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    if not langs:
        return Filter([], np.zeros((0, 1), np.uint64))
    index = counts.sparkSession.createDataFrame([(x, k, float(totals[x])) for k, x in enumerate(langs)], "lang string, k int, total double")
    rated = counts.join(maybe_broadcast(index, len(langs)), "lang").select("gram", "k", (F.col("n") / F.col("total")).alias("rate"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("by"))
    member = materialize(top.select("gram", F.transform(F.filter("by", lambda x: x["rate"] >= F.col("top") * share), lambda x: x["k"]).alias("ks")))
    fullest = member.select(F.explode("ks").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    slots = max(min(max(MIN_SLOTS, 1 << (8 * fullest - 1).bit_length()), MAX_SLOTS), 1 << (4 * fullest - 1).bit_length())
    words = (len(langs) + 63) // 64
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= 8 * t().itemsize or t is np.uint64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, where = b.column(1), slots_of(b.column(0).to_numpy(), slots)
            flat, n = ks.flatten().to_numpy(), ks.value_lengths().to_numpy()
            for w in where:
                slot, k = np.repeat(w, n), flat
                got, at = np.unique(np.stack([slot, k // 64]), axis=1, return_inverse=True)
                mask = np.zeros(got.shape[1], np.uint64)
                np.bitwise_or.at(mask, at.ravel(), np.uint64(1) << (k % 64).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int32)), pa.array(mask.view(np.int64))], ["slot", "word", "mask"])

    def dense(rows: pa.Table) -> pa.Table:
        block = np.zeros(_BLOCK, width)
        block[rows["slot"].to_numpy() % _BLOCK] = rows["mask"].to_numpy().view(np.uint64).astype(width)
        return pa.table({"at": [rows["block"][0].as_py() * _BLOCK], "word": [rows["word"][0].as_py()], "data": pa.array([block.tobytes()], pa.binary())})

    rows = member.mapInArrow(fill, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    blocks = rows.withColumn("block", F.floor(F.col("slot") / F.lit(_BLOCK))).groupBy("block", "word").applyInArrow(dense, "at long, word long, data binary")
    table = np.zeros((slots, words), width)
    for r in materialize(blocks).toLocalIterator():
        part = table[r["at"] : r["at"] + _BLOCK, r["word"]]
        part[:] = np.frombuffer(r["data"], width)[: len(part)]
    return Filter(langs, table)


def identify(docs: DataFrame, model: Filter, text: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "cover")) -> DataFrame:
    """``docs`` with the predicted language, its score and its cover (0 to 1) added under the names ``into``.

    A null text, or one without a letter, is ``und`` with score and cover 0; only the text is read.  All columns
    pass through; repeated rows get an answer each; no rows give none.
    """
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{into[0]}` string, `{into[1]}` double, `{into[2]}` double"
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.false_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*shared.value)
        place = names.index(text)
        for b in batches:
            told = [own.predict(t.as_py()) for t in b.column(place)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in told], pa.string()), *[pa.array([x[k] for x in told], pa.float64()) for k in (1, 2)]], [*names, *into])

    return docs.mapInArrow(tidy(run), schema)


def in_training(crc: Column, folds: int, held_out: int) -> Column:
    return F.pmod(crc, F.lit(folds)) != held_out
