"""Token ids in patched frame-of-reference files.

A file holds blocks of ``BLOCK`` ids (the last may be shorter), then an index, all little-endian:

    block   min u32, ids u16, width u8, pad u8, exceptions u16, pad u16,
            ids minus min, low ``width`` bits of each, packed into u64 words lane by lane,
            exception places u16, exception values minus min u32
    index   block starts u64 each; per document: id i64, is-null u8, first id u64
    footer  blocks u64, documents u64, ids u64, start of the index u64, b"PFORIDS1"

The width is the smallest that holds ``PERCENT`` percent of a block; wider values go to its exceptions.
Ids are packed in 64 lanes of BLOCK / 64: lane j of word row r holds bits j * width and up.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import Memo, held
from marlstone.llm.common import scratch_dir

BLOCK, LANES = 4096, 64
PERCENT = 95
MAGIC = b"PFORIDS1"
_HEAD = np.dtype([("min", "<u4"), ("n", "<u2"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2"), ("pad2", "<u2")])
_FOOT = np.dtype([("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("index", "<u8"), ("magic", "S8")])
_SEGMENT = 128 * BLOCK
MEMO = 500_000
_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n]|$)")
_JOINED = 256


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """[k, BLOCK] values of ``width`` bits as [k, width * BLOCK / 64] words."""
    k, rows = len(values), BLOCK // LANES
    out = np.zeros((k, width, rows), np.uint64)
    lanes = values.reshape(k, LANES, rows).astype(np.uint64)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(k, -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    k, rows = len(words), BLOCK // LANES
    out = np.zeros((k, LANES, rows), np.uint64)
    w, mask = words.reshape(k, width, rows), np.uint64((1 << width) - 1)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        got = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            got = got | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = got & mask
    return out.reshape(k, BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percent: int = PERCENT) -> list[bytes]:
    """``ids`` (u32) as encoded blocks."""
    if not len(ids):
        return []
    k = -(-len(ids) // BLOCK)
    padded = np.zeros(k * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1]
    rows = padded.reshape(k, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    need = np.sort(rest, axis=1)[:, -(-BLOCK * percent // 100) - 1]
    widths = np.ceil(np.log2(need.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * k
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        own = rest[at]
        over = own >= (1 << int(width)) if width < 32 else np.zeros(own.shape, bool)
        words = pack(np.where(over, 0, own), int(width))
        for row, b in enumerate(at):
            n = min(BLOCK, len(ids) - b * BLOCK)
            places = np.flatnonzero(over[row])
            head = np.zeros(1, _HEAD)
            head["min"], head["n"], head["width"], head["exceptions"] = low[b], n, width, len(places)
            out[b] = head.tobytes() + words[row].astype("<u8").tobytes() + places.astype("<u2").tobytes() + own[row][places].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks of ``data`` at ``starts``."""
    heads = [np.frombuffer(data, _HEAD, 1, int(s))[0] for s in starts]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    widths = np.array([int(h["width"]) for h in heads])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        n = int(width) * BLOCK // 64
        words = np.stack([np.frombuffer(data, "<u8", n, int(starts[b]) + _HEAD.itemsize) for b in at])
        out[at] = unpack(words, int(width))
    for b, h in enumerate(heads):
        if h["exceptions"]:
            x = int(h["exceptions"])
            place = int(starts[b]) + _HEAD.itemsize + int(h["width"]) * BLOCK // 8
            out[b, np.frombuffer(data, "<u2", x, place)] = np.frombuffer(data, "<u4", x, place + 2 * x)
        out[b] += h["min"]
    keep = np.arange(BLOCK)[None, :] < np.array([int(h["n"]) for h in heads])[:, None]
    return out[keep]


class Writer:
    """Appends documents to one file; holds a segment of ids at most, and the index."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.ids = sink, 0, 0
        self.held: list[np.ndarray] = []
        self.waiting, self.starts = 0, []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= _SEGMENT:
            self._flush(self.waiting - self.waiting % BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, upto, _SEGMENT):
            for block in encode_blocks(ids[at : min(at + _SEGMENT, upto)]):
                self.starts.append(self.at)
                self.sink.write(block)
                self.at += len(block)
        self.held, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(self.waiting)
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        foot = np.zeros(1, _FOOT)
        foot["blocks"], foot["docs"], foot["ids"], foot["index"], foot["magic"] = len(self.starts), len(self.docs), self.ids, self.at, MAGIC
        self.sink.write(np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + null.tobytes() + np.array([s for _, s in self.docs], "<u8").tobytes() + foot.tobytes())
        self.sink.close()


class Reader:
    """Documents of one file in order, decoded a segment of blocks at a time."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        foot = np.frombuffer(source.read_at(_FOOT.itemsize, size - _FOOT.itemsize), _FOOT)[0]
        if bytes(foot["magic"]) != MAGIC:
            raise ValueError("not a file of token ids")
        blocks, docs, self.ids, index = (int(foot[x]) for x in ("blocks", "docs", "ids", "index"))
        raw = source.read_at(size - _FOOT.itemsize - index, index)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(index)).astype(np.int64)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.null = np.frombuffer(raw, "u1", docs, at + 8 * docs).astype(bool)
        self.firsts = np.append(np.frombuffer(raw, "<u8", docs, at + 9 * docs), np.uint64(self.ids)).astype(np.int64)

    def segments(self) -> Iterator[np.ndarray]:
        step = _SEGMENT // BLOCK
        for b in range(0, len(self.starts) - 1, step):
            some = self.starts[b : b + step + 1]
            yield decode_blocks(self.source.read_at(int(some[-1] - some[0]), int(some[0])), some[:-1] - some[0])

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id, ids, CRC-32 of the ids as little-endian u32) of each document."""
        parts, have, base = self.segments(), np.zeros(0, np.uint32), 0
        for k in range(len(self.doc_ids)):
            at, end, crc = int(self.firsts[k]), int(self.firsts[k + 1]), 0
            n = end - at
            while at < end:
                if at >= base + len(have):
                    base, have = base + len(have), next(parts)
                piece = have[at - base : end - base]
                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                at += len(piece)
            yield None if self.null[k] else int(self.doc_ids[k]), int(self.firsts[k]), n, crc


# The rules of tokenizers whose texts may be cut at blanks, lower-cased, and parted before a lone mark.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


def require_rules(tokenizer: dict) -> None:
    """An error unless the tokenizer normalizes, cuts and ends words in the way that ``WordEncoder``'s shortcuts rely on."""
    first = ((tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    there = {
        "normalizer": (tokenizer.get("normalizer") or {}).get("normalizers") == NORMALIZERS,
        "pattern": (first.get("pattern") or {}).get("Regex") == PATTERN and first.get("invert") is True,
        "word end": tokenizer["model"].get("end_of_word_suffix") == WORD_END and not tokenizer["model"].get("continuing_subword_prefix"),
    }
    if not all(there.values()):
        raise ValueError(f"this tokenizer has another {', '.join(k for k, ok in there.items() if not ok)}; its texts cannot be cut at blanks")


class WordEncoder:
    """Ids of a text by the library, which sees each ASCII-blank-separated stretch once while it is held.

    The tokenizer's pattern never crosses blanks, and neither do its normalizer or special strings, so
    a text's ids are those of its stretches in a row.  It also lower-cases, and ends a piece before
    a lone full stop or comma after a letter or digit; so A-Z are lowered and such marks set apart
    first, unless the text may hold a special string.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        require_rules(json.loads(self.tok.to_str()))
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo = Memo(None, memo)

    @staticmethod
    def stretches(text: bytes) -> list[bytes]:
        return (text if b"<|" in text else _MARK.sub(rb" \1", text.lower())).split()

    def _encode(self, stems: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each stem.  Stems of letters alone are encoded many to a text, with blanks between.

        Each such stem is one piece and ends with one token of a word's end, so these tokens cut the
        ids; a text with another number of them than stems is encoded again stem by stem.
        """
        words = [s.decode() for s in stems]
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        single = [k for k, w in enumerate(words) if not w.isalpha()]
        out: dict[bytes, bytes] = {}
        groups = [plain[at : at + _JOINED] for at in range(0, len(plain), _JOINED)]
        texts = [" ".join([words[k] for k in g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(g):
                single += g
                continue
            raw, at = ids.tobytes(), 0
            for k, end in zip(g, cuts.tolist()):
                out[stems[k]] = raw[at:end]
                at = end
        for k, e in zip(single, self.tok.encode_batch_fast([words[k] for k in single], add_special_tokens=False)):
            out[stems[k]] = array("I", e.ids).tobytes()
        return out

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids (u32) of each text."""
        split = list(map(self.stretches, texts))
        got = [list(map(self.memo.get, words)) for words in split]
        new = list({w for words, ids in zip(split, got) if None in ids for w, x in zip(words, ids) if x is None})
        fresh: dict[bytes, bytes] = {}
        for at in range(0, len(new), 16_384):
            fresh.update(self._encode(new[at : at + 16_384]))
        for w, ids in fresh.items():
            self.memo.keep(w, ids)
        if fresh:
            got = [[fresh[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids for words, ids in zip(split, got)]
        return [np.frombuffer(b"".join(ids), np.uint32) for ids in got]


def write_files(docs: DataFrame, tokenizer: str, end_id: int, out_dir: str, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Encode all texts, append ``end_id`` to each, and write files in ascending id order.

    Returns (path, ids) of each file in order.  Null ids come first; repeated ids stay together; a
    null text is empty.  Ids are whole numbers, or text of such; other ids are an error rather than a null.  A task writes under its attempt's own name and only files that a finished
    task reports are used, so a lost executor's half-written file is never read.
    """
    ident = F.col(doc_id).cast("long")
    if docs.schema[doc_id].dataType.simpleString() == "string":
        whole = F.regexp_like(F.col(doc_id), F.lit("^[+-]?[0-9]+\\z"))
        ident = F.when(F.col(doc_id).isNull() | whole, F.col(doc_id).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), F.col(doc_id))).cast("long"))
    plain = docs.select(ident.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc = held(("binout", tokenizer), lambda: WordEncoder(tokenizer))
        task, writer, end = TaskContext.get(), None, np.uint32(end_id)
        for b in batches:
            step = 256
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                for d, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1).to_pylist())):
                    if writer is None:
                        path = f"{out_dir}/part-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
                        store, place = fs.FileSystem.from_uri(path)
                        store.create_dir(place.rpartition("/")[0])
                        writer = Writer(store.open_output_stream(place))
                    writer.add(d, np.append(ids, end))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([writer.ids], pa.int64())], ["part", "path", "ids"])

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(width, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    done = ordered.mapInArrow(run, "part int, path string, ids long").collect()
    return [(r["path"], r["ids"]) for r in sorted(done, key=lambda r: r["part"])]


def read_files(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``files``, read back from them."""
    starts = [0, *itertools.accumulate(n for _, n in files)]
    listed = [(p, starts[k]) for k, (p, _) in enumerate(files)]
    rows = spark.createDataFrame(listed, "path string, start long").repartition(max(1, len(listed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    docs = Reader(source).documents()
                    while some := list(itertools.islice(docs, 8192)):
                        d, s, n, c = zip(*some)
                        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(np.array(s) + base), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, out_dir: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder if ``out_dir`` is none) and read them back; see both parts."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, tokenizer, end_id, out_dir or scratch_dir(spark)))
