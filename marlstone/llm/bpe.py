"""Byte-level BPE with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import Memo, held, tidy

#: Pre-tokens whose ids a worker keeps.
MEMO = 500_000
_LONG_TEXT = 1 << 22


class RankQueue:
    """Positions by merge rank.  Two levels of bitmaps find the lowest rank in use by find-first-set.

    Each rank's bucket is a heap of linked-list positions, so equal ranks leave from left to right.
    """

    def __init__(self, ranks: int) -> None:
        self.words, self.top, self.buckets = [0] * ((ranks >> 8) + 1), 0, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.words[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; (-1, -1) when empty."""
        top = self.top
        if not top:
            return -1, -1
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        rank = (w << 8) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.words[w] = word ^ low
        if word == low:
            self.top = top ^ (1 << w)
        return rank, bucket[0]


class Bpe:
    """Ranks of byte strings, the pattern that makes pre-tokens, and a memo of encoded pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO) -> None:
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(size)
        self.bytes_of, self.text_of = [b""] * size, [""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank], self.text_of[rank] = token, str(rank)
        self.memo = Memo(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes(), memo)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, until none has a rank.

        A bucket entry is stale, and skipped, when its position was merged away or its pair changed.
        """
        rank_of = self.ranks
        whole = rank_of.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        queue = self.queue
        push, pop = queue.push, queue.pop
        for i in range(n - 1):
            r = rank_of.get(piece[i : i + 2], -1)
            if r >= 0:
                pair[i] = r
                push(r, i)
        while True:
            r, i = pop()
            if r < 0:
                break
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = rank_of.get(piece[i : after[k]], -1)
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                r = rank_of.get(piece[p:k], -1)
                pair[p] = r
                if r >= 0:
                    push(r, p)
        out, i = [], 0
        while i < n:
            out.append(rank_of[piece[i : after[i]]])
            i = after[i]
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of ``text``; those of a very long text in lists of bounded length."""
        if len(text) <= _LONG_TEXT:
            yield self.find.findall(text)
            return
        found = (m.group() for m in self.find.finditer(text))
        while block := list(itertools.islice(found, 1 << 18)):
            yield block

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of ``text``, block by block."""
        for block in self.pieces(text):
            yield array("I", b"".join(map(self.memo.__getitem__, block))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, from its ids and their decoding.

    ``ranks_path`` is a path that every worker can read.  A null or empty text has no ids, and both
    digests are of nothing; repeated rows get an answer each; other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(("bpe", ranks_path, pattern), lambda: Bpe(read_ranks(ranks_path), pattern))
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in b.column(1):
                n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode(t.as_py()):
                    listed.update(("," * bool(n and ids) + ",".join(map(bpe.text_of.__getitem__, ids))).encode())
                    decoded.update(bpe.decode(ids))
                    n += len(ids)
                counts.append(n)
                of_ids.append(listed.hexdigest())
                of_bytes.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain.mapInArrow(tidy(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
