"""Exact token counts; huge documents go through overlapping chunks that are spliced where it is proven safe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import held
from marlstone.llm.common import n_bytes

CHUNK = 32_768
OVERLAP = 512
TOKEN_LIMIT = 4096
_SPACE = "▁"
_MARK = _SPACE.encode()


class Encoder:
    """A sentencepiece model, or the library's tokenizer from a ``.json`` file, with token offsets."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.count_all = lambda texts: [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            self.spans = None  # normalizers may look across any cut, so these texts are not cut
            return
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        self.count_all = lambda texts: [len(x) for x in self.tok.encode(texts, num_threads=1)]
        pieces = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        inner = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        probe = "a  b \n c"
        plain = "".join(self.tok.encode(probe, out_type=str)).replace("<0x0A>", "\n") == _SPACE + probe.replace(" ", _SPACE)
        self.spans = None if inner or not plain else self._spans

    def _spans(self, text: bytes) -> list[int]:
        """Where each token of ``text`` (UTF-8) begins, in bytes."""
        return [p.begin for p in self.tok.encode(text.decode(), return_type="proto").pieces]


def stable(text: bytes, at: int) -> bool:
    """No token crosses ``at``: a space follows what is not one, and no piece holds an inner space.

    Merges join neighbours inside pieces only, so the text before such a place and the text after it
    are merged independently; what stands before ``at`` cannot change the tokens after it.
    """
    starts = text[at : at + 1] == b" " or text[at : at + 3] == _MARK
    return 0 < at < len(text) and starts and text[at - 1 : at] != b" " and text[max(0, at - 3) : at] != _MARK


def _whole(text: bytes, at: int) -> int:
    """``at``, or the next place where a character of ``text`` begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def count_spliced(text: bytes, spans: Callable[[bytes], list[int]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` (UTF-8) from overlapping chunks.

    Chunk k + 1 starts ``overlap`` bytes before chunk k ends.  They are spliced at a stable place of the
    overlap at which both begin a token and after which their tokens agree up to the last stable place
    of the overlap.  If there is none, chunk k is widened, and with it the overlap, until one is found
    or the text ends.
    """
    total, start, counted_from = 0, 0, 0
    while True:
        end, width = _whole(text, start + chunk), overlap
        while end < len(text):
            here = np.array(spans(text[start:end]), np.int64) + start
            low = _whole(text, end - width)
            then = np.array(spans(text[low : _whole(text, max(low + chunk, end))]), np.int64) + low
            inside = [p for p in range(max(low + 1, counted_from + 1), end) if stable(text, p)]
            if len(inside) >= 2:
                first, last = inside[0], inside[-1]
                a = here[(here >= first) & (here <= last)]
                b = then[(then >= first) & (then <= last)]
                if len(a) == len(b) and (a == b).all() and a[0] == first and a[-1] == last:
                    total += int(((here >= counted_from) & (here < first)).sum())
                    start, counted_from = low, first
                    break
            end, width = _whole(text, end + width), width * 2
        else:
            here = np.array(spans(text[start:]), np.int64) + start
            return total + int((here >= counted_from).sum())


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, as the library counts the whole text.

    ``model`` is a path that every worker can read.  Texts of more than ``chunk`` bytes are
    encoded in overlapping chunks.  A null or empty text has no bytes and no tokens; repeated rows get
    an answer each; other columns are ignored; no rows give none.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), n_bytes(F.col(text)).alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(("tokencount", model), lambda: Encoder(model))
        for b in batches:
            texts = b.column(2).to_pylist()
            counts = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk or enc.spans is None]
            counts[short] = enc.count_all([texts[i].decode() for i in short]) if short else []
            for i in sorted(set(range(len(texts))) - set(short)):
                counts[i] = count_spliced(texts[i], enc.spans, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return plain.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
