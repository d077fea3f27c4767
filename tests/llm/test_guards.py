"""What operators refuse, and language ID against a plain version of the whole query."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import binout, langid
from marlstone.llm.queries import QUERIES
from oracle import SMALL


@pytest.mark.parametrize("change", ["normalizer", "pattern", "suffix", None])
def test_only_tokenizers_of_these_rules(change):
    import public_tokenizers

    rules = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    if change == "normalizer":
        rules["normalizer"] = {"type": "NFC"}
    elif change == "pattern":
        rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "\\w+"
    elif change == "suffix":
        rules["model"]["end_of_word_suffix"] = "#"
    if change is None:
        return binout.require_rules(rules)
    with pytest.raises(ValueError, match={"normalizer": "normalizer", "pattern": "pattern", "suffix": "word end"}[change]):
        binout.require_rules(rules)


def test_another_tokenizer_is_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        binout.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_as_text(spark):
    import public_tokenizers

    df = spark.createDataFrame([("12", "one"), (" 7", "two"), (None, "three")], "doc_id string, text string")
    with pytest.raises(Exception, match="not a whole number"):
        binout.encode_documents(df, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    got = binout.encode_documents(df.filter("doc_id is null or doc_id = '12'"), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert [r["doc_id"] for r in got.orderBy("start").collect()] == [None, 12]


def plain_letters(text):
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).split()
    return f" {' '.join(words)} " if any(c.isalpha() for w in words for c in w) else ""


def plain_grams(text):
    s = plain_letters(text)
    return [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]


def slots_of(gram, bits):
    g = ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])
    g ^= g >> 29
    return [(g * m & (1 << 64) - 1) >> (64 - bits) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def test_language_query_equals_a_plain_version(spark):
    """Every prediction and score, from sets of filter slots a language instead of bitmasks."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held_out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    counts = {}
    for d, text, lang in rows:
        if lang is not None and not held_out[d]:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    langs = sorted(counts, key=lambda x: (-sum(counts[x].values()), x))
    rate = {x: {g: n / sum(counts[x].values()) for g, n in counts[x].items()} for x in langs}
    top = {}
    for x in langs:
        for g, p in rate[x].items():
            top[g] = max(p, top.get(g, 0))
    member = {x: [g for g, p in rate[x].items() if p >= top[g] * langid.SHARE] for x in langs}
    bits = max(14, (8 * max(map(len, member.values())) - 1).bit_length())
    filled = {x: {s for g in member[x] for s in slots_of(g, bits)} for x in langs}
    wrong = {x: (len(filled[x]) / (1 << bits)) ** 3 for x in langs}
    got = {r["doc_id"]: r for r in QUERIES["op5_bitmask_langid"](spark, SMALL).collect()}
    for d, text, _ in rows:
        grams = plain_grams(text)
        r = got[d]
        assert r["held_out"] == held_out[d]
        if not plain_letters(text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        hits = [sum(all(s in filled[x] for s in slots_of(g, bits)) for g in grams) for x in langs]
        real = [min(max((h / max(len(grams), 1) - wrong[x]) / max(1 - wrong[x], 1e-9), 0), 1) for h, x in zip(hits, langs)]
        best = int(np.argmax(real))
        assert r["lang_pred"] == langs[best]
        assert r["score"] == pytest.approx(real[best] / sum(real) if sum(real) else 0.0)
