"""Sketches, and near duplicates against all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pytest

from marlstone.llm import minhash
from marlstone.llm.simhash import shingles_of


def plain_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(str((k, len(s), low.get(find(i)), k == low.get(find(i)))) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(5)
    texts = []
    for size in (2, 3, 5, 6, 12, 40, 40, 150, 150, 600):
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        texts.append(" ".join(base))
        for k in range(14):  # around and below the threshold, appended and chained
            texts.append(" ".join(edited(rng, base, max(1, size * k // 100))))
            texts.append(" ".join(base + [f"a{rng.randrange(10**6)}" for _ in range(size * k // 50)]))
            base = edited(rng, base, max(1, size // 40)) if k > 9 else base
    texts += ["One Two three", "one two THREE", "one\ttwo\n three", "solo", "SOLO", "solo solo", "solo solo solo", None, "", " \n", "日本 語 語 日本"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(3, "one two three"), (None, "One two three"), (None, "no id here"), (None, None), (1, texts[1]), (1, texts[1])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, key string, root string, n string").repartition(3)
    return sorted(str(tuple(r)) for r in minhash.near_components(df, **how).collect())


def test_whole_query_equals_all_pairs(spark, rows):
    assert found(spark, rows) == plain_components(rows)


def test_left_over_pairs_alone_find_the_same(spark, rows, monkeypatch):
    """Without stars every pair of a bucket is compared, in cells of four rows."""
    monkeypatch.setattr(minhash, "ROUNDS", ())
    assert found(spark, rows, cell=4) == plain_components(rows)


@pytest.mark.parametrize("all_texts", [True, False])
def test_a_pivot_of_many_pairs_is_cut(spark, all_texts):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 60 - k % 20]).encode()) for k in range(200)]
    texts, pairs = spark.createDataFrame(rows, "key long, text binary"), spark.createDataFrame([(k, 0) for k in range(1, 200)] + [(5, 9)], "u long, v long")
    got = {(r["u"], r["v"]): r["linked"] for r in minhash.confirmed(pairs, texts, 2, all_texts, cell=16).collect()}
    assert len(got) == 200
    assert all(linked == (100 * (59 - u % 20) >= 80 * 59) for (u, v), linked in got.items() if v == 0) and got[5, 9]


def test_stars_alone_would_miss_some(spark, rows, monkeypatch):
    """The last step has work to do here, so the tests above are not idle."""
    monkeypatch.setattr(minhash, "left_over", lambda members, *_: members.selectExpr("key as u", "key as v").limit(0))
    monkeypatch.setattr(minhash, "ROUNDS", (1,))
    assert found(spark, rows) != plain_components(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 7, 63, 400, 5000])
def test_every_coordinate_fills_and_is_the_plain_rule(n):
    s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    got = minhash.sketch_of(s, 50)
    want = [None] * 50
    for r in range(100):
        for x in s:
            h = minhash._mixed(np.array([int(x) + (r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]
            at = (int(h) & 0xFFFFFFFF) * 50 >> 32 if r < 50 else r % 50
            v = r << 32 | int(h) >> 32
            want[at] = v if want[at] is None else min(want[at], v)
        if None not in want:
            break
    assert got.tolist() == want


@pytest.mark.parametrize("n", [4, 20, 300])
def test_agreement_is_near_the_similarity(n):
    rng, errors = np.random.default_rng(1), []
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n).astype(np.uint64))
        rng.shuffle(pool)
        a, b = pool[: 2 * n], np.concatenate([pool[n // 2 : 2 * n], pool[2 * n : 2 * n + n // 4]])
        same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((minhash.sketch_of(a) == minhash.sketch_of(b)).mean() - same)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.05  # 200 independent draws: 0.035


def test_parities_never_pass_over_a_near_pair():
    rng = np.random.default_rng(2)
    for n in (1, 5, 16, 17, 300, 4000):
        for share in (0.8, 0.85, 1.0):
            pool = rng.integers(0, 1 << 63, 3 * n + 3).astype(np.uint64)
            both = max(1, round(n * share))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : n + n - both]]))
            bits = minhash._Parities([minhash.parity_of(s) for s in (a, b)])
            differ = bits.differing(0, np.array([1]))[0]
            assert differ <= len(np.setxor1d(a, b))
            if minhash._shared_enough(a, b):
                assert differ * 180 <= (len(a) + len(b)) * 20


def test_parities_of_different_lengths_fold():
    s = np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    more = np.append(s, np.uint64(12345 << 8))
    bits = minhash._Parities([minhash.parity_of(x) for x in (s, more)])
    assert bits.lengths.tolist() == [1, 2]
    assert bits.differing(0, np.array([1])).tolist() == bits.differing(1, np.array([0])).tolist() == [1]


def test_shingles_are_hashed_without_loss():
    text = " ".join(f"w{k % 997} x{k % 991}" for k in range(20000))
    assert len(shingles_of(text.encode(), 2)) == len(plain_set(text))
