"""The filters before near-dedup's verification let every close pair pass."""

import numpy as np

from marlstone.llm import simhash

SHARE = 0.8


def test_parities_never_refuse_a_close_pair():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 31, 33, 200, 1030):
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(n) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1)).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if shared >= SHARE * (len(a) + len(b) - shared):
                x, y = (np.frombuffer(simhash.parity_of(v), np.uint64)[None] for v in (a, b))
                assert simhash.may_share(x, np.array([len(a)]), y, np.array([len(b)]), SHARE).all()
                none = np.zeros(0, np.uint64)
                assert np.intersect1d(simhash.prefix_of(a, SHARE, none, none), simhash.prefix_of(b, SHARE, none, none)).size


def test_pairs_of_a_token_are_those_that_may_share():
    """Every close pair comes out once at least; sets that share only a common passage do not."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    passage = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 40).astype(np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for s, k in zip(sets, range(2, 30))]
    none = np.zeros(0, np.uint64)
    rows = sorted((int(t.view(np.int64)), len(s), k, at) for k, s in enumerate(sets) for at, t in enumerate(simhash.prefix_of(s, SHARE, none, none)))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int32()), pa.array([simhash.parity_of(sets[r[2]]) for r in rows]), pa.array([0] * len(rows), pa.int32())], ["token", "size", "key", "root", "at", "odd", "side"])
    got = {(u, v) for b in simhash._size_pairs(iter([batch]), SHARE) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())}
    close = {(i, j) for i in range(len(sets)) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) >= SHARE * (len(sets[i]) + len(sets[j]) - c)}
    close = {(min(p), max(p)) for p in close}
    assert len(close) > 5 and close <= got and len(got) < 2 * len(close) + 20


def test_rows_of_shared_tokens_whatever_the_batches():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for most in (1, 3, 40):
        rows = sorted((int(t), int(k), 9, 1) for t, k in zip(rng.integers(0, 12, 80), rng.integers(0, most, 80)))
        keys = {}
        for t, k, *_ in rows:
            keys.setdefault(t, set()).add(k)
        want = [(t, k) for t in sorted(keys) if len(keys[t]) > 1 for k in sorted(keys[t])]
        for width in (1, 2, 7, 80):
            cut = [rows[i : i + width] for i in range(0, len(rows), width)]
            batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*x)], ["token", "key", "size", "at"]) for x in cut]
            got = [(t, k) for b in simhash._shared_rows(iter(batches)) for t, k in zip(b["token"].to_pylist(), b["key"].to_pylist())]
            assert got == want


def test_cells_of_a_hot_token_lose_no_pair(spark, monkeypatch):
    """Pairs that meet in the cells of hot tokens are the pairs that meet without cells, and hold every close one."""
    import random

    rnd = random.Random(6)
    prose = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, texts = prose(60), []
    for _ in range(40):
        w = passage + prose(12)
        x = list(w)
        x[rnd.randrange(60, 72)] = prose(1)[0]
        texts += [" ".join(w), " ".join(x), " ".join(w)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keys = docs.select(simhash.text_key(docs["text"]).alias("key")).distinct()
    roots = keys.select("key", keys["key"].alias("root"))
    plain, dealt = simhash._in_cells, []

    def spied(met, cell):
        cells = plain(met, cell)
        dealt.append(cells.filter("side > 0").count())
        return cells

    monkeypatch.setattr(simhash, "_in_cells", spied)
    pairs = [{tuple(r) for r in simhash.shared_pairs(docs, roots, "text", 5, SHARE, len(texts), cell).collect()} for cell in (5, 17, 4096)]
    assert pairs[0] == pairs[1] == pairs[2] and dealt[0] > dealt[1] > dealt[2] == 0
    named = {r["key"]: {tuple(r["text"].split()[i : i + 5]) for i in range(len(r["text"].split()) - 4)} for r in docs.select(simhash.text_key(docs["text"]).alias("key"), "text").collect()}
    close = {(u, v) for u in named for v in named if u < v and len(named[u] & named[v]) >= SHARE * len(named[u] | named[v])}
    assert len(close) >= 40 and close <= pairs[0]
