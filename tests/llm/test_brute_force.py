"""Each operator against a plain version of itself, or an exact round trip."""

import base64
import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash

import public_tokenizers as P
from marlstone.llm import binout, bpe, langid, mixing, ngram, quality, sharding, simhash, sketch, tokencount
from marlstone.llm.queries import ORACLE_SQL, QUERIES
from oracle import SMALL, check

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(QUERIES[name], ORACLE_SQL[name], spark, SMALL)


def test_schedule_is_lpt():
    rnd = random.Random(5)
    for _ in range(40):
        shards = rnd.randint(1, 7)
        hist = [(s, rnd.choice((1, 2, 3, 50, 4000))) for s in rnd.sample(range(1, 300), rnd.randint(1, 12))] + ([(90_000, 1)] if rnd.random() < 0.4 else [])
        heap = [(0, k) for k in range(shards)]
        for size, count in sorted(hist, reverse=True):
            for _ in range(count):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
        loads = Counter()
        for size, used, upper in sharding.schedule(hist, shards):
            for k, hi, lo in zip(used, upper, [0, *upper]):
                loads[k] += size * (hi - lo)
        assert sorted(loads[k] for k in range(shards)) == sorted(load for load, _ in heap)


def test_shards_keep_groups_and_balance(spark, small):
    got, t = by_id(sharding.shard_documents(small)), texts(small)
    where = defaultdict(set)
    for d, r in got.items():
        where[t[d]].add(r["shard"])
        assert r["size"] == len(t[d].encode()) + 8 and r["text_crc32"] == zlib.crc32(t[d].encode())
    assert all(len(s) == 1 for s in where.values())
    load, slots = Counter(), defaultdict(list)
    for r in got.values():
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = Counter()
    for d, r in got.items():
        group[t[d]] += r["size"]
    assert max(load.values()) <= max(max(group.values()), 4 / 3 * sum(load.values()) / 24)


def shingles(text, n):
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def slow_hashes(text):
    def chain(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (1 << 64) if h >> 63 else h

    return {chain(g) for g in shingles(text, sketch.SHINGLE_WORDS)}


def slow_sketch(hashes):
    """The hashes below the threshold, and all of them if they are few."""
    return {h for h in hashes if h < sketch.threshold()}, hashes if len(hashes) <= sketch.EXACT else None


def slow_pair(a, b):
    """What two texts are compared by."""
    return (a[0], b[0]) if None in (a[1], b[1]) else (a[1], b[1])


def test_sketch_query_equals_brute_force(spark, small):
    got, t = by_id(QUERIES["op2_scaled_sketch"](spark, SMALL)), texts(small)
    order = sorted(t, reverse=True)
    made = {d: slow_sketch(slow_hashes(t[d])) for d in t}
    hexed = lambda s: "".join(f"{h & (2**64 - 1):016x}" for h in sorted(s))
    text_of = lambda s: hexed(s[0]) + ("" if s[1] is None else ":" + hexed(s[1]))
    assert {made[d][1] is None for d in t} == {True, False}
    for d, after in zip(order, order[1:] + order[:1]):
        k = len(t[d]) // 3
        edited = t[d][: len(t[d]) - k] + t[after][:k]
        new, r = slow_sketch(slow_hashes(edited)), got[d]
        assert (r["edited_sha256"], r["n_chars"]) == (hashlib.sha256(edited.encode()).hexdigest(), len(t[d]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(made[d]), text_of(new))
        for other, near, part in ((new, "near_edited", "contain_edited"), (made[after], "near_next", "contain_next")):
            a, b = slow_pair(made[d], other)
            assert r[near] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
            assert r[part] == (pytest.approx(len(a & b) / len(b)) if b else 1 if other[1] == set() else None)


def test_sketch_estimates_are_near(spark, small):
    got, t = by_id(sketch.compare_edited(small)), texts(small)
    order, errors = sorted(t, reverse=True), []
    for d, after in zip(order, order[1:] + order[:1]):
        k = len(t[d]) // 3
        a, b = shingles(t[d], 5), shingles(t[d][: len(t[d]) - k] + t[after][:k], 5)
        errors.append(abs(got[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)))
    assert sum(errors) / len(errors) < 0.05


def test_short_texts_in_a_long_one(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    rows = [(" ".join(words[i : i + 7]), " ".join(words)) for i in range(0, 3990, 10)] + [("no such words in the long text at all", " ".join(words))]
    df = spark.createDataFrame(rows, "a string, b string")
    made = sketch.with_sketch(sketch.with_sketch(df, "a", "x"), "b", "y")
    got = [r[0] for r in made.select(sketch.containment(sketch.F.col("x"), sketch.F.col("y"))).collect()]
    assert set(got[:-1]) == {1.0, None} and got[:-1].count(1.0) > 90 and got[-1] in (0.0, None)


def test_sketches_merge(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(n))
    for n, m in ((20, 8), (100, 300), (30, 4000), (3000, 5000), (0, 9)):
        a, b = prose(n), prose(m)
        made = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
        got = made.select(sketch.merge(sketch.F.col("x"), sketch.F.col("y")).alias("m")).first()["m"]
        kept, whole = slow_sketch(slow_hashes(a) | slow_hashes(b))
        assert set(got["kept"]) == kept
        assert got["whole"] is None if whole is None or n > 250 or m > 250 else set(got["whole"]) == whole


def test_next_of_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RUN", 5)
    rnd = random.Random(1)
    keys = [rnd.choice((None, 7, 7, rnd.randrange(100))) for _ in range(300)]
    df = spark.createDataFrame([(k, rnd.getrandbits(64) - (1 << 63), i) for i, k in enumerate(keys)], "k long, t long, v long").repartition(7)
    want = sorted(df.collect(), key=lambda r: (r["k"] is None, -(r["k"] or 0), r["t"]))
    got = {r["v"]: r["next_v"] for r in sketch.with_next(df, "k", "t", ["v"]).collect()}
    assert got == {a["v"]: b["v"] for a, b in zip(want, want[1:] + want[:1])}
    cuts = [7] * 20 + [90, 40]
    runs = df.select("k", sketch.run_of(df.k, df.t, "bigint", cuts, 100).alias("r")).collect()
    assert len({r["r"] for r in runs if r["k"] == 7}) > 15 and len({r["r"] for r in runs if r["k"] is None}) > 15


def test_next_document_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RUN", 7)
    df = spark.range(100).selectExpr("id * id * 3 as k", "id as t", "cast(id as string) as v").repartition(9)
    got = {r["k"]: r["next_v"] for r in sketch.with_next(df, "k", "t", ["v"]).collect()}
    assert got == {i * i * 3: str(i - 1 if i else 99) for i in range(100)}


def test_targets_are_the_reshared_fixed_point(spark):
    rnd = random.Random(2)
    for _ in range(4):
        sizes = [rnd.choice((0, 3, 10, 50, 400, 2000)) for _ in range(rnd.randint(1, 9))]
        sized = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
        weight, capped = [(1, 2, 3)[i % 3] for i in range(len(sizes))], set()
        while True:
            rest = sum(sizes) - sum(3 * sizes[i] for i in capped)
            free = sum(weight[i] for i in range(len(sizes)) if i not in capped)
            share = {i: 3 * sizes[i] if i in capped else rest * weight[i] / free for i in range(len(sizes))}
            over = {i for i in share if share[i] > 3 * sizes[i]} - capped
            if not over:
                break
            capped |= over
        assert all(abs(got[f"s{i}"] - share[i]) < 1e-6 for i in share)


def test_mix_is_near_its_targets(spark):
    rnd = random.Random(8)
    rows = [(i, f"s{i % 4}", rnd.randint(1, 60)) for i in range(3000)]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect():
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 60 for s, t in target.items())


@pytest.mark.parametrize("folder", ["0.001", "0.01", "0.1"])
def test_mix_of_the_tables_is_near_its_targets(spark, folder):
    """Within 1 %; or, of a source that one document makes up, within half that document."""
    mixed = mixing.mix(mixing.word_sizes(spark.read.parquet(f"/root/testdata/sf{folder}/documents.parquet")))
    for r in mixed.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        off = abs(r["sum(taken)"] - r["max(target)"])
        assert off <= 0.01 * r["max(target)"] or (folder == "0.001" and off <= r["max(size)"] / 2), r


def test_mix_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LONGEST", 20)
    rnd = random.Random(3)
    rows = [(i, f"s{i % 3}", int(rnd.paretovariate(0.7))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    offset = {r["source"]: r["u"] for r in df.select("source", mixing.offset_of(df.source).alias("u")).distinct().collect()}
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    for s, at in offset.items():
        own = sorted(((size, d) for d, x, size in rows if x == s), reverse=True)
        left, rest = got[own[0][1]]["target"], sum(size for size, _ in own)
        for k, (size, d) in enumerate(own):
            if k <= 20:
                each, start, base = min(max(left / rest, 0), 3), at, k
            n = int(start + each * (k + 1 - base)) - int(start + each * (k - base))
            assert got[d]["copies"] == n
            at, left, rest = (start + each) % 1, left - n * size, rest - size


def test_kneser_ney_equals_the_formulas(spark, small):
    t = texts(small)
    tok = {d: [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), x)), 0] for d, x in t.items()}
    train = {d for d in t if zlib.crc32(str(d).encode()) % 5 != 1}
    c, pairs = Counter(), Counter()
    for d in train:
        c.update(tok[d])
        pairs.update(zip([1, *tok[d][:-1]], tok[d]))
    left, after = Counter(v for _, v in pairs), defaultdict(Counter)
    for (u, _), n in pairs.items():
        after[u][min(n, 3)] += 1

    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))]

    d2, d1 = discounts(pairs.values()), discounts(left.values())
    types, v_size, total = len(pairs), len(c), sum(c.values())
    spare = sum(d1[min(x, 3)] for x in left.values()) / types

    def p(u, v):
        low = max(left[v] - d1[min(left[v], 3)], 0) / types + spare / (v_size + 1)
        seen = len(train) if u == 1 else c[u]
        if not seen:
            return low
        n, f = pairs[u, v], after[u]
        return max(n - d2[min(n, 3)], 0) / seen + sum(d2[k] * f[k] for k in (1, 2, 3)) / seen * low

    assert abs(sum(p(1, v) for v in c) + p(1, "never seen") - 1) < 1e-9
    won = []
    for d, r in by_id(QUERIES["op4_kneser_ney"](spark, SMALL)).items():
        assert abs(r["score"] - sum(log10(p(u, v)) for u, v in zip([1, *tok[d][:-1]], tok[d]))) < 1e-6
        assert abs(r["base_score"] - sum(log10((c[v] + 0.5) / (total + 0.5 * (v_size + 1))) for v in tok[d])) < 1e-6
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tok[d]), sum(c[v] > 0 for v in tok[d]), total)
        assert r["held_out"] == (d not in train)
        won.append(r["score"] > r["base_score"])
    assert sum(won) > 0.9 * len(won)


def test_pair_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([("a b " * 400,), ("a b",)], "text string")
    look = ngram.Lookup(ngram.count(docs))
    a, b = ngram.hash_words([b"a"]), ngram.hash_words([b"b"])
    assert look.pair_numbers(a, b)[0] == 401 and look.pair_numbers(b, a)[0] == 399 and look.pair_numbers(b, b)[0] == 0


def test_language_of_held_out_texts(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_bitmask_langid"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_filter_corrects_false_positives():
    rng = np.random.default_rng(1)
    table = np.zeros((1 << 10, 1), np.uint64)
    grams = rng.integers(0, 1 << 60, 4000)
    for w in langid.slots_of(grams[:900], len(table)):
        np.bitwise_or.at(table[:, 0], w, np.uint64(1))
    f = langid.Filter(["a", "b"], table)
    masks = np.bitwise_and.reduce([table[w, 0] for w in langid.slots_of(grams[900:], len(table))])
    assert abs((masks & np.uint64(1)).mean() - f.false_rate[0]) < 0.05 and f.false_rate[1] == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 4096, 4097, 20_000):
        for ids in (rng.integers(0, 50_000, n), np.where(rng.random(n) < 0.03, 2**32 - 1, rng.integers(0, 30, n)), np.full(n, 7)):
            ids = ids.astype(np.uint32)
            blocks = binout.encode_blocks(ids)
            starts = np.array([0, *itertools.accumulate(map(len, blocks))][:-1] if blocks else [], np.int64)
            got = binout.decode_blocks(b"".join(blocks), starts) if blocks else np.zeros(0, np.uint32)
            assert (got == ids).all() and len(got) == n
    small, wide = binout.encode_blocks(np.full(4096, 9, np.uint32)), binout.encode_blocks(rng.integers(0, 2**16, 4096).astype(np.uint32))
    assert len(small[0]) < 20 and len(wide[0]) < 4096 * 2 + 20


def test_token_files_equal_the_library(spark, odd, small, as_tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    union = small.select("doc_id", "text").union(odd.filter("doc_id is not null and doc_id <> 3").selectExpr("doc_id + 100000", "text"))
    got, t, at = by_id(binout.encode_documents(union, P.path("word_bpe_49k.json"), 2)), texts(union), 0
    for d in sorted(t):
        ids = [*tok.encode(t[d], add_special_tokens=False).ids, 2]
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok, enc, rnd = Tokenizer.from_file(P.path("word_bpe_49k.json")), binout.WordEncoder(P.path("word_bpe_49k.json"), memo=50), random.Random(3)
    parts = ["Word", "it's", "a.", "b.,", ",", "..", "(c),", "É", "é.", "ǅx", "İ", "ΑΣ", "1,5", "2.", "<|endoftext|>", "<|ENDOFTEXT|>", "á,", " ", "\x1c", "日本", "x y", "ſ", "K", "'S", "we'LL,"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "", "\n", "\t"]) for _ in range(rnd.randint(0, 12)))
        assert list(enc.encode_all([text.encode()])[0]) == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_counts_equal_the_library(spark, odd, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (small, odd.filter("doc_id is not null and doc_id <> 3")):
        t = texts(df)
        for d, r in by_id(tokencount.count_tokens(df, P.path("piece_bpe_32k.model"), chunk=900, overlap=20)).items():
            assert (r["n_tokens"], r["n_bytes"]) == (len(sp.encode(t[d])), len(t[d].encode()))
            assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_json_tokenizers_count_whole_texts(spark, small):
    from tokenizers import Tokenizer

    tok, t = Tokenizer.from_file(P.path("byte_bpe_50k.json")), texts(small.limit(20))
    for d, r in by_id(tokencount.count_tokens(small.limit(20), P.path("byte_bpe_50k.json"))).items():
        assert r["n_tokens"] == len(tok.encode(t[d], add_special_tokens=False).ids)


def test_host_rates_shrink_to_the_mean(spark):
    rows = [("big", i < 600) for i in range(1000)] + [("clean", False)] * 1000 + [("tiny", True)]
    got = {r["h"]: r["rate"] for r in quality.host_rates(spark.createDataFrame(rows, "h string, bad boolean"), "h", "bad").collect()}
    assert abs(got["big"] - 0.6) < 0.02 and got["clean"] < 0.02 and got["tiny"] < 1


def test_a_host_is_rejected_for_its_odds(spark):
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    hosts = {"bad": (54, 6), "fair": (100, 900), "other": (80, 920), "tiny": (2, 1), None: (1, 9)}
    rows = [(h, "too short" if i < failed else good(i)) for h, (failed, kept) in hosts.items() for i in range(failed + kept)]
    got = Counter((r["host"], r["__q_kept"]) for r in quality.judge(spark.createDataFrame(rows, "host string, text string"), host="host").collect())
    assert got == {("bad", False): 60, ("fair", False): 100, ("fair", True): 900, ("other", False): 80, ("other", True): 920, ("tiny", False): 2, ("tiny", True): 1, (None, False): 1, (None, True): 9}


def test_a_host_with_a_third_of_all_rows_is_rejected(spark):
    hosts = {"hot": (450, 50), "b": (30, 470), "c": (50, 450)}
    rows = [(h, i < failed) for h, (failed, kept) in hosts.items() for i in range(failed + kept)]
    got = {r["h"]: r["rejected"] for r in quality.host_rates(spark.createDataFrame(rows, "h string, bad boolean"), "h", "bad").collect()}
    assert got == {"hot": True, "b": False, "c": False}


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "_POSITION_BITS", 59)  # five bits of the hash: every text has clashes
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 70}" for i in range(100))), (2, " ".join(f"w{i}" for i in range(200)))], "doc_id long, text string")
    got = {r["doc_id"]: r["__q_n_repeat_words"] for r in quality.rule_counts(docs).collect()}
    assert got == {1: 60, 2: 0}


def test_byte_bpe_equals_tiktoken(spark, odd, small):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (small, odd.filter("doc_id is not null and doc_id <> 3")):
        t = texts(df)
        for d, r in by_id(bpe.round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)).items():
            ids = lib.encode_ordinary(t[d])
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(t[d].encode()).hexdigest()


def test_rank_queue_on_long_pieces():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own, lib = bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(9)
    for text in ("a" * 9999, "ab" * 5000, "".join(rnd.choice("abcdeéß") for _ in range(8000)), " " * 3000):
        assert [i for part in own.encode(text) for i in part] == lib.encode_ordinary(text)


def slow_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_query_equals_brute_force(spark, small):
    t = texts(small)
    ids = sorted(t)
    fps = [slow_fingerprint(t[d]) for d in ids]
    roots = slow_components(fps, 3)
    got = by_id(QUERIES["op10_simhash_components"](spark, SMALL))
    for d, f, r in zip(ids, fps, roots):
        assert got[d]["fingerprint"] == f"{f:016x}" and got[d]["component_id"] == ids[r]


@pytest.mark.parametrize(("radius", "cell"), [(3, 4096), (3, 8), (7, 4096)])
def test_links_have_all_components(spark, radius, cell):
    rnd = random.Random(radius)
    fps = set()
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(60):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(df, radius, cell)
    root = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    assert root == {r["node"]: r["root"] for r in simhash.components(found, one_task=0).collect()}
    seen = {}
    for x, want in zip(signed, slow_components(fps, radius)):
        assert seen.setdefault(root.get(x, x), want) == want
    assert len(seen) == len(set(slow_components(fps, radius)))


def test_wide_links_are_verified(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(8)]
    rows, near = [], []
    for k, w in enumerate(base):
        rows.append((10 * k, " ".join(w)))
        for j, changes in ((1, 1), (2, 3), (3, 60)):
            x = list(w)
            for i in rnd.sample(range(200), changes):
                x[i] = word()
            rows.append((10 * k + j, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, wide=(7, 14)).collect()}
    t = dict(rows)
    for k in range(8):
        for j in (1, 2, 3):
            a, b = shingles(t[10 * k], 5), shingles(t[10 * k + j], 5)
            near.append((len(a & b) / len(a | b) >= 0.8, got[10 * k + j] == 10 * k))
    assert all(not linked for close, linked in near if not close)
    assert sum(linked for close, linked in near if close) >= 0.9 * sum(close for close, _ in near)


@pytest.mark.parametrize("n", [100, 10**6, 5 * 10**10, 10**13])
def test_plans_cover_every_radius(n):
    fps = np.random.default_rng(2).integers(0, 2**63, 50).astype(np.uint64)
    for radius in (3, 6, 10, 14, 18):
        m = simhash.partitions_for(n, radius)
        groups = simhash.group_bits(simhash._co_counts(fps).reshape(64, 64), len(fps), m)
        t = simhash.Plan(groups, {}, n, radius).thresholds(fps)
        assert (t.sum(axis=0) == radius - m + 1).all() and t.min() >= -1
    groups = simhash.group_bits(simhash._co_counts(fps).reshape(64, 64), len(fps), 2)
    with pytest.raises(ValueError, match="cannot cover"):
        simhash.Plan(groups, {}, n, 14).thresholds(fps)


def test_thresholds_keep_the_sum():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 500).astype(np.uint64)
    for radius, m in ((3, 2), (3, 4), (7, 5)):
        groups = simhash.group_bits(simhash._co_counts(fps).reshape(64, 64), len(fps), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        pieces = [p for g in simhash._pieces(groups) for p in g]
        hist = np.concatenate([np.bincount(simhash.take_bits(fps, p).astype(np.int64), minlength=1 << len(p)) for p in pieces])
        t = simhash.Plan(groups, dict(enumerate(hist)), len(fps), radius).thresholds(fps)
        assert (t.sum(axis=0) == radius - m + 1).all() and t.min() >= -1
