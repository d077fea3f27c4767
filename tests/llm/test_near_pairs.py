"""Near-dedup links every two texts that share 0.8 of their five-word shingles, and none on another text's account."""

import random

import corpus_pipeline
from marlstone.llm import simhash

SHARE = 0.8
WIDE = (6,)


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def share(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def bits(a, b):
    return bin(simhash.fingerprint_of(a.encode()) ^ simhash.fingerprint_of(b.encode())).count("1")


def prose(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def roots(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return simhash.near_components(df, wide=WIDE).collect()


def test_appended_and_block_edited_copies(spark):
    rnd, rows, far = random.Random(3), [], 0
    for k in range(160):
        n = (80, 300)[k % 2]
        w = prose(rnd, n)
        if k % 4 < 2:
            x = w + prose(rnd, int(n * rnd.uniform(0.15, 0.24)))
        else:
            at, m = rnd.randrange(n // 2), int(n * rnd.uniform(0.04, 0.1))
            x = w[:at] + prose(rnd, m) + w[at + m :]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
        far += share(rows[-2][1], rows[-1][1]) >= SHARE and bits(rows[-2][1], rows[-1][1]) > WIDE[-1]
    got = {r["doc_id"]: r["component_id"] for r in roots(spark, rows)}
    stage = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert far >= 5
    for k in range(160):
        want = share(rows[2 * k][1], rows[2 * k + 1][1]) >= SHARE or bits(rows[2 * k][1], rows[2 * k + 1][1]) <= simhash.RADIUS
        assert (got[2 * k + 1] == got[2 * k]) == want
        assert 2 * k in stage and (2 * k + 1 not in stage) == want


def test_a_refused_closest_pair_hides_no_other(spark):
    rnd, rows, found = random.Random(4), [], 0
    while found < 3:
        a = prose(rnd, 200)
        a2 = list(a)
        a2[rnd.randrange(200)] = prose(rnd, 1)[0]
        b = list(a2)
        for i in rnd.sample(range(200), 4):
            b[i] = prose(rnd, 1)[0]
        t = [" ".join(x) for x in (a, a2, b)]
        if bits(t[0], t[1]) <= 3 < bits(t[0], t[2]) < bits(t[1], t[2]) <= 10 and share(t[0], t[2]) < SHARE <= share(t[1], t[2]):
            rows += [(10 * found + i, x) for i, x in enumerate(t)]
            found += 1
    got = {r["doc_id"]: r["component_id"] for r in roots(spark, rows)}
    assert all(got[10 * k + 2] == 10 * k for k in range(found))


def test_rows_without_id_are_judged_by_their_own_text(spark):
    rnd = random.Random(5)
    while True:
        a = prose(rnd, 200)
        first, other = ["aaa", *a[1:]], list(a)
        for i in rnd.sample(range(20, 200), 7):
            other[i] = prose(rnd, 1)[0]
        t = [" ".join(x) for x in (a, first, other)]
        if 3 < bits(t[0], t[2]) <= 6 and bits(t[1], t[2]) > 3 and share(t[0], t[2]) < 0.75 and share(t[1], t[2]) < 0.75 and t[1] < t[2]:
            break
    got = roots(spark, [(1, t[0]), (None, t[1]), (None, t[2])])
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 1), (1, 1)]
