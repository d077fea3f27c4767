"""Hard negatives against a plain loop over all rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, rank string, v string"


def plain(rows):
    """(anchor, positive, rank, negative, positive score, negative score) of rows with distinct ids."""
    use = {}
    for k, x, label in rows:
        if k is not None and label is not None and x is not None and all(e is not None and math.isfinite(e) for e in x):
            use[k] = ((label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * float(np.float32(e))) for e in x])
    out = []
    for a, (label, v) in use.items():
        if a % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w)), k) for k, (_, w) in use.items() if k != a)
        for p, pos in [x for x in scores if use[x[1]][0] == label][:5]:
            window = [x for x in scores if use[x[1]][0] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(a, pos, rank, neg, -p, -n) for rank, (n, neg) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(negatives.usable(df, label), F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def made(n, width=6, step=1.0, seed=3):
    rng = random.Random(seed)
    return [(k, [round(rng.uniform(-1, 1) / step) * step for _ in range(width)], rng.randrange(4)) for k in range(n)]


@pytest.mark.parametrize("step", [0.001, 0.5, 1.0], ids=["few ties", "ties", "mostly ties"])
def test_equals_a_plain_loop(spark, step):
    rows = made(700, step=step)
    assert mined(spark, rows) == plain(rows) != []


def test_nulls_take_no_part(spark):
    rows = made(400, step=0.25)
    rows[100] = (100, None, 1)
    rows[101], rows[102] = (101, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (102, [float("nan")] + [1.0] * 5, 1)
    rows[103], rows[104], rows[200] = (103, [float("inf")] * 6, 1), (104, [1.0] * 6, None), (200, rows[200][1], None)
    rows += [(None, [1.0] * 6, 1), (500, [], 2), (501, [], 3), (502, [1.0], 2), (503, [1.0] * 9, 2)]
    assert mined(spark, rows) == plain(rows)


def test_one_vector_of_a_third_of_the_rows(spark):
    rows = [(k, [1.0] * 6 if k % 3 == 0 else x, label) for k, x, label in made(600, step=0.5)]
    assert mined(spark, rows) == plain(rows)


def test_several_blocks_and_pieces_give_the_same(spark, monkeypatch):
    rows = made(900, step=0.5)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 3 * 8 * 6)
    assert mined(spark, rows) == plain(rows)


def test_values_beyond_exact_floats(spark):
    rows = [(k, [x[0] * 5e5, x[1] * 5e5, x[2]], label) for k, x, label in made(300, width=3)]
    assert mined(spark, rows) == plain(rows)
    huge = [(k, [3e38, 1.0, 1.0], label) for k, _, label in made(300, width=3)]
    got = mined(spark, huge)
    assert got and {r[4] for r in got} == {r[5] for r in got} == {negatives.MOST}


def test_repeated_ids(spark):
    rows = made(300, step=0.5)
    assert mined(spark, rows + rows[:150]) == plain(rows)


def test_no_rows_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(k, x, label) for k, x, label in made(99) if k]) == []


def test_whole_query_reads_all_embeddings(spark, tmp_path):
    rows = made(450, step=0.125)
    spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()) == plain(rows)


def test_lists_merge():
    """Entries added in any order and pieces end as the same lists."""
    rng = np.random.default_rng(0)
    slot, score, ident = rng.integers(0, 6, 4000), rng.integers(0, 30, 4000), rng.integers(0, 500, 4000)
    once = negatives.Best(6)
    once.add(slot, score, ident)
    parts = negatives.Best(6)
    for k in range(0, 4000, 37):
        parts.add(slot[k : k + 37], score[k : k + 37], ident[k : k + 37])
    assert [x.tolist() for x in once.rows] == [x.tolist() for x in parts.rows]
    own = {}
    for s, v, i in zip(slot, score, ident):
        own.setdefault(s, {})[i] = max(v, own.get(s, {}).get(i, -1))
    want = [(s, v, i) for s in sorted(own) for v, i in [(-a, b) for a, b in sorted((-v, i) for i, v in own[s].items())[:5]]]
    assert list(zip(*[x.tolist() for x in once.rows])) == want


def test_short_and_long_vectors_are_padded_and_cut():
    got = negatives.floored(pa.array([[0.5, -0.001], [], [1.0, 1.0, 1.0]], pa.list_(pa.float32())), 2)
    assert got.tolist() == [[128.0, -1.0], [0.0, 0.0], [256.0, 256.0]]
