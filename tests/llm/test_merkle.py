"""Merkle manifests against trees built in plain Python."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes, fan=2):
    """The top of a list of digests, and each one's (left, right) siblings up to it."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fan * fan : i // fan * fan + fan]
            steps[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        level = [h("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], steps


def plain_check(rows):
    """One tuple a row of (doc_id, source, lang, n_chars, text), in the query's columns."""
    first = lambda v: (v is not None, v)
    leaves = sorted(((r, plain_leaf(r)) for r in rows), key=lambda x: (x[0][2] is not None, (x[0][2] or "").encode(), first(x[0][0]), x[1]))
    groups = [list(g) for _, g in itertools.groupby(leaves, key=lambda x: x[0][2])]
    tops = [tree([leaf for _, leaf in g]) for g in groups]
    root, above = tree([t for t, _ in tops]) if tops else (None, [])
    out = []
    for g, (top, steps), more in zip(groups, tops, above):
        for (r, leaf), own in zip(g, steps):
            path = own + more
            odd = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = plain_leaf((*r[:3], r[3] + 1, r[4])) if odd else leaf
            for left, right in path:
                folded = h(left + folded + right)
            out.append((r[0], leaf, top, root, h("".join(a + b for a, b in path)), folded, folded == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx string, g string")


LANGS = ("en", None, "", "de", "日本", "Z", "é")
ROWS = [(k, ("a", None)[k % 2], LANGS[k * k % 7], (k, None, 5)[k % 3], ("t" * k, None, "", "é😀")[k % 4]) for k in range(75)]
ROWS += [(7, "a", "en", 1, "t")] * 5 + [(None, None, None, None, None)] * 3 + [(None, "s", "only", 3, "alone")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [r for r in ROWS if r[2] == "en"], []], ids=["many", "one", "one group", "none"])
def test_whole_query_equals_plain_trees(spark, rows):
    got = [tuple(r) for r in merkle.check_documents(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_check(rows)))


def test_tampering_shows_only_where_it_was_done(spark):
    rows = {r["doc_id"]: r["verified"] for r in merkle.check_documents(table(spark, [(k, "s", "en", k, "t") for k in range(200)])).collect()}
    assert {k for k, ok in rows.items() if not ok} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 0}


@pytest.mark.parametrize("fan", [3, 4])
def test_wider_trees(spark, fan):
    docs = table(spark, [(k, None, ("a", "b")[k % 5 == 0], None, None) for k in range(41)])
    made = merkle.manifest(docs, merkle.leaf_of(F.col("doc_id")), fan=fan).collect()
    for lang in ("a", "b"):
        ids = [k for k in range(41) if ("a", "b")[k % 5 == 0] == lang]
        top, steps = tree([plain_leaf([k]) for k in ids], fan)
        own = {r["doc_id"]: r for r in made if r["doc_id"] in ids}
        for k, path in zip(ids, steps):
            assert own[k]["subroot"] == top
            assert [tuple(s) for s in own[k]["path"]][: len(path)] == path


def test_ranges_number_tied_rows_without_gaps(spark):
    df = spark.range(3000).selectExpr("id % 2 as g", "0L as tied")
    got = merkle.numbered(df, "g", ["tied"]).collect()
    for g in (0, 1):
        assert sorted(r["idx"] for r in got if r["g"] == g) == list(range(1500))
        assert {r["n"] for r in got if r["g"] == g} == {1500}
