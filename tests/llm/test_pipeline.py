"""The pipeline on documents planted for each stage, and against a plain version of its filters."""

import hashlib
import random

import corpus_pipeline
from oracle import SMALL


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "mixing sources", "byte-level BPE"]


def test_planted_documents(spark, small):
    rnd = random.Random(1)
    vocabulary = sorted({w for r in small.filter("lang = 'en'").limit(20).collect() for w in r["text"].split() if w.isalpha()})
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    clean = {10_000 + i: prose(300) for i in range(6)}
    copy = {20_000: clean[10_000], 20_001: clean[10_001].replace(" ", "  ", 3)}
    words = clean[10_002].split()
    words[150] = "changed"
    near = {20_002: " ".join(words)}
    bad = {30_000: "too short", 30_001: "same line of words here\n" * 30, 30_002: "12 34 56 78 90 " * 30, 30_003: None}
    rows = [(d, t, "en", "planted", len(t or "")) for d, t in {**clean, **copy, **near, **bad}.items()]
    docs = small.union(spark.createDataFrame(rows, small.schema))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), small.schema)
        left = {r["doc_id"] for r in docs.collect()}
        assert set(clean) <= left, name
        assert not set(bad) & left
    assert not set(copy) & left and not set(near) & left


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert got and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in got)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, root string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", "y") for i, t, lang, source in rows], COLUMNS).repartition(3)


def test_near_dedup_of_rows_without_ids_and_of_repeated_ids(spark):
    rnd = random.Random(4)
    a, b, c, d, e = (" ".join(f"{n}{rnd.randrange(10**6)}" for _ in range(60)) for n in "abcde")
    near = b.split()
    near[30] = "edited"
    rows = [(5, a), (None, a), (6, c), (None, b), (None, " ".join(near)), (None, b), (7, d), (7, d), (7, e), (None, None), (None, ""), (9, c)]
    got = corpus_pipeline.near_dedup(spark, rows_of(spark, [(i, t, "en", "s") for i, t in rows]), "")
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    alone = [t for i, t in kept if i is None]
    assert sorted((i, t) for i, t in kept if i is not None) == sorted([(5, a), (6, c), (7, d), (7, e)])
    assert len(alone) == 2 and len([t for t in alone if t]) == 1 and set(alone) - {None, ""} <= {b, " ".join(near)}


def test_near_dedup_keeps_the_same_row_each_time(spark):
    rows = [(1, "one two three four five six", lang, s) for lang in ("en", None, "de") for s in ("x", "y", None)]
    docs = rows_of(spark, rows)
    seen = {str(corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()) for n in (1, 2, 5)}
    assert len(seen) == 1


def test_mixing_of_rows_without_ids_takes_each_source_near_its_target(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows = [(None, text(rnd.randrange(80, 160)), "en", "a") for _ in range(60)]
    rows += [(k % 3, text(rnd.randrange(80, 160)), "en", "b") for k in range(60)] + [(k, text(100), None, None) for k in range(60)]
    taken = {}
    for r in corpus_pipeline.mix_sources(spark, rows_of(spark, rows), "").collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    total = sum(len(t.split()) for _, t, _, _ in rows)
    for source, weight in (("a", 1), ("b", 2), (None, 3)):
        assert abs(taken[source] - total * weight / 6) <= 0.02 * total, source


def test_mixing_of_rows_alike_keeps_their_number(spark):
    rows = [(1, "same words " * 50, "en", "a")] * 30 + [(2, "other words here " * 40, "en", "b")] * 30
    got = corpus_pipeline.mix_sources(spark, rows_of(spark, rows), "").collect()
    words = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in "ab"}
    assert abs(words["a"] - 6600 / 3) <= 200 and abs(words["b"] - 2 * 6600 / 3) <= 200


def test_filters_judge_rows_alike_whatever_their_ids(spark, small):
    """Quality rules and language ID, on repeated ids, nulls and ties: a row's verdict is its text's and its source's."""
    base = [(r["text"], r["lang"], r["source"]) for r in small.collect()]
    rows = [(i % 3 if i % 2 else None, t, lang if i % 5 else None, s) for i, (t, lang, s) in enumerate(base + base[:40])]
    docs = rows_of(spark, rows)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.language_id):
        kept = [(r["text"], r["source"]) for r in stage(spark, docs, "").collect()]
        verdict = {k: k in set(kept) for k in ((t, s) for _, t, _, s in rows)}
        assert sorted(map(str, kept)) == sorted(str((t, s)) for _, t, _, s in rows if verdict[t, s])
        assert 0 < len(kept) <= len(rows)
