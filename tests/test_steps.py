"""Rounds of completion, closures, line order, published versions, resampling: against plain versions and cut-off runs."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import graphs, metrics, rounds
from marlstone.sources import readers, sinks


# ---- rounds


def completer_of(log):
    def completer(prompt, budget):
        case = prompt.split()[1]
        with open(os.path.join(log, f"{case}-{budget}"), "a") as f:
            f.write(prompt + "\0")
        if case in ("a", "b") and budget < {"a": 200, "b": 300}[case]:
            return "cut off"
        if case == "x":
            raise TimeoutError("no answer")
        return f'{{"case": "{case}"}}'

    return completer


def checker():
    def check(answer):
        try:
            json.loads(answer)
            return None
        except ValueError:
            return "not JSON"

    return check


def test_rounds_ask_again_with_the_error_and_more_room(spark, tmp_path):
    log, at = tmp_path / "log", str(tmp_path / "rounds")
    log.mkdir()
    requests = spark.createDataFrame([(c, f"case {c}") for c in "abcx"] + [("c", "case c")], "id string, prompt string")
    run = lambda: {r["id"]: (r["answer"], r["error"], r["attempt"]) for r in rounds.complete(requests, "id", completer_of(str(log)), checker(), at, (100, 200, 300)).collect()}
    want = {"a": ('{"case": "a"}', None, 2), "b": ('{"case": "b"}', None, 3), "c": ('{"case": "c"}', None, 1), "x": (None, "TimeoutError: no answer", 3)}
    assert run() == want
    asked = {p.name: p.read_text().split("\0")[:-1] for p in log.iterdir()}
    assert sorted(asked) == sorted(["a-100", "a-200", "b-100", "b-200", "b-300", "c-100", "x-100", "x-200", "x-300"])
    assert all(len(v) == 1 for v in asked.values())
    assert asked["a-100"] == ["case a"] and "refused: not JSON" in asked["a-200"][0] and "TimeoutError" in asked["x-300"][0] and asked["b-300"][0].count("refused") == 1
    assert run() == want and all(len(p.read_text().split("\0")) == 2 for p in log.iterdir())


def test_a_run_that_was_cut_off_goes_on(spark, tmp_path):
    log, at = tmp_path / "log", tmp_path / "rounds"
    log.mkdir()
    requests = spark.createDataFrame([(c, f"case {c}") for c in "abc"], "id string, prompt string")
    rounds.complete(requests, "id", completer_of(str(log)), checker(), str(at), (100, 200, 300)).collect()
    os.remove(at / "attempt-2" / "_SUCCESS")  # as if lost while it was written
    for p in log.iterdir():
        p.unlink()
    got = {r["id"]: r["attempt"] for r in rounds.complete(requests, "id", completer_of(str(log)), checker(), str(at), (100, 200, 300)).collect()}
    assert got == {"a": 2, "b": 3, "c": 1}
    assert sorted(p.name for p in log.iterdir()) == ["a-200", "b-200"]


def test_no_requests(spark, tmp_path):
    none = spark.createDataFrame([], "id string, prompt string")
    assert rounds.complete(none, "id", completer_of(str(tmp_path)), checker(), str(tmp_path / "r")).collect() == []


def test_a_failing_case_stops_no_other(spark):
    def work(f):
        if (f["n"] < 0).any():
            raise ValueError("negative")
        return pd.DataFrame({"total": [f["n"].sum()]})

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1), ("c", 5)], "id string, n long")
    assert sorted(map(tuple, rounds.per_case(rows, "id", work, "total long").collect())) == [("a", 3, None), ("b", None, "ValueError: negative"), ("c", 5, None)]


# ---- graphs


def test_closure_of_a_long_chain_and_a_diamond(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(300)]
    edges = spark.createDataFrame([*chain, ("n0", "n5"), ("r", "s"), ("r", "s")], "parent string, child string")
    got = {(r["ancestor"], r["node"]): r["distance"] for r in graphs.closure(edges).collect()}
    assert len(got) == 301 * 300 // 2 + 1
    assert got["n0", "n300"] == 296 and got["n0", "n5"] == 1 and got["n1", "n300"] == 299 and got["r", "s"] == 1


@pytest.mark.parametrize("edges", [[("a", "a")], [("a", "b"), ("b", "c"), ("c", "a")], [("x", "a"), ("a", "b"), ("b", "a")]])
def test_cycles_are_refused(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        graphs.closure(spark.createDataFrame(edges, "parent string, child string"))


def test_paths_of_a_forest(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("x", "y")], "parent string, child string")
    got = {r["node"]: (r["path"], r["is_leaf"]) for r in graphs.tree_paths(edges).collect()}
    assert got == {"a": (["a"], False), "b": (["a", "b"], False), "c": (["a", "b", "c"], True), "d": (["a", "b", "d"], True), "x": (["x"], False), "y": (["x", "y"], True)}


def test_common_prefixes(spark):
    rows = [(1, ["a", "b", "c"]), (1, ["a", "b"]), (1, ["a", "b", "d"]), (2, ["a"]), (2, ["b"]), (3, ["q", "r"]), (4, []), (4, ["a"]), (5, ["a", None, "b"]), (5, ["a", None, "c"])]
    got = {r["g"]: (r["prefix"], r["label"]) for r in graphs.shared_ancestors(spark.createDataFrame(rows, "g int, p array<string>"), ["g"], "p").collect()}
    assert got == {1: (["a", "b"], "b"), 2: ([], None), 3: (["q", "r"], "r"), 4: ([], None), 5: (["a", None], None)}


# ---- lines


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"C{k}|ENG|S{k % 3}|term {k % 50}|{'Y' if k % 7 == 0 else 'N'}|" for k in range(4000)]
    (tmp_path / "a.rrf").write_text("\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.rrf").write_bytes(b"bad \xff byte|x|\n" + "\n".join(lines[2500:]).encode())
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4000", "33333", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.pipe_delimited(spark, str(tmp_path), ["concept", "language"]).collect()
            seen.append(sorted((os.path.basename(r["file"]), r["line_no"], r["concept"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == seen[2]
    assert [r[1] for r in seen[0]] == [*range(2500), *range(1501)] and seen[0][2499][2] == "C2499" and seen[0][2500][2] == "bad  byte"


def test_the_last_line_says_whether_a_term_is_preferred(spark):
    rows = [("C1", "ENG", "S1", "t", "Y", "a", 5), ("C1", "ENG", "S1", "t", "N", "b", 0), ("C1", "FRE", "S1", "t", "Y", "b", 9), ("C2", "ENG", "S2", "u", "N", "a", 1), ("C2", "ENG", "S2", "u", "Y", "a", 2), ("C3", "ENG", "S9", "v", "Y", "a", 3)]
    lines = spark.createDataFrame(rows, "concept string, language string, source string, term string, is_preferred string, file string, line_no long")
    got = sorted((r["concept"], r["source_rank"], r["preferred"]) for r in graphs.concepts(lines, ["ENG"], {"S1": 0, "S2": 1}).collect())
    assert got == [("C1", 0, 0), ("C2", 1, 1)]


# ---- published versions


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", sinks.STEPS)
def test_a_write_killed_after_any_step_leaves_a_whole_version(spark, tmp_path, step):
    path = str(tmp_path / "out")
    sinks.publish({"t": spark.range(5), "u": spark.range(2)}, path)

    def kill(at):
        if at == step:
            raise Killed

    with pytest.raises(Killed):
        sinks.publish({"t": spark.range(50), "u": spark.range(20)}, path, after=kill)
    new = step == "commit"
    assert (sinks.published(spark, path, "t").count(), sinks.published(spark, path, "u").count()) == ((50, 20) if new else (5, 2))
    assert sinks.damaged(spark, path).count() == 0
    sinks.publish({"t": spark.range(7), "u": spark.range(1)}, path)
    assert sinks.published(spark, path, "t").count() == 7


def test_damage_shows(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.bundle({"t": spark.range(5).coalesce(1)}, path)
    file = next((tmp_path / "out" / "versions").glob("*/t/part-*"))
    file.write_text(file.read_text() + "9\n")
    (file.parent / f".{file.name}.crc").unlink()
    (file.parent / "part-extra.csv").write_text("1\n")
    assert sorted(r["path"].split("/")[-1] for r in sinks.damaged(spark, path).collect()) == sorted([file.name, "part-extra.csv"])


def test_manifest_replaces_an_older_one(spark, tmp_path):
    path = str(tmp_path / "m")
    for n in (1, 2):
        sinks.manifest(spark.createDataFrame([(n,)], "n int"), path)
        assert [r["n"] for r in spark.read.json(path).collect()] == [n]
    with pytest.raises(ValueError):
        sinks.manifest(spark.range(2), path)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["m"]


# ---- resampling


def test_paired_bootstrap_is_the_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [("g", f"k{k}", float(rng.integers(0, 2)), float(rng.integers(0, 2))) for k in range(300)] + [(None, "x", 0.0, 1.0), ("h", "y", None, 1.0), ("h", "z", 1.0, 1.0), ("only null", "q", None, None)]
    df = spark.createDataFrame(rows, "g string, k string, a double, b double")
    got = {r["g"]: r for r in metrics.paired_bootstrap(df, "g", "k", "a", "b", resamples=200, cell_rows=40).collect()}
    again = {r["g"]: r for r in metrics.paired_bootstrap(df.repartition(7), "g", "k", "a", "b", resamples=200, cell_rows=40).collect()}
    assert got == again and set(got) == {"g", "h", None}
    assert (got[None]["mean"], got[None]["low"], got[None]["high"], got[None]["pairs"]) == (1.0, 1.0, 1.0, 1)
    cells = max(1, round(300 / 40))
    dealt = {}
    keyed = df.filter("g = 'g'").select("k", (F.col("b") - F.col("a")).alias("d")).select("k", "d", F.pmod(F.xxhash64("k", "d"), F.lit(cells)).alias("c"))
    for r in keyed.collect():
        dealt.setdefault(r["c"], []).append((r["k"], r["d"]))
    names = sorted(dealt)
    draws = metrics.resampled_sizes([len(dealt[c]) for c in names], 200, 17, "=g")
    assert (draws.sum(axis=1) == 300).all()
    sums = sum(metrics.resampled_sums(np.array([d for _, d in sorted(dealt[c])]), draws[:, i], 17, "=g", c) for i, c in enumerate(names))
    low, high = np.quantile(sums / 300, [0.025, 0.975])
    diffs = np.array([b - a for g, _, a, b in rows if g == "g"])
    assert got["g"]["mean"] == diffs.mean()
    assert got["g"]["low"] == pytest.approx(low, abs=1e-12) and got["g"]["high"] == pytest.approx(high, abs=1e-12)
    spread = diffs.std() / np.sqrt(300)
    assert got["g"]["high"] - got["g"]["low"] == pytest.approx(2 * 1.96 * spread, rel=0.2)
