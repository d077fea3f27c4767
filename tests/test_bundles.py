"""Bundles against a plain loop, and gates that fail one at a time."""

import random

import pytest

from marlstone.operators import bundles

DDL = {
    "p": "case_id string, mode string, error string, predicted_label string, bundle_sha256 string, retriever_id string",
    "t": "case_id string, bundle_sha256 string, consumers array<string>, provenance array<struct<node_id:string,diagnostic_path:array<string>,source_chunk_id:string,knowledge_source_ids:array<string>>>, candidate_ids array<string>, action string, resolved string, symbolic boolean, dialectical boolean, leaks boolean, flat_sha256 string, flat_shared boolean",
    "d": "case_id string, bundle_sha256 string, selected string, abstained boolean, error string",
}


def plain_bundle(bindings, siblings, k):
    """``bindings``: rank -> sources; ``siblings``: family -> (representative rank, [(rank, id, sources)])."""
    out = []
    for rank in sorted(bindings):
        if bindings[rank][0] not in [s for _, s in out]:
            out.append((rank, bindings[rank][0]))
    families = sorted((min(r for r, _, _ in alts) - rep, f, sorted(alts)) for f, (rep, alts) in siblings.items() if alts)
    for depth in range(max((len(a) for *_, a in families), default=0)):
        for _, f, alts in families:
            new = [s for s in alts[depth][2] if s not in [x for _, x in out]] if depth < len(alts) else []
            if new and len(out) < k:
                out.append((f, new[0]))
    for rank in sorted(bindings):
        for s in bindings[rank][1:]:
            if s not in [x for _, x in out] and len(out) < k:
                out.append((rank, s))
    return out


def test_fixed_bundle_is_the_plain_loop(spark):
    rng = random.Random(5)
    bound, other, want = [], [], {}
    for q in range(40):
        b = {r: [f"s{rng.randrange(14)}" for _ in range(rng.randint(1, 4))] for r in range(1, rng.randint(2, 6))}
        s = {r: (r, [(rng.randint(r + 1, 20), f"c{r}{i}", rng.sample([f"s{x}" for x in range(14)], rng.randint(0, 3))) for i in range(rng.randint(0, 3))]) for r in b}
        want[q] = plain_bundle(b, s, 9)
        bound += [(q, r, i, x) for r, xs in b.items() for i, x in enumerate(xs)]
        other += [(q, f, rep, r, c, xs) for f, (rep, alts) in s.items() for r, c, xs in alts]
    got = bundles.fixed_bundle(spark.createDataFrame(bound, "q int, rank int, position int, source_id string"), spark.createDataFrame(other, "q int, family_rank int, representative_rank int, candidate_rank int, candidate_id string, sources array<string>"), "q", 9)
    rows = sorted(got.collect(), key=lambda r: (r["q"], r["place"]))
    assert {q: [(r["rank"], r["source_id"]) for r in rows if r["q"] == q] for q in want} == want
    assert all(r["evidence_id"] == f"K{r['place']}" and r["score"] == round(1 / r["rank"], 6) for r in rows)


def good_run():
    p = [(c, m, None, "A", h, f"r-{m}") for c in ("1", "2") for m, h in (("flat_rag", "f" + c), ("graph_rag", "g" + c))]
    t = [(c, "g" + c, ["g" + c], [("n", ["a"], "s", ["k"])], ["x"], "keep", "A", False, True, False, "f" + c, False) for c in ("1", "2")]
    d = [("1", "g1", "x", False, None), ("2", "g2", None, True, "")]
    return p, t, d


def gates(spark, p, t, d, cases=("1", "2")):
    frames = [spark.createDataFrame(rows, DDL[k]) for k, rows in zip("ptd", (p, t, d))]
    want = spark.createDataFrame([(c,) for c in cases], "case_id string")
    return bundles.run_gates(*frames, want, ["flat_rag", "graph_rag"], {"flat_rag": "r-flat_rag", "graph_rag": "r-graph_rag"}).first().asDict()


def swap(row, at, value):
    return (*row[:at], value, *row[at + 1 :])


@pytest.mark.parametrize(("table", "row", "at", "value", "failed"), [
    (0, 0, 2, "boom", {"no_errors"}),
    (0, 0, 1, "graph_rag", {"modes_once", "flat_independent"}),
    (0, 3, 4, "zz", {"bundle_identity"}),
    (0, 0, 5, "other", {"flat_independent"}),
    (1, 0, 2, ["zz"], {"bundle_identity"}),
    (1, 0, 3, [], {"provenance"}),
    (1, 0, 3, [("n", [], "s", ["k"])], {"provenance"}),
    (1, 1, 7, True, {"resolver_bounded"}),
    (1, 1, 9, True, {"no_leaks"}),
    (1, 1, 11, True, {"flat_independent"}),
    (2, 0, 2, "unknown", {"bound_or_abstained"}),
    (2, 0, 2, None, set()),
    (2, 1, 2, "x", {"bound_or_abstained"}),
    (2, 1, 4, "late", {"bound_or_abstained"}),
])
def test_each_gate_fails_alone(spark, table, row, at, value, failed):
    run = [list(rows) for rows in good_run()]
    run[table][row] = swap(run[table][row], at, value)
    got = gates(spark, *run)
    names = set(got) - {"cases", "predictions", "all_gates_pass"}
    assert {n for n in names if not got[n]} >= failed and got["all_gates_pass"] == (not failed)
    if "flat_rag" not in str(value) and at != 1:
        assert {n for n in names if not got[n]} == failed


def test_a_run_of_other_cases_fails(spark):
    assert gates(spark, *good_run())["all_gates_pass"]
    assert not gates(spark, *good_run(), cases=("1",))["case_set"]
    assert not gates(spark, *good_run(), cases=("1", "2", "3"))["modes_once"]
    assert not gates(spark, [], [], [], cases=())["all_gates_pass"]


def test_payload_tells_no_gold(spark):
    cases = spark.createDataFrame([("a", "GOLD", "CAT"), ("b", "GOLD", "CAT")], "case_id string, gold_label string, gold_category string")
    parts = spark.createDataFrame([("a", "physical_exam", "fine"), ("a", "chief_complaint", "pain"), ("a", "other", "x"), ("b", "chief_complaint", "  ")], "case_id string, section string, text string")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    got = {r["case_id"]: r for r in bundles.question_set(cases, parts, want, "Say.").collect()}
    assert [e["evidence_id"] for e in got["a"]["evidence"]] == ["S-CC", "S-EXAM"] and "GOLD" not in got["a"]["payload"]
    assert (got["a"]["problem"], got["b"]["problem"], got["c"]["problem"]) == (None, "no evidence", "missing case")
    assert got["b"]["payload"] is None and got["c"]["gold_label"] is None
