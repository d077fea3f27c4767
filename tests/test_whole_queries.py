"""Queries over all rows against brute force."""

from collections import Counter
from math import comb

import pytest

from marlstone.plans import catalogue
from oracle import SMALL, connect

QUERIES = catalogue.queries()


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_paired_tests_take_all_labelled_documents(spark, sf_dir):
    pairs, base, other = Counter(), Counter(), Counter()
    for lang, quality, toxic in connect(sf_dir).sql("SELECT lang, quality, toxic FROM documents JOIN labels USING (doc_id)").fetchall():
        pairs[lang] += 1
        base[lang] += quality == 1 and toxic == 0
        other[lang] += quality == 0 and toxic == 1
    got = {r["lang"]: r for r in QUERIES["paired_exact"](spark, sf_dir).collect()}
    p = {}
    for lang in pairs:
        n, low = base[lang] + other[lang], min(base[lang], other[lang])
        p[lang] = min(1, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0
    assert {k: (r["pairs"], r["base_only"], r["other_only"]) for k, r in got.items()} == {k: (pairs[k], base[k], other[k]) for k in pairs}
    assert all(abs(got[k]["p_value"] - p[k]) < 1e-6 for k in pairs)
    most, want = 0.0, {}
    for i, k in enumerate(sorted(p, key=lambda k: (round(p[k], 6), k))):
        most = max(most, (len(p) - i) * p[k])
        want[k] = min(1.0, most)
    holm = {r["lang"]: r["p_holm"] for r in QUERIES["holm"](spark, sf_dir).collect()}
    assert set(holm) == set(want) and all(abs(holm[k] - want[k]) < 1e-5 for k in want)


def test_shared_modality_pairs_are_all_pairs(spark):
    import json

    keys = {}
    for user, kind, props in connect(SMALL).sql("SELECT user_id, event_type, props FROM events WHERE value > 150").fetchall():
        keys.setdefault((kind, user), set()).add(json.loads(props)["k"] % 10)
    want = {(a, b, kind, len(x & y)) for (kind, a), x in keys.items() for (other, b), y in keys.items() if kind == other and a < b and x & y}
    members = {}
    for r in QUERIES["shared_modality_classes"](spark, SMALL).collect():
        members.setdefault((r["event_type"], r["class"]), []).append(r["user_id"])
    got = []
    for r in QUERIES["shared_modality_pairs"](spark, SMALL).collect():
        a, b = (members[r["event_type"], r[c]] for c in ("class_a", "class_b"))
        users = {(min(x, y), max(x, y)) for x in a for y in b if x != y}
        assert len(users) == r["pairs"]
        got += [(x, y, r["event_type"], r["shared"]) for x, y in users]
    assert want and len(got) == len(want) and set(got) == want
