"""Cases and graphs written as files and read back; bad inputs are flagged, not lost."""

import json

import pytest

from marlstone.sources import cases

SECTIONS = {f"input{k}": f"section {k}\n text" for k in range(1, 7)}


@pytest.fixture
def dataset(tmp_path):
    def write(name, tree, base="Finished"):
        at = tmp_path / "unpacked" / base / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(tree if isinstance(tree, str) else json.dumps(tree))

    write("Heart.json", {"diagnostic": {"Heart Failure": {"Suspected HF": {"HFrEF": []}, "HFpEF": []}}, "knowledge": {"HFrEF": {"Signs": "edema; rales;; "}, "Cor pulmonale": "loud P2"}}, "Diagnosis_flowchart")
    deep = {}
    for k in range(600, 0, -1):
        deep = {f"step {k}$Cause_{k}": deep}
    write("Heart/HFrEF/a 1+2.json", {**SECTIONS, "hfref$Intermedia_4": {"low EF$Input6_2": {}, **deep}})
    write("Heart/HFrEF/b.json", {**SECTIONS, "input2": " ", "Heart  Failure$Intermedia": {}})
    write("Lung/PE/c.json", {**SECTIONS, "PE$Intermedia_1": {}})
    write("Heart/Other/d.json", {**SECTIONS, "Shock$Intermedia_1": {}})
    write("Heart/X/no_json.json", "{oops")
    write("Heart/X/two_roots.json", {**SECTIONS, "A$Intermedia_1": {}, "B$Intermedia_1": {}})
    write("Heart/X/cause_root.json", {**SECTIONS, "A$Cause_1": {}})
    write("Heart/X/keys.json", {**{k: v for k, v in SECTIONS.items() if k != "input6"}, "A$Intermedia_1": {"secret text": {}, "B$Cause_1": "no object"}})
    return tmp_path


@pytest.fixture
def loaded(spark, dataset):
    root = cases.dataset_root(spark, str(dataset))
    nodes = cases.graph_nodes(spark, f"{root}/Diagnosis_flowchart")
    return root, cases.cases(cases.files(spark, f"{root}/Finished"), nodes)


def test_labels_flags_and_problems(loaded):
    got = {r["relative"]: r for r in loaded[1].collect()}
    a, b, c, d = (got[x] for x in ("Heart/HFrEF/a 1+2.json", "Heart/HFrEF/b.json", "Lung/PE/c.json", "Heart/Other/d.json"))
    assert (a["gold_label"], a["directory_label"], a["disease_category"], a["quality_flags"], a["problems"]) == ("HFrEF", "HFrEF", "Heart", [], [])
    assert a["sections"]["chief_complaint"] == "section 1 text" and len(a["sections"]) == 6
    assert (b["gold_label"], b["quality_flags"]) == ("Heart Failure", ["conclusion_not_leaf", "directory_conclusion_mismatch", "empty_input_section"])
    assert "history_of_present_illness" not in b["sections"]
    assert c["quality_flags"] == ["missing_guideline_graph"] and c["gold_label"] == "PE"
    assert d["quality_flags"] == ["conclusion_outside_category_graph", "directory_conclusion_mismatch"]
    assert got["Heart/X/no_json.json"]["problems"] == ["inputs are not input1 to input6", "not one annotation root", "not a JSON object"]
    assert got["Heart/X/two_roots.json"]["problems"] == ["not one annotation root"]
    assert got["Heart/X/cause_root.json"]["problems"] == ["annotation root is not a diagnosis"]
    bad = got["Heart/X/keys.json"]["problems"]
    assert [p.split(" (")[0] for p in bad] == ["inputs are not input1 to input6", "children are no object", "invalid annotation key"]
    assert not any("secret" in p for p in bad) and "length=11 " in bad[-1]
    assert len(got) == 8


def test_strict_loading_names_the_files(loaded):
    with pytest.raises(ValueError, match="two_roots"):
        cases.require_whole(loaded[1])


def test_deep_annotations_round_trip(spark, loaded):
    found = cases.named_cases(cases.files(spark, f"{loaded[0]}/Finished").filter("relative like '%a 1+2%'"))
    nodes, edges = cases.annotations(cases.annotation_tree(found))
    rows = {r["node_id"].split(":")[1]: r for r in nodes.collect()}
    up = {r["source"].split(":")[1]: r["target"].split(":")[1] for r in edges.collect()}
    assert len(rows) == 602 and len(up) == 601
    assert (rows["a0001"]["text"], rows["a0001"]["role"], rows["a0001"]["annotation_index"]) == ("hfref", "diagnosis", 4)
    assert (rows["a0002"]["text"], rows["a0002"]["role"], rows["a0002"]["section"]) == ("low EF", "observation", "pertinent_results")
    assert up["a0002"] == up["a0003"] == "a0001" and all(up[f"a{k:04d}"] == f"a{k - 1:04d}" for k in range(4, 603))
    assert (rows["a0602"]["text"], rows["a0602"]["annotation_index"]) == ("step 600", 600)


def test_graph_nodes_and_edges(spark, loaded):
    path = f"{loaded[0]}/Diagnosis_flowchart"
    nodes = {r["label"]: (r["path"], r["is_leaf"]) for r in cases.graph_nodes(spark, path).collect()}
    assert nodes == {"Heart Failure": (["Heart Failure"], False), "Suspected HF": (["Heart Failure", "Suspected HF"], False), "HFrEF": (["Heart Failure", "Suspected HF", "HFrEF"], True), "HFpEF": (["Heart Failure", "HFpEF"], True), "Cor pulmonale": (["Cor pulmonale"], True)}
    edges = [(r["relation"], r["target"]) for r in cases.graph_edges(spark, path).collect()]
    assert sorted(edges) == sorted([("refines_to", "diagnosis:heart:suspected-hf"), ("refines_to", "diagnosis:heart:hfref"), ("refines_to", "diagnosis:heart:hfpef"), ("supports", "diagnosis:heart:hfref"), ("supports", "diagnosis:heart:hfref"), ("supports", "diagnosis:heart:cor-pulmonale")])


def test_no_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cases.dataset_root(spark, str(tmp_path))


def test_extensions_are_unique_and_new(spark, tmp_path):
    for name in ("One.json", "Two.json", "Two.provenance.json", "deeper/Three.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert sorted(r["category"] for r in cases.extensions(spark, str(tmp_path)).collect()) == ["One", "Three", "Two"]
    with pytest.raises(ValueError, match="exist already.*Two"):
        cases.extensions(spark, str(tmp_path), spark.createDataFrame([("Two",), ("Nine",)], "category string"))
    (tmp_path / "deeper" / "One.json").write_text("{}")
    with pytest.raises(ValueError, match="several extensions.*One"):
        cases.extensions(spark, str(tmp_path))
