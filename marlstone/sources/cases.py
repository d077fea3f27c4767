"""Annotated cases and guideline graphs: root discovery, annotation trees of any depth, labels, quality flags, extensions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import clinical
from marlstone.functions.text import label_key, slug
from marlstone.sources.readers import json_trees, premises

# The six sections of a case by their input, and where a dataset's folders may lie.
SECTIONS = ("chief_complaint", "history_of_present_illness", "past_medical_history", "family_history", "physical_exam", "pertinent_results")
INPUTS = tuple(f"input{k}" for k in range(1, 7))
CASES, GRAPHS = "Finished", "Diagnosis_flowchart"
LAYOUTS = ("", "/unpacked")

_TREE = "case_id string, n int, parent int, key string, problem string"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def dataset_root(spark: SparkSession, path: str, layouts: Sequence[str] = LAYOUTS) -> str:
    """The first of the ``layouts`` below ``path`` that has both the cases' and the graphs' folder, in any store that Spark reads."""
    for layout in layouts:
        root = f"{path.rstrip('/')}{layout}"
        there = [spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}") for name in (CASES, GRAPHS)]
        if all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in there):
            return root
    raise FileNotFoundError(f"no layout below {path} has {CASES} and {GRAPHS}")


def files(spark: SparkSession, root: str) -> DataFrame:
    """``relative, value``: the path below ``root`` and the whole text of every JSON file at any depth."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return found.select(F.regexp_replace(place, rf"^.*/\Q{base}\E/", "").alias("relative"), "value")


def _redacted(key: str) -> str:
    """A key's length and digest, which name it without its text."""
    return f"length={len(key)} sha256={hashlib.sha256(key.encode()).hexdigest()[:12]}"


def _walked(text: str | None) -> Iterator[tuple[int, int | None, str, str | None]]:
    """(number, parent's number, key, problem) of every node of the annotations in a case's JSON, parents first.

    The nodes yet to visit are on a stack of our own, so depth is bounded by memory only.
    """
    try:
        tree = json.loads(text or "")
    except (ValueError, RecursionError):
        tree = None
    if not isinstance(tree, dict):
        yield 0, None, "", "not a JSON object"
        return
    stack = [(k, v, None) for k, v in reversed(tree.items()) if k not in INPUTS]
    n = 0
    while stack:
        key, below, parent = stack.pop()
        n += 1
        yield n, parent, key, None if isinstance(below, dict) else f"children are no object ({_redacted(key)})"
        if isinstance(below, dict):
            stack += [(k, v, n) for k, v in reversed(below.items())]


def annotation_tree(cases: DataFrame) -> DataFrame:
    """``case_id, n, parent, key, problem``: a row for each annotation of ``case_id, value``, numbered in the file's order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(case, *row) for case, text in zip(f["case_id"], f["value"]) for row in _walked(text)]
            out = pd.DataFrame(rows, columns=["case_id", "n", "parent", "key", "problem"])
            yield out.astype({"n": "Int32", "parent": "Int32"})

    return cases.select("case_id", "value").mapInPandas(run, _TREE)


def annotations(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``case_id, node_id, n, text, role, section, annotation_index, problem`` and edges ``case_id, source, target, relation`` to their parents."""
    name = lambda n: F.concat(F.col("case_id"), F.lit(":a"), F.lpad(n.cast("string"), 4, "0"))
    read = clinical.annotation(F.col("key"))
    bad = F.when(F.col("role").isNull(), F.concat(F.lit("invalid annotation key (length="), F.length("key").cast("string"), F.lit(" sha256="), F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 12), F.lit(")")))
    rows = tree.withColumn("r", read).select("case_id", name(F.col("n")).alias("node_id"), "n", "parent", "key", F.col("problem").alias("p"), "r.text", "r.role", "r.section", F.col("r.index").alias("annotation_index"))
    nodes = rows.select("case_id", "node_id", "n", "text", "role", "section", "annotation_index", F.coalesce("p", bad).alias("problem"))
    edges = rows.filter("parent is not null").select("case_id", F.col("node_id").alias("source"), name(F.col("parent")).alias("target"), F.lit("supports").alias("relation"))
    return nodes, edges


def named_cases(found: DataFrame, prefix: str = "case") -> DataFrame:
    """``relative, value`` with the ``case_id`` of the path, the ``disease_category`` of its first folder and the ``directory_label`` of its last."""
    parts = F.split("relative", "/")
    ident = F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.col("relative").cast("binary"), 256), 1, 12))
    last = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))
    return found.withColumn("case_id", ident).withColumn("disease_category", _plain(F.get(parts, F.lit(0)))).withColumn("directory_label", _plain(last))


def cases(found: DataFrame, graph_nodes: DataFrame, prefix: str = "case") -> DataFrame:
    """A row a file: ``case_id, relative, disease_category, directory_label, sections, conclusion, gold_label, quality_flags, problems``.

    ``graph_nodes`` has ``category, label, is_leaf`` of the diagnoses.  Gold is the annotation root's text, spelled as a graph
    spells it, or as the folder does if both have one key.  Flags: no graph of the category, a conclusion outside it or not a leaf
    of it, another folder, an empty section.  ``problems`` says what keeps a file from being a case: other inputs than the six, not
    one root, a root that is no diagnosis, bad keys or children; texts are not repeated in it.
    """
    named = named_cases(found, prefix)
    nodes, _ = annotations(annotation_tree(named))
    root = nodes.join(annotation_tree(named).filter("parent is null").select("case_id", "n"), ["case_id", "n"])
    top = root.filter("n > 0").groupBy("case_id").agg(F.count(F.lit(1)).alias("roots"), F.min_by(F.struct("text", "role"), "n").alias("root"))
    wrong = nodes.filter("problem is not null").groupBy("case_id").agg(F.array_sort(F.collect_set("problem")).alias("bad"))
    body = F.from_json("value", "map<string,string>")
    inputs = F.array_sort(F.filter(F.map_keys(F.coalesce(body, F.create_map().cast("map<string,string>"))), lambda k: F.startswith(k, F.lit("input"))))
    filled = F.array(*[F.struct(F.lit(s).alias("key"), _plain(F.try_element_at(body, F.lit(i))).alias("value")) for i, s in zip(INPUTS, SECTIONS)])
    sections = F.map_from_entries(F.filter(filled, lambda e: e["value"] != ""))
    rows = named.withColumn("sections", sections).withColumn("__inputs", inputs).join(top, "case_id", "left").join(wrong, "case_id", "left")
    spelled = graph_nodes.groupBy(label_key(F.col("label")).alias("__gold")).agg(F.max("label").alias("__label"))
    own = graph_nodes.groupBy(label_key(F.col("category")).alias("__category"), label_key(F.col("label")).alias("__gold")).agg(F.bool_or("is_leaf").alias("__leaf"))
    known = graph_nodes.select(label_key(F.col("category")).alias("__category"), F.lit(True).alias("__graph")).distinct()
    rows = rows.withColumn("conclusion", F.col("root.text")).withColumn("__gold", label_key(F.coalesce("conclusion", F.lit("")))).withColumn("__category", label_key(F.col("disease_category")))
    rows = rows.join(spelled, "__gold", "left").join(known, "__category", "left").join(own, ["__category", "__gold"], "left")
    same = F.col("__gold") == label_key(F.coalesce("directory_label", F.lit("")))
    flags = F.array_compact(F.array(
        F.when(F.col("__graph").isNull(), "missing_guideline_graph").when(F.col("__leaf").isNull(), "conclusion_outside_category_graph").when(~F.col("__leaf"), "conclusion_not_leaf"),
        F.when(~same, "directory_conclusion_mismatch"), F.when(F.size("sections") < len(SECTIONS), "empty_input_section"),
    ))
    problems = F.concat(F.array_compact(F.array(
        F.when(F.col("__inputs") != F.array(*map(F.lit, INPUTS)), "inputs are not input1 to input6"),
        F.when(F.coalesce("roots", F.lit(0)) != 1, "not one annotation root"),
        F.when((F.col("roots") == 1) & ~F.coalesce(F.col("root.role") == "diagnosis", F.lit(False)), "annotation root is not a diagnosis"),
    )), F.coalesce("bad", F.array().cast("array<string>")))
    gold = F.when(same, F.col("directory_label")).otherwise(F.coalesce("__label", "conclusion"))
    return rows.select("case_id", "relative", "disease_category", "directory_label", "sections", "conclusion", gold.alias("gold_label"), flags.alias("quality_flags"), problems.alias("problems"))


def require_whole(loaded: DataFrame) -> DataFrame:
    """The cases, or an error that names the first files with problems."""
    bad = loaded.filter(F.size("problems") > 0).select("relative", "problems").limit(5).collect()
    if bad:
        raise ValueError(f"cases with problems: {[(r['relative'], r['problems']) for r in bad]}")
    return loaded


def graph_nodes(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``category, node_id, label, path, depth, is_leaf`` of every diagnosis in the graphs' files; also those only the knowledge names."""
    tree = json_trees(spark, path, glob)
    parents = tree.select("graph_id", F.col("parent").alias("node")).distinct().withColumn("__p", F.lit(True))
    placed = tree.join(parents, ["graph_id", "node"], "left").select("graph_id", F.col("node").alias("label"), "path", "depth", F.col("__p").isNull().alias("is_leaf"))
    extra = premises(spark, path, glob).select("graph_id", F.col("diagnosis").alias("label")).distinct()
    keyed = placed.select("graph_id", label_key(F.col("label")).alias("k"))
    lone = extra.withColumn("k", label_key(F.col("label"))).join(keyed, ["graph_id", "k"], "left_anti").select("graph_id", "label", F.array("label").alias("path"), F.lit(0).alias("depth"), F.lit(True).alias("is_leaf"))
    return placed.unionByName(lone).select(F.col("graph_id").alias("category"), node_id(F.col("graph_id"), F.col("label")).alias("node_id"), "label", "path", "depth", "is_leaf")


def node_id(category: Column, label: Column) -> Column:
    return F.concat(F.lit("diagnosis:"), slug(category), F.lit(":"), slug(label))


def graph_edges(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``category, source, target, relation``: ``refines_to`` from a diagnosis to its children and ``supports`` from a premise to its diagnosis."""
    tree = json_trees(spark, path, glob).filter("parent is not null")
    down = tree.select(F.col("graph_id").alias("category"), node_id(F.col("graph_id"), F.col("parent")).alias("source"), node_id(F.col("graph_id"), F.col("node")).alias("target"), F.lit("refines_to").alias("relation"))
    up = premises(spark, path, glob).select(F.col("graph_id").alias("category"), F.col("premise_id").alias("source"), node_id(F.col("graph_id"), F.col("diagnosis")).alias("target"), F.lit("supports").alias("relation"))
    return down.distinct().unionByName(up)


def extensions(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """``category, relative, value`` of the graph extensions in a folder, without their provenance files.

    Categories, the files' names in plain spelling, must be unique and, if ``existing`` has a ``category``, new.
    """
    found = files(spark, path).filter(~F.endswith("relative", F.lit(".provenance.json"))).withColumn("category", _plain(F.regexp_extract("relative", r"([^/]+)\.json$", 1)))
    twice = found.groupBy("category").count().filter("count > 1")
    if twice.limit(1).count():
        raise ValueError(f"categories of several extensions: {sorted(r['category'] for r in twice.limit(5).collect())}")
    if existing is not None:
        clash = found.join(existing.select("category").distinct(), "category", "left_semi").limit(5).collect()
        if clash:
            raise ValueError(f"categories that exist already: {sorted(r['category'] for r in clash)}")
    return found
