"""Readers: JSON lines, prediction records, JSON trees, terminology files, Parquet, JDBC, digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTIONS = (
    "run_id string, case_id string, dataset string, task string, mode string, model_id string, gold_label string, predicted_label string, reasoning string, "
    "citations array<string>, observations array<struct<text: string, source_id: string>>, abstained boolean, latency_seconds double, prompt_hash string, "
    "cache_hit boolean, valid_evidence_ids array<string>, quality_flags array<string>, error string, metadata string"
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped.  A missing path is an empty relation, or an error if ``strict``.

    ``strict`` also fails on a malformed line, which is otherwise a row of nulls.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    try:
        return reader.json(path)
    except AnalysisException as missing:
        if strict or "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records with defaults for what a line leaves out; ``error`` stays null."""
    df = json_lines(spark, path, PREDICTIONS)
    defaults = {"string": "", "boolean": False, "double": 0.0}

    def filled(f: T.StructField):
        kind = f.dataType.simpleString()
        if f.name == "error":
            return F.col(f.name)
        default = F.lit(defaults[kind]) if kind in defaults else F.array().cast(f.dataType)
        return F.coalesce(F.col(f.name), default).alias(f.name)

    return df.select(*[filled(f) for f in df.schema.fields])


def _walk(tree: dict, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    for label, below in tree.items():
        here = (*path, label)
        yield here
        if isinstance(below, dict):
            yield from _walk(below, here)


def json_trees(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``graph_id, node, parent, path, depth`` of every node of nested JSON objects, one file a graph.

    Depth and keys are free, so each file's text is walked in Python; files are the unit of work.
    A label met twice keeps its last path and its first parent.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("graph_id"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for graph, text in zip(f["graph_id"], f["value"]):
                tree = json.loads(text)
                tree = tree.get("diagnostic", tree)
                nodes: dict[str, tuple] = {}
                for p in _walk(tree, ()):
                    first = nodes.get(p[-1])
                    nodes[p[-1]] = (first[0] if first else (p[-2] if len(p) > 1 else None), list(p))
                rows += [(graph, n, parent, p, len(p) - 1) for n, (parent, p) in nodes.items()]
            yield pd.DataFrame(rows, columns=["graph_id", "node", "parent", "path", "depth"])

    return files.mapInPandas(run, "graph_id string, node string, parent string, path array<string>, depth int")


def premises(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``graph_id, diagnosis, premise_type, position, text, premise_id`` from the graphs' ``knowledge``.

    A bare string is of type "Diagnostic Criteria"; texts are split at semicolons.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("graph_id"), "value")
    by_label = files.select("graph_id", F.explode(F.from_json(F.get_json_object("value", "$.knowledge"), "map<string,string>")).alias("diagnosis", "body"))
    nested = F.from_json("body", "map<string,string>")
    typed = F.when(F.startswith(F.trim("body"), F.lit("{")), nested).otherwise(F.create_map(F.lit("Diagnostic Criteria"), F.col("body")))
    each = by_label.select("graph_id", "diagnosis", F.explode(typed).alias("premise_type", "body"))
    parts = F.filter(F.transform(F.split("body", ";+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = each.select("graph_id", "diagnosis", "premise_type", F.posexplode(parts).alias("position", "text"))
    identity = F.concat_ws("\0", "graph_id", "diagnosis", "premise_type", "position", "text")
    return rows.withColumn("premise_id", F.concat(F.lit("source-chunk:"), F.substring(F.sha2(identity, 256), 1, 20)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of every line of the text files at ``path``; ``line_no`` counts from 0 in each file.

    A line's number is its place in its block of the file, plus the lines of the blocks before: the same however the
    files are split.  Bytes that are no UTF-8 are left out.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("value"))
    blocks = raw.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return raw.join(starts, ["file", "__block"]).select("file", (F.col("__id") + F.col("__shift")).alias("line_no"), "value")


def pipe_delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``file, line_no`` and the fields of pipe-delimited lines without quotes, with an empty field after the last pipe.

    (file, line_no) is the lines' order, whatever the partitions.
    """
    fields = F.split("value", "\\|")
    return numbered_lines(spark, path).select("file", "line_no", *[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet or ORC table, of which only ``columns`` (struct fields by dots) are read."""
    df = spark.read.orc(path) if path.endswith(".orc") else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def jdbc(spark: SparkSession, url: str, name: str, partition: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC, read in ``bounds`` = (low, high, parts) ranges of ``partition`` if given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition and bounds:
        reader = reader.options(partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(bounds[2]))
    return reader.load()


def require_tables(present: list[str], wanted: list[str]) -> None:
    """Exactly the wanted tables must be there."""
    missing, extra = sorted(set(wanted) - set(present)), sorted(set(present) - set(wanted))
    if missing or extra:
        raise ValueError(f"tables missing: {missing}; not allowed: {extra}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame) -> str:
    """One digest of all files' names and digests in path order; a manifest is small."""
    lines = [f"{r['path']}\0{r['sha256']}" for r in files.orderBy("path").collect()]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def require_matching(left: DataFrame, right: DataFrame, key: str) -> None:
    """Both relations must have the same set of keys."""
    odd = left.select(key).distinct().join(right.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "full").filter(F.col(key).isNull() | F.col("__k").isNull())
    if odd.limit(1).count():
        raise ValueError(f"keys on one side only: {[tuple(r) for r in odd.limit(5).collect()]}")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to all cores if the scan has fewer splits than there are cores; else leave them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
