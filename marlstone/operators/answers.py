"""Reading a model's answers: JSON objects in text, closed schemas, and the parsers of the argument stages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"(?s)^\s*```json\s*\n(.*?)\n?```\s*$"


def _first_object(text: str | None) -> str | None:
    """From the first ``{`` to the brace that closes it, with strings and escapes taken into account."""
    depth, start, quoted, escaped = 0, -1, False, False
    for i, ch in enumerate(text or ""):
        if start < 0:
            if ch == "{":
                start, depth = i, 1
            continue
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def first_objects(answers: DataFrame, text: str, out: str = "object") -> DataFrame:
    """Add the first whole JSON object of ``text``, or null; the scan keeps state, so it runs on batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields) + f", `{out}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [_first_object(t) for t in f[text]]})

    return answers.mapInPandas(run, schema)


def fenced(text: Column) -> Column:
    """The JSON of an answer that is exactly one json fence with one object in it, or null."""
    body = F.regexp_extract(text, FENCE, 1)
    return F.when(F.regexp_like(text, F.lit(FENCE)) & ~F.contains(body, F.lit("```")) & F.regexp_like(body, F.lit(r"(?s)^\s*\{.*\}\s*$")), body)


def closed(text: Column, schema: str, keys: list[str]) -> Column:
    """The object read with ``schema`` if its keys are exactly ``keys``, else null."""
    own = F.array_sort(F.json_object_keys(text))
    return F.when(own == F.array(*[F.lit(k) for k in sorted(keys)]), F.from_json(text, schema))


def activations(choices: DataFrame, owners: DataFrame, per_candidate: int = 2, limit: int = 4) -> DataFrame:
    """``case_id, candidate_id, pair_id, place, refill``: up to ``limit`` candidates, each with pairs of its own.

    ``choices``: case_id, candidate_id, rank, pair_id, position, as the model named them; ``owners``:
    case_id, pair_id, candidate_id, score.  A pair of another candidate is dropped, and a candidate
    short of pairs is refilled with its best others.
    """
    first = choices.groupBy("case_id", "candidate_id").agg(F.min("rank").alias("rank"))
    known = first.join(owners.select("case_id", "candidate_id").distinct(), ["case_id", "candidate_id"], "left_semi")
    active = known.withColumn("__n", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "candidate_id"))).filter(F.col("__n") <= limit).drop("__n")
    named = choices.groupBy("case_id", "candidate_id", "pair_id").agg(F.min("position").alias("position"))
    pool = owners.join(active, ["case_id", "candidate_id"]).join(named, ["case_id", "candidate_id", "pair_id"], "left")
    order = Window.partitionBy("case_id", "candidate_id").orderBy(F.col("position").asc_nulls_last(), F.col("score").desc(), "pair_id")
    placed = pool.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_candidate)
    return placed.select("case_id", "candidate_id", "pair_id", "place", F.col("position").isNull().alias("refill"))


def differential(rows: DataFrame) -> DataFrame:
    """The direct comparison's answer, closed on failure.

    Columns: decision, candidate_id, child_label, pairs (of the candidate), foreign (pairs that are
    not), allowed_children.  A supported answer needs a candidate and pairs of its own, and no others;
    a child that is not allowed falls back to the family.
    """
    sound = (F.col("decision") == "supported") & (F.coalesce("candidate_id", F.lit("")) != "") & (F.size("pairs") > 0) & (F.size("foreign") == 0)
    child = F.when(F.array_contains("allowed_children", F.col("child_label")), F.col("child_label")).otherwise("")
    return rows.withColumn("decision", F.when(F.coalesce(sound, F.lit(False)), "supported").otherwise("inconclusive")).withColumn("child_label", F.when(F.col("decision") == "supported", F.coalesce(child, F.lit(""))).otherwise(""))


def attack(rows: DataFrame) -> DataFrame:
    """An attack stands only with evidence: a better alternative needs its own pairs, any other a cited one."""
    better = F.col("attack_type") == "better_supported_alternative"
    grounded = F.when(better, (F.coalesce("alternative", F.lit("")) != "") & (F.size("alternative_pairs") > 0)).otherwise(F.size("pairs") > 0)
    stands = F.col("attack") & F.coalesce(grounded, F.lit(False))
    return rows.withColumn("attack", F.coalesce(stands, F.lit(False))).withColumn("alternative", F.when(F.col("attack") & better, F.col("alternative")).otherwise(""))


def grounded_arguments(arguments: DataFrame, valid: DataFrame) -> DataFrame:
    """Arguments whose evidence ids are all valid, the first of each (case, claim, evidence set).

    ``arguments``: case_id, position, claim, evidence_ids; ``valid``: case_id, evidence_id.
    """
    ids = arguments.withColumn("evidence_ids", F.array_sort(F.array_distinct(F.transform("evidence_ids", lambda x: F.upper(F.trim(x))))))
    each = ids.select("case_id", "position", F.explode("evidence_ids").alias("evidence_id"))
    known = valid.select("case_id", F.upper(F.trim("evidence_id")).alias("evidence_id")).distinct()
    bad = each.join(known, ["case_id", "evidence_id"], "left_anti").select("case_id", "position").distinct()
    kept = ids.filter(F.size("evidence_ids") > 0).join(bad, ["case_id", "position"], "left_anti")
    first = Window.partitionBy("case_id", F.lower("claim"), "evidence_ids").orderBy("position")
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
