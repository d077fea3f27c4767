"""Audits, gates, run comparisons and record digests: one row per audited group, from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import typed
from marlstone.sources.sinks import canonical_json


def corpus_audit(premises: DataFrame, graphs: int, extensions: int) -> DataFrame:
    """One row on a corpus of ``source_chunk_id, graph_id, node_id, text, diagnostic_path, is_extension``: counts and gates.

    Three distinct counts, so each premise is expanded to three thin rows and combined before the shuffle; chunk ids, which may be
    long, are counted by their digests.
    """
    missing = (F.coalesce("source_chunk_id", F.lit("")) == "") | (F.coalesce("node_id", F.lit("")) == "") | (F.coalesce(F.size("diagnostic_path"), F.lit(0)) <= 0)
    row = premises.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("graph_id").alias("graphs"),
        F.countDistinct(F.when(F.col("is_extension"), F.col("graph_id"))).alias("extension_graphs"),
        F.count_if(missing).alias("missing_provenance"),
        F.countDistinct(F.unhex(F.sha2(F.col("source_chunk_id").cast("binary"), 256))).alias("chunks"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("blank"),
    )
    gates = {
        "graph_count_ok": F.col("graphs") == graphs,
        "extension_count_ok": F.col("extension_graphs") == extensions,
        "provenance_ok": F.col("missing_provenance") == 0,
        "unique_chunks_ok": F.col("chunks") == F.col("records"),
        "text_ok": F.col("blank") == 0,
    }
    return with_gates(row, gates)


def with_gates(row: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Add each gate and ``all_gates_pass``; a null gate fails."""
    row = row.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in gates.items()})
    every = F.lit(True)
    for n in gates:
        every = every & F.col(n)
    return row.withColumn("all_gates_pass", every)


def evidence_audit(nodes: DataFrame, by: list[str], diagnosis: str, decisive: Column, bound: Column) -> DataFrame:
    """Per group: nodes, distinct diagnoses, decisive nodes, those of them bound to evidence, and whether all are."""
    return nodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.countDistinct(diagnosis).alias("diagnoses"),
        F.count_if(decisive).alias("decisive"),
        F.count_if(decisive & bound).alias("decisive_bound"),
        F.bool_and(~decisive | bound).alias("all_bound"),
    )


def boundary_audit(requests: DataFrame, by: list[str], tokens: Column, limit: int, failed: Column) -> DataFrame:
    """Requests against a size limit: the longest, how many exceed it, how many failed, and the gate."""
    r = requests.withColumn("__t", tokens)
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.max("__t").alias("longest"),
        F.sum("__t").cast("long").alias("tokens"),
        F.count_if(F.col("__t") > limit).alias("over_limit"),
        F.count_if(failed).alias("failed"),
        (F.count_if((F.col("__t") > limit) | failed) == 0).alias("passed"),
    )


def prompt_audit(prompts: DataFrame, case: str, order: str, text: str, schema: str) -> DataFrame:
    """Per case: prompts, least and most characters, distinct schemas, and a digest of the sequence of prompt digests."""
    at = F.struct(F.col(order).alias("at"), F.sha2(F.col(text).cast("binary"), 256).alias("h"))
    sequence = F.array_join(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["h"]), "\n")
    n = F.length(text)
    return prompts.groupBy(case).agg(F.count(F.lit(1)).alias("prompts"), F.min(n).alias("least"), F.max(n).alias("most"), F.countDistinct(schema).alias("schemas"), F.sha2(sequence.cast("binary"), 256).alias("sequence_sha256"))


def crosstab(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """The 2 x 2 table of two 0/1 columns, one row a group, 0 where a cell is empty."""
    return rows.groupBy(*by).agg(*[F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])


def noise_floor(n: Column) -> Column:
    """The smallest difference of rates that n cases can show; null for none."""
    return F.try_divide(F.lit(1.0), n.cast("double"))


def compare_runs(runs: DataFrame, by: list[str], before: Column, after: Column, value: str, cases: str) -> DataFrame:
    """Mean of ``value`` before and after, its change, and whether that is beyond the larger noise floor."""
    side = lambda c: (F.avg(F.when(c, F.col(value))), F.countDistinct(F.when(c, F.col(cases))))
    (mean_a, n_a), (mean_b, n_b) = side(before), side(after)
    got = runs.groupBy(*by).agg(mean_a.alias("before"), mean_b.alias("after"), F.least(n_a, n_b).alias("n"))
    floor = noise_floor(F.col("n"))
    return got.withColumn("change", F.col("after") - F.col("before")).withColumn("noise_floor", floor).withColumn("beyond_noise", F.coalesce(F.abs(F.col("change")) > floor, F.lit(False)))


def partition_check(parts: DataFrame, whole: DataFrame, part: str, key: str) -> DataFrame:
    """One row: keys of the whole, keys in some part, in several, in none, and in a part but not in the whole; whether parts are disjoint and cover it."""
    each = parts.groupBy(key).agg(F.countDistinct(part).alias("parts"))
    both = whole.select(key).distinct().withColumn("in_whole", F.lit(True)).join(each, key, "full")
    inside, n = F.coalesce("in_whole", F.lit(False)), F.coalesce("parts", F.lit(0))
    row = both.agg(F.count_if(inside).alias("keys"), F.count_if(inside & (n > 0)).alias("covered"), F.count_if(n > 1).alias("shared"), F.count_if(inside & (n == 0)).alias("uncovered"), F.count_if(~inside).alias("foreign"))
    return row.withColumn("is_partition", (F.col("shared") == 0) & (F.col("uncovered") == 0) & (F.col("foreign") == 0))


def manifest_gate(held: DataFrame, asked: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Runs that may resume: the names of the fields in which the held manifest differs from the asked one, nulls equal to each other."""
    other = asked.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    differ = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]))
    return held.join(other, F.col(key) == F.col("__k")).select(key, differ.alias("differing")).withColumn("may_resume", F.size("differing") == 0)


def record_hash(rows: DataFrame, fields: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the fields: predictions, bindings and bundles by the fields that are frozen."""
    return F.sha2(canonical_json(rows, fields).cast("binary"), 256)


def replace_by_digest(rows: DataFrame, fields: list[str], out: str = "dropped_sha256") -> DataFrame:
    """Drop fields that must not be published and leave their digest."""
    return rows.withColumn(out, record_hash(rows, fields)).drop(*fields)


def gold_coverage(retrieved: DataFrame, gold: DataFrame, case: str, label: str, path: str) -> DataFrame:
    """Per case of ``gold`` (case, ``gold_label``): 1.0 if a retrieved fact's label or path names the gold label, else 0.0."""
    keyed = retrieved.select(case, F.transform(F.concat(F.array(F.col(label)), F.coalesce(F.col(path), F.array().cast("array<string>"))), lambda x: T.label_key(F.coalesce(x, F.lit("")))).alias("keys"))
    named = keyed.select(case, F.explode("keys").alias("key")).distinct()
    wanted = gold.select(case, T.label_key(F.col("gold_label")).alias("key"))
    hit = wanted.join(named.withColumn("hit", F.lit(1.0)), [case, "key"], "left")
    return hit.select(case, F.coalesce("hit", F.lit(0.0)).alias("gold_coverage"))


def relevant_paths(paths: DataFrame, needles: DataFrame, case: str, path: str, order: str, k: int = 8) -> DataFrame:
    """The first k distinct paths, in ``order``, of which some label holds a needle or lies in one; ``needles`` has the case and two labels.

    Every case's needles are compared with the labels of its own graph only: both sides carry ``graph``.
    """
    hit = lambda n: F.exists(path, lambda x: typed.either_contains(x, F.col(n)) & (F.col(n) != ""))
    met = needles.join(paths, "graph").filter(hit("reference") | hit("evaluated"))
    first = met.groupBy(case, path).agg(F.min(order).alias("__o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy("__o"))).filter(F.col("place") <= k).drop("__o")


def mode_by_position(rows: DataFrame, case: str, order: str, modes: list[str]) -> DataFrame:
    """Recover each row's mode from its place within the case; null beyond the list."""
    place = F.row_number().over(Window.partitionBy(case).orderBy(order)) - 1
    return rows.withColumn("position", place).withColumn("mode", F.get(F.array(*map(F.lit, modes)), F.col("position")))


def graph_paths(premises: DataFrame) -> DataFrame:
    """Each graph's distinct diagnostic paths, in order, rebuilt from its premises."""
    return premises.select("graph_id", "diagnostic_path").distinct().groupBy("graph_id").agg(F.sort_array(F.collect_list("diagnostic_path")).alias("paths"))


def event_log(events: DataFrame, case: str, at: str, kind: str) -> DataFrame:
    """Timed spans of a log: each ``started`` with the next ``completed`` or ``failed`` of its case, and the milliseconds between; open spans have none."""
    order = Window.partitionBy(case).orderBy(at, kind)
    nxt = events.withColumn("__k", F.lead(kind).over(order)).withColumn("__t", F.lead(at).over(order))
    ended = F.col("__k").isin("completed", "failed")
    took = F.when(ended, F.floor((F.unix_micros("__t") - F.unix_micros(at)) / 1000))
    return nxt.filter(F.col(kind) == "started").select(case, F.col(at).alias("started"), F.when(ended, F.col("__k")).otherwise("open").alias("status"), took.alias("duration_ms"))
