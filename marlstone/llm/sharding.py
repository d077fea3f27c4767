"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import RUN_ROWS, materialize, maybe_broadcast, n_bytes, null_safe, rank_by_class

SHARDS = 24
ROW_OVERHEAD = 8


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """LPT over ``(group size, groups)``: for each size, shards and the upper rank each one takes.

    Sizes go from large to small; each group goes to the least-loaded shard of a heap.  While the
    shards within one size of the least-loaded stay below all others, equal groups reach each of
    them once a round, so whole rounds are dealt at a time.
    """
    heap = [(0, k) for k in range(shards)]
    plan = []
    for size, left in sorted(histogram, reverse=True):
        took = [0] * shards
        while left:
            low = heap[0][0]
            near = [x for x in heap if x[0] - low <= size]
            rest = [x for x in heap if x[0] - low > size]
            rounds = left // len(near)
            if rest:
                rounds = min(rounds, (min(rest)[0] - max(near)[0]) // size)
            if rounds > 1:
                for _, k in near:
                    took[k] += rounds
                heap = [(load + rounds * size, k) for load, k in near] + rest
                heapq.heapify(heap)
                left -= rounds * len(near)
                continue
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            took[k] += 1
            left -= 1
        used = [k for k in range(shards) if took[k]]
        upper, total = [], 0
        for k in used:
            total += took[k]
            upper.append(total)
        plan.append((size, used, upper))
    return plan


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; equal texts share a shard.

    Size is the text's UTF-8 bytes plus 8; a null text has no bytes and belongs with the empty ones.
    The driver sees the distinct group sizes only: d sizes need at least d * d / 2 bytes of text, so
    they are at most the root of twice the input's bytes.  Groups of one size are ranked in runs and
    take the shard whose rank range holds them.  Slots are gapless from 0 in each shard, in runs of
    hashed ids; repeated ids keep a slot each.  No rows give none.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = materialize(docs.select(F.col(doc_id).alias("doc_id"), (n_bytes(F.col(text)) + ROW_OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h")))
    group = ["h", "text_crc32", "size"]
    groups = materialize(keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).withColumn("weight", F.col("members") * F.col("size")))
    histogram = [(r["weight"], r["count"]) for r in groups.groupBy("weight").count().collect()]
    plan = schedule(histogram, shards)
    table = pa.table({"weight": pa.array([p[0] for p in plan], pa.int64()), "shards": pa.array([p[1] for p in plan], pa.list_(pa.int32())), "upper": pa.array([p[2] for p in plan], pa.list_(pa.int64()))})
    ranges = maybe_broadcast(spark.createDataFrame(table), len(plan))
    ranked = rank_by_class(groups, ["weight"], [], "h").join(ranges, "weight")
    below = F.size(F.filter(F.col("upper"), lambda u: u <= F.col("rank")))
    placed = ranked.select(*group, F.get(F.col("shards"), below).cast("int").alias("shard"))
    rows = materialize(null_safe(keyed, placed, group).drop("h"))
    runs = max(1, -(-rows.count() // (shards * RUN_ROWS)))
    rows = rows.withColumn("__order", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))
    slots = rank_by_class(rows, ["shard"], ["__order"], "doc_id").withColumnRenamed("rank", "slot").drop("__order")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
