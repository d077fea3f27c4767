"""A Merkle manifest of a dataset: one tree a group, one tree over the groups' roots, and a proof for each row.

Levels are built from the leaves up: a window over group and parent index gathers each run of
siblings, which is both what the parent digests and what the proofs need; one row a parent goes on to the next
level.  Proofs then come from the top down, so all levels together handle about twice the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, maybe_broadcast, null_safe

FAN = 2
#: So many levels of proofs are joined in one job.
_CHAIN = 4
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings ``parts``, joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The digest of a row with these values."""
    return digest(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings from the leaf's level up, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``idx``: each row's 0-based place in ``group`` by ``order``, nulls first, and ``n``, the group's rows.

    Rows are dealt by ranges of group and order; a range's rows are numbered by themselves and prefix
    sums over the ranges, a row for each group and range, place them.  So a group of any size is cut,
    and rows that tie in all of ``order`` may fall into several ranges.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(width, *keys, F.col("__tie"))
    ranges = materialize(dealt.withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    all_of = Window.partitionBy(group)
    before = all_of.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select(group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"), F.sum("__n").over(all_of).alias("n")))
    inside = Window.partitionBy(group, "__range").orderBy(*keys[1:], "__tie")
    placed = ranges.withColumn("__k", F.row_number().over(inside)).join(maybe_broadcast(offsets, offsets.count()), [group, "__range"])
    return placed.withColumn("idx", (F.col("__at") + F.col("__k") - 1).cast("long")).drop("__tie", "__range", "__k", "__at")


def climb(nodes: DataFrame, most: int, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """The top ``g, h`` of each group and the levels below it, from ``g, idx, n, h``; ``most`` is the largest n.

    A level has a row for each node of a group with several: its parent's index ``up`` and the digests of its
    run to its ``left`` and ``right``.
    """
    levels, tops = [], nodes.filter("n = 1").select("g", "h")
    while most > 1:
        run = Window.partitionBy("g", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = nodes.filter("n > 1").withColumn("up", F.expr(f"idx div {fan}")).withColumn("run", F.collect_list("h").over(run))
        at = (F.col("idx") % fan).cast("int")
        sides = [F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(fan)), "").alias("right")]
        parent = F.when(at == 0, digest(F.array_join("run", "")))
        level = materialize(runs.select("g", "idx", "up", F.ceil(F.col("n") / fan).cast("long").alias("n"), *sides, parent.alias("h")))
        levels.append(level)
        nodes, most = level.filter(F.col("h").isNotNull()).select("g", F.col("up").alias("idx"), "n", "h"), -(-most // fan)
        tops = tops.union(nodes.filter("n = 1").select("g", "h"))
    return tops, levels


def paths(levels: list[DataFrame]) -> DataFrame | None:
    """``g, idx, path`` of every node of the lowest level; groups of one node have none."""
    above = None
    for k, level in reversed(list(enumerate(levels))):
        step = F.array(F.struct("left", "right")).cast(_PATH)
        if above is None:
            above = level.select("g", "idx", step.alias("path"))
        else:
            rest = F.coalesce(F.col("rest"), F.array().cast(_PATH))
            above = level.join(above.select("g", F.col("idx").alias("up"), F.col("path").alias("rest")), ["g", "up"], "left").select("g", "idx", F.concat(step, rest).alias("path"))
        if k % _CHAIN == 0:
            above = materialize(above)
    return above


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", carry: Sequence[Column] = (), fan: int = FAN) -> DataFrame:
    """``<order>, leaf, subroot, root, path`` and the columns ``carry`` of every row of ``rows``.

    In each ``group`` the leaves stand by ``order``, nulls first, then by digest; every ``fan`` consecutive nodes
    become their digest until one is left, the subroot.  Subroots by group, null first, likewise give the root.
    ``path`` has for each level up to the root the digests to the left and right of the row's node in its run.
    Repeated rows are leaves of their own; no rows give none.
    """
    plain = materialize(rows.select(F.col(group).alias("__group"), F.col(order).alias("__order"), leaf.alias("leaf"), *carry))
    names = numbered(plain.select("__group").distinct().withColumn("__all", F.lit(0)), "__all", ["__group"])
    names = materialize(names.select("__group", F.col("idx").alias("g")))
    groups = names.count()
    leaves = materialize(numbered(null_safe(plain, maybe_broadcast(names, groups), ["__group"]).drop("__group"), "g", ["__order", "leaf"]))
    most = leaves.agg(F.max("n")).first()[0] or 0
    tops, levels = climb(leaves.select("g", "idx", "n", F.col("leaf").alias("h")), most, fan)
    tops = materialize(tops)
    root, upper = climb(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(groups).cast("long").alias("n"), "h"), groups, fan)
    root = [r["h"] for r in root.collect()]  # one row, or none
    none = F.array().cast(_PATH)
    above = tops.withColumnRenamed("h", "subroot")
    above = above.join(paths(upper).select(F.col("idx").alias("g"), F.col("path").alias("above")), "g") if upper else above.withColumn("above", none)
    out = leaves.join(maybe_broadcast(materialize(above), groups), "g")
    out = out.join(paths(levels), ["g", "idx"], "left") if levels else out.withColumn("path", none)
    own = [c for c in plain.columns if c not in ("__group", "__order", "leaf")]
    path = F.concat(F.coalesce(F.col("path"), none), "above")
    return out.select(F.col("__order").alias(order), "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), path.alias("path"), *own)


def check_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    Each row is proved again after some were tampered with: where 7 divides the CRC-32 of the decimal id, ``n_chars``
    grows by one.  A null ``n_chars`` stays, and rows without an id are left alone.
    """
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    odd = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields]
    found = F.when(odd & F.col("n_chars").isNotNull(), leaf_of(*changed))
    tree = manifest(docs, leaf_of(*[F.col(c) for c in fields]), carry=[found.alias("__found")])
    told = tree.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("__found", "leaf"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
