"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, maybe_broadcast, null_safe, rank_by_class, settled, word_array

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
#: So many of a source's longest documents have their expected copies planned anew after each of them.
LONGEST = 256


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, n_docs, target`` from rows of ``source, size``.

    Sources go by code point, null last, and take ``weights`` in turn.  Targets share the total by
    weight, none above ``cap`` times its source's size; what a capped source leaves is shared again
    by weight.  That fixed point is one level, weight times which is the target of the sources below
    their cap.  With the sources in order of cap / weight and those before j capped, the level the
    rest would share rises with j while j itself must be capped and falls afterwards, so it is the
    highest of these; prefix sums over one row per source give them all.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    t = totals.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(len(weights)))).cast("long"))
    t = t.withColumn("limit", F.col("source_size") * cap)
    ratio = F.col("limit") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.max(left / open_weight).over(whole)
    return t.withColumn("target", F.least(F.col("limit").cast("double"), level * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A random place in [0, 1) for each source, from the seed."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(source, F.lit("")), F.lit(":"), source.isNull().cast("string")).cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("long") / F.lit(4294967296.0)


def word_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size`` in words of every row, and the columns ``carry``."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"), *carry)


def _expected(left: Column, rest: Column) -> Column:
    """Copies of each of the documents that have ``rest`` words, if ``left`` are still to be taken."""
    return F.when(rest > 0, F.least(F.greatest(left / rest, F.lit(0.0)), F.lit(float(MAX_COPIES)))).otherwise(F.lit(0.0))


def _longest_first(sizes: Column, target: Column, total: Column, offset: Column) -> Column:
    """Sampling of ``sizes`` in turn: ``copies`` of each, the words ``left`` to take and the ``rest`` to take them from, and the next offset."""

    def step(s: Column, size: Column) -> Column:
        at = s["at"] + _expected(s["left"], s["rest"])
        n = F.floor(at)
        return F.struct((s["left"] - n * size).alias("left"), (s["rest"] - size).alias("rest"), (at - n).alias("at"), F.concat(s["copies"], F.array(n.cast("int"))).alias("copies"))

    none = F.array().cast("array<int>")
    return F.aggregate(sizes, F.struct(target.alias("left"), total.cast("double").alias("rest"), offset.alias("at"), none.alias("copies")), step)


def mix(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """Copies of every row of ``doc_id, source, size``; adds ``source_size, target, copies, taken``.

    Systematic sampling: expected copies are summed up over a source's documents, longest first, then
    by descending id, from one random offset a source; a document is emitted once for each integer
    passed.  Expected copies are the words still to take over the words still to come, at most
    ``MAX_COPIES``: for each of the ``LONGEST`` longest documents after those before it, and alike
    for all the rest, whose prefix sums are then a rank times a constant.  So what a very long
    document takes too much or too little is made up for by the shorter ones.
    A null source is a source; null or empty texts have size 0; rows of one id are told apart by
    nothing but their order; a source without words has target 0 and no copies; no rows give none.
    Other columns pass through.
    """
    return settled(sized.sparkSession, lambda: _mix(sized, seed))


def _mix(sized: DataFrame, seed: str) -> DataFrame:
    sized = materialize(sized)
    targets = materialize(source_targets(sized))
    few = targets.count()
    ranked = materialize(null_safe(rank_by_class(sized, ["source"], ["size"], "doc_id"), maybe_broadcast(targets, few), ["source"]))
    place = F.col("n_docs") - 1 - F.col("rank")
    top = ranked.filter(place < LONGEST).groupBy("source").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "size"))).alias("top"), F.first("target").alias("t"), F.first("source_size").alias("n"))
    sampled = _longest_first(F.transform("top", lambda x: x["size"]), F.col("t"), F.col("n"), offset_of(F.col("source"), seed))
    first = materialize(top.select("source", sampled.alias("s")).select("source", _expected(F.col("s.left"), F.col("s.rest")).alias("each"), F.col("s.at").alias("at"), F.col("s.copies").alias("top")))
    joined = null_safe(ranked, maybe_broadcast(first, few), ["source"])
    after = lambda k: F.floor(F.col("at") + F.col("each") * (place - LONGEST + k))
    copies = F.when(place < LONGEST, F.get("top", place.cast("int"))).otherwise(F.least(after(1) - after(0), F.lit(MAX_COPIES))).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("rank", "n_docs", "each", "at", "top")
