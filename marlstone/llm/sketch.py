"""Document fingerprints: threshold-scaled sketches that keep every shingle hash below a fixed fraction."""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import let, word_array

SHINGLE_WORDS = 5
#: One shingle hash in this many is kept.
SCALE = 8
#: Texts of at most so many distinct shingles have them all in a list beside the sketch.
EXACT = 256
#: Documents of one run of ids, and the most cuts the driver holds; beyond them runs grow, and their windows spill.
RUN, MAX_RUNS = 512, 1 << 16


def threshold(scale: int = SCALE) -> int:
    """Signed 64-bit hashes below this are kept: a share of 1 / ``scale``."""
    return -(1 << 63) + (1 << 64) // scale


def with_sketch(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Add ``out``, struct(kept, whole) of the text's ``words``-word shingles.

    ``kept``, the sketch, has the sorted distinct hashes below the threshold, whatever the length.  ``whole`` has all distinct hashes of
    a text of at most ``EXACT`` of them, which a sketch can say little of, and is null for others.
    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    w, h = F.col("__sk_w"), F.col("__sk_h")
    shingles = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]))
    n = F.size(w)
    df = df.withColumn("__sk_w", word_array(F.col(text)))
    df = df.withColumn("__sk_h", F.when(n >= words, F.slice(shingles, 1, F.greatest(n - (words - 1), F.lit(1)))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    kept = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < threshold(scale))))
    # a text of many more shingles than that repeats most of them, and is not worth the look
    whole = F.when(F.size(h) <= 8 * EXACT, let(F.array_distinct(h), lambda d: F.when(F.size(d) <= EXACT, F.sort_array(d))))
    return df.withColumn(out, F.struct(kept.alias("kept"), whole.alias("whole"))).drop("__sk_w", "__sk_h")


def merge(a: Column, b: Column) -> Column:
    """What two texts' shingles together give: their sketch, and all of them if both texts have theirs and they are few."""
    every = F.sort_array(F.array_union(a["whole"], b["whole"]))
    return F.struct(F.sort_array(F.array_union(a["kept"], b["kept"])).alias("kept"), F.when(F.size(every) <= EXACT, every).alias("whole"))


def likeness(a: Column, b: Column) -> Column:
    """Struct of ``near`` (``resemblance``) and ``part`` (``containment`` of a in b), from one intersection.

    Two texts with all their shingles compare by these, exactly; any other two by their sketches.
    """
    whole = a["whole"].isNotNull() & b["whole"].isNotNull()
    pair = F.struct(F.when(whole, a["whole"]).otherwise(a["kept"]).alias("x"), F.when(whole, b["whole"]).otherwise(b["kept"]).alias("y"))
    sizes = let(pair, lambda p: F.struct(F.size(p["x"]).alias("x"), F.size(p["y"]).alias("y"), F.size(F.array_intersect(p["x"], p["y"])).alias("both")))

    def told(n: Column) -> Column:
        union = n["x"] + n["y"] - n["both"]
        near = F.when(union > 0, n["both"] / F.greatest(union, F.lit(1))).when(whole, 1.0).otherwise(0.0)
        empty = F.coalesce(F.size(a["whole"]), F.lit(1)) == 0
        part = F.when(empty, F.lit(1.0)).when(n["x"] > 0, n["both"] / F.greatest(n["x"], F.lit(1)))
        return F.struct(near.alias("near"), part.alias("part"))

    return let(sizes, told)


def resemblance(a: Column, b: Column) -> Column:
    """Share of common shingles among all, estimated from two sketches; 1 for two wordless texts, 0 where neither sketch has a hash."""
    return likeness(a, b)["near"]


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has too, estimated from two sketches; 1 for a wordless a.

    Null if there is no estimate: the texts have no lists of all shingles both, and a's sketch has no hash.
    """
    return likeness(a, b)["part"]


def _hexed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def as_text(sketch: Column) -> Column:
    """The sketch's hashes in hexadecimal, then, for a text that has the list, a colon and all its hashes."""
    return F.concat(_hexed(sketch["kept"]), F.when(sketch["whole"].isNotNull(), F.concat(F.lit(":"), _hexed(sketch["whole"]))).otherwise(""))


def _numbers(values: list, kind: str) -> Column:
    """An array literal, folded from one string so that long ones stay one expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def run_of(key: Column, tie: Column, kind: str, cuts: list, n_null: int) -> Column:
    """The run of a row by descending ``key``, null last, then ascending ``tie`` (a hash): the number of ``cuts`` before it.

    A key that several cuts share is hot: its rows are spread over as many runs by ``tie``; so are those
    without a key, over a run for each ``RUN`` of them.
    """
    times = Counter(cuts)
    own = sorted(times, reverse=True)
    before = [0, *itertools.accumulate(times[c] for c in own)]
    even = (F.shiftright(tie, 12) + F.lit(1 << 51)) / F.lit(float(1 << 52))
    spread = lambda n: F.floor(even * n).cast("int")
    if own:
        found, steps = _numbers(own, kind), [1 << k for k in range(len(own).bit_length() - 1, -1, -1)]
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get(found, a + s - 1) > key, a + s).otherwise(a))
        hot = lambda a: F.when(F.get(found, a) == key, spread(F.get(_numbers([times[c] for c in own], "int"), a))).otherwise(F.lit(0))
        run = let(at, lambda a: F.get(_numbers(before, "int"), a) + hot(a))
    else:
        run = F.lit(0)
    return F.when(key.isNull(), len(cuts) + 1 + spread(F.lit(max(1, min(MAX_RUNS, n_null // RUN))))).otherwise(run).cast("int")


def with_next(df: DataFrame, key: str, tie: str, take: list[str], prefix: str = "next_") -> DataFrame:
    """Add ``take`` columns of the next row by descending ``key`` (a number; null last), then ``tie`` (a long); the last row's next is the first.

    Rows are dealt to runs of neighbouring keys, cut at quantiles; each run also gets the first row of
    the following run, so no window spans more than a run.  One row a run, at most twice ``MAX_RUNS``,
    is broadcast.
    """
    n, n_null = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    runs = max(1, min(MAX_RUNS, n // RUN))
    cuts = []
    if runs > 1:
        shares = _numbers([k / runs for k in range(1, runs)], "double")
        cuts = df.select(F.percentile_approx(key, shares, F.lit(max(10_000, 4 * runs))).alias("q")).first()["q"] or []
    df = df.withColumn("__run", run_of(F.col(key), F.col(tie), df.schema[key].dataType.simpleString(), cuts, n_null))
    place = F.struct(F.col(key).alias("k"), F.bitwise_not(F.col(tie)).alias("t"))
    heads = df.groupBy("__run").agg(F.max(place).alias("__head"))
    last = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("__before", F.coalesce(F.lag("__run").over(Window.orderBy("__run")), F.last("__run").over(last)))
    own, other = (F.struct(F.col(run).alias("run"), F.lit(halo).alias("halo")) for run, halo in (("__run", False), ("__before", True)))
    dealt = df.join(F.broadcast(heads), "__run")
    dealt = dealt.withColumn("__to", F.explode(F.when(place.eqNullSafe(F.col("__head")), F.array(own, other)).otherwise(F.array(own))))
    dealt = dealt.withColumn("__run", F.col("__to.run")).withColumn("__halo", F.col("__to.halo")).drop("__to", "__head", "__before")
    order = Window.partitionBy("__run").orderBy("__halo", F.col(key).desc_nulls_last(), tie)
    return dealt.withColumns({f"{prefix}{c}": F.lead(c).over(order) for c in take}).filter(~F.col("__halo")).drop("__run", "__halo")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by as many first ones of the next
    document by descending id.  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next`` (resemblances) and ``contain_edited, contain_next``
    (containments in the original, null if a sketch cannot tell).  Ids are numbers.  Null texts count as
    empty; null ids come last; rows of one id are ordered by their text's hash; a single row is its own
    next; no rows give none.  Texts of any length are taken whole; other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_sketch(plain, "text", "sketch").withColumn("tie", F.xxhash64("text"))
    near = with_next(own, "doc_id", "tie", ["text", "sketch"]).drop("tie")
    near = near.withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 3).cast("int")
    near = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - part), F.substring(F.col("next_text"), F.lit(1), part))).drop("text", "next_text")
    near = with_sketch(near, "edited", "edited_sketch")
    near = near.withColumn("to_edited", likeness(F.col("edited_sketch"), F.col("sketch"))).withColumn("to_next", likeness(F.col("next_sketch"), F.col("sketch")))
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("to_edited.near").alias("near_edited"),
        F.col("to_next.near").alias("near_next"),
        F.col("to_edited.part").alias("contain_edited"),
        F.col("to_next.part").alias("contain_next"),
    )
