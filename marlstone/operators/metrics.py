"""Evaluation statistics: summaries, intervals, paired tests, splits and samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import exact_binomial


def summarize(rows: DataFrame, by: list[str], metrics: list[str], subset: Column | None = None) -> DataFrame:
    """Count, null-skipping mean and population deviation of each metric, over all rows and over ``subset``."""
    parts = [rows.withColumn("scope", F.lit("all"))]
    if subset is not None:
        parts.append(rows.filter(subset).withColumn("scope", F.lit("subset")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_pop(m), F.lit(0.0)), 6).alias(f"{m}_sd")]
    return both.groupBy("scope", *by).agg(*aggs)


def paired_counts(rows: DataFrame, by: list[str], base: str, other: str) -> DataFrame:
    """Pairs, discordant counts and the exact two-sided p value of two 0/1 columns."""
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sum(((F.col(base) == 1) & (F.col(other) == 0)).cast("int")).alias("base_only"), F.sum(((F.col(base) == 0) & (F.col(other) == 1)).cast("int")).alias("other_only"))
    return c.withColumn("p_value", F.round(exact_binomial(F.col("base_only"), F.col("other_only")), 6))


def holm(tests: DataFrame, p: str, key: str, within: list[str] | None = None) -> DataFrame:
    """Holm's step-down adjustment of a family of tests; a family is a handful of rows."""
    family = Window.partitionBy(*(within or []))
    order = family.orderBy(p, key)
    m, rank = F.count(F.lit(1)).over(family), F.row_number().over(order)
    stepped = tests.withColumn("__s", (m - rank + 1) * F.col(p))
    running = F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.least(running, F.lit(1.0))).drop("__s")


def draw(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on its parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(rows: DataFrame, by: list[str], key: str, value: str, resamples: int = 200, seed: int = 17) -> DataFrame:
    """95 % percentile interval of the mean of ``value`` by resampling.

    A row's weight in a resample is a Poisson(1) draw from a hash of seed, resample and key, so every
    partition resamples its own rows and only sums are shuffled: (group, resample) pairs, not rows.
    """
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    u = draw(F.lit(seed), F.col("__b"), F.col(key)) / 4294967296.0
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    drawn = rows.select(*by, key, value).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("__w", weight)
    means = drawn.groupBy(*by, "__b").agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("m"))
    return means.groupBy(*by).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def _stream(seed: int, *parts) -> np.random.Generator:
    """Random numbers that depend on the seed and the parts alone."""
    digest = hashlib.sha256("\0".join([str(seed), *map(str, parts)]).encode()).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest[:16], np.uint64)))


def resampled_sizes(sizes: Sequence[int], resamples: int, seed: int, group: str) -> np.ndarray:
    """How many of the n draws of each resample fall into each cell, an array [resample, cell]: multinomial, by the cells' sizes."""
    sizes = np.asarray(sizes, np.int64)
    return _stream(seed, "sizes", group).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=resamples)


def resampled_sums(values: np.ndarray, draws: np.ndarray, seed: int, group: str, cell: int) -> np.ndarray:
    """The sum of ``draws[b]`` draws from ``values`` for each resample b, in turn from one stream."""
    rng = _stream(seed, "rows", group, cell)
    out = np.zeros(len(draws))
    for b, n in enumerate(draws):
        out[b] = values[rng.integers(0, len(values), n)].sum() if n else 0.0
    return out


def paired_bootstrap(pairs: DataFrame, by: str, key: str, baseline: str, comparison: str, resamples: int = 2000, seed: int = 17, cell_rows: int = 65_536) -> DataFrame:
    """``by, pairs, mean, low, high``: the mean of comparison less baseline in each group, and its 95 % percentile interval by resampling.

    A resample draws whole pairs, so both sides share it.  A group's pairs are dealt to cells of about ``cell_rows`` by a hash
    of the key; a multinomial draw says how many of each resample's draws fall into each cell, and the cell draws them from its own
    pairs, in the order of key and difference.  So a cell gives one array of ``resamples`` sums, and only these are shuffled by group.
    The same for any partitions.  Pairs with a null side take no part; a null group is a group; groups without pairs give no row.
    """
    name, diff = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")), F.col(comparison).cast("double") - F.col(baseline).cast("double")
    rows = pairs.select(F.col(by).alias("by"), name.alias("g"), F.col(key).cast("string").alias("k"), diff.alias("d")).filter("d is not null")
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("cells", F.greatest(F.round(F.col("n") / cell_rows), F.lit(1)).cast("long")).drop("n")
    dealt = rows.join(counts, "g").withColumn("cell", F.pmod(F.xxhash64("k", "d"), F.col("cells")).cast("int")).drop("cells")
    sizes = dealt.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("s"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, s in zip(f["g"], f["s"]):
                drawn = resampled_sizes([x["n"] for x in s], resamples, seed, g)
                yield pd.DataFrame({"g": g, "cell": [x["cell"] for x in s], "draws": [d.tolist() for d in drawn.T]})

    def sums(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["k", "d"], kind="stable")
        g, cell, d = f["g"].iloc[0], int(f["cell"].iloc[0]), f["d"].to_numpy()
        total = resampled_sums(d, np.asarray(f["draws"].dropna().iloc[0]), seed, g, cell)
        return pd.DataFrame({"by": [f["by"].iloc[0]], "g": [g], "cell": [cell], "n": [len(d)], "total": [d.sum()], "sums": [total.tolist()]})

    draws = sizes.mapInPandas(split, "g string, cell int, draws array<long>")
    first = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("g", "cell").orderBy("k", "d")))
    # the draws ride on one row of each cell
    told = first.join(draws.withColumn("__r", F.lit(1)), ["g", "cell", "__r"], "left").drop("__r")
    kind = f"by {pairs.schema[by].dataType.simpleString()}, g string, cell int, n long, total double, sums array<double>"
    per_cell = told.groupBy("g", "cell").applyInPandas(sums, kind)

    in_order = lambda c: F.aggregate(F.sort_array(F.collect_list(F.struct("cell", c))), F.lit(0.0), lambda t, x: t + x[c])
    whole = per_cell.groupBy("g").agg(F.first("by").alias("by"), F.sum("n").alias("pairs"), in_order("total").alias("total"))
    means = per_cell.select("g", "cell", F.posexplode("sums").alias("b", "x")).groupBy("g", "b").agg(in_order("x").alias("x"))
    ends = means.join(whole.select("g", "pairs"), "g").groupBy("g").agg(*[F.percentile(F.col("x") / F.col("pairs"), q).alias(c) for c, q in (("low", 0.025), ("high", 0.975))])
    return whole.join(ends, "g").select(F.col("by").alias(by), "pairs", (F.col("total") / F.col("pairs")).alias("mean"), "low", "high")


def hash_order(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def stratified_split(rows: DataFrame, stratum: str, key: str, fraction: float = 0.2, seed: int = 17, least: int = 5) -> DataFrame:
    """Add ``part``: development for the first round(n * fraction) of each stratum in hash order, else test.

    Strata of fewer than ``least`` rows go to test whole; others give one row at least.  Halves round
    to even.  Rows of a stratum are ranked by hash in two levels: counts by the hash's first two
    digits say which digits' rows are inside, so only the rows of one digit pair are sorted together.
    """
    h = rows.withColumn("__h", hash_order(seed, F.col(key))).withColumn("__d", F.substring("__h", 1, 2))
    digits = h.groupBy(stratum, "__d").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(stratum).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    placed = digits.select(F.col(stratum).alias("__s"), F.col("__d").alias("__e"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(stratum)).alias("__n"))
    joined = h.join(placed, h[stratum].eqNullSafe(placed["__s"]) & (h["__d"] == placed["__e"]))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(stratum, "__d").orderBy("__h", key))
    want = F.when(F.col("__n") >= least, F.greatest(F.lit(1), F.bround(F.col("__n") * fraction)))
    return joined.withColumn("part", F.when(rank <= want, "development").otherwise("test")).drop("__h", "__d", "__s", "__e", "__before", "__n")


def agreement(rows: DataFrame, case: str, mode: str, label: str) -> DataFrame:
    """Share of common cases on which two modes give the same label."""
    a = rows.select(case, F.col(mode).alias("a"), F.col(label).alias("la"))
    b = rows.select(case, F.col(mode).alias("b"), F.col(label).alias("lb"))
    return a.join(b, case).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("la") == F.col("lb")).cast("double")), 6).alias("agreement"))
