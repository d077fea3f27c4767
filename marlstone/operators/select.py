"""Selections that cover groups before they fill up by rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cover_then_fill(ranked: DataFrame, within: list[str], cover: str, order: list, k: int) -> DataFrame:
    """The first of each ``cover`` value in rank order, then the rest in rank order, k rows in all; adds ``place``.

    The two passes of a loop are one sort: rows that are first of their value come before all others.
    """
    first = Window.partitionBy(*within, cover).orderBy(*order)
    marked = ranked.withColumn("__n", F.row_number().over(first))
    place = Window.partitionBy(*within).orderBy((F.col("__n") > 1).cast("int"), *order)
    return marked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).drop("__n")


def round_robin(rows: DataFrame, within: list[str], family: str, inside: list, families: list, k: int) -> DataFrame:
    """One row of each family in turn: depth first, then the families' order; adds ``depth`` and ``place``."""
    depth = Window.partitionBy(*within, family).orderBy(*inside)
    deep = rows.withColumn("depth", F.row_number().over(depth))
    place = Window.partitionBy(*within).orderBy("depth", *families)
    return deep.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def _allocated(routes: Column, budget: int, source: str) -> Column:
    """Places ``n, route, fact`` in the order in which the budget of a query is spent over its ``routes``, as a fold.

    A route is struct(route_position, siblings, tie, options); options are struct(fact_position, source_id) in order.  The first
    steps offer each route one source in turn, the rest one to the route with fewest, most siblings, smallest tie.
    """
    kind = f"struct<used:array<{source}>,taken:array<int>,picked:array<struct<n:int,route:int,fact:int>>>"
    start = F.struct(F.array().cast(f"array<{source}>").alias("used"), F.transform(routes, lambda r: F.lit(0)).alias("taken"), F.array().cast("array<struct<n:int,route:int,fact:int>>").alias("picked")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        def offer(r: Column, j: Column) -> Column:
            free = F.get(F.filter(r["options"], lambda o: ~F.array_contains(s["used"], o["source_id"])), F.lit(0))
            mine = free.isNotNull() & ((i > F.size(routes)) | (j == i - 1))
            return F.when(mine, F.struct(F.get(s["taken"], j).alias("taken"), (-r["siblings"]).alias("few"), r["tie"].alias("tie"), j.alias("at"), r["route_position"].cast("int").alias("route"), free["fact_position"].cast("int").alias("fact"), free["source_id"].alias("source")))

        def spend(best: Column) -> Column:
            one = F.struct((F.size(s["picked"]) + 1).alias("n"), best["route"].alias("route"), best["fact"].alias("fact"))
            more = F.struct(F.array_append(s["used"], best["source"]).alias("used"), F.transform(s["taken"], lambda t, j: F.when(j == best["at"], t + 1).otherwise(t)).alias("taken"), F.array_append(s["picked"], one).alias("picked")).cast(kind)
            return F.when((F.size(s["picked"]) < budget) & best.isNotNull(), more).otherwise(s)

        best = F.array_min(F.array_compact(F.transform(routes, offer)))
        return F.get(F.transform(F.array(best), spend), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.size(routes) + budget), start, step)["picked"]


def allocate_facts(facts: DataFrame, query: str, budget: int = 12) -> DataFrame:
    """A budget of facts per query over its routes: one each, then to the route with fewest so far.

    Ties go to more siblings, then to the smaller ``tie`` (the route's position, if there is no such column); a source is used once.
    Needs columns ``route_position, fact_position, source_id, siblings``, the first two integers, which name a fact.  Adds ``allocated``.
    A query's routes stand in one array, of as many routes and facts as its caller selected.
    """
    tie = F.col("tie") if "tie" in facts.columns else F.col("route_position")
    source = facts.schema["source_id"].dataType.simpleString()
    routes = facts.groupBy(query, "route_position").agg(F.min("siblings").cast("long").alias("siblings"), F.min(tie).cast("long").alias("tie"), F.array_sort(F.collect_list(F.struct("fact_position", "source_id"))).alias("options"))
    whole = routes.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("route_position", "siblings", "tie", "options"))).alias("routes"))
    picked = whole.select(query, F.inline(_allocated(F.col("routes"), budget, source)))
    return facts.join(picked.select(query, F.col("n").alias("allocated"), F.col("route").alias("route_position"), F.col("fact").alias("fact_position")), [query, "route_position", "fact_position"]).select(*facts.columns, "allocated")


def _match(pairs: pd.DataFrame, least: float) -> pd.DataFrame:
    left, right, kept = set(), set(), []
    for at, r in pairs.sort_values(["score", "left_pos", "right_pos"], ascending=False).iterrows():
        if r["score"] >= least and r["left_pos"] not in left and r["right_pos"] not in right:
            left.add(r["left_pos"])
            right.add(r["right_pos"])
            kept.append(at)
    return pairs.loc[kept]


def greedy_match(pairs: DataFrame, record: str, least: float = 0.35) -> DataFrame:
    """One-to-one matches of each record's ``left_pos, right_pos, score`` rows, best score first.

    Ties take the later positions first; pairs below ``least`` are dropped before they are grouped.
    """
    schema = pairs.schema
    return pairs.filter(F.col("score") >= least).groupBy(record).applyInPandas(lambda g: _match(g, least), schema)
