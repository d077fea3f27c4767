"""Hybrid seeding and candidate inventories: which facts start a search, which diagnoses are argued, on what evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import typed
from marlstone.operators.fusion import evidence_score, margin, reciprocal_rank, route_score

#: What an executable threshold adds to a fused score, and the strengths of structured evidence.
THRESHOLD_BONUS = 0.08
THRESHOLD_STRENGTH, EVENT_STRENGTH = 1.0, 0.8


def fuse(sparse: DataFrame, dense: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Fused scores of facts: reciprocal ranks of both channels times the premise's weight, plus the bonus of a met threshold.

    ``facts`` has the keys, ``weight`` and ``threshold_met``; a fact in neither channel is left out.
    """
    ranks = sparse.select(*keys, F.col("rank").alias("__s")).join(dense.select(*keys, F.col("rank").alias("__d")), keys, "full")
    score = (reciprocal_rank(F.col("__s")) + reciprocal_rank(F.col("__d"))) * F.col("weight") + F.when(F.col("threshold_met"), THRESHOLD_BONUS).otherwise(0.0)
    return ranks.join(facts, keys).withColumn("score", score).filter("score > 0").drop("__s", "__d")


def structured_floor(scored: DataFrame, facts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Raise facts with structured evidence above all others: the best score plus 1, times their strength.

    ``facts`` has the keys, ``threshold_met`` and ``event_met``.  The best score is one row a group of ``by``.
    """
    strength = F.when(F.col("threshold_met"), THRESHOLD_STRENGTH).when(F.col("event_met"), EVENT_STRENGTH)
    strong = facts.select(*keys, strength.alias("__x")).filter(F.col("__x").isNotNull())
    best = scored.groupBy(*by).agg(F.max("score").alias("__b"))
    strong = strong.join(best, by, "left").withColumn("__f", (F.coalesce("__b", F.lit(0.0)) + 1) * F.col("__x"))
    joined = scored.select(*keys, "score").join(strong.select(*keys, "__f"), keys, "full")
    return joined.select(*keys, F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("__f", F.lit(0.0))).alias("score"), F.col("__f").isNotNull().alias("structured"))


def hybrid_candidates(scored: DataFrame, by: list[str], graph: str, label: str, key: str, overlap: Column, seeds: int, graphs: int, most: int) -> DataFrame:
    """From scored facts to ranked routes: seeds, the graphs they name, each route's evidence, its margin over siblings.

    ``scored`` has ``by``, graph, label, key and ``score``.  Seeds are the best facts of a group; the best
    graphs by the seeds' diminishing sum are kept whole, and a route is a (graph, label) of them.
    """
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), key)
    seeded = scored.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= seeds)
    evidence = evidence_score(seeded, [*by, graph], "score", "__g")
    best = Window.partitionBy(*by).orderBy(F.col("__g").desc(), graph)
    kept = evidence.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= graphs).drop("__r")
    own = evidence_score(scored, [*by, graph, label], "score", "own").join(kept, [*by, graph])
    routes = margin(own, [*by, graph], "own", label)
    ranked = routes.withColumn("route", F.round(route_score(F.col("own"), F.col("__g"), overlap, F.col("margin")), 6))
    place = Window.partitionBy(*by).orderBy(F.col("route").desc(), F.lower(label), graph)
    return ranked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).select(*by, graph, label, "route", "place")


def candidate_inventory(facts: DataFrame, case: str, seed: str | None = None, most: int = 12) -> DataFrame:
    """Candidates of a case: facts of one diagnosis key are one entry with its best score and first rank; at most ``most``.

    ``facts`` has the case, ``diagnosis``, ``score`` and ``rank``; a column ``seed`` names the case's own
    diagnosis, which takes the last place if it is not among the others.
    """
    more = [F.first(seed).alias("__seed")] if seed else []
    keyed = facts.withColumn("__k", T.label_key(F.col("diagnosis")))
    entries = keyed.groupBy(case, "__k").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.min_by("diagnosis", F.struct("rank", "diagnosis")).alias("diagnosis"), F.count(F.lit(1)).alias("facts"), *more)
    order = Window.partitionBy(case).orderBy(F.col("score").desc(), "rank", "__k")
    own = F.col("__k") == T.label_key(F.col("__seed")) if seed else F.lit(False)
    placed = entries.withColumn("place", F.row_number().over(order)).withColumn("__own", own)
    if not seed:
        return placed.filter(F.col("place") <= most).drop("__k", "__own")
    late = F.max(F.when(F.col("__own"), F.col("place"))).over(Window.partitionBy(case))
    n = F.count(F.lit(1)).over(Window.partitionBy(case))
    room = F.when(late > most, most - 1).otherwise(most)
    chosen = placed.withColumn("__room", room).withColumn("__n", n).filter((F.col("place") <= F.col("__room")) | F.col("__own"))
    return chosen.withColumn("place", F.least("place", F.lit(most))).drop("__k", "__own", "__seed", "__room", "__n")


def family_inventory(facts: DataFrame, case: str, family: str, most: int = 8) -> DataFrame:
    """The best ``most`` families of a case by their best fact, with the number of facts and of children."""
    f = facts.groupBy(case, family).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("facts"), F.countDistinct("diagnosis").alias("children"))
    order = Window.partitionBy(case).orderBy(F.col("score").desc(), family)
    return f.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def atomic_facts(facts: DataFrame) -> DataFrame:
    """Each clause of a fact as a fact of its own, named by its parent, node, place and text."""
    atoms = facts.select("*", F.posexplode(typed.atomic_criteria(F.col("text"))).alias("__i", "atom"))
    named = F.concat_ws("|", "evidence_id", "node_id", (F.col("__i") + 1).cast("string"), "atom")
    return atoms.withColumn("atom_id", T.content_id("KFA-", named, 16)).drop("__i")


def argument_compatibility(cited: DataFrame, argument: str) -> DataFrame:
    """Per argument the least compatibility of its cited knowledge, 0 if a gate fails.

    ``cited`` has the argument, ``evidence_id``, ``is_valid``, ``compatibility``, ``role`` and the ``scheme``.
    Gates: every id is valid, some id is the patient's unless a guideline speaks, every cited role is the
    one its scheme allows.
    """
    # The knowledge role that each scheme of support may cite.
    allowed = F.create_map(*[F.lit(x) for pair in (("clinical_sign", "clinical_feature"), ("diagnostic_criterion", "diagnostic_criterion"), ("risk_factor", "risk_factor"), ("guideline_authority", "guideline")) for x in pair])
    knowledge, patient = F.startswith("evidence_id", F.lit("K")), F.startswith("evidence_id", F.lit("S-"))
    fits = F.coalesce(F.col("role") == F.try_element_at(allowed, F.col("scheme")), F.lit(False))
    return cited.groupBy(argument, "scheme").agg(F.bool_and("is_valid").alias("v"), F.bool_or(patient).alias("p"), F.bool_and(~knowledge | fits).alias("r"), F.min(F.when(knowledge, F.col("compatibility"))).alias("c")).select(
        argument, F.when(F.col("v") & F.col("r") & (F.col("p") | (F.col("scheme") == "guideline_authority")), F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("compatibility")
    )


def graph_candidates(candidates: DataFrame, labels: DataFrame, case: str) -> DataFrame:
    """Candidates whose own label or any label of their path has the key of the case's graph label."""
    keys = F.array_distinct(F.transform(F.concat(F.array("diagnosis"), "path"), lambda x: T.label_key(x)))
    mine = candidates.select(case, "candidate_id", F.explode(keys).alias("key"))
    return mine.join(labels.select(case, T.label_key(F.col("graph_label")).alias("key")), [case, "key"], "left_semi").select(case, "candidate_id").distinct()


def shape_signal(candidates: DataFrame, labels: DataFrame, case: str) -> DataFrame:
    """Per case: how many candidates name the graph's label, how many of these are active, and the cited evidence they share.

    ``candidates`` has the case, ``candidate_id``, ``diagnosis``, ``path``, ``active`` and ``evidence``; ``labels``
    the case, ``graph_label`` and ``citations``.
    """
    found = graph_candidates(candidates, labels, case).withColumn("__g", F.lit(True))
    rows = candidates.join(found, [case, "candidate_id"], "left").join(labels.select(case, "citations"), case)
    named, shared = F.coalesce("__g", F.lit(False)), F.size(F.array_intersect("evidence", "citations"))
    return rows.groupBy(case).agg(
        F.count_if(named).alias("graph_candidates"),
        F.count_if(named & F.col("active")).alias("active_graph_candidates"),
        F.count_if(F.col("active")).alias("active"),
        F.sum(F.when(F.col("active"), shared).otherwise(0)).alias("active_overlap"),
        F.sum(F.when(named, shared).otherwise(0)).alias("graph_overlap"),
    )


def claim_aliases(claims: DataFrame, case: str) -> DataFrame:
    """Each claim of a case with the first claim on its node as its alias, and how many stand on it: a row a claim, not a pair."""
    first = claims.groupBy(case, "node_id").agg(F.min("claim_id").alias("alias_of"), F.count(F.lit(1)).alias("claims"))
    return claims.join(first, [case, "node_id"]).select(case, "node_id", "claim_id", "alias_of", "claims")


def trace_profile(traces: DataFrame, predictions: DataFrame, graph_rows: DataFrame, adjudications: DataFrame, case: str) -> DataFrame:
    """Traces with their prediction, and, where there is one, the graph's row and the adjudication; missing ones are told."""
    j = traces.join(predictions, case).join(graph_rows.withColumn("__g", F.lit(True)), case, "left").join(adjudications.withColumn("__a", F.lit(True)), case, "left")
    return j.withColumn("has_graph_row", F.coalesce("__g", F.lit(False))).withColumn("has_adjudication", F.coalesce("__a", F.lit(False))).drop("__g", "__a")
