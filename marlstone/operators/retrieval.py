"""Retrieval in one chain: rankings fused, structured evidence executed, whole graphs of the seeds, diverse routes, a budget of facts.

Every step is a join or a rank over (query, ...), and what several later steps read is written once; structured evidence meets on the names of measurements and on
(modality, concept), so no query is compared with all premises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import clinical
from marlstone.functions.text import content_id, holds, label_key, tokens
from marlstone.operators import inventory, lexical, select
from marlstone.operators.binding import concept_terms
from marlstone.operators.fusion import evidence_score, margin, reciprocal_rank, route_score
from marlstone.sources.scratch import written

# Words of a past event, of a positive and of a negative result, and premises that say nothing.
HISTORICAL = r"(?i)\b(?:history of|historical|previous(?:ly)?|prior|remote|resolved)\b"
POSITIVE = r"(?i)\b(?:positive|detect(?:s|ed|ing)?|demonstrat(?:e|es|ed|ing)|show(?:s|ed|ing)?|confirm(?:s|ed|ing)?|reveals?|present)\b"
NEGATIVE = r"(?i)\b(?:negative|normal|absent|excluded|ruled out|without|no evidence of)\b"
MEANINGLESS = ("etc", "and so on", "other", "others")
SEEDS, GRAPHS, CANDIDATES, SOURCES = 24, 12, 32, 4
ROUTES, FACTS = 8, 12


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.;]+"), lambda c: F.trim(c)), lambda c: c != "")


def current_text(text: Column) -> Column:
    """The clauses of a query that speak of no past."""
    return F.array_join(F.filter(clauses(text), lambda c: ~F.regexp_like(c, F.lit(HISTORICAL))), ". ")


def generic(label: Column) -> Column:
    """Whether a label only suspects a diagnosis."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[-\s]+", " "))
    return F.startswith(plain, F.lit("suspected ")) | F.startswith(plain, F.lit("strongly suspected "))


def meaningless(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[\s.;,:]+|[\s.;,:]+$", ""), r"\s+", " "))
    return plain.isin(*MEANINGLESS)


def _met(queries: DataFrame, text: Column, wanted: DataFrame) -> DataFrame:
    seen = queries.select("query", F.explode(clinical.measurements(text)).alias("m")).select("query", F.col("m.name").alias("name"), F.col("m.value").alias("seen")).distinct()
    return seen.join(wanted, "name").filter(holds(F.col("seen"), F.col("op"), F.col("value"))).select("query", "premise").distinct()


def _events(rows: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """``key, modality, concept`` of every positive clause: what was tested, and each concept it names besides."""
    said = rows.select(key, F.explode(clauses(text)).alias("c")).filter(F.regexp_like("c", F.lit(POSITIVE)) & ~F.regexp_like("c", F.lit(NEGATIVE)))
    tested = said.withColumn("modality", clinical.modality(F.col("c"))).filter("modality is not null")
    bare = F.col("c")
    for _, pattern in clinical.MODALITIES:
        bare = F.when(F.regexp_like("c", F.lit(f"(?i){pattern}")) & (F.col("modality") == _), F.regexp_replace("c", f"(?i){pattern}", " ")).otherwise(bare)
    words = F.transform(tokens(bare), lambda w: w)
    asked = tested.select(key, "modality", F.explode(F.array_distinct(F.concat(concept_terms(bare), words))).alias("key_"))
    return asked.join(terms.select(F.col("key").alias("key_"), "concept"), "key_").select(key, "modality", "concept").distinct()


def structured(queries: DataFrame, premises: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``query, premise, threshold_met, strength`` of pairs with executed evidence.

    ``threshold_met`` says that a measurement of the query meets a threshold of the premise; the strength is 1 if a current one
    does, else 0.8 if a positive test of one modality and concept stands in both, which needs ``terms`` (key, concept).
    """
    wanted = premises.select("premise", F.explode(clinical.thresholds(F.col("text"))).alias("t")).select("premise", "t.name", "t.op", "t.value")
    wanted = written(wanted)
    any_, now = _met(queries, F.col("text"), wanted), _met(queries, current_text(F.col("text")), wanted)
    marks = any_.select("query", "premise", F.lit(True).alias("any"), F.lit(0.0).alias("s")).union(now.select("query", "premise", F.lit(False), F.lit(1.0)))
    if terms is not None:
        own, theirs = _events(queries, "query", current_text(F.col("text")), terms), _events(premises, "premise", F.col("text"), terms)
        both = own.join(theirs, ["modality", "concept"]).select("query", "premise").distinct()
        marks = marks.union(both.select("query", "premise", F.lit(False), F.lit(0.8)))
    return written(marks.groupBy("query", "premise").agg(F.bool_or("any").alias("threshold_met"), F.max("s").alias("strength")))


def candidate_choices(queries: DataFrame, premises: DataFrame, dense: DataFrame, evidence: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """``query, place, candidate_id, label, graph, route, sources``: ranked routes of the best seeds' graphs.

    ``queries`` has ``query, text``; ``premises`` ``premise, graph, label, text, weight``; ``dense`` ``query, premise, rank``, ranked
    before anything is left out; ``evidence`` comes from ``structured``.  All premises of the seeds' graphs take part in their routes, scored or not.
    """
    docs, asked = premises.select(F.col("premise").alias("doc_id"), "text"), queries.withColumnRenamed("query", "item_id")
    by_query = Window.partitionBy("query").orderBy(F.col("score").desc(), "premise")
    # what later steps ask of a premise, read from its text once
    known = written(premises.select("premise", "graph", "label", "weight", (~meaningless(F.col("text"))).alias("useful"), generic(F.col("label")).alias("generic")))
    scored = lexical.bm25_scores(docs, asked).withColumnRenamed("doc", "premise").join(known.filter("useful").hint("shuffle_hash"), "premise")
    sparse = written(scored.withColumn("rank", F.row_number().over(by_query)).drop("score"))
    # a row of every (query, premise) in any channel carries all that its score needs: they meet in one grouping, and no join of them all follows
    own = ["graph", "label", "weight", "useful", "generic"]
    none = lambda kind: F.lit(None).cast(kind)
    channels = sparse.select("query", "premise", *own, "rank", none("int").alias("near"), none("boolean").alias("threshold_met"), none("double").alias("strength"))
    channels = channels.union(dense.join(known, "premise").select("query", "premise", *own, none("int"), F.col("rank"), none("boolean"), none("double")))
    channels = channels.union(evidence.join(known, "premise").select("query", "premise", *own, none("int"), none("int"), "threshold_met", "strength"))
    met = channels.groupBy("query", "premise").agg(*[F.first(c).alias(c) for c in own], *[F.max(c).alias(c) for c in ("rank", "near", "threshold_met", "strength")])
    ranked_ = F.col("useful") & (F.col("rank").isNotNull() | F.col("near").isNotNull())
    score = (reciprocal_rank(F.col("rank")) + reciprocal_rank(F.col("near"))) * F.col("weight") + F.when(F.col("threshold_met"), inventory.THRESHOLD_BONUS).otherwise(0.0)
    fused = written(met.select("query", "premise", "graph", "label", (F.col("useful") & ~F.col("generic")).alias("member"), "strength", F.when(ranked_ & (score > 0), score).alias("fused")))
    # executed evidence stands above all else of its query
    floor = fused.groupBy("query").agg((F.coalesce(F.max("fused"), F.lit(0.0)) + 1).alias("__f"))
    lift = F.when(F.col("strength") == 1, inventory.THRESHOLD_STRENGTH).when(F.col("strength") > 0, inventory.EVENT_STRENGTH)
    raised = fused.join(F.broadcast(floor), "query").withColumn("score", F.greatest(F.coalesce("fused", F.lit(0.0)), F.coalesce(F.col("__f") * lift, F.lit(0.0)))).filter("score > 0")
    # the seeds come from the best fused facts and the executed ones
    by_fused = Window.partitionBy("query").orderBy(F.col("fused").desc(), "premise")
    before = raised.filter("fused is not null").withColumn("__r", F.row_number().over(by_fused)).filter(F.col("__r") <= SEEDS).drop("__r")
    pool = before.union(raised.filter("strength > 0")).distinct()
    seeds = pool.withColumn("__r", F.row_number().over(by_query)).filter(F.col("__r") <= SEEDS)
    by_graph = evidence_score(seeds, ["query", "graph"], "score", "__g")
    best = Window.partitionBy("query").orderBy(F.col("__g").desc(), "graph")
    kept = by_graph.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= GRAPHS).drop("__r")
    kept = F.broadcast(written(kept))
    route = ["query", "graph", "label"]
    inside = Window.partitionBy(*route).orderBy(F.col("score").desc(), "premise")
    best_few = lambda rows: rows.withColumn("__n", F.row_number().over(inside)).filter(F.col("__n") <= SOURCES)
    scored_ = best_few(raised.filter("member").join(kept, ["query", "graph"]).select(*route, "__g", "premise", "score")).drop("__n")
    # premises without a score fill a route by id; fewer than SOURCES of its first are scored if any is needed
    by_id = Window.partitionBy("graph", "label").orderBy("premise")
    low = known.filter("useful and not generic").withColumn("__n", F.row_number().over(by_id)).filter(F.col("__n") < 2 * SOURCES).select("graph", "label", "premise")
    plain = low.join(kept, "graph").select(*route, "__g", "premise", F.lit(0.0).alias("score"))
    members = written(best_few(scored_.union(plain).groupBy(*route, "__g", "premise").agg(F.max("score").alias("score"))))
    sources = members.groupBy(*route, "__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "premise"))), lambda x: x["premise"]).alias("sources"))
    own = sources.join(evidence_score(members, route, "score", "own"), route, "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    routes = margin(own, ["query", "graph"], "own", "label").join(queries.select("query", F.col("text").alias("__t")), "query")
    words = F.array_distinct(tokens(F.col("label")))
    overlap = F.size(F.array_intersect(words, tokens(F.col("__t")))) / F.greatest(F.size(words), F.lit(1))
    ranked = routes.withColumn("route", F.round(route_score(F.col("own"), F.col("__g"), overlap, F.col("margin")), 9)).withColumn("candidate_id", content_id("candidate:", label_key(F.col("label"))))
    place = Window.partitionBy("query").orderBy(F.col("route").desc(), F.lower("label"), "candidate_id", "graph")
    return ranked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).select("query", "place", "candidate_id", "label", "graph", "route", "sources")


def diverse_routes(choices: DataFrame, evidence: DataFrame, routes: int = ROUTES, facts: int = FACTS) -> DataFrame:
    """``query, rank, candidate_id, label, graph, place, sources``: at most ``routes`` of the choices with ``facts`` sources among them.

    A generic label gives way to a specific one of its graph.  Choices with executed evidence come first, then by place; the first of each graph
    before any second.  Each route gets a source, then the route with fewest; a source is used once, and routes without one are left out.
    """
    choices, g = written(choices), generic(F.col("label"))
    specific = F.bool_or(~g).over(Window.partitionBy("query", "graph"))
    viable = choices.withColumn("__s", specific).filter(~(g & F.col("__s"))).drop("__s")
    strong = viable.select("query", "place", F.explode("sources").alias("premise")).join(evidence.select("query", "premise", "strength"), ["query", "premise"]).groupBy("query", "place").agg(F.max("strength").alias("__x"))
    known = viable.join(strong, ["query", "place"], "left").withColumn("__x", F.coalesce("__x", F.lit(0.0)))
    chosen = select.cover_then_fill(known.withColumnRenamed("place", "original"), ["query"], "graph", [F.col("__x").desc(), F.col("original")], routes)
    siblings = written(chosen.withColumn("siblings", F.count(F.lit(1)).over(Window.partitionBy("query", "graph"))))
    each = siblings.select("query", F.col("place").alias("route_position"), "siblings", F.col("original").alias("tie"), F.posexplode("sources").alias("fact_position", "source_id"))
    taken = select.allocate_facts(each, "query", facts).groupBy("query", "route_position").agg(F.transform(F.array_sort(F.collect_list(F.struct("allocated", "source_id"))), lambda x: x["source_id"]).alias("sources"))
    rows = siblings.drop("sources").join(taken.withColumnRenamed("route_position", "place"), ["query", "place"])
    return rows.select("query", F.col("place").alias("rank"), "candidate_id", "label", "graph", F.col("original").alias("place"), "sources")
