"""Evidence bundles: query terms, selection, rendering, question sets, and the gates of a run and its package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import label_key, look_up

# The term to look up for a graph label, by the label's key.
QUERY_TERMS = {
    "alzheimer": "Alzheimer disease",
    "asthmacopd": "asthma COPD overlap syndrome",
    "hfmref": "heart failure",
    "hfpef": "heart failure with preserved ejection fraction",
    "hfref": "heart failure with reduced ejection fraction",
    "ltbi": "latent tuberculosis infection",
    "lowriskpe": "pulmonary embolism",
    "massivepe": "pulmonary embolism",
    "mildcopd": "chronic obstructive pulmonary disease",
    "moderatecopd": "chronic obstructive pulmonary disease",
    "nsteacs": "acute coronary syndrome",
    "pituitarymacroadenomas": "pituitary macroadenoma",
    "pituitarymicroadenomas": "pituitary microadenoma",
    "pituitarysilentadenomas": "non-functioning pituitary adenoma",
    "persistentatrialfibrillation": "persistent atrial fibrillation",
    "pulmonaryembolism": "pulmonary embolism",
    "severeasthma": "severe asthma",
    "severecopd": "chronic obstructive pulmonary disease",
    "specifictypesofdiabetes": "diabetes mellitus",
    "stemiacs": "ST elevation myocardial infarction",
    "submassivepe": "pulmonary embolism",
    "suspectedepilepsy": "epilepsy",
    "thyroidcancer": "thyroid cancer",
    "thyroidnodules": "thyroid nodule",
    "typeidiabetes": "type 1 diabetes mellitus",
    "typeiidiabetes": "type 2 diabetes mellitus",
    "ua": "unstable angina",
    "uppergastrointestinalbleeding": "upper gastrointestinal bleeding",
    "veryseverecopd": "chronic obstructive pulmonary disease",
}

# Evidence ids of a case's sections, in order.
SECTION_IDS = {
    "chief_complaint": "S-CC",
    "history_of_present_illness": "S-HPI",
    "past_medical_history": "S-PMH",
    "family_history": "S-FH",
    "physical_exam": "S-EXAM",
    "pertinent_results": "S-RESULTS",
}


def query_term(label: Column, terms: dict[str, str] = QUERY_TERMS) -> Column:
    """The term that stands for a graph label: its own, else that of the label without "(strongly) suspected", else that label."""
    flat = F.trim(F.regexp_replace(label, r"\s+", " "))
    sure = F.regexp_replace(flat, "(?i)^(strongly suspected|suspected) ", "")
    return F.coalesce(look_up(label_key(flat), terms), look_up(label_key(sure), terms), sure)


def corpus_order(premises: DataFrame, graph: str = "graph_id", node: str = "node_id") -> DataFrame:
    """The corpus in its one order: by graph, then node."""
    return premises.orderBy(graph, node)


def flat_line(evidence: Column, diagnosis: Column, kind: Column, text: Column) -> Column:
    return F.concat(evidence, F.lit(" | diagnosis="), diagnosis, F.lit(" | premise_type="), kind, F.lit(" | premise="), text)


def graph_lines(evidence: Column, diagnosis: Column, kind: Column, text: Column, path: Column) -> Column:
    edge = F.concat(evidence, F.lit(" --supports--> "), diagnosis, F.lit(" | type="), kind, F.lit(" | premise="), text)
    return F.concat(edge, F.lit("\nPATH "), evidence, F.lit(": "), F.array_join(path, " -> "))


def render(queries: DataFrame, facts: DataFrame, by: str, position: str, line: Column, empty: str) -> DataFrame:
    """``by, bundle``: the lines of each query's facts in order, or ``empty`` for a query without facts.  A bundle has a handful of facts."""
    lines = facts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), line.alias("line")))).alias("lines"))
    joined = queries.select(by).distinct().join(lines, by, "left")
    return joined.select(by, F.coalesce(F.array_join(F.col("lines.line"), "\n"), F.lit(empty)).alias("bundle"))


def binding_problems(bindings: DataFrame, corpus: DataFrame, allowed: DataFrame, by: str) -> DataFrame:
    """``bindings`` with ``problem``: why a query may not use a source, or null.

    ``bindings`` has ``by, label, source_id``; ``corpus`` has ``source_id, diagnostic_path``, of which
    one label must have the binding's key; ``allowed`` has ``by, source_id``.
    """
    known = bindings.join(corpus.select("source_id", F.coalesce("diagnostic_path", F.array().cast("array<string>")).alias("__path")), "source_id", "left")
    both = known.join(allowed.select(by, "source_id").distinct().withColumn("__may", F.lit(True)), [by, "source_id"], "left")
    key = label_key(F.col("label"))
    supported = F.coalesce((key != "") & F.exists("__path", lambda p: F.coalesce(label_key(p) == key, F.lit(False))), F.lit(False))
    why = F.when(F.col("__path").isNull(), "unknown source").when(F.col("__may").isNull(), "not allowed").when(~supported, "unsupported")
    return both.withColumn("problem", why).drop("__path", "__may")


def fixed_bundle(bindings: DataFrame, siblings: DataFrame, by: str, k: int) -> DataFrame:
    """``by, place, evidence_id, source_id, rank, score`` of each query's evidence, a source once.

    First the first binding of every candidate; then, while there are fewer than ``k``, siblings in
    turn: depth first, families by how far their best sibling ranks behind the representative; then the
    candidates' other bindings.  ``bindings`` has ``by, rank, position, source_id``; ``siblings`` has
    ``by, family_rank, representative_rank, candidate_rank, candidate_id, sources``, of which the first
    unused source counts.  A query's routes are few, so they are folded as one array.
    """
    order = ("stage", "a", "b", "c")
    first = F.row_number().over(Window.partitionBy(by, "rank").orderBy("position", "source_id")) == 1
    own = bindings.withColumn("__first", first).select(by, F.when(F.col("__first"), 1).otherwise(3).alias("stage"), F.col("rank").cast("long").alias("a"), F.when(F.col("__first"), 0).otherwise(F.col("position")).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.col("rank").cast("long").alias("rank"), F.array("source_id").alias("sources"))
    family = Window.partitionBy(by, "family_rank")
    gap = F.min(F.col("candidate_rank") - F.col("representative_rank")).over(family)
    depth = F.row_number().over(family.orderBy("candidate_rank", "candidate_id"))
    other = siblings.select(by, F.lit(2).alias("stage"), depth.cast("long").alias("a"), gap.cast("long").alias("b"), F.col("family_rank").cast("long").alias("c"), F.col("family_rank").cast("long").alias("rank"), "sources")
    offers = own.unionByName(other).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "rank", "sources"))).alias("offers"))

    def take(taken: Column, offer: Column) -> Column:
        new = F.get(F.array_except(offer["sources"], F.transform(taken, lambda x: x["source_id"])), F.lit(0))
        room = (offer["stage"] == 1) | (F.size(taken) < k)
        return F.when(new.isNotNull() & room, F.concat(taken, F.array(F.struct(offer["rank"].alias("rank"), new.alias("source_id"))))).otherwise(taken)

    kind = bindings.schema["source_id"].dataType.simpleString()
    taken = F.aggregate("offers", F.array().cast(f"array<struct<rank:bigint,source_id:{kind}>>"), take)
    rows = offers.select(by, F.posexplode(taken).alias("at", "fact"))
    place = F.col("at") + 1
    return rows.select(by, place.alias("place"), F.concat(F.lit("K"), place).alias("evidence_id"), "fact.source_id", "fact.rank", F.round(1 / F.col("fact.rank"), 6).alias("score"))


def family_child_facts(premises: DataFrame, routes: DataFrame, allowed: DataFrame, by: str) -> DataFrame:
    """``by, place, evidence_id, graph_id, source_id`` of all facts of the graphs that a query's ``routes`` (by, graph_id) select.

    Only sources that the query may cite, in ``allowed`` (by, source_id), in the order of graph, path, node and source; ids are ``KF1`` on.
    ``premises`` has ``graph_id, diagnostic_path, node_id, source_id``; a graph that several routes name counts once.
    """
    # by source first: a graph has many facts, a query may cite few
    may = allowed.select(by, "source_id").distinct().join(premises.select("graph_id", "diagnostic_path", "node_id", "source_id"), "source_id")
    may = may.join(routes.select(by, "graph_id").distinct(), [by, "graph_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy(by).orderBy("graph_id", "diagnostic_path", "node_id", "source_id"))
    return may.withColumn("place", place).select(by, "place", F.concat(F.lit("KF"), F.col("place").cast("string")).alias("evidence_id"), "graph_id", "source_id")


def question_set(cases: DataFrame, sections: DataFrame, expected: DataFrame, instruction: str) -> DataFrame:
    """``case_id, evidence, payload, gold_label, gold_category, problem`` of every expected case.

    ``sections`` has ``case_id, section, text``; blank ones and unknown sections are left out.  The
    payload is JSON and holds nothing of the gold columns.  ``problem`` names a missing case or one
    without evidence; else it is null.
    """
    names = list(SECTION_IDS)
    at = F.array_position(F.array(*map(F.lit, names)), F.col("section"))
    item = F.struct(at.alias("at"), look_up(F.col("section"), SECTION_IDS).alias("evidence_id"), "section", "text")
    told = sections.filter(F.col("section").isin(names) & (F.trim("text") != "")).groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    known = cases.select("case_id", F.col("gold_label"), F.col("gold_category"), F.lit(True).alias("known"))
    all_of = expected.select("case_id").distinct().join(known, "case_id", "left").join(told, "case_id", "left")
    evidence = F.transform("items", lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["section"].alias("section"), x["text"].alias("text")))
    why = F.when(F.col("known").isNull(), "missing case").when(F.col("items").isNull(), "no evidence")
    payload = F.to_json(F.struct("case_id", F.lit("diagnosis").alias("task"), F.col("evidence").alias("patient_evidence"), F.lit(instruction).alias("instruction")))
    rows = all_of.select("case_id", evidence.alias("evidence"), "gold_label", "gold_category", why.alias("problem"))
    return rows.withColumn("payload", F.when(F.col("problem").isNull(), payload))


def package_gate(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: files (``path, sha256``) that the manifest lacks, listed ones that are missing or changed, and whether the two agree."""
    both = files.select("path", F.col("sha256").alias("have"), F.lit(True).alias("is_file")).join(manifest.select("path", F.col("sha256").alias("want"), F.lit(True).alias("listed")), "path", "full")
    there = F.col("is_file").isNotNull() & F.col("listed").isNotNull()
    row = both.agg(F.count_if(F.col("listed").isNull()).alias("extra"), F.count_if(F.col("is_file").isNull()).alias("missing"), F.count_if(there & ~F.col("have").eqNullSafe(F.col("want"))).alias("changed"))
    return row.withColumn("may_run", (F.col("extra") == 0) & (F.col("missing") == 0) & (F.col("changed") == 0))


def run_gates(predictions: DataFrame, traces: DataFrame, decisions: DataFrame, expected: DataFrame, modes: Sequence[str], retrievers: dict[str, str], flat: str = "flat_rag", graph: str = "graph_rag") -> DataFrame:
    """One row: whether a finished run holds together, gate by gate, and ``all_gates_pass``.

    ``predictions``: ``case_id, mode, error, predicted_label, bundle_sha256, retriever_id``;
    ``traces``: ``case_id, bundle_sha256, consumers (array of digests), provenance (array of structs),
    candidate_ids, action, resolved, symbolic, dialectical, leaks, flat_sha256, flat_shared``;
    ``decisions``: ``case_id, bundle_sha256, selected, abstained, error``.  A gate without cases fails;
    what is null fails its gate, except errors and selections, which are then absent.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    of = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    known = predictions.join(expected.select("case_id").distinct().withColumn("__asked", F.lit(True)), "case_id", "left")
    per_case = known.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(none("error")).alias("clean"), F.max("__asked").alias("asked"),
        F.array(*[F.count_if(F.col("mode") == m) for m in modes]).alias("times"),
        *[of(m, c).alias(f"{name}_{c}") for name, m in (("flat", flat), ("graph", graph)) for c in ("bundle_sha256", "retriever_id", "predicted_label")],
    )
    t = traces.withColumnRenamed("bundle_sha256", "input_sha256").withColumn("traced", F.lit(True))
    d = decisions.select("case_id", F.col("bundle_sha256").alias("decided_sha256"), "selected", "abstained", F.col("error").alias("decision_error"), F.lit(True).alias("decided"))
    asked = expected.select("case_id").distinct().withColumn("wanted", F.lit(True))
    rows = asked.join(per_case, "case_id", "full").join(t, "case_id", "full").join(d, "case_id", "full")
    wanted = F.col("wanted").isNotNull()
    bundle = F.col("input_sha256")
    same = (bundle != "") & F.forall("consumers", lambda x: yes(x == bundle)) & (F.col("graph_bundle_sha256") == bundle) & (F.col("decided_sha256") == bundle)
    full = lambda p: yes(p["node_id"] != "") & yes(F.size(p["diagnostic_path"]) > 0) & yes(p["source_chunk_id"] != "") & yes(F.size(p["knowledge_source_ids"]) > 0)
    off = yes(F.col("abstained"))
    kept = ~off & none("selected") & F.col("action").isin("keep", "graphrag_fallback") & (F.coalesce("resolved", F.lit("")) == F.coalesce("graph_predicted_label", F.lit("")))
    bound = ((off & none("selected")) | (~off & yes(F.array_contains("candidate_ids", F.col("selected")))) | yes(kept)) & none("decision_error")
    apart = ~F.col("flat_shared") & (F.col("flat_sha256") != "") & (F.col("flat_bundle_sha256") == F.col("flat_sha256")) & (F.col("flat_retriever_id") == retrievers.get(flat, "")) & (F.col("graph_retriever_id") == retrievers.get(graph, ""))
    every = lambda c: F.coalesce(F.bool_and(F.when(wanted, yes(c))), F.lit(False))
    gates = {
        "case_set": F.coalesce(F.bool_and(wanted & F.col("traced").isNotNull() & F.col("decided").isNotNull()), F.lit(False)),
        "modes_once": F.coalesce(F.bool_and(wanted & yes(F.forall("times", lambda x: x == 1)) & yes(F.col("n") == len(modes))), F.lit(False)),
        "no_errors": F.coalesce(F.bool_and(F.col("n").isNull() | (F.col("n") == F.col("clean"))), F.lit(False)),
        "bundle_identity": every(same),
        "flat_independent": every(apart),
        "provenance": every((F.size("provenance") > 0) & F.forall("provenance", full)),
        "bound_or_abstained": every(F.col("decided").isNotNull() & bound),
        "no_leaks": every(F.col("traced").isNotNull() & ~yes(F.col("leaks"))),
        "resolver_bounded": every(~F.col("symbolic") & F.col("dialectical")),
    }
    row = rows.agg(F.count_if(wanted).alias("cases"), F.sum(F.coalesce("n", F.lit(0))).alias("predictions"), *[g.alias(name) for name, g in gates.items()])
    passed = F.lit(True)
    for name in gates:
        passed = passed & F.col(name)
    return row.withColumn("all_gates_pass", passed)
