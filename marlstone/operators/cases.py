"""Operators over cases: corpus and evidence graph, patient queries, candidate ranking, judging, metrics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import binding, clinical
from marlstone.functions import text as T
from marlstone.operators.lexical import candidate_score, top_k

# Keys that must not enter a retrieval query, sections in order with their evidence ids, type weights.
FORBIDDEN = ("gold_label", "gold", "label", "answer", "diagnosis", "evaluation_gold_label")
SECTIONS = {
    "chief_complaint": "S-CC",
    "history_of_present_illness": "S-HPI",
    "past_medical_history": "S-PMH",
    "family_history": "S-FH",
    "physical_exam": "S-PE",
    "pertinent_results": "S-RESULTS",
    "patient_info": "S-DEMOGRAPHICS",
    "initial_vitals": "S-VITALS",
    "tests": "S-TESTS",
    "question": "S-QUESTION",
}
TYPE_WEIGHTS = {
    "diagnostic criteria": 1.25,
    "criteria": 1.25,
    "confirmatory test": 1.25,
    "laboratory finding": 1.2,
    "signs": 1.1,
    "sign": 1.1,
    "symptoms": 1.0,
    "symptom": 1.0,
    "risk factors": 0.8,
    "risk factor": 0.8,
}


def type_weight(premise_type: Column) -> Column:
    key = F.lower(F.trim(F.regexp_replace(premise_type, r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(1.0))


def corpus(premises: DataFrame, paths: DataFrame, extension: DataFrame | None = None) -> DataFrame:
    """Premises with the path of their diagnosis; those of an extension of the same category join in.

    ``premises``: graph_id, diagnosis, premise_type, position, text, premise_id; ``paths``: graph_id,
    node, path.  A premise whose diagnosis has no path is an error, raised when the rows are read.
    """
    rows = premises if extension is None else premises.unionByName(extension)
    keyed = paths.select(F.col("graph_id").alias("__g"), T.label_key(F.col("node")).alias("__k"), "path")
    joined = rows.join(keyed, (rows["graph_id"] == keyed["__g"]) & (T.label_key(rows["diagnosis"]) == keyed["__k"]), "left").drop("__g", "__k")
    checked = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no diagnostic path for "), "diagnosis")).cast("array<string>"))
    return joined.withColumn("path", checked).filter(~F.lower(F.trim("text")).isin(*T.MEANINGLESS))


def evidence_graph(corpus_rows: DataFrame) -> DataFrame:
    """Propositions: each premise's clauses with role, kind, relation, scope, conjunction and anchor flag."""
    each = corpus_rows.select("*", F.posexplode(T.sentences(F.col("text"))).alias("atom", "claim"))
    role = binding.role(F.col("premise_type"))
    scope = F.when(F.size("path") <= 1, "family").otherwise("child")
    identity = F.concat_ws("|", "graph_id", "premise_id", F.col("atom") + 1, "claim")
    rows = each.withColumns({"role": role, "scope": scope, "proposition_id": F.concat(F.lit("ep:"), F.substring(F.sha2(identity, 256), 1, 20))})
    claim, r = F.col("claim"), F.col("role")
    return rows.withColumns({"kind": clinical.proposition_kind(claim, r), "relation": clinical.relation(claim, r), "conjunctive": clinical.conjunctive(claim), "anchor": clinical.decisive_anchor(claim, r)})


def patient_evidence(sections: DataFrame) -> DataFrame:
    """``case_id, evidence_id, section, position, text`` of the known sections that are not blank, in their order."""
    ids = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    order = F.array(*map(F.lit, SECTIONS))
    named = sections.withColumn("section", F.regexp_replace(F.lower("section"), " ", "_"))
    known = named.select("case_id", F.try_element_at(ids, "section").alias("evidence_id"), "section", F.array_position(order, F.col("section")).alias("position"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return known.filter(F.col("evidence_id").isNotNull() & (F.col("text") != ""))


def retrieval_queries(evidence: DataFrame) -> DataFrame:
    """One query a case: its sections in order, a line each; a case has at most ten sections."""
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", "section", "text").alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return evidence.groupBy("case_id").agg(F.concat(F.lit("Clinical evidence for differential diagnosis:\n"), body).alias("query"))


def finding_queries(evidence: DataFrame) -> DataFrame:
    """One query a segment of each section, for dense search."""
    each = evidence.select("case_id", "evidence_id", "section", F.posexplode(T.retrieval_segments(F.col("text"))).alias("segment", "text"))
    return each.select("case_id", "evidence_id", "segment", F.concat_ws(": ", F.regexp_replace("section", "_", " "), "text").alias("query"))


def rank_candidates(choices: DataFrame, premises: DataFrame, queries: DataFrame, k: int = 32) -> DataFrame:
    """Candidates of each case by upstream rank, lexical fit of their sources, label overlap and source count.

    ``choices``: case_id, candidate_id, label, position, premise_id (a row a source); ``premises``:
    premise_id, premise_type, text; ``queries``: case_id, query.  Suspected labels are left out.
    """
    n = max(premises.count(), 1)
    terms = premises.select("premise_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("premise_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    distinct = terms.groupBy("premise_id").agg(F.count(F.lit(1)).alias("n_terms"))
    asked = queries.select("case_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("case_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    generic = F.regexp_like(F.lower(F.regexp_replace("label", "-", " ")), F.lit(r"^\s*(strongly )?suspected "))
    kept = choices.filter(~generic)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pairs = kept.select("case_id", "premise_id").distinct().join(terms, "premise_id").join(asked, ["case_id", "term"]).join(df, "term")
    fit = pairs.groupBy("case_id", "premise_id").agg(F.sum(idf * F.least("tf", F.lit(2)) * F.least("qtf", F.lit(2))).alias("overlap"))
    weighted = fit.join(distinct, "premise_id").join(premises.select("premise_id", "premise_type"), "premise_id").select("case_id", "premise_id", (F.col("overlap") / F.sqrt("n_terms") * type_weight(F.col("premise_type"))).alias("fit"))
    by = kept.join(weighted, ["case_id", "premise_id"], "left").groupBy("case_id", "candidate_id", "label", "position").agg(F.max(F.coalesce("fit", F.lit(0.0))).alias("fit"), F.countDistinct("premise_id").alias("sources"))
    words = by.join(queries, "case_id")
    label = F.array_distinct(T.tokens(F.col("label")))
    overlap = F.size(F.array_intersect(label, T.tokens(F.col("query")))) / F.greatest(F.size(label), F.lit(1))
    scored = words.select("case_id", "candidate_id", "label", "sources", F.round(candidate_score(F.col("position"), F.col("fit"), overlap, F.col("sources")), 6).alias("score"))
    return top_k(scored, k, "case_id", "score", "candidate_id")


def exact_match(predicted: Column, gold: Column) -> Column:
    """1 for the same lexical key; 0 if either is empty."""
    full = (F.coalesce(predicted, F.lit("")) != "") & (F.coalesce(gold, F.lit("")) != "")
    return F.when(full & (T.lexical_key(predicted) == T.lexical_key(gold)), 1.0).otherwise(0.0)


def family_match(predicted: Column, gold: Column) -> Column:
    full = (F.coalesce(predicted, F.lit("")) != "") & (F.coalesce(gold, F.lit("")) != "")
    kin = (T.family_key(predicted) == T.family_key(gold)) & ~T.contradict(T.qualifiers(predicted), T.qualifiers(gold))
    return F.when(exact_match(predicted, gold) == 1.0, 1.0).when(full & kin, 1.0).otherwise(0.0)


def hierarchy_match(predicted: Column, gold: Column, distance: Column, both_known: Column) -> Column:
    """1, 3/4 or 1/2 by distance in the hierarchy; labels it knows but does not connect are 0; else by family."""
    a, b = T.qualifiers(predicted), T.qualifiers(gold)
    plain = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.75).otherwise(0.5)
    kin = (T.family_key(predicted) == T.family_key(gold)) & ~T.contradict(a, b)
    return F.when(exact_match(predicted, gold) == 1.0, 1.0).when(distance == 1, 0.75).when(distance > 1, 0.5).when(both_known, 0.0).when(kin, plain).otherwise(0.0)


def observation_scores(matched: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of matched observations: all 1 if both sides are empty, recall 1 if only gold is."""
    p = F.when((predicted == 0) & (gold == 0), 1.0).when(predicted == 0, 0.0).otherwise(F.try_divide(matched, predicted))
    r = F.when(gold == 0, F.when(predicted == 0, 1.0).otherwise(1.0)).otherwise(F.try_divide(matched, gold))
    p = F.when((gold == 0) & (predicted > 0), 0.0).otherwise(p)
    r = F.when((predicted == 0) & (gold > 0), 0.0).otherwise(r)
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def citation_validity(citations: Column, valid: Column) -> Column:
    """Share of citations that are valid whatever their case; 0 without any."""
    known = F.transform(valid, lambda v: F.lower(v))
    good = F.filter(citations, lambda c: F.array_contains(known, F.lower(c)))
    return F.coalesce(F.try_divide(F.size(good).cast("double"), F.size(citations).cast("double")), F.lit(0.0))


def case_metrics(predictions: DataFrame, cases: DataFrame, distances: DataFrame) -> DataFrame:
    """One wide row a prediction; a case that is missing leaves its metrics null.

    ``distances``: a, b, distance of label keys, as ``graphs.path_distances`` gives them.
    """
    known = distances.select("a").distinct()
    gold = cases.select("case_id", F.col("gold_label").alias("gold"))
    rows = predictions.drop("gold_label").join(gold, "case_id", "left").withColumns({"pk": T.label_key(F.col("predicted_label")), "gk": T.label_key(F.col("gold"))})
    near = distances.select(F.col("a").alias("pk"), F.col("b").alias("gk"), "distance")
    rows = rows.join(near, ["pk", "gk"], "left")
    rows = rows.join(known.select(F.col("a").alias("pk"), F.lit(True).alias("pred_known")), "pk", "left").join(known.select(F.col("a").alias("gk"), F.lit(True).alias("gold_known")), "gk", "left")
    p, g = F.col("predicted_label"), F.col("gold")
    both = F.coalesce(F.col("pred_known") & F.col("gold_known"), F.lit(False))
    some = lambda c: F.when(g.isNotNull(), c)
    return rows.select("case_id", "mode", "abstained", some(exact_match(p, g)).alias("exact"), some(family_match(p, g)).alias("family"), some(hierarchy_match(p, g, F.col("distance"), both)).alias("hierarchy"), citation_validity(F.col("citations"), F.col("valid_evidence_ids")).alias("citations_valid"))


def judge(predictions: DataFrame, relatives: DataFrame) -> DataFrame:
    """Add ``decision``, ``passed``: no prediction, identity, controlled family, or open for a model to judge.

    ``relatives``: label keys a, b that share an ancestor; an open case has null ``passed``.
    """
    rows = predictions.withColumns({"pk": T.unicode_key(F.col("predicted_label")), "gk": T.unicode_key(F.col("gold_label"))})
    kin = relatives.select(F.col("a").alias("pk"), F.col("b").alias("gk"), F.lit(True).alias("kin")).distinct()
    rows = rows.join(kin, ["pk", "gk"], "left")
    decision = F.when(F.col("abstained"), "abstained").when(F.col("pk") == "", "no_prediction").when(F.col("pk") == F.col("gk"), "identity").when(F.col("kin"), "controlled_family").otherwise("open")
    rows = rows.withColumn("decision", decision)
    return rows.withColumn("passed", F.when(F.col("decision").isin("identity", "controlled_family"), True).when(F.col("decision") != "open", False)).drop("pk", "gk", "kin")


def incumbents(pairs: DataFrame) -> DataFrame:
    """Each case's candidate of the single highest score, if only one has it and it cites evidence."""
    best = Window.partitionBy("case_id")
    top = pairs.filter("cited").withColumn("top", F.max("score").over(best)).filter("score = top")
    return top.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("candidate_id")).filter("n = 1").drop("n")


def cost_shares(calls: DataFrame, by: list[str], weight: str, total: float) -> DataFrame:
    """``total`` dealt to the groups by their share of ``weight``."""
    g = calls.groupBy(*by).agg(F.sum(weight).alias("calls"))
    share = F.col("calls") / F.sum("calls").over(Window.partitionBy())
    return g.withColumn("share", share).withColumn("cost", share * total)


def gates(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row a gate: ``gate, passed``; a null check fails.  ``row`` is a single row of aggregates."""
    each = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return row.select(F.inline(each))


def refuse_forbidden(payload: Column, keys: tuple[str, ...] = FORBIDDEN) -> Column:
    """The payload, or an error when the rows are read if it has a key that must not leave evaluation."""
    return F.when(~T.has_json_key(payload, keys), payload).otherwise(F.raise_error(F.lit("evaluation-only fields cannot enter a retrieval query")).cast("string"))
