"""Findings bound to criteria: candidates by shared keys, decisions on atoms, ranked options, tiers of citations.

A pair can only be admissible if it shares enough of a clause's tokens, a phrase, a concept or a special sign.
Each clause therefore gives its rarest tokens, so many that any sufficient share has one of them,
with its signs and, where they can decide, phrases; findings give all of theirs.  Pairs meet on these keys and never as a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import atoms as A
from marlstone.functions.clinical import candidate_terms
from marlstone.functions.text import term_key
from marlstone.sources.scratch import written

#: The least share of a clause's tokens that makes a match: that of a risk factor, an absence or a test.
LEAST = 0.4
#: Words and phrases of all criteria up to which these go to every task.
KEYS_SENT = 100_000
#: Roles by the order in which they win.
ROLE_ORDER = ("risk_factor", "guideline", "clinical_feature", "diagnostic_criterion")


def concept_terms(text: Column) -> Column:
    """Keys under which a terminology may know what a text names: candidate terms, words in capitals, and runs of two to four words."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9][A-Za-z0-9/-]*"), F.lit(0))
    capitals = F.filter(words, lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & F.regexp_like(w, F.lit("[A-Za-z]")))

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.transform(F.concat(candidate_terms(text, 16), capitals, *[runs(n) for n in (2, 3, 4)]), term_key))


def named_concepts(rows: DataFrame, keys: Sequence[str], text: str, terms: DataFrame) -> DataFrame:
    """``keys, concepts``: ids of the concepts a text names, for rows that name one; ``terms`` has ``key, concept``, one concept a key."""
    asked = rows.select(*keys, F.explode(concept_terms(F.col(text))).alias("key"))
    return asked.join(terms.select("key", "concept"), "key").groupBy(*keys).agg(F.sort_array(F.collect_set("concept")).alias("concepts"))


def findings(rows: DataFrame, keys: Sequence[str], text: str, terms: DataFrame | None = None) -> DataFrame:
    """``keys, finding``: each finding's atom, with concepts if a terminology is given.  ``keys`` name a finding."""
    plain = rows.select(*keys, F.col(text).alias("__t"))
    if terms is None:
        return plain.select(*keys, A.atom(F.col("__t")).alias("finding"))
    known = plain.join(named_concepts(plain, keys, "__t", terms), list(keys), "left")
    return known.select(*keys, A.atom(F.col("__t"), F.col("concepts")).alias("finding"))


def criteria(rows: DataFrame, keys: Sequence[str], text: str, role: str, terms: DataFrame | None = None) -> DataFrame:
    """``keys, role, criterion``: the atoms of each criterion's clauses, in order.  ``keys`` name a criterion."""
    plain = rows.select(*keys, F.col(role).alias("role"), F.col(text).alias("__t"))
    if terms is None:
        return plain.select(*keys, "role", A.clause_atoms(F.col("__t")).alias("criterion"))
    parts = plain.select(*keys, F.posexplode(A.clauses(F.col("__t"))).alias("__i", "__c"))
    known = parts.join(named_concepts(parts, [*keys, "__i"], "__c", terms), [*keys, "__i"], "left")
    whole = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "__c", "concepts"))).alias("__p"))
    made = F.transform("__p", lambda p: A.atom(p["__c"], p["concepts"]))
    return plain.drop("__t").join(whole.select(*keys, made.alias("criterion")), list(keys))


def _kind(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.xxhash64(F.lit(name), v))


def _concepts(atom: Column) -> Column:
    return _kind("c", atom["concepts"])


def _when(condition: Column, keys: Column) -> Column:
    return F.when(condition, keys).otherwise(F.array().cast("array<bigint>"))


def _st(atom_has: Column) -> Column:
    return _when(atom_has, F.array(F.xxhash64(F.lit("st"))))


def finding_keys(finding: Column) -> Column:
    """All keys under which a finding may meet a clause, as 64-bit hashes; two alike by chance make one more pair to assess."""
    own = F.concat(_kind("t", finding["tokens"]), _kind("p", finding["pairs"]), _concepts(finding), _kind("r", finding["rising"]), _st(finding["st_depression"]))
    return F.array_distinct(own)


def clause_keys(found: DataFrame, wanted: DataFrame, c_key: str, within: Sequence[str] = (), few: bool = False) -> DataFrame:
    """``within, c_key, key``: the keys of each criterion, one of which every finding has that may be admissible.

    How rare a token is, is counted over all findings; only tokens that some clause has are counted, and if these are ``few``
    no other leaves the place where it lies.  A phrase alone decides only on clauses with quantities or tests.
    """
    parts = wanted.select(*within, c_key, F.posexplode("criterion").alias("__i", "clause"))
    each = parts.select(*within, c_key, "__i", F.size("clause.tokens").alias("n"), F.explode("clause.tokens").alias("token"))
    asked = each.select("token").distinct()
    often = found.select(F.explode("finding.tokens").alias("token")).join(F.broadcast(asked) if few else asked, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    words = each.join(often, "token")
    rare = Window.partitionBy(*within, c_key, "__i").orderBy("often", "token")
    # a token that no finding has cannot be shared, but counts among those that are left out
    missing = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy(*within, c_key, "__i"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(LEAST) - 1e-9) + 1 - missing
    tokens = words.withColumn("keep", keep).withColumn("place", F.row_number().over(rare)).filter("place <= keep").select(*within, c_key, F.xxhash64(F.lit("t"), "token").alias("key"))
    phrases = _when((F.size("clause.quantities") > 0) | F.col("clause.names_test"), _kind("p", F.col("clause.pairs")))
    signs = F.concat(phrases, _concepts(F.col("clause")), _when(F.col("clause.elevates"), _kind("r", F.col("clause.tokens"))), _st(F.col("clause.no_st_elevation")))
    return tokens.union(parts.select(*within, c_key, F.explode(signs).alias("key"))).distinct()


def candidate_pairs(found: DataFrame, wanted: DataFrame, f_key: str, c_key: str, within: Sequence[str] = ()) -> DataFrame:
    """``within, f_key, c_key`` of every pair that may be admissible, from ``findings`` and ``criteria``; only pairs of equal ``within`` meet."""
    have = found.select(*within, f_key, F.explode(finding_keys(F.col("finding"))).alias("key"))
    return have.join(clause_keys(found, wanted, c_key, within), [*within, "key"]).select(*within, f_key, c_key).distinct()


def _met_in_place(found: DataFrame, wanted: DataFrame, c_key: str, within: Sequence[str]) -> DataFrame:
    """The columns of both sides for every candidate pair, each found where its finding lies: nothing of a finding is shuffled.

    A pair is made by the first of its finding's keys that the criterion has, so it is made once.
    """
    keys = written(clause_keys(found, wanted, c_key, within, few=True))
    asked = wanted.join(F.broadcast(keys.groupBy(*within, c_key).agg(F.collect_list("key").alias("__asked"))), [*within, c_key])
    have = found.withColumn("__have", finding_keys(F.col("finding"))).withColumn("key", F.explode("__have"))
    met = have.join(F.broadcast(keys), [*within, "key"]).join(F.broadcast(asked), [*within, c_key])
    return met.filter(F.get(F.array_intersect("__have", "__asked"), F.lit(0)) == F.col("key")).drop("key", "__have", "__asked")


def _few(wanted: DataFrame) -> bool:
    """Whether the criteria have so few words that each task may hold them all."""
    words = wanted.select(F.explode("criterion").alias("c")).agg(F.sum(F.size("c.tokens") + F.size("c.pairs") + F.size("c.concepts"))).first()[0]
    return (words or 0) <= KEYS_SENT


def bind(found: DataFrame, wanted: DataFrame, f_key: str, c_key: str, within: Sequence[str] = (), pairs: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """``within, f_key, c_key, role, admissible, score, clause, matched_clause, questions`` of every candidate pair, or of the given ``pairs``."""
    return assessed(found, wanted, f_key, c_key, within, pairs, least).drop("finding", "criterion")


def assessed(found: DataFrame, wanted: DataFrame, f_key: str, c_key: str, within: Sequence[str] = (), pairs: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """The rows of ``bind`` with both sides' atoms, ``finding`` and ``criterion``; with ``least`` only pairs of such a score or admissible ones.

    ``found`` and ``wanted`` are read more than once: give them written, or their texts are read as often.  Few criteria go to
    where the findings lie; with many, or given ``pairs``, keys are shuffled and both sides joined to the pairs.
    """
    if pairs is None and _few(wanted):
        both = _met_in_place(found, wanted, c_key, within)
    else:
        met = candidate_pairs(found, wanted, f_key, c_key, within) if pairs is None else pairs
        both = met.join(found, [*within, f_key]).join(wanted, [*within, c_key])
    # as rows of a generator: a filter on the verdict would else be moved below it and assess each pair anew for every column it names
    verdict = F.array_compact(F.array(A.assess(F.col("finding"), F.col("criterion"), F.col("role"), least)))
    told = both.select(*within, f_key, c_key, "role", "finding", "criterion", F.inline(verdict))
    return told if least is None else told.filter((F.col("score") >= least) | F.col("admissible"))


def ranked_options(bound: DataFrame, within: Sequence[str], f_key: str, c_key: str, node: str, most: int = 8) -> DataFrame:
    """The first ``most`` bound pairs of each group with their ``place``: admissible, of a fitting concept, high score, strong role, then ids.

    The best pair of each node comes first, then the rest in the same order.
    """
    fits = F.exists("questions", lambda q: (q["question"] == "concept_compatible") & q["passed"])
    weight = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    order = [F.col("admissible").desc(), F.col("__fits").desc(), F.col("score").desc(), weight.desc(), F.col(f_key), F.col(c_key)]
    name = F.when(F.coalesce(F.col(node), F.lit("")) != "", F.concat(F.lit("n:"), node)).otherwise(F.concat(F.lit("k:"), F.col(c_key).cast("string")))
    first = bound.withColumn("__node", name).withColumn("__fits", fits).withColumn("__n", F.row_number().over(Window.partitionBy(*within, "__node").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("__n") > 1, *order))
    # a pair has at least all better ones of its node before it, so those beyond ``most`` need not be shuffled
    return first.filter(F.col("__n") <= most).withColumn("place", place).filter(F.col("place") <= most).drop("__node", "__n", "__fits")


def shortlist(bound: DataFrame, within: Sequence[str], family: str, fact: str, node: str, most: int = 3) -> DataFrame:
    """For each family of a group the ``most`` facts that bind best: ``within, family, fact, admissible, score, place``.

    A fact counts by its best pair; facts of which any best clause states an absence are left out.  A family's nodes come first
    with one fact each, then the rest by admissibility, score and id.  ``bound`` has the columns of ``bind`` and ``family, node``,
    and ``absence``: whether the matched clause states one.
    """
    each = bound.groupBy(*within, family, fact, node).agg(F.bool_or("admissible").alias("admissible"), F.max("score").alias("score"), F.bool_or("absence").alias("__a"))
    order = [F.col("admissible").desc(), F.col("score").desc(), F.col(fact)]
    first = each.filter(~F.col("__a")).withColumn("__n", F.row_number().over(Window.partitionBy(*within, family, node).orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*within, family).orderBy(F.col("__n") > 1, *order))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(*within, family, fact, "admissible", "score", "place")


def cited_pairs(pairs: DataFrame, citations: DataFrame, within: Sequence[str], claim: str, f_key: str, c_key: str) -> DataFrame:
    """Pairs that each claim cites, with their ``tier``: 1 if both ids are cited; 2, if only the criterion's is, for claims without a pair of tier 1.

    ``citations`` has ``within, claim, evidence_id``.  The second tier takes only claims that the first left without one, as a flag over the
    pairs of a claim tells; the pairs are joined once.
    """
    cited = citations.select(*within, claim, "evidence_id").distinct()
    by_criterion = pairs.join(cited.withColumnRenamed("evidence_id", c_key), [*within, c_key])
    marked = by_criterion.join(cited.withColumnRenamed("evidence_id", f_key).withColumn("__both", F.lit(True)), [*within, claim, f_key], "left")
    strict = F.bool_or(F.coalesce("__both", F.lit(False))).over(Window.partitionBy(*within, claim))
    kept = marked.withColumn("__strict", strict).filter(F.col("__both") | ~F.col("__strict"))
    return kept.withColumn("tier", F.when(F.col("__strict"), 1).otherwise(2)).drop("__both", "__strict")
