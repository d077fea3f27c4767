"""Clinical atoms and whether a finding satisfies a criterion: the best clause and six critical questions.

An atom holds all that a decision needs of one side, so a finding or criterion is read once however
many pairs it is in.  Atoms are plain structs; a decision is an expression over two of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import binding as B
from marlstone.functions.clinical import binding_tokens
from marlstone.functions.text import let

# Words of elevation, and patterns of a starred value, of ST changes and of diagnostic tests.
ELEVATION = ("above", "elevated", "exceeded", "high", "increase", "increased")
STARRED = r"(?i)([A-Za-z][A-Za-z0-9/-]{1,30})\s*[-:=]\s*[<>]?\s*(\d+(?:\.\d+)?)\*"
NO_ST_ELEVATION = r"(?i)\b(?:non[-\s]?st[-\s]?elevation|no\s+st[-\s]?elevation)\b"
ST_DEPRESSION = r"(?i)(?:\bst(?:[-\s]+segment)?[-\s]+depression\b|\b(?:horizontal|downsloping|upsloping|concordant)\s+std\b|\bstd\s+(?:in\s+)?(?:lead\s+)?v\d\b)"
DIAGNOSTIC_TEST = r"(?i)\b(?:ct(?:pa)?|mri|mra|x[- ]?ray|radiograph|ultrasound|echo(?:cardiogram)?|angiograph(?:y|ram)|endoscop(?:y|ic)|egd|colonoscopy|biopsy|pathology|culture|pcr|scan|imaging|spirometr(?:y|ic)|pulmonary function test|pft|stress test|monitoring|tracing)\b"
COMPARED = r"(?i)\b(?:since|compared\s+(?:with|to))\s+(?:the\s+)?(?:previous|prior)\s+(?:tracing|study|exam(?:ination)?|scan|test)\b"
POLARITY_ONLY = ("absent", "absence", "denied", "denies", "negative", "normal", "unremarkable", "without")
CLAUSE = r"(?<=[.!?])\s+|[;\r\n]+"
ROLES = ("diagnostic_criterion", "clinical_feature", "risk_factor", "guideline")

QUESTIONS = ("observation_present", "concept_compatible", "criterion_satisfied", "temporality_compatible", "quantity_compatible", "scheme_role_compatible")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def temporality(text: Column) -> Column:
    """Current wins, also where the text compares with a prior study; then historical; else unspecified."""
    return F.when(F.regexp_like(text, F.lit(COMPARED)), "current").otherwise(B.temporality(text))


def rising(text: Column, tokens: Column) -> Column:
    """Names of starred values that are among the ``tokens``, occur twice or more, and end higher than they start."""
    names, values = (F.regexp_extract_all(text, F.lit(STARRED), F.lit(k)) for k in (1, 2))
    read = F.zip_with(names, values, lambda n, v: let(binding_tokens(n), lambda w: F.struct(F.when(F.size(w) == 1, F.get(w, F.lit(0))).alias("name"), v.cast("double").alias("value"))))

    def climbs(series: Column, name: Column) -> Column:
        own = F.filter(series, lambda x: x["name"] == name)
        return (F.size(own) > 1) & (F.try_element_at(own, F.lit(-1))["value"] > F.try_element_at(own, F.lit(1))["value"])

    names_of = let(read, lambda series: F.filter(F.array_distinct(F.transform(series, lambda x: x["name"])), lambda n: n.isNotNull() & F.array_contains(tokens, n) & climbs(series, n)))
    return F.when(F.contains(text, F.lit("*")), names_of).otherwise(F.array().cast("array<string>"))


def atom(text: Column, concepts: Column | None = None) -> Column:
    """What one side of a binding says: tokens, neighbouring pairs of them, polarity, time, quantities and special signs.

    ``concepts`` are the ids of the concepts that the text names, if a terminology is at hand.  A null text is empty.
    """
    raw, known = F.coalesce(text, F.lit("")), F.array().cast("array<string>") if concepts is None else F.coalesce(concepts, F.array().cast("array<string>"))

    def read(words: Column, one_line: Column) -> Column:
        starts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        pairs = F.array_distinct(F.transform(starts, lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1))))
        return F.struct(
            one_line.alias("text"),
            F.array_distinct(words).alias("tokens"),
            pairs.alias("pairs"),
            known.alias("concepts"),
            B.polarity(raw).alias("polarity"),
            temporality(raw).alias("temporality"),
            B.stated_quantities(raw).alias("quantities"),
            B.ranges(one_line).alias("ranges"),
            rising(one_line, words).alias("rising"),
            (F.arrays_overlap(words, _words(*ELEVATION)) & (F.size(F.array_distinct(words)) <= 8)).alias("elevates"),
            F.regexp_like(one_line, F.lit(NO_ST_ELEVATION)).alias("no_st_elevation"),
            F.regexp_like(one_line, F.lit(ST_DEPRESSION)).alias("st_depression"),
            F.regexp_like(one_line, F.lit(DIAGNOSTIC_TEST)).alias("names_test"),
            B.completed_result(one_line).alias("completed"),
        )

    return let(flat(raw), lambda one_line: let(binding_tokens(raw), lambda words: read(words, one_line)))


def clauses(text: Column) -> Column:
    """The clauses of a criterion, on one line each; the whole text if it has none."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE), flat), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce(text, F.lit(""))))


def clause_atoms(text: Column) -> Column:
    """The atoms of a criterion's clauses."""
    return F.transform(clauses(text), lambda c: atom(c))


def coverage(finding: Column, clause: Column) -> Column:
    """The share of a clause's tokens that a finding has."""
    return F.size(F.array_intersect(finding["tokens"], clause["tokens"])) / F.greatest(F.size(clause["tokens"]), F.lit(1))


def closeness(finding: Column, clause: Column) -> Column:
    """How much of a clause a finding covers: the share of its tokens, or 1 if concepts or ST changes stand for them."""
    # one concept may stand for another's name, but not for a long rule
    named = (F.size(clause["concepts"]) > 0) & (F.size(clause["tokens"]) <= 4) & (F.size(clause["quantities"]) == 0) & (F.size(F.array_except(clause["concepts"], finding["concepts"])) == 0)
    return F.when(named | (clause["no_st_elevation"] & finding["st_depression"]), F.lit(1.0)).otherwise(coverage(finding, clause))


def judge(finding: Column, clause: Column, role: Column, score: Column) -> Column:
    """struct(semantic, covered): whether a clause's subject and claim are met by a finding of this ``closeness``."""

    def decide(shared: Column) -> Column:
        lexical = F.size(shared) / F.greatest(F.size(clause["tokens"]), F.lit(1))
        concept = F.arrays_overlap(finding["concepts"], clause["concepts"])
        specific = F.exists(shared, lambda t: F.regexp_like(t, F.lit("[-/0-9]")))
        compares = lambda a: F.exists(a["quantities"], lambda q: q["op"] != "=")
        numeric = (F.size(clause["quantities"]) > 0) & (compares(clause) | compares(finding))
        climbs = clause["elevates"] & F.arrays_overlap(finding["rising"], clause["tokens"])
        st = clause["no_st_elevation"] & finding["st_depression"]
        done = finding["names_test"] & finding["completed"] & (finding["polarity"] == "present") & (finding["temporality"] != "historical")
        absent = (finding["polarity"] == "absent") & (clause["polarity"] == "absent") & (score >= 0.4) & (F.size(F.array_except(shared, _words(*POLARITY_ONLY))) > 0)

        def told(phrase: Column) -> Column:
            tested = (role == "diagnostic_criterion") & done & clause["names_test"] & (concept | phrase | (lexical >= 0.4))
            met = absent | climbs | st | tested
            return F.struct(((score >= 0.6) | concept | phrase | specific | met).alias("semantic"), ((score >= 0.6) | (numeric & phrase) | met).alias("covered"))

        return let(F.arrays_overlap(finding["pairs"], clause["pairs"]), told)

    return let(F.array_intersect(finding["tokens"], clause["tokens"]), decide)


def quantities_fit(finding: Column, clause: Column) -> Column:
    """An exact value of the finding lies in a range of the clause; without ranges a threshold of it is met, if it has one."""
    inside = F.exists(clause["ranges"], lambda r: F.exists(finding["quantities"], lambda q: (q["op"] == "=") & ((r["unit"] == "") | (q["unit"] == r["unit"])) & q["value"].between(r["low"], r["high"])))
    return F.when(F.size(clause["ranges"]) > 0, inside).otherwise(B.quantity_compatible(finding["quantities"], clause["quantities"]))


def assess(finding: Column, criterion: Column, role: Column, least: float | None = None) -> Column:
    """A finding's atom against a criterion's clause atoms: struct(admissible, score, clause, matched_clause, questions).

    The clause of the highest score is judged, the first of equals.  ``clause`` is its place from 0; each of the six
    ``questions`` has its name, whether it passed, and a detail.  A pair is admissible if all pass.  With ``least`` the
    result is null where the score is below it and the pair cannot be admissible.
    """
    each = F.transform(criterion, lambda c, i: F.struct(closeness(finding, c).alias("score"), (-i).alias("before")))

    def decide(best: Column) -> Column:
        place = -best["before"]

        def answer(clause: Column) -> Column:
            def told(j: Column) -> Column:
                covered = j["covered"] | ((role == "risk_factor") & (best["score"] >= 0.4))
                passed = {
                    "observation_present": (finding["polarity"] == clause["polarity"], finding["polarity"]),
                    "concept_compatible": (j["semantic"], F.lit("shared concept, phrase or specific token")),
                    "criterion_satisfied": (covered, F.format_string("coverage of the clause %.3f", best["score"])),
                    "temporality_compatible": (~((role == "diagnostic_criterion") & (finding["temporality"] == "historical")), finding["temporality"]),
                    "quantity_compatible": (quantities_fit(finding, clause), F.lit("operator, unit and value")),
                    "scheme_role_compatible": (F.coalesce(role.isin(*ROLES), F.lit(False)), F.coalesce(role, F.lit(""))),
                }
                asked = F.array(*[F.struct(F.lit(q).alias("question"), passed[q][0].alias("passed"), passed[q][1].alias("detail")) for q in QUESTIONS])
                whole = let(asked, lambda t: F.struct(F.forall(t, lambda x: x["passed"]).alias("admissible"), F.round(best["score"], 6).alias("score"), place.alias("clause"), clause["text"].alias("matched_clause"), t.alias("questions")))
                return whole if least is None else F.when(near | (j["semantic"] & covered), whole)

            near = F.lit(True) if least is None else F.round(best["score"], 6) >= least
            # a low score alone rules out all but quantities, tests and rising values
            hopeful = near | (best["score"] >= 0.4) | (F.size(clause["quantities"]) > 0) | clause["names_test"] | clause["elevates"]
            return let(F.when(hopeful, judge(finding, clause, role, best["score"])), told)

        return let(F.get(criterion, place), answer)

    return let(F.array_max(each), decide)


def passed(assessment: Column, question: str) -> Column:
    """Whether one of the six questions passed."""
    return F.exists(assessment["questions"], lambda q: (q["question"] == question) & q["passed"])
