"""Typed binding of a patient's finding to a criterion: authority, family tests, asserted diagnoses, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import atoms as A
from marlstone.functions.atoms import POLARITY_ONLY
from marlstone.functions.clinical import binding_tokens
from marlstone.functions.text import morphologically_compatible

# Tests by their names, words that assert a diagnosis, and the ends of a patient's clauses.
TEST_MODALITIES = (
    ("ctpa", r"\b(?:ctpa|ct pulmonary angiograph(?:y|ram))\b"),
    ("cta", r"\b(?:cta|ct angiograph(?:y|ram))\b"),
    ("mra", r"\b(?:mra|mr angiograph(?:y|ram))\b"),
    ("angiography", r"\bangiograph(?:y|ram)\b"),
    ("endoscopy", r"\b(?:endoscop(?:y|ic)|egd)\b"),
    ("ct", r"\bct(?: scan| imaging)?\b"),
    ("mri", r"\bmri?\b"),
    ("radiograph", r"\b(?:x[- ]?ray|radiograph)\b"),
    ("ultrasound", r"\b(?:ultrasound|sonograph(?:y|ic))\b"),
    ("echocardiography", r"\b(?:echo|echocardiogram|echocardiography)\b"),
    ("spirometry", r"\b(?:spirometr(?:y|ic)|pulmonary function test|pft)\b"),
    ("pathology", r"\b(?:biopsy|pathology|histology)\b"),
    ("culture", r"\bculture\b"),
    ("pcr", r"\bpcr\b"),
    ("stress_test", r"\b(?:stress test|ett)\b"),
    ("ecg", r"\b(?:ecg|ekg|electrocardiogra(?:m|phy)|tracing)\b"),
)
ASSERTION = r"(?i)\b(?:diagnos(?:ed|is)|has|have|with|confirmed|present|current|acute)\b"
PATIENT_CLAUSE = r"(?<=[.!?])\s+|[;:\r\n]+"
ABNORMAL_LAB = r"(?i)([A-Za-z][A-Za-z0-9/-]{1,30})\s*[-:=]\s*[<>]?\s*\d+(?:\.\d+)?\*"


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def test_modalities(text: Column) -> Column:
    """Names of all tests the text mentions, in the table's order."""
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(f"(?i){p}")), F.lit(n)) for n, p in TEST_MODALITIES]))


def _subject(tokens: Column) -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, POLARITY_ONLY)))


def assess(finding: Column, criterion: Column, role: Column) -> Column:
    """A finding's text against a criterion's text: see ``atoms.assess``."""
    return A.let(A.atom(finding), lambda f: A.let(A.clause_atoms(criterion), lambda c: A.assess(f, c, role)))


def authority_of(finding: Column, criterion: Column, candidate: Column, role: Column, told: Column | None = None) -> Column:
    """What decides a pair of atoms without review: an executed measurement, an asserted test result, a stated absence or a named current diagnosis; else ``semantic_review``.

    ``criterion`` has the clause atoms; the best clause decides.  ``candidate`` is the diagnosis as an atom, ``told`` what
    ``atoms.assess`` said of the pair, if it is known.
    """

    def decide(told: Column) -> Column:
        def of(clause: Column) -> Column:
            shared = F.size(F.array_intersect(_subject(finding["tokens"]), _subject(clause["tokens"]))) > 0
            measured = (F.size(clause["quantities"]) > 0) & (F.size(finding["quantities"]) > 0) & shared
            own, wanted = test_modalities(finding["text"]), test_modalities(clause["text"])
            now = (finding["polarity"] == "present") & (finding["temporality"] != "historical")
            shown = (F.size(own) > 0) & (own == wanted) & now & finding["completed"] & shared
            named = (F.size(candidate["tokens"]) > 0) & (F.size(F.array_except(candidate["tokens"], finding["tokens"])) == 0)
            review = F.lit("semantic_review")
            return (
                F.when(~(told["admissible"] & (role == "diagnostic_criterion")), review)
                .when(measured, "exact_measurement")
                .when((F.size(own) > 0) | (F.size(wanted) > 0), F.when(shown, "exact_positive_test").otherwise(review))
                .when((finding["polarity"] == "absent") & (clause["polarity"] == "absent") & shared, "explicit_negation")
                .when(named & F.regexp_like(finding["text"], F.lit(ASSERTION)) & now, "explicit_current_diagnosis")
                .otherwise(review)
            )

        return A.let(F.get(criterion, told["clause"]), of)

    return A.let(A.assess(finding, criterion, role) if told is None else told, decide)


def authority(finding: Column, criterion: Column, candidate: Column, role: Column) -> Column:
    """``authority_of`` the texts."""
    return A.let(A.atom(finding), lambda f: A.let(A.clause_atoms(criterion), lambda c: authority_of(f, c, A.atom(candidate), role)))


def family_test_of(finding: Column, family: Column) -> Column:
    """struct(admissible, score) of atoms: a completed, current, positive test that names a family by concept or by three in four of its words; good for the family only."""
    matched = F.filter(family["tokens"], lambda w: F.exists(finding["tokens"], lambda t: morphologically_compatible(w, t)))
    part = F.size(matched) / F.greatest(F.size(family["tokens"]), F.lit(1))
    now = (finding["polarity"] == "present") & (finding["temporality"] != "historical")
    ok = now & (F.arrays_overlap(finding["concepts"], family["concepts"]) | (part >= 0.75)) & finding["names_test"] & finding["completed"]
    return F.struct(ok.alias("admissible"), F.when(ok, 1.0).otherwise(F.round(part, 6)).alias("score"))


def family_test(finding: Column, family: Column) -> Column:
    """``family_test_of`` the texts."""
    return A.let(A.atom(finding), lambda f: A.let(A.atom(family), lambda g: family_test_of(f, g)))


def asserts_diagnosis_of(finding: Column, criterion: Column, diagnosis: Column) -> Column:
    """Three atoms state one proposition: each two neighbours share a concept, or one's words hold the other's."""

    def same(a: Column, b: Column) -> Column:
        x, y = _subject(a["tokens"]), _subject(b["tokens"])
        inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
        return F.arrays_overlap(a["concepts"], b["concepts"]) | ((F.size(x) > 0) & (F.size(y) > 0) & inside)

    now = (finding["polarity"] == "present") & (criterion["polarity"] == "present") & (finding["temporality"] != "historical")
    return now & same(finding, criterion) & same(criterion, diagnosis)


def asserts_diagnosis(finding: Column, criterion: Column, diagnosis: Column) -> Column:
    """``asserts_diagnosis_of`` the texts."""
    return A.let(A.atom(finding), lambda f: A.let(A.atom(criterion), lambda c: A.let(A.atom(diagnosis), lambda d: asserts_diagnosis_of(f, c, d))))


def atomic_criteria(text: Column) -> Column:
    """The clauses of a criterion, flattened; the whole text if it has none."""
    return A.clauses(text)


def patient_spans(text: Column) -> Column:
    """Clauses of eight characters or more, then for each laboratory value starred twice or more all from its first to its last mention."""
    t = F.coalesce(text, F.lit(""))
    clauses = F.filter(F.transform(F.split(t, PATIENT_CLAUSE), _flat), lambda x: F.length(x) >= 8)
    found, names = (F.regexp_extract_all(t, F.lit(ABNORMAL_LAB), F.lit(k)) for k in (0, 1))
    between = F.split(t, ABNORMAL_LAB)  # with the lengths of the matches these give every match's place
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))

    def place(name: Column, i: Column) -> Column:
        start, words = length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(found, F.lit(1), i)), binding_tokens(name)
        return F.struct(F.when(F.size(words) == 1, F.get(words, F.lit(0))).alias("name"), start.alias("start"), (start + F.length(F.get(found, i))).alias("end"))

    at = F.filter(F.transform(names, place), lambda m: m["name"].isNotNull())

    def span(name: Column) -> Column:
        own = F.filter(at, lambda m: m["name"] == name)
        first, last = F.element_at(own, 1)["start"], F.element_at(own, -1)["end"]
        return F.when(F.size(own) >= 2, _flat(F.substring(t, first + 1, last - first)))

    series = F.filter(F.transform(F.array_distinct(F.transform(at, lambda m: m["name"])), span), lambda s: F.length(s).between(8, 2000))
    starred = F.when(F.contains(t, F.lit("*")), series).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(clauses, starred))


def contains_extract(source: Column, extract: Column) -> Column:
    """Whether the source has the extract, of eight characters or more, whatever the case and blanks."""
    e = F.lower(_flat(F.coalesce(extract, F.lit(""))))
    return (F.length(e) >= 8) & F.contains(F.lower(_flat(F.coalesce(source, F.lit("")))), e)


def either_contains(a: Column, b: Column) -> Column:
    """One of two labels, in lower case, lies within the other."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def evidence_basis(ids: Column) -> Column:
    """Which kinds of evidence the ids name."""
    kind = lambda p, n: F.when(F.exists(ids, lambda x: F.startswith(F.coalesce(x, F.lit("")), F.lit(p))), F.lit(n))
    return F.array_compact(F.array(kind("S-", "patient evidence"), kind("K", "controlled-corpus evidence")))


def error_category(error: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    binding = F.contains(e, F.lit("citation")) | F.contains(e, F.lit("provenance")) | F.contains(e, F.lit("evidence"))
    return F.when(e == "", "").when(F.contains(e, F.lit("duplicate diagnosis")), "invalid duplicate candidate assessment").when(F.contains(e, F.lit("json")), "invalid structured response").when(binding, "invalid evidence binding").otherwise("technical stage failure")


def abstention_category(abstained: Column, error: Column, selected: Column, action: Column) -> Column:
    none = F.coalesce(selected, F.lit("")) == ""
    refused = F.coalesce(action, F.lit("")).isin("abstain", "differential_abstain", "insufficient_abstain")
    return F.when(~abstained, "not_abstained").when(F.coalesce(error, F.lit("")) != "", "execution_failure").when(none & refused, "insufficient_evidence").otherwise("other_abstention")


def namespace(ident: Column) -> Column:
    """What an identifier names, by its prefix."""
    starts = lambda p: F.startswith(ident, F.lit(p))
    return F.when(starts("S-"), "patient").when(starts("K"), "knowledge").when(starts("P-"), "pair").otherwise("other")


def is_source_id(value: Column) -> Column:
    return F.regexp_like(F.coalesce(value, F.lit("")), F.lit("^source-chunk:[0-9a-f]{20}\\z"))


def is_candidate_id(value: Column) -> Column:
    return F.regexp_like(F.coalesce(value, F.lit("")), F.lit("^candidate:[0-9a-f]{20}\\z"))
