"""Readings of clinical prose: binding tokens, candidate terms, modalities, anchors, thresholds, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import holds, label_key, let, tokens

# Words left out of binding tokens.
BINDING_STOPWORDS = (
    "about", "after", "also", "and", "any", "are", "been", "before", "but", "can", "clinical", "could", "criterion", "criteria", "day", "days",
    "diagnosis", "diagnostic", "feature", "finding", "findings", "for", "from", "had", "has", "have", "his", "into", "more", "most", "level", "levels",
    "over", "patient", "present", "result", "results", "sign", "signs", "state", "symptom", "symptoms", "test", "tests", "than", "that", "the", "their",
    "there", "this", "was", "were", "who", "with",
)
TROPONIN = ("ctn", "ctnt", "ctropnt", "hsctn", "hsctnt", "tropt", "troponint")

# What makes a run of words a candidate term.
TERM_STOPWORDS = (
    "the", "and", "with", "from", "that", "this", "these", "those", "into", "onto", "over", "under", "between", "within", "without", "for", "of", "to", "in",
    "on", "at", "by", "as", "is", "are", "was", "were", "be", "been", "being", "a", "an", "or", "it", "its", "if", "then", "when", "while", "may", "might",
    "can", "could", "should", "would", "patient", "patients", "clinical", "medical", "history", "case", "report",
)
TERM_SUFFIXES = ("itis", "emia", "osis", "opathy", "algia", "uria", "ectomy", "plasty", "graphy", "scopy", "meter", "gram", "ology", "ase")
TERM_CUES = (
    "disease", "disorder", "syndrome", "symptom", "sign", "diagnosis", "lab", "laboratory", "test", "result", "finding", "risk", "renal", "cardiac",
    "pulmonary", "infection", "hypertension", "diabetes", "failure", "dysfunction",
)
TERM_EDGES = ("patient", "patients", "has", "have", "had", "is", "are", "was", "were", "be", "been", "being", "with", "without", "treated", "treat")

# Names of diagnostic modalities; the first that matches counts in ``modality``.
MODALITIES = (
    ("ventilation-perfusion-scan", r"\b(?:v\s*/\s*q|ventilation[- ]perfusion)(?:\s+lung)?\s+scan\b"),
    ("ct-angiography", r"\b(?:ctpa|cta|ct\s+angiograph\w*|computed\s+tomography\s+angiograph\w*)\b"),
    ("computed-tomography", r"\b(?:ct(?:\s+scan)?|computed\s+tomography)\b"),
    ("magnetic-resonance", r"\b(?:mri|magnetic\s+resonance\s+imag\w*)\b"),
    ("echocardiography", r"\b(?:echocardiogra\w*|echo)\b"),
    ("ultrasound", r"\b(?:ultrasound|ultrasonogra\w*)\b"),
    ("angiography", r"\bangiogra\w*\b"),
    ("endoscopy", r"\bendoscop\w*\b"),
    ("gastroscopy", r"\bgastroscop\w*\b"),
    ("colonoscopy", r"\bcolonoscop\w*\b"),
    ("biopsy", r"\bbiops\w*\b"),
    ("microscopy", r"\bmicroscop\w*\b"),
    ("pcr", r"\b(?:pcr|polymerase\s+chain\s+reaction)\b"),
    ("culture", r"\bcultur\w*\b"),
    ("radiograph", r"\b(?:x[- ]?ray|radiograph\w*)\b"),
    ("electrocardiography", r"\b(?:ecg|ekg|electrocardiogra\w*)\b"),
    ("electroencephalography", r"\b(?:eeg|electroencephalogra\w*)\b"),
)
ANCHOR_MODALITIES = (
    ("ctpa", r"\b(?:ctpa|ct pulmonary angiograph(?:y|ram))\b"),
    ("ct", r"\bct(?: scan| imaging)?\b"),
    ("mri", r"\bmri?\b"),
    ("endoscopy", r"\b(?:endoscop(?:y|ic)|egd)\b"),
    ("spirometry", r"\b(?:spirometr(?:y|ic)|pulmonary function test|pft)\b"),
    ("echocardiography", r"\b(?:echo|echocardiogram|echocardiography)\b"),
    ("ecg", r"\b(?:ecg|ekg|electrocardiogra(?:m|phy))\b"),
    ("angiography", r"\bangiograph(?:y|ram)\b"),
    ("pathology", r"\b(?:biopsy|pathology|histology)\b"),
    ("culture", r"\bculture\b"),
    ("pcr", r"\bpcr\b"),
)

# Patterns of tests, measurements, exclusions and history.
TEST = r"(?i)\b(?:test|testing|imaging|scan|radiograph|x[- ]?ray|ct|mri|ultrasound|echo|endoscop|biopsy|histolog|patholog|culture|pcr|spirometr|pulmonary function|ecg|ekg|assay|laboratory|level)\b"
MEASUREMENT = r"(?i)(?:<=|>=|≤|≥|<|>|\d+(?:\.\d+)?\s*(?:%|mmhg|mg/dl|mmol/l))"
CONJUNCTION = r"(?i)\b(?:and|all of|together with|plus)\b"
EXCLUDING = r"(?i)\b(?:absence|absent|negative|normal|without|no )\b"
NOT_EXCLUDING = r"(?i)\bwith or without\b|\b(?:that|which)\s+(?:define|defines|characteriz(?:e|es))\b"
PAST = r"(?i)\b(?:history of|historical|previous(?:ly)?|prior|remote|resolved)\b"
THRESHOLD = r"([A-Za-z][A-Za-z0-9 /_()'-]{0,48}?)\s*(>=|<=|≥|≤|>|<)\s*(\d+(?:\.\d+)?)"
ANSWER_PREFIXES = (
    r"(?i)^(?:answer|diagnosis)\s*:\s*",
    r"(?i)^(?:the\s+)?(?:most\s+likely\s+)?diagnosis\s+is\s+",
    r"(?i)^(?:the\s+)?patient(?:'s)?\s+clinical\s+presentation\s+is\s+(?:most\s+)?consistent\s+with\s+",
    r"(?i)^(?:the\s+)?clinical\s+presentation\s+is\s+(?:most\s+)?consistent\s+with\s+",
)
ANNOTATION_KEY = r"(?s)^(.*)\$(Input[1-6]|Cause|Intermedia)(?:_(\d+))?$"


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def binding_tokens(text: Column) -> Column:
    """Tokens with numeric tails cut, troponin names joined and plurals made singular; three letters or more."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9][A-Za-z0-9/-]*"), F.lit(0))

    # one pass a step, as an expression named twice is read twice; only words with a sign inside have a tail to cut
    def cut(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("-")) | F.contains(t, F.lit("/")), F.regexp_replace(t, r"[-/:][<>]?\d.*$", "")).otherwise(t)

    def named(t: Column) -> Column:
        return F.when(F.translate(t, "-/", "").isin(*TROPONIN), F.lit("troponin")).otherwise(t)

    def read(t: Column) -> Column:
        many, one = (F.length(t) > 5) & F.endswith(t, F.lit("ies")), (F.length(t) > 5) & F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss"))
        return F.when(many, F.concat(F.substring(t, 1, F.length(t) - 3), F.lit("y"))).when(one, F.substring(t, 1, F.length(t) - 1)).otherwise(t)

    bare = F.transform(found, lambda raw: F.btrim(F.lower(raw), F.lit("-/")))
    words = F.transform(F.transform(F.transform(bare, cut), named), read)
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*BINDING_STOPWORDS))


def candidate_terms(text: Column, limit: int = 120) -> Column:
    """Runs of one to four words that look like clinical terms: best score first, then longer, then alphabetical."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9/-]*"), F.lit(0))
    ends = lambda w: F.regexp_like(w, F.lit("(" + "|".join(TERM_SUFFIXES) + ")$"))

    def judged(run: Column) -> Column:
        low, term = F.transform(run, lambda w: F.lower(w)), F.array_join(run, " ")
        bonus = lambda c, n: F.when(c, n).otherwise(0)
        score = F.size(run) + bonus(F.exists(low, ends), 3) + bonus(F.arrays_overlap(low, F.array(*map(F.lit, TERM_CUES))), 3) + bonus(F.regexp_like(term, F.lit(r"\d")), 2)
        score = score + bonus(F.regexp_like(term, F.lit("[-/]")), 1) + bonus(F.regexp_like(term, F.lit("^[A-Z]")), 1) + 1
        first, last = F.element_at(low, 1), F.element_at(low, -1)
        short = (F.size(run) == 1) & (F.length(first) < 5) & ~ends(first)
        bad = F.arrays_overlap(low, F.array(*map(F.lit, TERM_STOPWORDS))) | first.isin(*TERM_EDGES) | last.isin(*TERM_EDGES) | (F.length(term) < 4) | short | (score < 3)
        return F.when(~bad, F.struct((-score).alias("s"), (-F.length(term)).alias("n"), F.lower(term).alias("low"), term.alias("term")))

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: judged(F.slice(words, i, n)))

    best = F.array_sort(F.array_distinct(F.array_compact(F.concat(*[runs(n) for n in (1, 2, 3, 4)]))))
    return F.transform(F.slice(best, 1, limit), lambda x: x["term"])


def modality(text: Column) -> Column:
    """The first diagnostic modality that the text names, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(MODALITIES):
        found = F.when(F.regexp_like(text, F.lit(f"(?i){pattern}")), F.lit(name)).otherwise(found)
    return found


def anchor_modalities(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(f"(?i){p}")), F.lit(n)) for n, p in ANCHOR_MODALITIES]))


def is_excluding(text: Column) -> Column:
    return F.regexp_like(text, F.lit(EXCLUDING)) & ~F.regexp_like(text, F.lit(NOT_EXCLUDING))


def proposition_kind(text: Column, role: Column) -> Column:
    return F.when(role == "risk_factor", "risk_context").when(role == "guideline", "guideline").when(F.regexp_like(text, F.lit(MEASUREMENT)), "measurement").when(F.regexp_like(text, F.lit(TEST)), "diagnostic_test").otherwise("clinical_finding")


def relation(text: Column, role: Column) -> Column:
    return F.when(is_excluding(text), "contradiction_or_exclusion").when(role == "risk_factor", "weak_support").when(role == "guideline", "authority").otherwise("direct_support")


def decisive_anchor(text: Column, role: Column) -> Column:
    """A criterion that is no exclusion and names a modality or a measurement."""
    return (role == "diagnostic_criterion") & ~is_excluding(text) & ((F.size(anchor_modalities(text)) > 0) | F.regexp_like(text, F.lit(MEASUREMENT)))


def conjunctive(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CONJUNCTION))


def current_clauses(text: Column) -> Column:
    """Clauses that do not speak of the past."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.;]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x: ~F.regexp_like(x, F.lit(PAST)))


def measurements(text: Column) -> Column:
    """(name, value) of every "name = 12" or "name is 12" in the text, with blood pressure as sbp and dbp."""
    low = F.lower(_flat(text))
    named = F.lit(r"\b([a-z][a-z0-9]*)\b\s*(?:=|:|is|of)?\s*(\d+(?:\.\d+)?)")
    bp = F.lit(r"\b(?:bp|blood pressure)\b\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)")

    def pairs(names: Column, values: Column) -> Column:
        return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.cast("double").alias("value")))

    both = pairs(F.regexp_extract_all(low, named, F.lit(1)), F.regexp_extract_all(low, named, F.lit(2)))
    upper, lower = F.regexp_extract_all(low, bp, F.lit(1)), F.regexp_extract_all(low, bp, F.lit(2))
    return F.concat(both, pairs(F.transform(upper, lambda _: F.lit("sbp")), upper), pairs(F.transform(lower, lambda _: F.lit("dbp")), lower))


def _near_signs(text: Column) -> Column:
    """What ``THRESHOLD`` can match of a text: before each sign the 49 characters that a name has at most, behind it a number.

    The pattern looks ahead from every letter, so on whole texts it costs fifty times their length.
    """

    def ends(part: Column) -> Column:
        number = F.regexp_extract(part, r"^=?\s*\d+(?:\.\d+)?", 0)
        before = F.rtrim(F.substring(part, F.lit(1), F.length(part) - 1), F.lit(" \t\n\x0b\f\r"))
        return F.when(F.length(part) <= 100, part).otherwise(F.concat(number, F.lit("\x01"), F.right(before, F.lit(49)), F.right(part, F.lit(1))))

    return F.array_join(F.transform(F.split(text, "(?<=[<>≤≥])"), ends), "")


def thresholds(text: Column) -> Column:
    """(name, op, value) of every threshold; the name is the last token before the sign."""
    parts = lambda body: [F.regexp_extract_all(body, F.lit(THRESHOLD), F.lit(k)).alias(n) for k, n in ((1, "metric"), (2, "op"), (3, "value"))]
    found = let(_near_signs(F.coalesce(text, F.lit(""))), lambda body: F.arrays_zip(*parts(body)))
    read = F.transform(found, lambda x: F.struct(F.try_element_at(tokens(x["metric"]), F.lit(-1)).alias("name"), x["op"].alias("op"), x["value"].cast("double").alias("value")))
    return F.filter(read, lambda x: x["name"].isNotNull())


def threshold_met(text: Column, premise: Column) -> Column:
    """Some threshold of the premise holds for a measurement of its name in the text."""
    seen = measurements(text)
    return F.exists(thresholds(premise), lambda t: F.exists(seen, lambda m: (m["name"] == t["name"]) & F.coalesce(holds(m["value"], t["op"], t["value"]), F.lit(False))))


def normalize_answer(answer: Column, options: Column | None = None) -> Column:
    """The option a letter or text stands for, else the answer without a prefix (the first that fits) and reasons."""
    text = _flat(answer)
    body = text
    for p in reversed(ANSWER_PREFIXES):
        body = F.when(F.regexp_like(text, F.lit(p)), F.regexp_replace(text, p, "")).otherwise(body)
    plain = F.regexp_replace(F.get(F.split(body, r"\s+(?:based on|because|given)\s+"), F.lit(0)), "^[ .]+|[ .]+$", "")
    if options is None:
        return plain
    bare = lambda c: F.lower(F.regexp_replace(c, "^[ .]+|[ .]+$", ""))
    by_letter = F.try_element_at(options, F.regexp_replace(F.upper(text), "^[ .():]+|[ .():]+$", ""))
    by_text = F.get(F.filter(F.map_values(options), lambda o: bare(o) == bare(text)), F.lit(0))
    return F.coalesce(by_letter, by_text, plain)


def identifier_list(values: Column) -> Column:
    """Parts of comma lists, blanks collapsed, the first of each spelling whatever its case."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, ",")))
    clean = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.filter(clean, lambda p, i: F.array_position(F.transform(clean, lambda q: F.lower(q)), F.lower(p)) == i + 1)


def exact_findings(source: Column, least: int = 8, most: int = 240) -> Column:
    """Distinct parts of 8 to 240 characters: the whole source first if it fits, then its sentences.

    A longer part is packed greedily with whole words: a fold over its words, as each chunk's start
    depends on the one before.
    """
    whole = _flat(source)
    parts = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), r"(?<=[.!?])\s+|[;\r\n]+"), _flat), lambda p: F.length(p) >= least)

    def packed(part: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def add(s: Column, w: Column) -> Column:
            longer = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
            full = (s["open"] != "") & (F.length(longer) > most)
            return F.struct(F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"), F.when(full, w).otherwise(longer).alias("open"))

        return F.aggregate(F.split(part, " "), start, add, lambda s: F.array_append(s["done"], s["open"]))

    each = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > most, packed(p)).otherwise(F.array(p))))
    first = F.when((F.length(whole) >= least) & (F.length(whole) <= most), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(first, each), lambda p: F.length(p) >= least))


def annotation(key: Column) -> Column:
    """struct(text, role, section, index) of a key like ``text$Cause_2``; nulls if it is none."""
    part = lambda k: F.regexp_extract(key, ANNOTATION_KEY, k)
    names = ("chief_complaint", "history_of_present_illness", "past_medical_history", "family_history", "physical_exam", "pertinent_results")
    kind = part(2)
    role = F.when(F.startswith(kind, F.lit("Input")), "observation").when(kind == "Cause", "rationale").when(kind == "Intermedia", "diagnosis")
    section = F.get(F.array(*map(F.lit, names)), F.try_subtract(F.substring(kind, 6, 1).try_cast("int"), F.lit(1)))
    return F.struct(F.when(role.isNotNull(), _flat(part(1))).alias("text"), role.alias("role"), F.when(role == "observation", section).alias("section"), F.nullif(part(3), F.lit("")).try_cast("int").alias("index"))


def path_compatibility(label: Column, path: Column, key=label_key) -> Column:
    """1, 3/4 or 1/2 as the label's last place on the path is its end, one before it, or further up; else 0."""
    keys = F.reverse(F.transform(path, key))
    at = F.array_position(keys, key(label))
    return F.when(at == 1, 1.0).when(at == 2, 0.75).when(at > 2, 0.5).otherwise(0.0)


def prompt_part(prompt: Column, begin: str, end: str) -> Column:
    """What stands between two markers of a prompt; empty if the first is missing."""
    from_ = F.instr(prompt, begin)
    rest = F.substring(prompt, from_ + len(begin), F.length(prompt))
    to = F.instr(rest, end)
    return F.when(from_ == 0, "").when(to > 0, F.substring(rest, F.lit(1), to - 1)).otherwise(rest)


def budget(prompt_tokens: Column, completion: int = 1536, context: int = 16_384, margin: int = 1024) -> Column:
    """struct(left, fits): tokens left after prompt, completion and margin."""
    left = F.lit(context - completion - margin) - prompt_tokens
    return F.struct(left.alias("left"), (left >= 0).alias("fits"))
