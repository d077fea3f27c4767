"""Text functions as Column expressions: tokens, keys, segments, quantities, redaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Words that carry no retrieval weight.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its",
    "of", "on", "or", "patient", "she", "that", "the", "their", "this", "to", "was", "were", "with",
)

# Texts that say nothing by themselves.
MEANINGLESS = ("etc", "and so on", "other", "others")

# Lexical keys that name the same diagnosis.
KEY_ALIASES = {
    "nonstelevationmyocardialinfarction": "nstemi",
    "nonstelevationmyocardialinfarctionnstemi": "nstemi",
    "lowriskpulmonaryembolism": "lowriskpe",
    "pulmonaryembolismlowrisk": "lowriskpe",
    "stemi": "stemiacs",
    "copdasthma": "asthmacopd",
    "severeasthmaexacerbation": "severeasthma",
    "pituitarymacroadenoma": "pituitarymacroadenomas",
    "pituitarymicroadenoma": "pituitarymicroadenomas",
    "gastroesophagealrefluxdisease": "gastrooesophagealrefluxdisease",
}

# Keys and the family each belongs to.
FAMILY_ALIASES = {
    "rrms": "multiplesclerosis",
    "relapsingremittingmultiplesclerosis": "multiplesclerosis",
    "lowriskpe": "pulmonaryembolism",
    "submassivepe": "pulmonaryembolism",
    "bacterialpneumonia": "pneumonia",
    "viralpneumonia": "pneumonia",
    "severecopd": "copd",
    "copdexacerbation": "copd",
    "acuteexacerbationofcopd": "copd",
    "asthmacopd": "copd",
    "copdasthma": "copd",
    "mildcopd": "copd",
    "moderatecopd": "copd",
    "veryseverecopd": "copd",
    "hfpef": "heartfailure",
    "hfmref": "heartfailure",
    "hfref": "heartfailure",
    "pituitarymacroadenomas": "pituitaryadenoma",
    "pituitarymicroadenomas": "pituitaryadenoma",
    "pituitarysilenadenomas": "pituitaryadenoma",
    "pituitarysilentadenomas": "pituitaryadenoma",
    "nsteacs": "acutecoronarysyndrome",
    "nstemi": "acutecoronarysyndrome",
    "stemiacs": "acutecoronarysyndrome",
    "ua": "acutecoronarysyndrome",
}

# Keys that say a qualifier by themselves (several with commas between).
KEY_QUALIFIERS = {
    "bacterialpneumonia": "bacterial",
    "viralpneumonia": "viral",
    "relapsingremittingmultiplesclerosis": "relapsing_remitting",
    "rrms": "relapsing_remitting",
    "lowriskpe": "low_risk",
    "submassivepe": "intermediate_risk",
    "severecopd": "severe",
    "copdexacerbation": "exacerbation",
    "acuteexacerbationofcopd": "acute,exacerbation",
    "mildcopd": "mild",
    "moderatecopd": "moderate",
    "veryseverecopd": "very_severe",
    "massivepe": "high_risk",
    "hfpef": "preserved_ef",
    "hfmref": "mildly_reduced_ef",
    "hfref": "reduced_ef",
    "typeidiabetes": "type_1",
    "typeiidiabetes": "type_2",
    "asthmacopd": "overlap",
    "nsteacs": "non_st_elevation",
    "nstemi": "non_st_elevation",
    "stemiacs": "st_elevation",
    "ua": "unstable_angina",
}

# Words and phrases that qualify a diagnosis.
QUALIFIERS = {
    "acute": "acute",
    "chronic": "chronic",
    "primary": "primary",
    "secondary": "secondary",
    "mild": "mild",
    "moderate": "moderate",
    "severe": "severe",
    "bacterial": "bacterial",
    "viral": "viral",
    "fungal": "fungal",
    "hemorrhagic": "hemorrhagic",
    "haemorrhagic": "hemorrhagic",
    "ischemic": "ischemic",
    "ischaemic": "ischemic",
}
QUALIFIER_PHRASES = {
    "very severe": "very_severe",
    "low risk": "low_risk",
    "intermediate risk": "intermediate_risk",
    "high risk": "high_risk",
    "preserved ejection fraction": "preserved_ef",
    "mildly reduced ejection fraction": "mildly_reduced_ef",
    "reduced ejection fraction": "reduced_ef",
    "non st elevation": "non_st_elevation",
    "st elevation": "st_elevation",
    "unstable angina": "unstable_angina",
}

# Qualifiers of one group exclude each other.
CONTRADICTIONS = (
    ("bacterial", "viral"),
    ("low_risk", "intermediate_risk", "high_risk"),
    ("mild", "moderate", "severe", "very_severe"),
    ("preserved_ef", "mildly_reduced_ef", "reduced_ef"),
    ("type_1", "type_2"),
    ("st_elevation", "non_st_elevation", "unstable_angina"),
    ("primary", "secondary"),
    ("acute", "chronic"),
)


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case ``[a-z0-9]+`` tokens of two characters or more that are no stopwords; null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(*stopwords))


def retrieval_segments(text: Column, size: int = 56, overlap: int = 8) -> Column:
    """Distinct segments: sentences and clauses, cut before a test's heading, in windows of ``size`` words.

    Line breaks are blanks by then, so only ``. ! ?`` before a blank and ``;`` separate clauses.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    heading = "(?i)(?=\\b(?:ECG|EKG|EEG|EGD|Endoscopy|Echocardiogram|Echo|CXR|CT|MRI|Imaging|Laboratory|Labs?|Pathology|Biopsy)\\s*:)"
    blocks = F.flatten(F.transform(F.split(flat, "(?<=[.!?])\\s+|[;\\r\\n]+"), lambda c: F.split(c, heading)))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: word_windows(b, size, size - overlap))))


def normalize_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def label_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def unicode_key(text: Column) -> Column:
    """As ``label_key``, with all letters and digits of Unicode."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("unknown"))


def term_key(text: Column) -> Column:
    """Terminology key: lower-case alphanumeric runs with one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def look_up(key: Column, pairs: dict[str, str], default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    found = F.try_element_at(table, key)
    return F.coalesce(found, default) if default is not None else found


def lexical_key(text: Column) -> Column:
    key = label_key(text)
    return look_up(key, KEY_ALIASES, key)


def family_key(text: Column) -> Column:
    """Family of a label: no "suspected" in front, then the family table, else no severity in front."""
    key = F.regexp_replace(lexical_key(text), "^(stronglysuspected|suspected)", "")
    bare = F.regexp_replace(key, "^(verysevere|moderate|severe|mild)(?=.)", "")
    return F.coalesce(look_up(key, FAMILY_ALIASES), look_up(bare, FAMILY_ALIASES, bare))


def qualifiers(text: Column) -> Column:
    """Sorted qualifiers of a label: by its key or a token's, by words and phrases, and "suspected"."""
    spaced = F.concat(F.lit(" "), term_key(text), F.lit(" "))
    words = [F.when(F.contains(spaced, F.lit(f" {w} ")), F.lit(q)) for w, q in QUALIFIERS.items()]
    phrases = [F.when(F.contains(spaced, F.lit(p)), F.lit(q)) for p, q in QUALIFIER_PHRASES.items()]
    key = label_key(text)
    strongly = F.startswith(key, F.lit("stronglysuspected"))
    suspected = [F.when(strongly, F.lit("strongly_suspected")), F.when(strongly | F.startswith(key, F.lit("suspected")), F.lit("suspected"))]
    parts = F.transform(F.split(F.lower(text), "[^a-z0-9-]+"), lambda t: F.regexp_replace(t, "-", ""))
    named = F.transform(F.array_append(parts, lexical_key(text)), lambda k: look_up(k, KEY_QUALIFIERS))
    by_key = F.flatten(F.transform(F.array_compact(named), lambda q: F.split(q, ",")))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*words, *phrases, *suspected)), by_key)))


def contradict(left: Column, right: Column) -> Column:
    """Two qualifier sets clash if both have members of a group, and not the same ones."""
    clash = F.lit(False)
    for group in CONTRADICTIONS:
        g = F.array(*[F.lit(x) for x in group])
        a, b = F.array_sort(F.array_intersect(left, g)), F.array_sort(F.array_intersect(right, g))
        clash = clash | ((F.size(a) > 0) & (F.size(b) > 0) & (a != b))
    return clash


def clauses(text: Column, separators: str = "[;\\r\\n]+") -> Column:
    """Trimmed non-blank parts between ``separators``."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and blanks, and between lines."""
    return clauses(text, "(?<=[.!?])\\s+|[\\r\\n]+")


def word_windows(text: Column, size: int = 56, stride: int = 48) -> Column:
    """Overlapping windows of ``size`` words, one every ``stride`` words, until a window reaches the end."""
    words = F.array_remove(F.split(F.trim(F.coalesce(text, F.lit(""))), "\\s+"), "")
    n = F.size(words)
    last = F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))


def ngrams(toks: Column, low: int = 1, high: int = 4) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, blank-separated, shorter ones first."""
    def run(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(1)))
        return F.when(F.size(toks) >= n, F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = [run(n) for n in range(low, high + 1)]
    return F.concat(*runs)


def ordered_distinct(items: Column) -> Column:
    """First occurrence of each item, in order."""
    return F.array_distinct(items)


def quantities(text: Column) -> Column:
    """(operator, value, unit) of every number with an optional comparison before and a unit after it."""
    pattern = F.lit("(>=|<=|>|<|=)?\\s*(\\d+(?:\\.\\d+)?)\\s*(%|[a-z]+)?")
    body = F.lower(F.coalesce(text, F.lit("")))
    parts = [F.regexp_extract_all(body, pattern, F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("op", "value", "unit"))]), lambda x: F.struct(x["op"].alias("op"), x["value"].cast("double").alias("value"), x["unit"].alias("unit")))


def holds(observed: Column, operator: Column, threshold: Column) -> Column:
    """The comparison named by ``operator``: >, >=, ≥, <, <=, ≤; null for any other."""
    return F.when(operator == ">", observed > threshold).when(operator.isin(">=", "≥"), observed >= threshold).when(operator == "<", observed < threshold).when(operator.isin("<=", "≤"), observed <= threshold)


def redact(text: Column, patterns: Sequence[str], by: str = "internal reference") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text


def content_id(prefix: str, text: Column, length: int = 20) -> Column:
    """``prefix`` and the first hex digits of the text's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, length))


def morphologically_compatible(a: Column, b: Column) -> Column:
    """Equal, or both of six letters or more that share the first five and differ in at most four after."""
    shared = F.greatest(*[F.when(F.substring(a, 1, k) == F.substring(b, 1, k), F.lit(k)).otherwise(0) for k in range(5, 33)])
    rest = F.greatest(F.length(a), F.length(b)) - shared
    return (a == b) | ((F.length(a) >= 6) & (F.length(b) >= 6) & (shared >= 5) & (rest <= 4))


def json_object(text: Column) -> Column:
    """The first ``{...}`` of a model's answer, without a code fence around it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^```(?:json)?\\s*", ""), "\\s*```$", "")
    return F.nullif(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1), F.lit(""))


def has_json_key(text: Column, keys: Sequence[str]) -> Column:
    """True if any object in the JSON text, however deep, has one of ``keys``."""
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit('"(' + "|".join(keys) + ')"\\s*:'))
