"""Reading of findings and criteria: roles, polarity, time, quantities, and whether they bind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import holds, let

# Words that decide polarity, time, and the state of a test.
NEGATION = r"(?i)\b(?:no|not|without|denies|denied|negative|absent|absence of|lacks|lack of)\b"
HISTORICAL = r"(?i)\b(?:history of|historical|previous|previously|prior|status post|s/p|remote|years? ago)\b"
CURRENT = r"(?i)\b(?:current|currently|today|now|presented|acute|new|on admission)\b"
COMPLETED = r"(?i)\b(?:show(?:ed|s)|demonstrat(?:ed|es)|reveal(?:ed|s)|confirm(?:ed|s)|positive for|consistent with|diagnostic of|significant for|evidence of|found|identified|visuali[sz](?:ed|es))\b"
NONFINAL = r"(?i)\b(?:ordered|planned|scheduled|pending|recommended|referred|consider(?:ed|ation)|to (?:exclude|rule out|evaluate)|cannot exclude|possible|suspicious for|equivocal)\b"

# Operator words, units, and premise types by role in order of precedence.
OPERATORS = {
    ">": ("above", "over", "more than", "greater than", "exceeding", "exceeds", "exceeded", "surpassing", "surpasses", "surpassed", ">"),
    ">=": ("at least", ">=", "≥"),
    "<": ("below", "under", "less than", "<"),
    "<=": ("at most", "<=", "≤"),
}
_UNITS = "%|mmhg|mg/dl|mmol/l|ng/ml|pg/ml|µg/l|ug/l|mm|cm/sec|cm/s|seconds?|minutes?|hours?|days?|weeks?|months?|years?"
_RANGE_UNITS = "%|mmhg|mg/dl|mmol/l|ng/ml|pg/ml|µg/l|ug/l|mm|cm/sec|cm/s"
ROLES = (
    ("counterevidence", ("exclude", "contra", "negative")),
    ("diagnostic_criterion", ("criterion", "criteria", "test", "result")),
    ("clinical_feature", ("symptom", "sign", "feature", "presentation")),
    ("risk_factor", ("risk",)),
)


def role(premise_type: Column) -> Column:
    """The first role one of whose words the type contains; guideline if none does."""
    kind = F.lower(F.coalesce(premise_type, F.lit("")))
    found = F.lit("guideline")
    for name, words in reversed(ROLES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(kind, F.lit(w))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def polarity(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(NEGATION)), "absent").otherwise("present")


def temporality(text: Column) -> Column:
    """current wins over historical; unspecified if neither shows."""
    return F.when(F.regexp_like(text, F.lit(CURRENT)), "current").when(F.regexp_like(text, F.lit(HISTORICAL)), "historical").otherwise("unspecified")


def completed_result(text: Column) -> Column:
    return F.regexp_like(text, F.lit(COMPLETED)) & ~F.regexp_like(text, F.lit(NONFINAL))


def _with_digits(text: Column) -> Column:
    """The lower-cased text; an empty one in place of a text without digits, which no pattern of numbers matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.regexp_like(low, F.lit("[0-9]")), low).otherwise("")


def stated_quantities(text: Column) -> Column:
    """(op, value, unit) of every number, with operator words read as signs and no operator as ``=``."""
    words = "|".join(w for ws in OPERATORS.values() for w in sorted(ws, key=len, reverse=True))
    pattern = F.lit(rf"({words})?\s*(\d+(?:\.\d+)?)\s*({_UNITS})?")
    parts = lambda low: [F.regexp_extract_all(low, pattern, F.lit(k)).alias(n) for k, n in ((1, "op"), (2, "value"), (3, "unit"))]

    def read(x: Column) -> Column:
        sign = F.lit("=")
        for s, ws in OPERATORS.items():
            sign = F.when(x["op"].isin(*ws), s).otherwise(sign)
        return F.struct(sign.alias("op"), x["value"].cast("double").alias("value"), F.coalesce(x["unit"], F.lit("")).alias("unit"))

    return let(_with_digits(text), lambda low: F.transform(F.arrays_zip(*parts(low)), read))


def quantity_compatible(observed: Column, criterion: Column) -> Column:
    """Some observed quantity meets some threshold of its unit; true if the criterion has no threshold."""
    limits = F.filter(criterion, lambda q: q["op"] != "=")
    met = F.exists(limits, lambda t: F.exists(observed, lambda o: ((t["unit"] == "") | (o["unit"] == t["unit"])) & F.coalesce(holds(o["value"], t["op"], t["value"]), F.lit(False))))
    return (F.size(limits) == 0) | met


def ranges(text: Column) -> Column:
    """(low, high, unit) of every range such as "120-140 mmHg" or "3 to 5"."""
    pattern = F.lit(rf"(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*({_RANGE_UNITS})?")
    parts = lambda low: [F.regexp_extract_all(low, pattern, F.lit(k)).alias(n) for k, n in ((1, "low"), (2, "high"), (3, "unit"))]
    read = lambda x: F.struct(x["low"].cast("double").alias("low"), x["high"].cast("double").alias("high"), F.coalesce(x["unit"], F.lit("")).alias("unit"))
    return let(_with_digits(text), lambda low: F.transform(F.arrays_zip(*parts(low)), read))


def quantities_meet(finding: Column, criterion: Column) -> Column:
    """Some stated value of the finding lies in some range of the criterion; without ranges its thresholds decide."""
    seen, wanted = stated_quantities(finding), ranges(criterion)
    inside = F.exists(wanted, lambda r: F.exists(seen, lambda q: (q["op"] == "=") & ((r["unit"] == "") | (q["unit"] == r["unit"])) & q["value"].between(r["low"], r["high"])))
    return F.when(F.size(wanted) > 0, inside).otherwise(quantity_compatible(seen, stated_quantities(criterion)))

