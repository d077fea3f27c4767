"""Queries that bind sentences of documents to the clauses of benchmark items, and values of tables to ranges in prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import atoms as A
from marlstone.functions import binding as B
from marlstone.functions import clinical, typed
from marlstone.functions.clinical import BINDING_STOPWORDS, TROPONIN
from marlstone.functions.text import content_id
from marlstone.operators import binding
from marlstone.plans.registry import query, table, texts
from marlstone.sources.scratch import written

_BLANK = r"[ \t\n\x0B\f\r]"


def _among(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_BLANK}+', ' ', 'g'))"


def _parts(text: str, ends: str) -> str:
    """SQL for the pieces of a text, split after a sentence and at any of ``ends``."""
    return rf"list_transform(string_split_regex(regexp_replace({text}, '([.!?]){_BLANK}+', '\1' || chr(10), 'g'), '[{ends}\r\n]+'), lambda x: {_flat('x')})"


_READ = "list_transform(list_transform(list_transform(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9/-]*'), lambda w: regexp_replace(regexp_replace(lower(w), '^[-/]+|[-/]+$', '', 'g'), '[-/:][<>]?[0-9].*$', '')), lambda w: CASE WHEN list_contains(%s, regexp_replace(w, '[^a-z0-9]', '', 'g')) THEN 'troponin' ELSE w END), lambda w: CASE WHEN len(w) > 5 AND w[-3:] = 'ies' THEN w[:-4] || 'y' WHEN len(w) > 5 AND w[-1:] = 's' AND w[-2:] <> 'ss' THEN w[:-2] ELSE w END)" % _among(TROPONIN)
_WORDS = f"list_filter({_READ}, lambda w: len(w) >= 3 AND NOT list_contains({_among(BINDING_STOPWORDS)}, w))"
_UNITS = "%|mmhg|mg/dl|mmol/l|ng/ml|pg/ml|µg/l|ug/l|mm|cm/sec|cm/s"
_OPS = "below|under|above|over|at least|at most|more than|less than|greater than|exceeding|exceeds|exceeded|surpassing|surpasses|surpassed|<=|>=|≤|≥|<|>"
_NUMBER = rf"({_OPS})?{_BLANK}*([0-9]+(?:\.[0-9]+)?){_BLANK}*({_UNITS}|seconds?|minutes?|hours?|days?|weeks?|months?|years?)?"
_SPAN = rf"([0-9]+(?:\.[0-9]+)?){_BLANK}*(?:-|–|—|to){_BLANK}*([0-9]+(?:\.[0-9]+)?){_BLANK}*({_UNITS})?"
_SIGN = "CASE WHEN o IN ('above', 'over', 'more than', 'greater than', 'exceeding', 'exceeds', 'exceeded', 'surpassing', 'surpasses', 'surpassed', '>') THEN '>' WHEN o IN ('at least', '>=', '≥') THEN '>=' WHEN o IN ('below', 'under', 'less than', '<') THEN '<' WHEN o IN ('at most', '<=', '≤') THEN '<=' ELSE '=' END"


def _zip(pattern: str, *names: str) -> str:
    each = [f"regexp_extract_all(lower(t), '{pattern}', {k})" for k in range(1, len(names) + 1)]
    return f"list_transform(list_zip({', '.join(each)}), lambda z: {{{', '.join(f'{n!r}: z[{k}]' for k, n in enumerate(names, 1))}}})"


def _bounded(pattern: str) -> str:
    """The pattern with its outer word boundaries spelled out, as DuckDB's know ASCII only."""
    inner = pattern.removeprefix("(?i)")
    if inner.startswith(r"\b") and inner.endswith(r"\b"):
        return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{inner[2:-2]})(?:$|[^\p{{L}}\p{{N}}_])"
    return pattern


def _atoms(source: str) -> str:
    """SQL for the atoms of the column t of ``source``, one row a distinct text."""
    cols = [
        f"{_WORDS} AS w",
        f"list_transform({_zip(_NUMBER, 'o', 'v', 'u')}, lambda q: {{'o': {_SIGN.replace('o IN', 'q.o IN')}, 'v': q.v::DOUBLE, 'u': coalesce(q.u, '')}}) AS quantities",
        f"list_transform({_zip(_SPAN, 'a', 'b', 'u')}, lambda q: {{'a': q.a::DOUBLE, 'b': q.b::DOUBLE, 'u': coalesce(q.u, '')}}) AS spans",
        f"regexp_matches(t, '{_bounded(B.NEGATION)}') AS absent",
        f"CASE WHEN regexp_matches(t, '{_bounded(A.COMPARED)}') OR regexp_matches(t, '{_bounded(B.CURRENT)}') THEN 'current' WHEN regexp_matches(t, '{_bounded(B.HISTORICAL)}') THEN 'historical' ELSE 'unspecified' END AS tense",
        f"regexp_matches(t, '{_bounded(A.NO_ST_ELEVATION)}') AS no_st, regexp_matches(t, '{A.ST_DEPRESSION}') AS st, regexp_matches(t, '{_bounded(A.DIAGNOSTIC_TEST)}') AS test, regexp_matches(t, '{_bounded(B.COMPLETED)}') AND NOT regexp_matches(t, '{_bounded(B.NONFINAL)}') AS done",
    ]
    return f"(SELECT *, list_distinct(w) AS tok, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM (SELECT t, {', '.join(cols)} FROM (SELECT DISTINCT t FROM {source})))"


def _judged(role: str) -> str:
    """SQL for the clauses c met by findings f, from the atoms of both and ``role``."""
    return f"""m AS (SELECT *, len(list_intersect(ftok, ctok))::DOUBLE / greatest(len(ctok), 1) AS lexical, list_has_any(fpairs, cpairs) AS phrase, list_intersect(ftok, ctok) AS shared FROM met),
j AS (SELECT *, CASE WHEN c_no_st AND f_st THEN 1.0::DOUBLE ELSE lexical END AS score, {role} = 'diagnostic_criterion' AND f_test AND f_done AND NOT f_absent AND f_tense <> 'historical' AND c_test AND (phrase OR lexical >= 0.4) AS tested FROM m),
k AS (SELECT *, tested OR (c_no_st AND f_st) OR (f_absent AND c_absent AND score >= 0.4 AND len(list_filter(shared, lambda x: NOT list_contains({_among(A.POLARITY_ONLY)}, x))) > 0) AS special FROM j),
b AS (SELECT *, phrase OR special OR score >= 0.6 OR len(list_filter(shared, lambda x: regexp_matches(x, '[-/0-9]'))) > 0 AS semantic,
        special OR score >= 0.6 OR (len(c_quantities) > 0 AND len(list_filter(list_concat(c_quantities, f_quantities), lambda q: q.o <> '=')) > 0 AND phrase) OR ({role} = 'risk_factor' AND score >= 0.4) AS covered,
        CASE WHEN len(c_spans) > 0 THEN len(list_filter(c_spans, lambda r: len(list_filter(f_quantities, lambda q: q.o = '=' AND (r.u = '' OR q.u = r.u) AND q.v BETWEEN r.a AND r.b)) > 0)) > 0
             ELSE len(list_filter(c_quantities, lambda r: r.o <> '=')) = 0 OR len(list_filter(c_quantities, lambda r: r.o <> '=' AND len(list_filter(f_quantities, lambda q: (r.u = '' OR q.u = r.u) AND CASE r.o WHEN '>' THEN q.v > r.v WHEN '>=' THEN q.v >= r.v WHEN '<' THEN q.v < r.v ELSE q.v <= r.v END)) > 0)) > 0 END AS fits
      FROM k QUALIFY row_number() OVER (PARTITION BY finding_id, item_id ORDER BY score DESC, clause) = 1)"""


_ROLE = "['diagnostic_criterion', 'clinical_feature', 'risk_factor', 'guideline'][1 + item_id % 4]"
_SIDES = ", ".join(f"{side}.{name} AS {side}{'' if name in ('tok', 'pairs') else '_'}{name}" for side in "fc" for name in ("tok", "pairs", "quantities", "spans", "absent", "tense", "no_st", "st", "test", "done"))
_BOUND = f"""s AS (SELECT doc_id, list_distinct(list_filter({_parts("text", ";:")}, lambda x: len(x) >= 8)) AS spans FROM documents),
found AS (SELECT DISTINCT unnest(spans) AS t FROM s),
i AS (SELECT item_id, list_filter({_parts("text", ";")}, lambda x: x <> '') AS parts FROM benchmark), wanted AS (SELECT item_id, generate_subscripts(parts, 1) - 1 AS clause, unnest(parts) AS t FROM i),
fa AS MATERIALIZED (SELECT 'S-' || substr(sha256(t), 1, 16) AS finding_id, * FROM {_atoms("found")}), ca AS MATERIALIZED (SELECT * FROM {_atoms("wanted")}),
met AS (SELECT finding_id, item_id, clause, {_ROLE} AS role, f.t AS finding, c.t AS criterion, {_SIDES} FROM fa f, wanted JOIN ca c USING (t)),
{_judged("role")}"""


def _found(spark, sf_dir):
    """The distinct sentences of all documents as findings, written: each is read into an atom once."""
    spans = texts(spark, sf_dir, "text").select(F.explode(typed.patient_spans(F.col("text"))).alias("t")).distinct()
    return written(binding.findings(spans.withColumn("finding_id", content_id("S-", F.col("t"), 16)), ["finding_id"], "t"))


def _bound(spark, sf_dir):
    """The sentences as findings, the benchmark's items as criteria of four roles."""
    role = F.get(F.array(F.lit("diagnostic_criterion"), F.lit("clinical_feature"), F.lit("risk_factor"), F.lit("guideline")), (F.col("item_id") % 4).cast("int"))
    wanted = binding.criteria(table(spark, sf_dir, "benchmark").withColumn("role", role), ["item_id"], "text", "role")
    return _found(spark, sf_dir), written(wanted)


_FAILED = "array_to_string(list_filter(list_transform(list_zip(['observation_present', 'concept_compatible', 'criterion_satisfied', 'temporality_compatible', 'quantity_compatible'], [f_absent = c_absent, semantic, covered, NOT (role = 'diagnostic_criterion' AND f_tense = 'historical'), fits]), lambda z: CASE WHEN NOT z[2] THEN z[1] END), lambda x: x IS NOT NULL), ',')"


@query("clinical_atoms", f"""WITH s AS (SELECT list_distinct(list_filter({_parts("text", ";:")}, lambda x: len(x) >= 8)) AS spans FROM documents), found AS (SELECT DISTINCT unnest(spans) AS t FROM s)
SELECT 'S-' || substr(sha256(t), 1, 16) AS finding_id, CASE WHEN absent THEN 'absent' ELSE 'present' END AS polarity, tense AS temporality, done AS completed, len(tok)::INT AS n_tokens, len(pairs)::INT AS n_pairs, len(quantities)::INT AS n_quantities, len(spans)::INT AS n_ranges,
coalesce(quantities[1].v, -1) AS first_value, coalesce(quantities[1].o, '') AS op, coalesce(quantities[1].u, '') AS unit FROM {_atoms("found")}""")
def clinical_atoms(spark, sf_dir):
    """What each distinct sentence of the documents says: polarity, time, test state, tokens and quantities."""
    f, first = F.col("finding"), F.get("finding.quantities", F.lit(0))
    size = lambda n: F.size(f[n]).alias(f"n_{n}")
    return _found(spark, sf_dir).select("finding_id", f["polarity"].alias("polarity"), f["temporality"].alias("temporality"), f["completed"].alias("completed"), size("tokens"), size("pairs"), size("quantities"), size("ranges"), F.coalesce(first["value"], F.lit(-1.0)).alias("first_value"), F.coalesce(first["op"], F.lit("")).alias("op"), F.coalesce(first["unit"], F.lit("")).alias("unit"))


@query("typed_binding", f"WITH {_BOUND} SELECT finding_id, item_id, role, clause::INT AS clause, round(score, 6) AS score, {_FAILED} AS failed, {_FAILED} = '' AS admissible FROM b WHERE score >= 0.4 OR {_FAILED} = ''")
def typed_binding(spark, sf_dir):
    """Each sentence against each item with which it shares enough: the best clause, its score and the critical questions it fails."""
    bound = binding.bind(*_bound(spark, sf_dir), "finding_id", "item_id", least=binding.LEAST)
    failed = F.array_join(F.transform(F.filter("questions", lambda q: ~q["passed"]), lambda q: q["question"]), ",")
    return bound.select("finding_id", "item_id", "role", "clause", "score", failed.alias("failed"), "admissible")


@query("binding_options", f"""WITH {_BOUND}, o AS (SELECT *, {_FAILED} = '' AS admissible, array_position(['risk_factor', 'guideline', 'clinical_feature', 'diagnostic_criterion'], role) AS weight FROM b WHERE score >= 0.4 OR {_FAILED} = ''),
n AS (SELECT *, row_number() OVER (PARTITION BY role, item_id ORDER BY admissible DESC, semantic DESC, round(score, 6) DESC, weight DESC, finding_id, item_id) AS n FROM o)
SELECT * FROM (SELECT role, finding_id, item_id, admissible, round(score, 6) AS score, row_number() OVER (PARTITION BY role ORDER BY n > 1, admissible DESC, semantic DESC, round(score, 6) DESC, weight DESC, finding_id, item_id)::INT AS place FROM n) WHERE place <= 8""")
def binding_options(spark, sf_dir):
    """The eight best pairs of each role, every item first with its best sentence."""
    bound = binding.bind(*_bound(spark, sf_dir), "finding_id", "item_id", least=binding.LEAST)
    rows = bound.withColumn("node", F.col("item_id").cast("string"))
    return binding.ranked_options(rows, ["role"], "finding_id", "item_id", "node").select("role", "finding_id", "item_id", "admissible", "score", "place")


_LABEL = "array_to_string(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ')[1:2], ' ')"


def _subject(name: str) -> str:
    return f"list_filter({name}, lambda x: NOT list_contains({_among(A.POLARITY_ONLY)}, x))"


def _tests(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{_bounded('(?i)' + p)}') THEN '{n}' END" for n, p in typed.TEST_MODALITIES) + "], lambda x: x IS NOT NULL)"


_LABELLED = f"""l AS (SELECT item_id, {_LABEL} AS t FROM benchmark), la AS (SELECT item_id, tok AS label_tok FROM l JOIN {_atoms("l")} USING (t)),
p AS (SELECT *, {_FAILED} = '' AND role = 'diagnostic_criterion' AS executable, len(list_intersect({_subject("ftok")}, {_subject("ctok")})) > 0 AS subject, {_tests("finding")} AS own, {_tests("criterion")} AS asked, NOT f_absent AND f_tense <> 'historical' AS present FROM b JOIN la USING (item_id) WHERE score >= 0.4 OR {_FAILED} = '')"""


@query("binding_authority", f"""WITH {_BOUND}, {_LABELLED}
SELECT finding_id, item_id, CASE WHEN NOT executable THEN 'semantic_review' WHEN len(c_quantities) > 0 AND len(f_quantities) > 0 AND subject THEN 'exact_measurement'
WHEN len(own) > 0 OR len(asked) > 0 THEN CASE WHEN len(own) > 0 AND own = asked AND present AND f_done AND subject THEN 'exact_positive_test' ELSE 'semantic_review' END
WHEN f_absent AND c_absent AND subject THEN 'explicit_negation' WHEN present AND len(label_tok) > 0 AND len(list_intersect(label_tok, ftok)) = len(label_tok) AND regexp_matches(finding, '{_bounded(typed.ASSERTION)}') THEN 'explicit_current_diagnosis' ELSE 'semantic_review' END AS authority FROM p""")
def binding_authority(spark, sf_dir):
    """What decides each bound pair without review; an item's first two words are its diagnosis."""
    told = binding.assessed(*_bound(spark, sf_dir), "finding_id", "item_id", least=binding.LEAST)
    rows = told.join(_labels(spark, sf_dir), "item_id")
    return rows.select("finding_id", "item_id", typed.authority_of(F.col("finding"), F.col("criterion"), F.col("label"), F.col("role"), F.struct("admissible", "clause")).alias("authority"))


def _labels(spark, sf_dir):
    label = F.array_join(F.slice(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), 1, 2), " ")
    labels = written(table(spark, sf_dir, "benchmark").select("item_id", A.atom(label).alias("label")))
    # the pairs carry both sides' atoms: they stay where they are
    return F.broadcast(labels) if labels.count() <= binding.KEYS_SENT else labels


def _same(a: str, b: str) -> str:
    x, y = _subject(a), _subject(b)
    return f"len({x}) > 0 AND len({y}) > 0 AND len(list_intersect({x}, {y})) IN (len({x}), len({y}))"


@query("asserted_diagnoses", f"WITH {_BOUND}, {_LABELLED} SELECT finding_id, item_id, present AND NOT c_absent AND {_same('ftok', 'ctok')} AND {_same('ctok', 'label_tok')} AS asserted FROM p")
def asserted_diagnoses(spark, sf_dir):
    """Whether sentence, best clause and the item's first two words state one thing."""
    told = binding.assessed(*_bound(spark, sf_dir), "finding_id", "item_id", least=binding.LEAST)
    rows = told.join(_labels(spark, sf_dir), "item_id")
    return rows.select("finding_id", "item_id", typed.asserts_diagnosis_of(F.col("finding"), F.get("criterion", F.col("clause")), F.col("label")).alias("asserted"))


@query("family_shortlist", f"""WITH {_BOUND}, e AS (SELECT role, item_id, bool_or({_FAILED} = '') AS admissible, max(round(score, 6)) AS score, bool_or(c_absent) AS absence FROM b WHERE score >= 0.4 OR {_FAILED} = '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY role, item_id // 12 ORDER BY admissible DESC, score DESC, item_id) AS n FROM e WHERE NOT absence)
SELECT role, item_id, admissible, score, place FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n > 1, admissible DESC, score DESC, item_id)::INT AS place FROM n) WHERE place <= 3""")
def family_shortlist(spark, sf_dir):
    """The three items of each role that all sentences bind best; twelve neighbouring items are one node."""
    told = binding.assessed(*_bound(spark, sf_dir), "finding_id", "item_id", least=binding.LEAST)
    absence = F.get("criterion", F.col("clause"))["polarity"] == "absent"
    rows = told.select(F.col("role").alias("family"), "item_id", F.floor(F.col("item_id") / 12).alias("node"), "admissible", "score", absence.alias("absence"))
    return binding.shortlist(rows, [], "family", "item_id", "node").withColumnRenamed("family", "role")


_TESTED = r"(SELECT p_partkey, p_name, CASE p_type WHEN 'SMALL' THEN 'CT scan showed ' WHEN 'MEDIUM' THEN 'MRI ordered for ' WHEN 'LARGE' THEN 'biopsy confirmed no ' WHEN 'PROMO' THEN 'prior culture identified ' ELSE 'seen: ' END || p_name || ', ' || p_size || ' mm' AS finding, lead(p_name) OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS other FROM part)"


def _tested(spark, sf_dir):
    from pyspark.sql import Window

    said = F.when(F.col("p_type") == "SMALL", "CT scan showed ").when(F.col("p_type") == "MEDIUM", "MRI ordered for ").when(F.col("p_type") == "LARGE", "biopsy confirmed no ").when(F.col("p_type") == "PROMO", "prior culture identified ").otherwise("seen: ")
    other = F.lead("p_name").over(Window.partitionBy(F.floor(F.col("p_partkey") / 4)).orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.concat(said, "p_name", F.lit(", "), F.col("p_size").cast("string"), F.lit(" mm")).alias("finding"), other.alias("other"))


@query("family_tests", f"""WITH p AS (SELECT p_partkey, finding AS t, coalesce(other, p_name) AS label FROM {_TESTED}), f AS {_atoms("p")}, l AS (SELECT t AS lt, tok AS ltok FROM {_atoms("(SELECT label AS t FROM p)")}),
q AS (SELECT p_partkey, NOT absent AND tense <> 'historical' AND test AND done AS ready, len(list_filter(ltok, lambda a: len(list_filter(tok, lambda b: a = b OR (len(a) >= 6 AND len(b) >= 6 AND len(list_filter(range(5, 33), lambda k: a[:k] = b[:k])) > 0 AND greatest(len(a), len(b)) - list_max(list_filter(range(5, 33), lambda k: a[:k] = b[:k])) <= 4))) > 0))::DOUBLE / greatest(len(ltok), 1) AS part FROM p JOIN f USING (t) JOIN l ON label = lt)
SELECT p_partkey, ready AND part >= 0.75 AS admissible, CASE WHEN ready AND part >= 0.75 THEN 1.0::DOUBLE ELSE round(part, 6) END AS score FROM q""")
def family_tests(spark, sf_dir):
    """Test results that name a part, read for the next part's family."""
    t = typed.family_test(F.col("finding"), F.coalesce("other", "p_name"))
    return _tested(spark, sf_dir).select("p_partkey", t["admissible"].alias("admissible"), t["score"].alias("score"))


@query("range_binding", """WITH b AS (SELECT p_brand, min(p_size) AS low, floor(avg(p_size))::INT AS high, round(avg(p_retailprice), 1) AS price FROM part GROUP BY p_brand)
SELECT p_partkey, p_size BETWEEN low AND high AS in_range, p_retailprice > price AS above FROM part JOIN b USING (p_brand)""")
def range_binding(spark, sf_dir):
    """Each part's size and price, as prose, against its brand's range of sizes and mean price, as prose."""
    part = table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(F.min("p_size").alias("low"), F.floor(F.avg("p_size")).cast("int").alias("high"), F.round(F.avg("p_retailprice"), 1).alias("price"))
    plain = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    rows = part.join(brands, "p_brand").select("p_partkey", F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" mm today")).alias("size"), F.concat(F.lit("retail is "), plain("p_retailprice"), F.lit(" mg/dl")).alias("retail"), F.concat(F.lit("size of "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string"), F.lit(" mm")).alias("sizes"), F.concat(F.lit("retail above "), plain("price"), F.lit(" mg/dl")).alias("prices"))
    return rows.select("p_partkey", B.quantities_meet(F.col("size"), F.col("sizes")).alias("in_range"), B.quantities_meet(F.col("retail"), F.col("prices")).alias("above"))


@query("named_thresholds", """WITH b AS (SELECT p_brand, round(avg(p_size), 1) AS size, floor(avg(p_retailprice)) AS price FROM part GROUP BY p_brand)
SELECT p_partkey, p_size >= size AS large, floor(p_retailprice) < price AS low_sbp, p_size > floor(size) AS high_dbp FROM part JOIN b USING (p_brand)""")
def named_thresholds(spark, sf_dir):
    """Each part's size and price, in prose and as a blood pressure, against thresholds made of its brand's means."""
    part = table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 1).alias("size"), F.floor(F.avg("p_retailprice")).alias("price"))
    text = F.concat(F.lit("rested; size is "), F.col("p_size").cast("string"), F.lit(", BP: "), F.floor("p_retailprice").cast("string"), F.lit("/"), F.col("p_size").cast("string"))
    rows = part.join(brands, "p_brand").withColumn("text", text)
    plain = lambda c: c.cast("decimal(18,1)").cast("string")
    premise = {"large": F.concat(F.lit("unusual size >= "), plain(F.col("size"))), "low_sbp": F.concat(F.lit("low SBP < "), F.col("price").cast("string"), F.lit(" at rest")), "high_dbp": F.concat(F.lit("DBP > "), F.floor("size").cast("string"))}
    return rows.select("p_partkey", *[clinical.threshold_met(F.col("text"), p).alias(n) for n, p in premise.items()])


@query("canonical_ids", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'source-chunk:' ELSE 'candidate:' END || substr(sha256(coalesce(text, '')), 1, 17 + length(lang)::INT + (n_chars % 3)::INT) || CASE WHEN n_chars % 7 = 0 THEN chr(10) ELSE '' END AS id FROM documents)
SELECT doc_id, id, regexp_matches(id, '^source-chunk:[0-9a-f]{20}\z') AS is_source, regexp_matches(id, '^candidate:[0-9a-f]{20}\z') AS is_candidate FROM d""".replace("\\\\z", "\\z"))
def canonical_ids(spark, sf_dir):
    """Identifiers made of texts' digests, of several lengths and some with a line end: which have the right form."""
    d = table(spark, sf_dir, "documents")
    length = (17 + F.length("lang") + (F.col("n_chars") % 3)).cast("int")
    digest = F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.lit(1), length)
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "source-chunk:").otherwise("candidate:"), digest, F.when(F.col("n_chars") % 7 == 0, "\n").otherwise(""))
    return d.select("doc_id", name.alias("id")).select("doc_id", "id", typed.is_source_id(F.col("id")).alias("is_source"), typed.is_candidate_id(F.col("id")).alias("is_candidate"))


@query("cited_pairs", """WITH p AS (SELECT o_orderkey AS case_id, l_suppkey AS finding, l_partkey AS knowledge FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber // 3 AS claim, l_partkey AS k, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS f FROM lineitem),
k AS (SELECT DISTINCT p.case_id, claim, finding, knowledge, EXISTS (SELECT 1 FROM c d WHERE d.case_id = c.case_id AND d.claim = c.claim AND d.f = p.finding) AS both_cited FROM p JOIN c ON c.case_id = p.case_id AND c.k = p.knowledge),
t AS (SELECT *, bool_or(both_cited) OVER (PARTITION BY case_id, claim) AS strict FROM k)
SELECT case_id, claim, 'S-' || finding AS finding_id, 'K' || knowledge AS knowledge_id, CASE WHEN strict THEN 1 ELSE 2 END AS tier FROM t WHERE both_cited OR NOT strict""")
def cited_pairs(spark, sf_dir):
    """Lines of an order as pairs of supplier and part; claims cite parts, and suppliers only of returned or accepted lines."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_returnflag", F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("finding_id"), F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("knowledge_id"))
    pairs = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id")), "case_id").select("case_id", "finding_id", "knowledge_id").distinct()
    claim = F.floor(F.col("l_linenumber") / 3).alias("claim")
    cited = li.select("case_id", claim, F.col("knowledge_id").alias("evidence_id")).union(li.filter("l_returnflag <> 'N'").select("case_id", claim, F.col("finding_id").alias("evidence_id")))
    return binding.cited_pairs(pairs, cited, ["case_id"], "claim", "finding_id", "knowledge_id")
