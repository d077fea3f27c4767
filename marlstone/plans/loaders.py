"""Queries that load annotated cases from JSON texts made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.sources import cases
from marlstone.plans.registry import query, table

_CASES = """(SELECT s_suppkey, r_name AS category, CASE WHEN s_suppkey % 4 = 0 THEN r_name ELSE n_name END AS directory, CASE WHEN s_suppkey % 5 = 0 THEN r_name WHEN s_suppkey % 7 = 0 THEN s_name ELSE n_name END AS conclusion, s_name, s_suppkey % 3 AS empty, s_acctbal < 0 AS loose
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _json(spark, sf_dir):
    """A case file for each supplier: its region and nation as folders, its columns as sections, its names as annotations."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    conclusion = F.when(k % 5 == 0, F.col("r_name")).when(k % 7 == 0, F.col("s_name")).otherwise(F.col("n_name"))
    folder = F.when(k % 4 == 0, F.col("r_name")).otherwise(F.col("n_name"))
    relative = F.concat_ws("/", "r_name", folder, F.concat(k.cast("string"), F.lit(".json")))
    leaf = F.concat(F.lit('{"'), "s_name", F.lit('  seen$Input2_3": {}}'))
    cause = F.concat(F.lit('{"because of '), k.cast("string"), F.lit('$Cause_1": '), leaf, F.lit(', "noted$Input5": '), F.when(F.col("s_acctbal") < 0, '"loose"').otherwise("{}"), F.lit("}"))
    sections = F.concat_ws(", ", *[F.concat(F.lit(f'"input{i}": "'), F.when((k % 3 == 0) & F.lit(i == 4), " ").otherwise(F.concat(F.lit(f"part {i} of "), "s_name")), F.lit('"')) for i in range(1, 7)])
    value = F.concat(F.lit("{"), sections, F.lit(', "'), conclusion, F.lit('$Intermedia_1": '), cause, F.lit("}"))
    nodes = place.select(F.col("r_name").alias("category"), F.col("n_name").alias("label"), F.lit(True).alias("is_leaf")).union(table(spark, sf_dir, "region").select(F.col("r_name"), F.col("r_name"), F.lit(False)))
    return s.select(relative.alias("relative"), value.alias("value")), nodes


_CLEAN = "lower(regexp_replace({}, '[^A-Za-z0-9]+', '', 'g'))"


@query("annotated_cases", f"""WITH c AS (SELECT *, {_CLEAN.format('conclusion')} = {_CLEAN.format('directory')} AS same FROM {_CASES})
SELECT category || '/' || directory || '/' || s_suppkey || '.json' AS relative, category AS disease_category, CASE WHEN same THEN directory ELSE conclusion END AS gold_label, CASE WHEN empty = 0 THEN 5 ELSE 6 END AS sections,
array_to_string(list_filter([CASE WHEN conclusion = s_name THEN 'conclusion_outside_category_graph' WHEN conclusion = category THEN 'conclusion_not_leaf' END, CASE WHEN NOT same THEN 'directory_conclusion_mismatch' END, CASE WHEN empty = 0 THEN 'empty_input_section' END], lambda x: x IS NOT NULL), ',') AS flags,
CASE WHEN loose THEN 'children are no object (length=12 sha256=' || substr(sha256('noted$Input5'), 1, 12) || ')' ELSE '' END AS problems FROM c""")
def annotated_cases(spark, sf_dir):
    """Cases with their gold label, flags and problems."""
    loaded = cases.cases(*_json(spark, sf_dir))
    return loaded.select("relative", "disease_category", "gold_label", F.size("sections").alias("sections"), F.array_join("quality_flags", ",").alias("flags"), F.array_join("problems", ",").alias("problems"))


@query("annotation_edges", f"""WITH c AS (SELECT *, 'case-' || substr(sha256(category || '/' || directory || '/' || s_suppkey || '.json'), 1, 12) AS case_id FROM {_CASES})
SELECT case_id, case_id || e.source AS source, case_id || e.target AS target, 'supports' AS relation FROM c, (VALUES (':a0002', ':a0001'), (':a0003', ':a0002'), (':a0004', ':a0001')) e(source, target)""")
def annotation_edges(spark, sf_dir):
    """Each annotation supports its parent, whatever the depth."""
    return cases.annotations(cases.annotation_tree(cases.named_cases(_json(spark, sf_dir)[0])))[1]
