"""Hierarchies, families, argument graphs and terminology tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import lexical_key, look_up, qualifiers, term_key
from marlstone.sources.scratch import written


def path_distances(paths: DataFrame, path: str) -> DataFrame:
    """``a, b, distance``: the least distance of two labels on any root-to-leaf path, both ways round."""
    at = paths.select("path_id", F.posexplode(path).alias("i", "a"))
    other = at.select("path_id", F.col("i").alias("j"), F.col("a").alias("b"))
    return at.join(other, "path_id").filter("i <> j").groupBy("a", "b").agg(F.min(F.abs(F.col("i") - F.col("j"))).alias("distance"))


def hierarchy_score(distance: Column) -> Column:
    """1 for the same label, 3/4 for parent and child, 1/2 for more distant relatives, 0 for none."""
    return F.when(distance == 0, 1.0).when(distance == 1, 0.75).when(distance > 1, 0.5).otherwise(0.0)


def walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``root, node, depth, path`` for every node within ``depth`` steps of a root; ``edges`` is (parent, child)."""
    level = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.col("root").alias("path"))
    found = level
    for d in range(1, depth + 1):
        level = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(d).alias("depth"), F.concat_ws(" > ", "path", "child").alias("path"))
        found = found.unionByName(level)
    return found


def closure(edges: DataFrame) -> DataFrame:
    """``ancestor, node, distance``: every node below every other at any depth, by the fewest steps; ``edges`` is (parent, child).

    Paths double in each round, so a chain of n edges takes log n rounds, each written, until no new pair shows.
    A cycle is an error that names some of its nodes.
    """
    found = written(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")).distinct())
    size = found.count()
    while True:
        loop = found.filter("ancestor = node").select("node").limit(5).collect()
        if loop:
            raise ValueError(f"edges form a cycle through {sorted(r['node'] for r in loop)}")
        above, below = found.select("ancestor", F.col("node").alias("via"), F.col("distance").alias("a")), found.select(F.col("ancestor").alias("via"), "node", F.col("distance").alias("b"))
        longer = above.join(below, "via").select("ancestor", "node", (F.col("a") + F.col("b")).alias("distance"))
        found = written(found.union(longer).groupBy("ancestor", "node").agg(F.min("distance").alias("distance")))
        grown = found.count()
        if grown == size:
            return found
        size = grown


def tree_paths(edges: DataFrame) -> DataFrame:
    """``node, path, is_leaf``: the labels from the root to every node of a forest, whatever its depth; ``edges`` is (parent, child)."""
    up = closure(edges)
    steps = up.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False).alias("up"))
    paths = steps.select("node", F.concat(F.transform("up", lambda s: s["ancestor"]), F.array("node")).alias("path"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    every = paths.union(roots.select("node", F.array("node")))
    inner = edges.select(F.col("parent").alias("node")).distinct().withColumn("__p", F.lit(True))
    return every.join(inner, "node", "left").select("node", "path", F.col("__p").isNull().alias("is_leaf"))


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of two arrays."""
    least = F.least(F.size(low), F.size(high))
    differ = F.array_position(F.zip_with(F.slice(low, F.lit(1), least), F.slice(high, F.lit(1), least), lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.slice(low, F.lit(1), F.when(differ == 0, least).otherwise((differ - 1).cast("int")))


def shared_ancestors(rows: DataFrame, by: list[str], path: str) -> DataFrame:
    """``by..., prefix, label``: the longest prefix of all paths of a group, and its last label, null if there is none.

    All share what the first and the last in array order share, so the minimum and the maximum, which merge, are enough.
    """
    ends = rows.groupBy(*by).agg(F.min(path).alias("__low"), F.max(path).alias("__high"))
    prefix = common_prefix(F.col("__low"), F.col("__high"))
    return ends.select(*by, prefix.alias("prefix")).withColumn("label", F.try_element_at("prefix", F.lit(-1)))


def concepts(lines: DataFrame, languages: list[str], source_rank: dict[str, int]) -> DataFrame:
    """``concept, term, source, source_rank, preferred`` of terminology lines, one row a concept, term and source.

    ``lines`` has ``concept, language, source, term, is_preferred, file, line_no``.  Other languages and sources are left out; of
    several lines the last in the files' order says whether the term is preferred.
    """
    ranks = F.create_map(*[F.lit(x) for pair in source_rank.items() for x in pair])
    kept = lines.filter(F.col("language").isin(*languages)).withColumn("source_rank", F.try_element_at(ranks, F.col("source"))).filter("source_rank is not null")
    last = F.max_by(F.when(F.col("is_preferred") == "Y", 1).otherwise(0), F.struct("file", "line_no"))
    return kept.groupBy("concept", "term", "source", "source_rank").agg(last.alias("preferred"))


def rebuttals(claims: DataFrame, case: str, claim: str, score: str) -> DataFrame:
    """Edges between every two claims of a case, from the stronger to the weaker; a case has a few claims."""
    a = claims.select(case, F.col(claim).alias("source"), F.col(score).alias("s"))
    b = claims.select(case, F.col(claim).alias("target"), F.col(score).alias("t"))
    return a.join(b, case).filter((F.col("s") > F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("source") < F.col("target")))).select(case, "source", "target", F.lit("rebuts").alias("relation"))


def terminology(concepts: DataFrame) -> DataFrame:
    """Add ``key`` to (concept, term, source, source_rank, preferred); sorted inside partitions for lookup."""
    return concepts.withColumn("key", term_key(F.col("term"))).sortWithinPartitions("key")


def best_match(terms: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """The best term for each query's key: source rank, preferred first, longer, then alphabetical."""
    asked = queries.select(F.col(query).alias("query"), term_key(F.col(query)).alias("key")).distinct()
    order = Window.partitionBy("query").orderBy("source_rank", F.col("preferred").desc(), F.length("term").desc(), "term", "concept")
    return asked.join(terms, "key").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "key")


def aliases(terms: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` distinct terms of each concept, by their best source and preference."""
    g = terms.groupBy("concept", "term").agg(F.min("source_rank").alias("r"), F.max("preferred").alias("p"))
    order = Window.partitionBy("concept").orderBy("r", F.col("p").desc(), F.length("term"), "term")
    return g.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("concept", "term", "place")


# The category of a concept by its semantic type.
SEMANTIC_CATEGORY = {
    "Disease or Syndrome": "diagnosis",
    "Sign or Symptom": "clinical_finding",
    "Finding": "clinical_finding",
    "Diagnostic Procedure": "therapy_or_procedure",
    "Laboratory Procedure": "lab_or_measurement",
    "Laboratory or Test Result": "lab_or_measurement",
    "Body Part, Organ, or Organ Component": "anatomy",
}


def category(semantic_type: Column, vocabulary: Column, by_vocabulary: dict[str, str]) -> Column:
    """The category of the semantic type, else that of the source vocabulary, else null."""
    return F.coalesce(look_up(semantic_type, SEMANTIC_CATEGORY), look_up(vocabulary, by_vocabulary))


def diagnosis_keys(terms: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``label, diagnosis_key`` of the distinct labels: the best concept's id and the label's qualifiers, else the lexical key."""
    found = best_match(terms, labels, label).select("query", "concept")
    named = labels.select(F.col(label).alias("label")).distinct().join(found, F.col("label") == F.col("query"), "left")
    kept = qualifiers(F.col("label"))
    by_concept = F.concat(F.lit("cui:"), F.lower("concept"), F.when(F.size(kept) > 0, F.concat(F.lit("|mod:"), F.array_join(kept, ","))).otherwise(""))
    return named.select("label", F.when(F.col("concept").isNotNull(), by_concept).otherwise(lexical_key(F.col("label"))).alias("diagnosis_key"))


def expand(terms: DataFrame, candidates: DataFrame, key: str, candidate: str, limit: int = 5) -> DataFrame:
    """``key, term``: aliases of the concepts that a text's candidate terms name, without those that drop a qualifier of the candidate."""
    found = best_match(terms, candidates, candidate).select("query", "concept")
    wanted = candidates.select(key, F.col(candidate).alias("query")).distinct().join(found, "query")
    other = wanted.join(aliases(terms, limit).select("concept", "term"), "concept")
    kept = F.size(F.array_except(qualifiers(F.col("query")), qualifiers(F.col("term")))) == 0
    return other.filter(kept).select(key, "term").distinct()


def subset(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """All terms of the concepts that any wanted key names."""
    keys = wanted.select(term_key(F.col("wanted")).alias("key")).distinct()
    return terms.join(terms.join(keys, "key", "left_semi").select("concept").distinct(), "concept", "left_semi")
