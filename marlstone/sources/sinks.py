"""Writers: JSON lines, CSV, write-once, canonical JSON, manifests, artefact bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources import readers


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Overwrite or append; the committer makes either appear whole or not at all."""
    df.write.mode("append" if append else "overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Fail if anything is there already."""
    df.write.mode("errorifexists").format(kind).save(path)


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON of the columns with keys in order at every level of structs, and no blanks."""

    def ordered(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        return c

    fields = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[ordered(F.col(n), fields[n]).alias(n) for n in sorted(columns or fields)]), {"ignoreNullFields": "false"})


def bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables as CSV folders below ``path``, published together with a manifest of their files' digests."""
    publish(tables, path, "csv", header=True)


def manifest(df: DataFrame, path: str) -> None:
    """A run's manifest, one row, as one JSON file: written under another name and renamed over an older one, so readers see either, whole."""
    rows = df.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a manifest is one row")
    beside, _, name = path.rstrip("/").rpartition("/")
    _put(df.sparkSession, f"{beside}/.{name}-{uuid.uuid4().hex}", rows[0] + "\n", path)


#: Steps of ``publish`` in order; a test stops it after each.
STEPS = ("tables", "manifest", "pointer", "commit")


def publish(tables: dict[str, DataFrame], path: str, kind: str = "parquet", after=lambda step: None, **options) -> str:
    """Write the ``tables`` as a new version below ``path`` and make it the current one; returns the version's name.

    Tables go to a folder of their own, then a manifest of all files with lengths and digests, then a pointer file under another name,
    and at last one rename of that over ``CURRENT``.  Until then readers follow the old version, which is left as it is.
    ``after`` is called after each of ``STEPS``.
    """
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    version = f"{path.rstrip('/')}/versions/{name}"
    for t, df in tables.items():
        df.write.format(kind).options(**options).save(f"{version}/{t}")
    after("tables")
    listed = readers.digests(spark, version).filter(~F.col("path").rlike("/[._][^/]*$"))
    relative = F.regexp_replace("path", rf"^.*\Q/{name}/\E", "")
    listed.select(relative.alias("path"), "length", "sha256").coalesce(1).write.json(f"{version}/_manifest")
    after("manifest")
    staged = f"{path.rstrip('/')}/.{name}"
    _put(spark, staged, name)
    after("pointer")
    _rename(spark, staged, f"{path.rstrip('/')}/CURRENT")
    after("commit")
    return name


def _put(spark: SparkSession, path: str, text: str, then: str | None = None) -> None:
    """Write a small text to ``path`` and, if ``then`` is given, rename it over that."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if then is not None:
        _rename(spark, path, then)


def _rename(spark: SparkSession, path: str, over: str) -> None:
    """One rename of a file over another, which the store does whole or not at all."""
    jvm = spark._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, over))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(old, new, how)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version."""
    name = spark.read.text(f"{path.rstrip('/')}/CURRENT").first()["value"]
    return f"{path.rstrip('/')}/versions/{name}"


def published(spark: SparkSession, path: str, table: str, kind: str = "parquet", **options) -> DataFrame:
    """A table of the current version."""
    return spark.read.format(kind).options(**options).load(f"{current(spark, path)}/{table}")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the current version's files that are missing, not listed, or other than their manifest says."""
    version = current(spark, path)
    listed = spark.read.schema("path string, length long, sha256 string").json(f"{version}/_manifest")
    name = version.rsplit("/", 1)[-1]
    there = readers.digests(spark, version).filter(~F.col("path").rlike("/[._][^/]*$") & ~F.contains("path", F.lit("/_manifest/"))).select(F.regexp_replace("path", rf"^.*\Q/{name}/\E", "").alias("path"), F.col("length").alias("n"), F.col("sha256").alias("h"))
    both = listed.join(there, "path", "full")
    return both.filter(~(F.col("length").eqNullSafe(F.col("n")) & F.col("sha256").eqNullSafe(F.col("h")))).select("path")


def audit_log(rows: DataFrame, path: str) -> None:
    """Append rows to a log; each gets a ``request_id`` above all that are there, rising in the rows' order.

    Ids rise but leave gaps between partitions, so no task has to see all rows; one writer at a time.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.parquet(path).agg(F.max("request_id")).first()[0] if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    rows.withColumn("request_id", F.monotonically_increasing_id() + F.lit(0 if old is None else old + 1)).write.mode("append").parquet(path)


def markdown(df: DataFrame, columns: list[str], title: str) -> Column:
    """One Markdown row of a report for each row of ``df``; the report joins a bounded summary."""
    return F.concat(F.lit(f"{title} | "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]))


def sorted_table(df: DataFrame, path: str, key: str, files: int) -> None:
    """Parquet dealt by ``key`` and sorted in each file, so lookups skip row groups by their bounds."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
