"""Pieces shared by the training-data operators: word splitting, scratch tables, distributed ranks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources.readers import spread

#: Rows of one sorted run when ranks are made bucket by bucket.
RUN_ROWS = 1024
#: A relation is broadcast only if it was counted and has at most this many rows of bounded width.
BROADCAST_ROWS = 20_000
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_ROOTS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    An application's folders lie in one, which is deleted when its JVM ends.  Only a session on one
    machine may go without that setting; it then gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        root = f"{base.rstrip('/')}/marlstone-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _ROOTS[app] = root
    return f"{_ROOTS[app]}/{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends, rather than when the driver next collects garbage.

    Only for runs whose result is written or collected, which read no other run's shuffles.
    """
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


#: Scratch folders of each ``settled`` step that is under way, in this thread.
_STEPS = threading.local()


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns and delete the scratch tables made for it, which nothing else may read."""
    steps = _STEPS.__dict__.setdefault("open", [])
    steps.append([])
    try:
        df = build()
    except BaseException:
        _delete(spark, steps.pop())
        raise
    used = steps.pop()
    made = materialize(df)
    _delete(spark, used)
    return made


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files behind it are deleted at once, so a job of many steps needs the disk of one.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    if steps := _STEPS.__dict__.get("open"):
        steps[-1].append(path)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted rows are few; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal to each other; the right side's keys are dropped."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"__r_{k}"])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def rank_by_class(df: DataFrame, part: Sequence[str], order: Sequence[str], tie: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Add ``rank``: the 0-based place of each row within ``part`` by ``order``, then ``tie``.

    Rows are counted per class (``part`` + ``order``).  A class of more than ``run_rows`` rows is cut
    by a hash of ``tie`` into runs, so no window sorts an unbounded group; prefix sums over the class
    counts (one row per class or run) place the runs.  Within a large class the order is run, tie.
    """
    keys = [*part, *order]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = counts.filter(F.col("__n") > run_rows).withColumn("__runs", F.ceil(F.col("__n") / F.lit(run_rows)).cast("int")).drop("__n")
    hot = large.limit(1).count() > 0
    if hot:
        df = null_safe(df, large, keys, "left").withColumn("__run", F.pmod(F.xxhash64(F.col(tie)), F.coalesce(F.col("__runs"), F.lit(1))).cast("int")).drop("__runs")
        counts = df.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__n"))
        keys = [*keys, "__run"]
    before = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_last() for c in keys if c not in part]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys).orderBy(F.col(tie).asc_nulls_last())
    ranked = null_safe(df, offsets, keys).withColumn("rank", (F.col("__at") + F.row_number().over(inside) - 1).cast("long"))
    return ranked.drop("__at", "__run")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
