"""Tables written between the steps of a long job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted with the application; only a local session may go without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not base:
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/steps-{app}-{uuid.uuid4().hex[:8]}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _ROOTS[app] = path.toString()
    return f"{_ROOTS[app]}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written and read again: what led to them is never run again, whichever executor is lost."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
