"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Spark removes the shuffle files of a query at its end, rather than when the driver's heap is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a session has built once from a folder of tables: by application, folder, its state and a name.
built: dict[tuple, object] = {}


def materialize(df: DataFrame | Sequence[DataFrame], name: str) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back: a plan that uses a table several times reads it instead of
    computing it again. What was shuffled for it goes as soon as it is written. Where none is set: a temporary folder on a single machine, the warehouse on a cluster.

    Several frames of one schema are parts of one table: they are written one after another, so only one part's shuffle is on disk at a time.
    """
    parts = [df] if isinstance(df, DataFrame) else list(df)
    spark = parts[0].sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}/{name}"
    clean = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if clean is None else spark.conf.set(CLEANUP, clean)
    return spark.read.schema(parts[0].schema).parquet(path)


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], T]) -> T:
    """What `build` makes of the tables in a folder, made once a session and again when a file of the folder has changed.

    For written tables that several queries read: build should materialise them.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple((f.getPath().getName(), f.getModificationTime(), files.getContentSummary(f.getPath()).getLength()) for f in files.listStatus(at))
    key = (spark.sparkContext.applicationId, folder, state, name)
    if key not in built:
        built[key] = build()
    return built[key]  # type: ignore[return-value]
