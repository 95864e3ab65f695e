"""Shared scratch tables: cut lineage with files that every executor and the driver can read."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one on a single machine, the warehouse on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pactloom-{uuid.uuid4().hex}"


class Written(threading.local):
    """Paths of the scratch tables that this thread has written and that may still be there: of one run, where runs have a thread each."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


written = Written()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: a lost executor costs a task, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    written.paths.append(path)
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a scratch table that no later step reads."""
    delete(df.sparkSession, df.staged_path)


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if name in written.paths:
        written.paths.remove(name)


def drop_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the scratch tables this thread has written since `written` had `mark` entries, but for one."""
    for name in written.paths[mark:]:
        if name != keep.staged_path:
            delete(spark, name)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column: inputs may hold any names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
