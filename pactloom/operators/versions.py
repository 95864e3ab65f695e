"""A table as numbered versions with commit marks: readers see the last committed one, a writer that is lost leaves no trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Versions of one table below a folder; a version counts once its mark is there, a file made in one step."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        marks = self.at(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(marks)) if self.files.exists(marks) else []

    def read(self, empty: DataFrame | None = None) -> DataFrame | None:
        """The last committed version; `empty` where there is none."""
        done = self.committed()
        return self.spark.read.parquet(f"{self.path}/version-{done[-1]}") if done else empty

    def write(self, df: DataFrame, version: int) -> None:
        """Write a version, over what a lost writer may have left of it."""
        df.write.mode("overwrite").parquet(f"{self.path}/version-{version}")

    def commit(self, version: int, keep: int = 2) -> None:
        """Mark a version as committed and drop all but the last `keep`."""
        self.files.create(self.at(f"{self.path}/commits/{version}"), True).close()
        for old in self.committed()[:-keep]:
            self.files.delete(self.at(f"{self.path}/version-{old}"), True)


def row_hash(df: DataFrame, key: str) -> DataFrame:
    """(key, h): a hash of all other columns, nulls and their places included."""
    parts = [F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(F.col(f"`{c}`")))), F.lit("-")) for c in sorted(df.columns) if c != key]
    return df.select(F.col(f"`{key}`").alias("key"), F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\n"), b), parts, F.lit("")), 256).alias("h"))


def change_set(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of each key of either table: inserted, changed, same or gone. Keys are unique; null keys are left out."""
    a, b = row_hash(old, key).withColumnRenamed("h", "was"), row_hash(new, key).withColumnRenamed("h", "now")
    kind = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return a.where("key IS NOT NULL").join(b.where("key IS NOT NULL"), "key", "full").select("key", kind.alias("change"))


def replace_table(table: Versions, new: DataFrame, key: str, prune: bool = True, dry_run: bool = False) -> dict[str, int]:
    """Put new rows in the place of the table's and tell seen, written, inserted, changed, same and gone.

    Rows that are gone go, or stay without prune. The next version is written beside the present one and then committed in one step; a dry run
    stops before it writes. A run that is repeated writes nothing.
    """
    old = table.read(new.limit(0))
    counts = {r["change"]: r["n"] for r in change_set(old, new, key).groupBy("change").agg(F.count("*").alias("n")).collect()}
    told = {k: counts.get(k, 0) for k in ("inserted", "changed", "same", "gone")}
    told = {"seen": told["inserted"] + told["changed"] + told["same"], "written": told["inserted"] + told["changed"], **told}
    done = table.committed()
    if not dry_run and (told["written"] or (prune and told["gone"]) or not done):
        rows = new if prune else new.unionByName(old.join(new.select(key), key, "left_anti").select(new.columns))
        version = done[-1] + 1 if done else 0
        table.write(rows, version)
        table.commit(version)
    return told
