"""Loading rules: upserts on natural keys, child replacement, versions, links (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_id(*parts: str | Column) -> Column:
    """A deterministic id of 128 bits: md5 of the key's parts."""
    return F.md5(F.concat_ws("\u0001", *parts))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert_last_wins(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of updates replace those of equal keys; of several updates the last by `order`.

    Columns in `keep` (ids, creation times) stay as they are in the target where it has the key.
    """
    new = last_per_key(updates, keys, [F.desc_nulls_last(c) for c in order])
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
        new = new.join(old, keys, "left").select(*[F.coalesce(f"__old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return target.join(new, keys, "left_anti").unionByName(new.select(*target.columns))


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only rows of keys that the target lacks are added."""
    fresh = last_per_key(new, keys, [F.asc_nulls_last(c) for c in order]).join(target, keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both, new ones on top; null counts as empty unless both are."""
    rest = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(rest, new))


def upsert_coalesce_merge(target: DataFrame, updates: DataFrame, keys: list[str], map_cols: tuple[str, ...] = ()) -> DataFrame:
    """Values that the target has stay, gaps are filled; map columns are merged with the update's entries on top."""
    both = target.alias("t").join(updates.alias("u"), keys, "full_outer")
    out = []
    for c in target.columns:
        t, u = F.col(f"t.{c}"), F.col(f"u.{c}")
        if c in keys:
            out.append(F.col(c))
        elif c in map_cols:
            out.append(merge_maps(t, u).alias(c))
        else:
            out.append(F.coalesce(t, u).alias(c))
    return both.select(*out)


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All children of the given parents go, new ones come."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*children.columns))


def append_version(history: DataFrame, documents: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Documents become the versions after the key's last one, with the hash of their content."""
    last = history.groupBy(key).agg(F.max("version_no").alias("last"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    new = documents.withColumn("rn", rank).join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + F.col("rn")).alias("version_no"), F.sha2(content, 256).alias("canonical_hash"))
    return history.unionByName(new.select(*history.columns))


def link_documents(documents: DataFrame, files: DataFrame, shared_types: list[str]) -> DataFrame:
    """Each document's file: of the same type, its own project's first, other projects' only for shared types.

    documents (document_id, project_code, document_type), files (file_id, project_code, document_type).
    """
    f = files.select("file_id", F.col("project_code").alias("file_project"), "document_type")
    # one candidate for each (type, project) and one for each type is enough: both are the smallest id
    own = f.groupBy("document_type", F.col("file_project").alias("project_code")).agg(F.min("file_id").alias("own_file"))
    common = f.where(F.col("document_type").isin(shared_types)).groupBy("document_type").agg(F.min("file_id").alias("shared_file"))
    return documents.join(own, ["document_type", "project_code"], "left").join(common, "document_type", "left").select("document_id", "project_code", "document_type", F.coalesce("own_file", "shared_file").alias("file_id"))


def prune(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the given keys go."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def record_runs(runs: DataFrame) -> DataFrame:
    """One audit row a run with its final status; skipped runs count as completed."""
    return runs.withColumn("run_status", F.when(F.col("run_status") == "skipped", "completed").otherwise(F.col("run_status")))
