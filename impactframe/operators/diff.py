"""Snapshot comparison operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, status): added, removed, modified or unchanged, by a full outer join."""
    b = before.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    joined = b.join(a, keys, "full_outer")
    status = (
        F.when(F.col("_in_b").isNull(), "added")
        .when(F.col("_in_a").isNull(), "removed")
        .when(~F.col("_b").eqNullSafe(F.col("_a")), "modified")
        .otherwise("unchanged")
    )
    return joined.select(*keys, status.alias("status"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in order, as one aggregate without a sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*")


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """(keys, status) of keys that were added, removed or modified in any value; of rows
    with one key the last counts."""
    value = F.struct(*[F.col(v) for v in values])
    b = keep_last(before, keys, [F.col(order)]).withColumn("_v", value)
    a = keep_last(after, keys, [F.col(order)]).withColumn("_v", value)
    return snapshot_diff(b, a, keys, "_v").where("status <> 'unchanged'")


def file_diff(
    paths: DataFrame,
    before: DataFrame,
    after: DataFrame,
    item_changes: DataFrame,
    always_known: DataFrame,
) -> DataFrame:
    """(path, status, is_unknown) of changed paths from two snapshots of (path, hash).

    Neither has it: unknown, and an unknown file unless ``always_known`` lists the path.
    Equal hashes, or no item change: unchanged_structure_modified."""
    b = before.select("path", F.col("hash").alias("_b"))
    a = after.select("path", F.col("hash").alias("_a"))
    moved = item_changes.select("path").distinct().withColumn("_items", F.lit(True))
    known = always_known.select("path").distinct().withColumn("_known", F.lit(True))
    joined = paths.select("path").distinct().join(b, "path", "left").join(a, "path", "left")
    joined = joined.join(moved, "path", "left").join(known, "path", "left")
    neither = F.col("_b").isNull() & F.col("_a").isNull()
    status = (
        F.when(neither, "unknown")
        .when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when((F.col("_b") == F.col("_a")) | F.col("_items").isNull(), "unchanged_structure_modified")
        .otherwise("modified")
    )
    return joined.select("path", status.alias("status"), (neither & F.col("_known").isNull()).alias("is_unknown"))


def incremental_reuse(
    current: DataFrame, previous: DataFrame, changed: DataFrame, same_list: bool, same_root: bool
) -> DataFrame:
    """(path, decision) of an incremental index build: ``trusted`` without hashing if the
    path is not listed as changed and list and root are as before, ``reused`` if the hash
    is equal, ``reparsed`` otherwise, and ``removed`` for paths that are gone."""
    listed = changed.select("path").distinct().withColumn("_listed", F.lit(True))
    old = previous.select("path", F.col("hash").alias("_old"))
    joined = current.select("path", "hash").join(old, "path", "left").join(listed, "path", "left")
    trusted = F.col("_listed").isNull() & F.col("_old").isNotNull() & F.lit(same_list and same_root)
    decision = F.when(trusted, "trusted").when(F.col("_old") == F.col("hash"), "reused").otherwise("reparsed")
    gone = previous.select("path").join(current.select("path"), "path", "left_anti")
    return joined.select("path", decision.alias("decision")).unionByName(gone.withColumn("decision", F.lit("removed")))


def left_join_default(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """``df`` with the table's value, or a default where it has none."""
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, default))
