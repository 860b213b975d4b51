"""Grouping operators. Quantifiers over no rows: ``all`` holds, ``any`` does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every(test: Column) -> Column:
    return F.coalesce(F.bool_and(test), F.lit(True))


def some(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def collect_sorted(value: Column) -> Column:
    """Distinct values of a group in order."""
    return F.array_sort(F.collect_set(value))


def merge_ranges(changes: DataFrame) -> DataFrame:
    """(path, ranges) with one row a path; rows without ranges keep an empty array, rows
    with an empty path go."""
    exploded = changes.where("path <> ''").select("path", F.explode_outer("ranges").alias("range"))
    valid = (F.col("range.start_line") > 0) & (F.col("range.end_line") >= F.col("range.start_line"))
    return exploded.groupBy("path").agg(collect_sorted(F.when(valid, F.col("range"))).alias("ranges"))


def grouped_arguments(df: DataFrame, keys: list[str], value: str, flag: str = "-p") -> DataFrame:
    """(keys, args): ``flag value`` for every distinct value of a group, in order."""
    pairs = F.flatten(F.transform(collect_sorted(F.col(value)), lambda v: F.array(F.lit(flag), v)))
    return df.groupBy(*keys).agg(pairs.alias("args"))


def all_or_none(df: DataFrame, keys: list[str], owner: str, value: str) -> DataFrame:
    """Groups with their sorted values, or no group at all if any row has no owner."""
    flag = df.agg(every(F.col(owner).isNotNull()).alias("_ok"))
    grouped = df.groupBy(*keys).agg(collect_sorted(F.col(value)).alias(value))
    return grouped.join(F.broadcast(flag.where("_ok")), how="cross").drop("_ok")


def flag_merge(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """One row a key, the flag set if any row has it."""
    return df.groupBy(*keys).agg(some(F.col(flag)).alias(flag))


def argmax(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """The value of each group's greatest order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_by_priority(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """One row a key from the first source that has it; within a source the first."""
    ranked = None
    for k, source in enumerate(sources):
        marked = source.withColumn("_source", F.lit(k))
        ranked = marked if ranked is None else ranked.unionByName(marked)
    window = Window.partitionBy(*keys).orderBy("_source", *order)
    return ranked.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn", "_source")


def totals(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Sum of a group's values, 0 where it has none."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name))


def replace_partition(df: DataFrame, wide: DataFrame, key: str, made: DataFrame) -> DataFrame:
    """``df`` without the rows of keys in ``wide``, and the rows made for those keys."""
    return df.join(wide.select(key).distinct(), key, "left_anti").unionByName(made, allowMissingColumns=True)


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as one aggregate without a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select(*keys, "_row.*")
