"""Decision operators: precedence, ladders, widening and self-checks over flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import every

#: Module commands for each selected package before a whole package is run instead.
MODULE_COMMANDS_PER_PACKAGE = 8


def rule_precedence(matches: DataFrame, path: str, selection: str) -> DataFrame:
    """(path, is_inert, n_rules): inert only if every matching rule is ``ignore``."""
    return matches.groupBy(path).agg(
        every(F.col(selection) == "ignore").alias("is_inert"), F.count("*").alias("n_rules")
    )


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """Label of the first step whose test holds; a null test does not."""
    column = None
    for test, label in steps:
        sure = F.coalesce(test, F.lit(False))
        column = F.when(sure, label) if column is None else column.when(sure, label)
    return F.lit(otherwise) if column is None else column.otherwise(otherwise)


def capped(
    commands: DataFrame, packages: str | Column, limit: int = MODULE_COMMANDS_PER_PACKAGE, keys: list[str] | None = None
) -> DataFrame:
    """One row, or one for each of ``keys``: commands, packages, and whether there are more
    than ``limit`` commands for each package (one at least)."""
    return commands.groupBy(*(keys or [])).agg(F.count("*").alias("n_commands"), F.count_distinct(packages).alias("n_packages")).withColumn(
        "over_cap", F.col("n_commands") > F.lit(limit) * F.greatest(F.lit(1), F.col("n_packages"))
    )


def self_check(expected: DataFrame, selected: DataFrame, groups: list[str], member: list[str]) -> DataFrame:
    """(groups, n_expected, n_selected, n_missing, result): of what each group expects, what
    the selection has; ``widened`` if anything is missing, else ``ok``."""
    marked = expected.join(selected.select(*member).distinct().withColumn("_in", F.lit(1)), member, "left")
    return (
        marked.groupBy(*groups)
        .agg(
            F.count("*").alias("n_expected"),
            F.count("_in").alias("n_selected"),
            F.count_if(F.col("_in").isNull()).alias("n_missing"),
        )
        .withColumn("result", F.when(F.col("n_missing") > 0, "widened").otherwise("ok"))
    )


def widen_unmatched(commands: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Commands with ``mode`` after validation by the tests that each matched: a module
    command without a match becomes a package command, or a workspace one without a
    package."""
    counted = matches.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = commands.join(counted, keys, "left")
    empty = (F.col("mode") == "module") & (F.coalesce("_n", F.lit(0)) == 0)
    mode = F.when(empty & F.col("package").isNotNull(), "package").when(empty, "workspace_wide").otherwise(F.col("mode"))
    return joined.withColumn("n_matched", F.coalesce("_n", F.lit(0)).cast("long")).withColumn("mode", mode).drop("_n")


def fail_wide(workspaces: DataFrame, reason: str, when: DataFrame | None = None) -> DataFrame:
    """One whole-workspace command for every workspace, under a one-row condition."""
    out = workspaces.select("workspace").distinct().select(
        "workspace", F.lit("workspace_wide").alias("mode"), F.lit(reason).alias("reason")
    )
    return out if when is None else out.join(F.broadcast(when.where("failed").select("failed").limit(1)), how="cross").drop("failed")
