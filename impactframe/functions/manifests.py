"""Changed manifest lines by the table they stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classes import INERT_MANIFEST_KEYS
from .text import carry_forward, numbered_lines, stripped


def changed_lines(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line_no, line, table, is_header, changed) of the lines of ``files(path,
    content)``; ``ranges(path, start_line, end_line)`` are the changed ones."""
    lines = numbered_lines(files.where("content is not null"), "content", "path").withColumn("line", stripped(F.col("line")))
    header = F.startswith(F.col("line"), F.lit("[")) & F.endswith(F.col("line"), F.lit("]"))
    name = stripped(F.regexp_replace("line", r"^\[+|\]+$", ""))
    carried = carry_forward(lines, F.when(header, name), "table", "path").withColumn("table", F.coalesce("table", F.lit("")))
    hit = ranges.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    return carried.withColumn("is_header", header).join(hit.withColumn("changed", F.lit(True)), ["path", "line_no"], "left").withColumn(
        "changed", F.coalesce("changed", F.lit(False))
    )


def change_kind(table: Column, line: Column) -> Column:
    return (
        F.when(
            (table == "features")
            | F.endswith(table, F.lit(".features"))
            | (F.contains(line, F.lit("features")) & F.contains(line, F.lit("="))),
            "features",
        )
        .when(
            F.startswith(table, F.lit("target.")) & F.contains(table, F.lit("dependencies")),
            "target_specific_dependencies",
        )
        .when((table == "profile") | F.startswith(table, F.lit("profile.")), "profiles")
        .when(
            (table == "workspace")
            | F.startswith(table, F.lit("workspace."))
            | F.contains(line, F.lit("workspace = true")),
            "workspace_inheritance",
        )
        .otherwise("manifest_other")
    )


def keeps_inert(table: Column, line: Column, is_header: Column) -> Column:
    """Whether a changed line leaves the manifest's meaning as it was."""
    metadata = F.startswith(table, F.lit("package.metadata"))
    key = stripped(F.substring_index(line, "=", 1))
    return F.when(is_header, (table == "package") | metadata).otherwise(
        metadata | ((table == "package") & key.isin(INERT_MANIFEST_KEYS))
    )


#: The kinds of a manifest change whose lines are not known.
UNKNOWN_KINDS = [
    "features", "manifest_other", "profiles", "target_specific_dependencies", "workspace_inheritance",
]


def manifest_changes(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, kinds, is_inert) of changed manifests. ``changes(path, ranges)``; without
    ranges or content all kinds are possible and the edit is not inert."""
    ranges = changes.select("path", F.explode("ranges").alias("r")).select("path", "r.start_line", "r.end_line")
    lines = changed_lines(contents.join(changes.select("path"), "path", "left_semi"), ranges).where("changed")
    told = lines.groupBy("path").agg(
        F.array_sort(F.collect_set(change_kind(F.col("table"), F.col("line")))).alias("kinds"),
        F.bool_and(keeps_inert(F.col("table"), F.col("line"), F.col("is_header"))).alias("is_inert"),
    )
    readable = contents.where("content is not null").select("path", F.lit(True).alias("_has"))
    joined = changes.join(readable, "path", "left").join(told, "path", "left")
    blind = F.col("_has").isNull() | (F.size("ranges") == 0)
    return joined.select(
        "path",
        F.when(blind, F.lit(UNKNOWN_KINDS)).otherwise(F.coalesce("kinds", F.array(F.lit("manifest_other")))).alias("kinds"),
        F.when(blind, False).otherwise(F.coalesce("is_inert", F.lit(True))).alias("is_inert"),
    )
