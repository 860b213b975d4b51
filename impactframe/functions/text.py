"""Line- and JSON-shaped text as rows and Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines without a last empty one and without carriage returns."""
    parts = F.split(text, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda line: F.regexp_replace(line, "\r$", ""))


def stripped(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def numbered_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no from 1, line)."""
    exploded = df.select(*keys, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    return exploded.withColumn("line_no", F.col("line_no") + 1)


def carry_forward(lines: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """``lines`` with the last non-null ``value`` at or before each line."""
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(order))


def coalesce_keys(json: Column, *keys: str, kind: str = "bigint") -> Column:
    """First of several keys of a JSON object that has a value."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}").cast(kind) for k in keys])


def json_block(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without both in that order."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def normalize_ranges(ranges: Column) -> Column:
    """Distinct valid ranges (start above 0, end not before start), sorted, not merged."""
    valid = F.filter(ranges, lambda r: (r["start_line"] > 0) & (r["end_line"] >= r["start_line"]))
    return F.array_sort(F.array_distinct(valid))


def fingerprint(*values: Column, separator: str = "\x00") -> Column:
    """Digest of a set of texts, whatever their order, as an aggregate."""
    (value,) = values
    return F.sha2(F.array_join(F.array_sort(F.collect_list(value)), separator), 256)
