"""Reports as JSON and text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .affected import Index, Report, affected, dependency_edges
from .explain import discovery_edges

SCHEMA_VERSION = 1


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a small table, in the order of their text."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True))


def as_dict(report: Report) -> dict:
    tables = ("explanations", "files", "items", "packages", "workspaces", "commands", "checks", "chains")
    shown = {t: _rows(getattr(report, t)) for t in tables}
    shown["package_reasons"] = _rows(report.package_reasons)
    shown["rules"] = [r.asDict(recursive=True) for r in report.rules.collect()]  # in their own order
    return {"schema_version": SCHEMA_VERSION, **report.summary, **shown}


def as_text(summary: dict) -> str:
    """``key: value`` lines; lists by their length."""
    shown = {k: len(v) if isinstance(v, list) else v for k, v in summary.items()}
    return "\n".join(f"{k}: {str(v).lower() if isinstance(v, bool) else '-' if v is None else v}" for k, v in shown.items())


def explain_path(index: Index, path: str, **options) -> dict:
    """Why a change of ``path`` selects what it does."""
    changes = index.spark.createDataFrame([(path, [])], "path string, ranges array<struct<start_line int, end_line int>>")
    report = affected(index, changes, **options)
    whole = as_dict(report)
    reasons = {c["reason"] for c in whole["commands"]} | {w["reason"] for w in whole["workspaces"] if w["failed_wide"]}
    return {
        "subject": {"path": path}, "explanations": whole["explanations"], "chains": whole["chains"],
        "commands": whole["commands"], "widening_reasons": sorted(r for r in reasons if r),
    }


def explain_package(index: Index, name: str) -> dict:
    """Packages that depend on ``name``, by distance and with the edge that led to each; the
    name must be that of exactly one package."""
    found = index["packages"].where(F.col("name") == name).select("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} package is called {name}")
    edges = dependency_edges(index).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    seeds = index.spark.createDataFrame([(found[0]["id"],)], "seed string")
    names = index["packages"].select(F.col("id").alias("node"), "workspace", "name")
    via = index["packages"].select(F.col("id").alias("via"), F.col("name").alias("via_name"))
    steps = discovery_edges(edges, graph.bfs_levels(edges, seeds)).join(names, "node").join(via, "via", "left")
    return {"subject": {"package": name}, "chains": _rows(steps.select("workspace", "name", "level", "via_name"))}
