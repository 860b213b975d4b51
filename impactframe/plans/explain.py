"""Explanation rows: why a node is selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..session import dealt


def chains(edges: DataFrame, closure: DataFrame, commands: DataFrame) -> DataFrame:
    """(from, relationship, to): direct dependents of each seed, all edges inside its
    closure, and the commands that run each node."""
    seeds = closure.select(F.col("seed").alias("dst")).distinct()
    direct = edges.join(seeds, "dst", "left_semi").select("src", "dst").distinct().select(
        F.col("src").cast("string").alias("from"), F.lit("direct dependent").alias("relationship"), F.col("dst").cast("string").alias("to")
    )
    # kinds differ, so rows are made distinct by kind, as nodes and not as their texts
    inner = dealt(graph.induced_edges(edges, closure).select("src", "dst"), edges.count(), "src", "dst").distinct().select(
        F.col("src").cast("string").alias("from"), F.lit("reverse dependency").alias("relationship"), F.col("dst").cast("string").alias("to")
    )
    run = closure.select("node").distinct().join(commands, "node").select("node", "command").distinct().select(
        F.col("node").cast("string").alias("from"), F.lit("selected by").alias("relationship"), F.col("command").alias("to")
    )
    return direct.unionByName(inner).unionByName(run)


def discovery_edges(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(seed, node, level, via): for every reached node the least neighbour one step nearer
    to the seed, with ``edges(src, dst)`` walked from src to dst."""
    near = levels.select("seed", F.col("node").alias("src"), (F.col("level") + 1).alias("level"))
    step = levels.join(edges, levels["node"] == edges["dst"]).select("seed", "node", "level", "src")
    via = step.join(near, ["seed", "src", "level"]).groupBy("seed", "node", "level").agg(F.min("src").alias("via"))
    return levels.join(via, ["seed", "node", "level"], "left")
