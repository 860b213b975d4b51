"""Graph operators by frontier iteration; safe on cycles.

Each step joins the frontier to the edges, makes the targets distinct and takes away what
was visited before; tables are written to the checkpoint folder so that lineage stays
short and a lost executor costs no recomputation of earlier steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, durable

MAX_STEPS = 10_000
COMPACT_STEPS = 16


def bfs_levels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, level): nodes reached from each seed along ``edges(src, dst)``, with the
    least number of steps; a seed reaches itself in none."""
    return reached_levels(edges, seeds.select("seed", F.col("seed").alias("node")))


def reached_levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(seed, node, level) from ``starts(seed, node)``: nodes reached from any start of a
    seed. A seed may be a label of many starts, which are then walked as one."""
    edges = durable(edges.select("src", "dst").where("src <> dst").distinct())
    n = edges.count()  # from the files' footers
    frontier = durable(starts.select("seed", "node").distinct().withColumn("level", F.lit(0)))
    reached = frontier
    for level in range(1, MAX_STEPS):
        met = frontier.join(dealt(edges, n, "src"), F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
        frontier = durable(
            dealt(met, n, "seed", "node")
            .distinct()
            .join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
            .withColumn("level", F.lit(level))
        )
        if frontier.isEmpty():
            return reached
        # what was reached stays in the files of its step; now and then they become one
        reached = reached.unionByName(frontier)
        if level % COMPACT_STEPS == 0:
            reached = durable(reached)
    raise RuntimeError("the graph is deeper than MAX_STEPS")


def reverse_closure(dependencies: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): what depends on each seed, directly or not, itself included.
    ``dependencies(src, dst)``: src depends on dst."""
    backward = dependencies.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs_levels(backward, seeds).select("seed", "node")


def induced_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(seed, src, dst): edges with both ends in one seed's closure. The edges are counted, to
    give each task a bounded number of them."""
    n = edges.count()
    src = closure.select("seed", F.col("node").alias("src"))
    dst = closure.select("seed", F.col("node").alias("dst"))
    out = dealt(edges.select("src", "dst"), n, "src").join(src, "src")
    return dealt(out, n, "seed", "dst").join(dst, ["seed", "dst"]).select("seed", "src", "dst").distinct()


def closure_difference(dependencies: DataFrame, tests: DataFrame, production: DataFrame) -> DataFrame:
    """Nodes that only test seeds reach: the closure of ``tests(seed)`` without the closure
    of ``production(seed)`` and without the test seeds themselves."""
    backward = dependencies.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    side = lambda seeds, label: seeds.select(F.lit(label).alias("seed"), F.col("seed").alias("node"))
    reached = reached_levels(backward, side(tests, "t").unionByName(side(production, "p")))
    return (
        reached.groupBy("node")
        .agg(F.bool_or(F.col("seed") == "p").alias("p"), F.min("level").alias("level"))
        .where("not p and level > 0")
        .select("node")
    )
