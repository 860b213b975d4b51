"""Connected components of an edge table by alternating large-star and small-star steps.

Up to ``DRIVER_EDGES`` edges, once counted, are merged on the driver instead, where each takes
16 bytes: a step over a small table costs its tasks alone. Beyond that each step is a partial aggregation (least neighbour of a node) and a join back; every
round is written to the shared folder, so lineage stays short. Least neighbours are written
before the join back, so that both its sides are plain shuffles: adaptive execution then
splits the rows of a star's centre, however large, over several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, release

MAX_ROUNDS = 60
#: Edges that may be merged on the driver.
DRIVER_EDGES = 1_000_000


def _merged(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """(node, component) of the edges (u, v): roots are hooked to their least neighbour's
    root until no edge has two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while not np.array_equal(further := root[root], root):
            root = further
    return pa.table({"node": nodes, "component": nodes[root]})


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step over edges (u > v). Large: every larger neighbour of u is linked to the
    least of u and its neighbours; small: u and its smaller neighbours are. Also returns
    the table of least neighbours, to be released."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    out = out.where("u <> v")
    return (out if large else out.distinct()), least


def connected_components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, component) for the nodes of ``edges(u, v)``; the component is its least node.

    Self-loops and edges with a null end are ignored; repeated edges count once. With
    ``steps`` the work ends after so many: nodes of one label are connected, but connected
    nodes may have several labels (on the driver they are merged to the end)."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if edges.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        known = edges.toArrow()
        ends = [known[c].to_numpy().astype(np.int64) for c in ("u", "v")]
        return edges.sparkSession.createDataFrame(_merged(*ends), "node long, component long")
    current = durable(edges.distinct())
    mark = None
    for done in range(MAX_ROUNDS):
        larger, least = _star(current, True)
        step, smaller = _star(larger, False)
        step = durable(step)
        release(least)
        release(smaller)
        seen = step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        release(current)
        current = step
        if seen == mark or done + 1 == steps:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    if steps is not None:
        current = current.groupBy("u").agg(F.min("v").alias("v"))
        roots = current.select("v").distinct().join(current.select(F.col("u").alias("v")), "v", "left_anti")
    else:
        roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
