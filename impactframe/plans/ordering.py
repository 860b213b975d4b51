"""Total order over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def total_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: place from 1 in the order of ``keys``, which must be unique. A
    range-partitioned sort gives places within partitions; one count for each partition
    gives the places before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before")
    )
    # one row a shuffle partition
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    place = F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return joined.withColumn(name, place.cast("long")).drop("_part", "_at", "_before")
