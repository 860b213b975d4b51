"""Sessions and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder made up where none is set.
_local: list[str] = []
#: Rows that a task sorts or groups where a table is dealt out by its size.
ROWS = 500_000


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("impactframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back, so that its
    lineage is cut by files that every executor can read."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="impactframe-"))
        folder = _local[0]
    path = f"{folder.rstrip('/')}/impactframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by its keys in so many tasks that none has much more than
    ``ROWS``; a table of fewer rows is left as it is."""
    if rows <= ROWS:
        return df
    return df.repartition(max(-(-rows // ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)
