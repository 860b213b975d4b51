"""A change feed as a stream: each micro-batch of changes is answered on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.groups import merge_ranges
from ..plans.affected import Index, Report, affected


def change_feed(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of change rows from JSON lines files that are put into a folder."""
    return spark.readStream.schema(schemas.CHANGES).option("maxFilesPerTrigger", max_files).json(folder)


def answer_feed(
    feed: DataFrame, index: Index, sink: Callable[[Report, int], None], checkpoint: str, **options
) -> StreamingQuery:
    """Start a query that gives ``sink`` a report for every batch with changes. The batch
    number lets a sink write a repeated batch only once."""

    def answer(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(affected(index, batch, **options), number)

    return feed.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()


def merged_feed(feed: DataFrame, table: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that gives ``table`` each batch's changes with one row a path."""
    return (
        feed.writeStream.foreachBatch(lambda batch, number: table(merge_ranges(batch), number))
        .option("checkpointLocation", checkpoint)
        .start()
    )
