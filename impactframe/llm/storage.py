"""Durable intermediate tables and size-checked broadcasts.

Lineage is cut by writing Parquet under the folder that the session names in
``spark.checkpoint.dir``, which every executor can read, so a lost executor never
loses an intermediate result. A folder is made up only where the setting is absent,
and then only for a local master.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one narrow (id-like) table that may be broadcast after it has been counted.
BROADCAST_ROWS = 500_000

_written: dict[str, list[str]] = {}
_local: dict[str, str] = {}
#: Paths written since the innermost ``settled`` of this thread began.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, else a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "" not in _local:
        _local[""] = tempfile.mkdtemp(prefix="impactframe-")
    return _local[""]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame over what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/impactframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The DataFrame that ``make`` returns, as ``durable`` has it. The tables that ``make`` wrote
    on the way to it are deleted, so no other DataFrame may read them."""
    outer, own = _scope.get(), []
    token = _scope.set(own)
    try:
        out = durable(make())
    finally:
        _scope.reset(token)
    *before, last = own
    _delete(out.sparkSession, before)
    if outer is not None:
        outer.append(last)
    return out


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    own = _written.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in own:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            own.remove(path)


def release(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that no later plan reads."""
    spark = df.sparkSession
    own = _written.get(spark.sparkContext.applicationId, [])
    files = df.inputFiles()[:1]
    _delete(spark, [path for path in own if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files)])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow, already written table only if it has at most
    ``rows`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def barrier() -> Column:
    """A number, never negative, for a column of the select that computes costly columns.
    A filter that also asks for ``>= 0`` of it is not pushed below that select, where the
    optimiser would put the costly expressions into the condition."""
    return F.monotonically_increasing_id()


def map_batches(df: DataFrame, function: Callable[[Iterable], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package's folder on the workers' path, for sessions whose
    workers would not find it otherwise."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    path = environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))
    owner = function.__module__
    return df.mapInArrow(lambda batches: _in_worker(owner, function, batches), schema)


#: What operators keep in a Python worker for its later tasks.
_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The cache of one operator in this Python worker. Those of other operators are
    dropped, so that workers which serve several do not add them up."""
    for other in [name for name in _caches if name != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})


def _in_worker(owner: str, function: Callable[[Iterable], Iterator], batches: Iterable) -> Iterator:
    worker_cache(owner)
    try:
        yield from function(batches)
    finally:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
