"""The index: built from a repository, updated in part, saved and loaded as Parquet."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__, schemas
from ..operators import diff, groups, joins
from ..session import durable
from ..sources import listings, scan
from ..sources.rust import RustSyntaxError, parse
from .affected import Index

_PARSED = "path string, error string, body string"


def _identity(*parts: str) -> str:
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def _parse_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One JSON body of rows for each file; a file that cannot be read has an error."""
    for batch in batches:
        out = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                out.append((path, None, json.dumps(file_rows(path, text or ""))))
            except RustSyntaxError as error:
                out.append((path, str(error), None))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "error", "body"])


def file_rows(path: str, text: str) -> dict:
    """Index rows of one source file."""
    found = parse(text, path)
    file_id = _identity("file", path)
    ids: dict[int, str] = {}
    items, edges = [], []
    for i in found.items:
        line, column, end_line, end_column = i["span"]
        ids[id(i)] = item_id = _identity("item", path, i["kind"], i["name"], str(line), str(column))
        parent = ids[id(i["parent"])] if i["parent"] is not None else None
        items.append({
            "item_id": item_id, "file_id": file_id, "kind": i["kind"], "name": i["name"], "visibility": i["visibility"],
            "span": {"start_line": line, "start_column": column, "end_line": end_line, "end_column": end_column},
            "parent_item_id": parent, "is_test": i["is_test"], "parent_name": i["parent"]["name"] if parent else None,
        })
        edges.append({"from": parent or file_id, "to": item_id, "kind": "Contains"})
    return {
        "items": items,
        "edges": edges,
        "module_declarations": [{"file_id": file_id, "from_item_id": ids[id(m["item"])], "target_paths": m["targets"]} for m in found.modules],
        "source_dependencies": [{"source_path": path, "target_path": t, "kind": k} for t, k in dict.fromkeys(found.sources)],
    }


def parse_files(files: DataFrame) -> DataFrame:
    """(path, error, body) of ``files(path, content)``; Python, one file at a time. Files are
    dealt out first: a table of a few MB, one task otherwise, may hold very many."""
    environment = files.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", ""):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").repartition(tasks, "path").mapInArrow(_parse_batches, _PARSED)


def rows_of(name: str, *more: str) -> Column:
    """The array of an index table's rows, and ``more`` fields, in the body of a parsed file."""
    fields = ", ".join([schemas.TABLES[name], *more])
    return F.from_json(F.get_json_object("body", f"$.{name}"), f"array<struct<{_colons(fields)}>>")


def tables_from(parsed: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    out = {"files": files.select(F.sha2(F.concat(F.lit("file\x00"), "path"), 256).alias("file_id"), "path", "hash", "byte_len")}
    for name in ("items", "edges", "module_declarations", "source_dependencies"):
        out[name] = parsed.where("error is null").select(F.explode(rows_of(name)).alias("r")).select("r.*")
    declared = joins.explode_join(
        out["module_declarations"].select("from_item_id", "target_paths"), "target_paths",
        out["files"].select(F.col("path").alias("target"), "file_id"), "target",
    )
    edges = declared.select(F.col("from_item_id").alias("from"), F.col("file_id").alias("to"), F.lit("ModuleDeclares").alias("kind"))
    out["edges"] = out["edges"].unionByName(edges)
    return out


def _colons(schema: str) -> str:
    """``name type`` fields as ``name:type``, also inside structs."""
    import re

    return re.sub(r"(\w+|`\w+`) (?=string|int|long|boolean|array|struct)", r"\1:", schema).replace(":long", ":bigint")


def build(spark: SparkSession, root: str, reports: list[dict], tracked: list[str] | None = None, head: str | None = None) -> Index:
    """A cold index of the tracked Rust files under ``root`` and the build tool's metadata
    reports. A tracked file that is missing, or cannot be parsed, is an error."""
    paths = tracked if tracked is not None else scan.tracked_paths(root)
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    sources = scan.keep_paths(listed, "path", scan.SKIPPED, ".rs")
    files = durable(scan.read_files(spark, root, [p for p in paths if scan.is_source(p)]))
    gone = [r["path"] for r in scan.inaccessible(sources, files).collect()]
    if gone:
        raise FileNotFoundError(f"tracked files are missing: {', '.join(sorted(gone))}")
    parsed = durable(parse_files(files))
    bad = parsed.where("error is not null").limit(5).collect()
    if bad:
        raise RustSyntaxError("; ".join(f"{r['path']}: {r['error']}" for r in bad))
    tables = tables_from(parsed, files)
    tables["packages"], tables["targets"], tables["package_dependencies"] = listings.package_tables(spark, root, reports)
    return _with_meta(Index(spark, tables), root, reports, paths, head)


def _with_meta(index: Index, root: str, reports: list[dict], tracked: list[str], head: str | None) -> Index:
    rust = sorted(p for p in tracked if p.endswith(".rs"))
    row = (
        schemas.INDEX_VERSION, __version__, root, head, _identity(*rust), _identity(*sorted(tracked)),
        _identity(json.dumps(reports, sort_keys=True)), int(time.time() * 1000),
    )
    index.tables["meta"] = index.spark.createDataFrame([row], schemas.META)
    return index


def update(
    spark: SparkSession, root: str, reports: list[dict], previous: Index, changed: list[str], tracked: list[str] | None = None,
    head: str | None = None,
) -> tuple[Index, DataFrame, str]:
    """Index, (path, decision) of every file, and the mode: ``warm_unmodified``,
    ``incremental_update`` or ``cold_rebuild``. Files that are not listed as changed are
    trusted without hashing if file list and root are as before."""
    paths = tracked if tracked is not None else scan.tracked_paths(root)
    meta = previous["meta"].first()
    rust = sorted(p for p in paths if p.endswith(".rs"))
    if meta is None or meta["version"] != schemas.INDEX_VERSION or meta["tool_version"] != __version__ or meta["package_hash"] != _identity(
        json.dumps(reports, sort_keys=True)
    ) or (meta["root"] != root and meta["tracked_list_hash"] != _identity(*sorted(paths))):
        index = build(spark, root, reports, paths, head)
        return index, index["files"].select("path", F.lit("reparsed").alias("decision")), "cold_rebuild"
    named = spark.createDataFrame([(p,) for p in changed], "path string")
    same_list, same_root = meta["file_list_hash"] == _identity(*rust), meta["root"] == root
    sources = [p for p in paths if scan.is_source(p)]
    if same_list and same_root:
        # what is not listed as changed is trusted: neither read nor hashed
        listed = set(changed)
        files = durable(scan.read_files(spark, root, [p for p in sources if p in listed]))
        trusted = previous["files"].join(named, "path", "left_anti").select("path", "hash")
        current = files.select("path", "hash").unionByName(trusted)
    else:
        files = durable(scan.read_files(spark, root, sources))
        current = files
    decided = durable(diff.incremental_reuse(current, previous["files"], named, same_list, same_root))
    stale = durable(decided.where("decision in ('reparsed', 'removed')"))
    if stale.isEmpty() and meta["root"] == root:
        return previous, decided, "warm_unmodified"
    parsed = durable(parse_files(files.join(decided.where("decision = 'reparsed'"), "path", "left_semi")))
    bad = parsed.where("error is not null").limit(5).collect()
    if bad:
        raise RustSyntaxError("; ".join(f"{r['path']}: {r['error']}" for r in bad))
    fresh_files = files.join(decided.where("decision = 'reparsed'"), "path", "left_semi")
    fresh = tables_from(parsed, fresh_files)
    old_ids = previous["files"].join(stale, "path", "left_semi").select("file_id", "path")
    tables = dict(previous.tables)
    keep_files = previous["files"].join(stale, "path", "left_anti")
    owned = previous["items"].join(old_ids, "file_id", "left_semi").select(F.col("item_id").alias("id")).unionByName(
        old_ids.select(F.col("file_id").alias("id"))
    )
    kept = {
        "files": keep_files,
        "items": previous["items"].join(old_ids, "file_id", "left_anti"),
        "edges": previous["edges"].where("kind = 'Contains'").join(owned, F.col("from") == F.col("id"), "left_anti"),
        "module_declarations": previous["module_declarations"].join(old_ids, "file_id", "left_anti"),
        "source_dependencies": previous["source_dependencies"].join(old_ids.select(F.col("path").alias("source_path")), "source_path", "left_anti"),
    }
    for name, rows in kept.items():
        new = fresh[name] if name != "edges" else fresh[name].where("kind = 'Contains'")
        tables[name] = durable(rows.unionByName(new))
    declared = joins.explode_join(
        tables["module_declarations"].select("from_item_id", "target_paths"), "target_paths",
        tables["files"].select(F.col("path").alias("target"), "file_id"), "target",
    )
    tables["edges"] = tables["edges"].unionByName(
        declared.select(F.col("from_item_id").alias("from"), F.col("file_id").alias("to"), F.lit("ModuleDeclares").alias("kind"))
    )
    return _with_meta(Index(spark, tables), root, reports, paths, head), decided, "incremental_update"


def save(index: Index, path: str) -> None:
    """Write a new version beside the old ones, then point to it, so a reader never sees
    half an index."""
    version = uuid.uuid4().hex
    for name in schemas.TABLES:
        index[name].write.parquet(f"{path}/{version}/{name}")
    pointer = index.spark.createDataFrame([(version,)], "version string").coalesce(1)
    pointer.write.mode("overwrite").parquet(f"{path}/current")


def load(spark: SparkSession, path: str) -> Index | None:
    """The saved index; None if there is none or it is of another version."""
    try:
        version = spark.read.parquet(f"{path}/current").first()["version"]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    index = Index(spark, {n: spark.read.schema(s).parquet(f"{path}/{version}/{n}") for n, s in schemas.TABLES.items()})
    meta = index["meta"].first()
    return index if meta and meta["version"] == schemas.INDEX_VERSION else None


def summary(index: Index) -> dict:
    """Counts of the index tables and the bytes of its sources."""
    out = {name: index[name].count() for name in schemas.TABLES if name != "meta"}
    out["source_bytes"] = groups.totals(index["files"], [], "byte_len", "n").first()["n"]
    out["test_items"] = index["items"].where("is_test").count()
    return out
