"""File sources: tracked paths, contents and hashes."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are never scanned.
SKIPPED = [".git", "target", "node_modules"]


def keep_paths(df: DataFrame, path: str, skipped: list[str], suffix: str = "") -> DataFrame:
    """Rows whose path has no skipped component and ends with ``suffix``."""
    inside = F.arrays_overlap(F.split(F.col(path), "/"), F.lit(skipped))
    return df.where(~inside & F.endswith(F.col(path), F.lit(suffix)))


def tracked_paths(repo: str) -> list[str]:
    """Paths of regular files in the git index (links and submodules are left out)."""
    out = subprocess.run(["git", "-C", repo, "ls-files", "-s", "-z"], capture_output=True, check=True).stdout
    rows = [entry.split("\t", 1) for entry in out.decode().split("\0") if entry]
    return sorted({path for meta, path in rows if meta.startswith("100")})


def hashed(df: DataFrame, content: str) -> DataFrame:
    """``df`` with ``hash`` and ``byte_len`` of a text or binary column."""
    raw = F.col(content).cast("binary")
    return df.withColumns({"hash": F.sha2(raw, 256), "byte_len": F.octet_length(raw).cast("long")})


def is_source(path: str, suffix: str = ".rs") -> bool:
    """``keep_paths`` for one path."""
    return path.endswith(suffix) and not set(path.split("/")) & set(SKIPPED)


def read_files(spark: SparkSession, repo: str, listed: list[str]) -> DataFrame:
    """(path, hash, byte_len, content) of the listed files below ``repo``, and of no others:
    only they are opened. Listed but missing files are not among them, see ``inaccessible``."""
    root = repo.rstrip("/")
    there = [p for p in listed if os.path.isfile(f"{root}/{p}")]
    if not there:
        return spark.createDataFrame([], "path string, hash string, byte_len long, content string")
    # the reader takes paths as patterns
    exact = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", f"{root}/{p}") for p in there]
    files = spark.read.format("binaryFile").load(exact)
    relative = F.substring(F.regexp_replace("path", r"^file:/+", "/"), len(root) + 2, 1 << 20)
    return hashed(files.select(relative.alias("path"), "content"), "content").select(
        "path", "hash", "byte_len", F.col("content").cast("string").alias("content")
    )


def inaccessible(tracked: DataFrame, files: DataFrame) -> DataFrame:
    return tracked.join(files.select("path"), "path", "left_anti")
