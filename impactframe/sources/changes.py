"""Sources of changes: text, JSON, unified diffs, delta rows and git.

Change lists typed or piped by a person are parsed on the driver; the DataFrame forms do
the same for tables of such texts."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import carry_forward, json_block, numbered_lines, stripped
from ..session import durable

SCHEMA = "path string, ranges array<struct<start_line int, end_line int>>"
# The keys of an object that may hold further paths.
NESTED_KEYS = ["files", "paths", "changed_files", "items", "values"]
#: Levels of a JSON value that are opened at once.
LEVELS = 16


def trimmed_lines(text: Column) -> Column:
    """Trimmed, non-empty lines; blanks inside a line stay."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def _ranges(found) -> list[tuple[int, int]]:
    out = []
    for r in found if isinstance(found, list) else []:
        if isinstance(r, dict):
            start = r.get("start_line", r.get("start"))
            if isinstance(start, int) and not isinstance(start, bool):
                end = r.get("end_line", r.get("end"))
                out.append((start, end if isinstance(end, int) else start))
    return out


def json_paths(value) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(path, ranges) of a JSON value: arrays and the known keys of objects are searched; an
    object with a text ``path`` is one row; a text is one."""
    if isinstance(value, str):
        yield value, []
    elif isinstance(value, list):
        for item in value:
            yield from json_paths(item)
    elif isinstance(value, dict):
        if isinstance(value.get("path"), str):
            yield value["path"], _ranges(value.get("ranges"))
        else:
            for key in NESTED_KEYS:
                if key in value:
                    yield from json_paths(value[key])


def parse_changes(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Rows of a change list: the whole text as JSON if it is, else its lines."""
    try:
        value = json.loads(text)
    except ValueError:
        return [(line.strip(), []) for line in text.splitlines() if line.strip()]
    return list(json_paths(value))


def change_table(spark: SparkSession, rows: list[tuple[str, list[tuple[int, int]]]]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def json_path_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path) of JSON texts in a table, however deep they are nested, without Python.
    Each pass opens ``LEVELS`` levels of a value within its row; what lies deeper is written
    and opened by the next."""
    level = df.select(key, text).repartition(key, text).select(key, F.try_parse_json(text).alias("v"))
    found: list[DataFrame] = []
    while True:
        held = F.array(_held(F.col("v")))
        for _ in range(LEVELS):
            held = F.flatten(F.transform(held, _opened))
        level = durable(level.select(key, F.inline(held)))
        found.append(level.where("path is not null").select(key, "path"))
        level = level.where("path is null and v is not null").select(key, "v")
        if level.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _held(v: Column | None, path: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none.cast("variant") if v is None else v).alias("v"), (none.cast("string") if path is None else path).alias("path")
    )


def _opened(x: Column) -> Column:
    """What a value holds: itself if it is a path already, its path, or the values inside.
    The kind of a value is found by taking it as an array, then as an object; its schema,
    which is as long as the value, is asked of scalars only."""
    v = x["v"]
    get = lambda kind: F.call_function("try_variant_get", v, F.lit("$"), F.lit(kind))
    inside = F.transform(get("array<variant>"), lambda y: _held(y))

    def fields(o: Column) -> Column:
        below = F.transform(F.array_compact(F.array(*[o[k] for k in NESTED_KEYS])), lambda y: _held(y))
        is_text = F.schema_of_variant(o["path"]) == "STRING"
        own = F.call_function("try_variant_get", o["path"], F.lit("$"), F.lit("string"))
        return F.when(o.isNotNull(), F.when(is_text, F.array(_held(None, own))).otherwise(below))

    known = f"struct<path:variant,{','.join(f'{k}:variant' for k in NESTED_KEYS)}>"
    # an array of one is the object under a name, so that it is taken out once
    object_ = F.element_at(F.transform(F.array(get(known)), fields), 1)
    text = F.when(F.schema_of_variant(v) == "STRING", F.array(_held(None, get("string"))))
    return F.when(x["path"].isNotNull(), F.array(x)).otherwise(
        F.coalesce(inside, object_, text, F.array().cast("array<struct<v:variant,path:string>>"))
    )


def diff_ranges(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, path, start_line, end_line) of unified diffs: a row for each hunk's new side,
    and one without range for a file without hunks on that side. A file that is deleted is
    named by its old path."""
    lines = numbered_lines(df, text, *keys)
    old = F.when(lines["line"].rlike("^--- "), F.regexp_extract("line", r"^--- (?:a/)?([^\t]*)", 1))
    lines = carry_forward(lines, old, "_old", *keys)
    new = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1)
    name = F.when(F.col("line").rlike(r"^\+\+\+ "), F.when(new == "/dev/null", F.col("_old")).otherwise(new))
    lines = carry_forward(lines, name, "path", *keys)
    gone = F.when(F.col("line").rlike(r"^\+\+\+ "), new == "/dev/null")
    lines = carry_forward(lines, gone, "_gone", *keys)
    hunk = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    start = F.regexp_extract("line", hunk, 1)
    count = F.regexp_extract("line", hunk, 2)
    first = F.when((start != "") & ~F.col("_gone"), start.try_cast("int"))
    n = F.when(count == "", 1).otherwise(count.try_cast("int"))
    rows = lines.where("path is not null").select(
        *keys, "path", first.alias("start_line"), F.when(first.isNotNull(), first + F.greatest(n, F.lit(1)) - 1).alias("end_line")
    )
    whole = F.when(F.col("start_line").isNotNull(), F.struct("start_line", "end_line"))
    grouped = rows.groupBy(*keys, "path").agg(F.collect_set(whole).alias("r"))
    return grouped.select(*keys, "path", F.explode_outer("r").alias("r")).select(*keys, "path", "r.start_line", "r.end_line")


def delta_paths(deltas: DataFrame) -> DataFrame:
    """(path, status) of ``deltas(old, new, status)``: renames and copies give both paths,
    deletions the old one, all else the new one or the old."""
    both = F.col("status").isin("renamed", "copied")
    paths = (
        F.when(both, F.array("old", "new"))
        .when(F.col("status") == "deleted", F.array("old"))
        .otherwise(F.array(F.coalesce("new", "old")))
    )
    return deltas.select("status", F.explode(paths).alias("path")).where("path is not null").distinct()


def provider_report(df: DataFrame, text: str, schema: str) -> DataFrame:
    """A tool's JSON answer, with log text before and after it, as columns."""
    return df.select(F.from_json(json_block(F.col(text)), schema).alias("r")).select("r.*")


def combine(*sets: DataFrame) -> DataFrame:
    """Union of change tables, one row a path with all its ranges."""
    from ..operators.groups import merge_ranges

    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return merge_ranges(out)


def git_changes(repo: str, *args: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Paths and changed new lines of ``git diff`` with the given arguments."""
    command = ["git", "-c", "core.quotepath=off", "-C", repo, "diff", "--no-color", "--no-ext-diff", "-M", "-C"]
    names = subprocess.run([*command, "--name-status", "-z", *args], capture_output=True, check=True).stdout
    found: dict[str, list[tuple[int, int]]] = {}
    fields = iter(names.decode().split("\0"))
    for status in fields:
        if status:
            found.setdefault(next(fields), [])
            if status[0] in "RC":
                found.setdefault(next(fields), [])
    patch = subprocess.run([*command, "--unified=0", *args], capture_output=True, check=True).stdout
    for path, line in added_lines(patch.decode(errors="replace")):
        found.setdefault(path, []).append((line, line))
    return list(found.items())


def added_lines(patch: str) -> Iterator[tuple[str, int]]:
    """(path, new line number) of the lines that a git patch adds. A hunk's header says how
    many old and new lines follow, so a line of text is never taken for a file's header."""
    path, line, old, new = None, 0, 0, 0
    for text in patch.split("\n"):
        if old > 0 or new > 0:
            sign = text[:1]
            if sign == "+":
                if path is not None:
                    yield path, line
                line, new = line + 1, new - 1
            elif sign == "-":
                old -= 1
            elif sign != "\\":
                line, old, new = line + 1, old - 1, new - 1
        elif text.startswith("+++ "):
            name = _unquoted(text[4:].rstrip("\t"))
            path = name[2:] if name.startswith("b/") else None
        elif m := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", text):
            line, old, new = int(m[2]), int(m[1] or 1), int(m[3] or 1)


def _unquoted(name: str) -> str:
    """A name as git writes it: in quotes, with C escapes, if it has special characters."""
    if not (name.startswith('"') and name.endswith('"')):
        return name
    plain = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
    out = bytearray()
    for octal, letter, other in re.findall(r"\\([0-7]{3})|\\(.)|([^\\]+)", name[1:-1]):
        out += bytes([int(octal, 8)]) if octal else bytes([plain[letter]]) if letter else other.encode()
    return out.decode(errors="replace")


def revisions(repo: str, base: str, head: str):
    return git_changes(repo, base, head)


def merge_base(repo: str, upstream: str):
    base = subprocess.run(["git", "-C", repo, "merge-base", upstream, "HEAD"], capture_output=True, check=True)
    return git_changes(repo, base.stdout.decode().strip(), "HEAD")


def staged(repo: str):
    return git_changes(repo, "--cached")


def worktree(repo: str):
    """One comparison of HEAD with the working tree, untracked files included."""
    born = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True)
    empty = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree
    known = git_changes(repo, "HEAD" if born.returncode == 0 else empty)
    others = subprocess.run(
        ["git", "-C", repo, "ls-files", "-z", "--others", "--exclude-standard"], capture_output=True, check=True
    ).stdout.decode()
    return [*known, *((p, []) for p in others.split("\0") if p)]


def explicit(paths: list[str]):
    return [(p, []) for p in paths]
