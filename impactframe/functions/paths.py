"""Path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped


def clean(path: Column) -> Column:
    """Normal form: trimmed, no leading ``./``, forward slashes, no trailing slash."""
    forward = F.translate(F.regexp_replace(stripped(path), r"^(\./)+", ""), "\\", "/")
    return F.regexp_replace(forward, "/+$", "")


def is_under(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or lies beneath it; the empty root and ``.`` own all."""
    return root.isin("", ".") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """``path`` seen from ``root``; null if it does not lie beneath it."""
    return F.when(root.isin("", "."), path).when(
        F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))
    )


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; null without a dot."""
    name = F.lower(basename(path))
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def normalize(path: Column) -> Column:
    """Lexical ``.`` and ``..`` removal; null for an absolute path or one that escapes."""

    def step(kept: Column, part: Column) -> Column:
        popped = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        return (
            F.when(kept.isNull(), kept)
            .when(part.isin("", "."), kept)
            .when(part == "..", popped)
            .otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.split(path, "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.startswith(path, F.lit("/")), F.array_join(folded, "/"))


def ancestors(path: Column) -> Column:
    """All roots that own ``path``: the empty root, each directory above, and itself."""
    parts = F.split(path, "/")
    return F.concat(
        F.array(F.lit("")),
        F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
        ),
    )


def module_prefix(relative: Column) -> Column:
    """Module path of a file below ``src/``: ``src/a/b.rs`` is ``a::b``; the tails ``lib``,
    ``main`` and ``mod`` go; null outside ``src/``."""
    inner = F.regexp_replace(F.substring(relative, 5, 1 << 20), r"(\.rs)+$", "")
    whole = F.when(inner.isin("lib", "main"), F.lit("")).otherwise(
        F.regexp_replace(
            F.regexp_replace(F.regexp_replace(inner, "(/mod)+$", ""), "(/lib)+$", ""), "(/main)+$", ""
        )
    )
    return F.when(F.startswith(relative, F.lit("src/")), F.replace(whole, F.lit("/"), F.lit("::")))


def module_filter(relative: Column, module: Column) -> Column:
    """Filter text of a test module in a file."""
    prefix = F.coalesce(module_prefix(relative), F.lit(""))
    return F.when(prefix == "", module).otherwise(F.concat(prefix, F.lit("::"), module))
