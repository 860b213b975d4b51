"""Join operators: longest prefix, interval containment and overlap, lookups, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..session import durable

#: Rules broadcast at once.
RULES = 10_000
#: Paths of a directory that a join by its name may gather.
CROWD = 100_000


def longest_prefix_join(df: DataFrame, path: str, roots: DataFrame, root: str, key: str) -> DataFrame:
    """``df`` with the columns of the deepest root that owns its path; null without one.

    Equal roots: the greatest key wins, and only that one is joined. Ancestors are exploded
    for each distinct directory rather than for each path; a path then asks for itself and
    for its directory. Directories of more than ``CROWD`` paths are broadcast, so that none
    of them gathers its paths in one task: there is at most one for so many rows."""
    owned = (
        roots.select(
            F.when(F.col(root) == ".", "").otherwise(F.col(root)).alias("_root"),
            F.struct(*[F.col(c) for c in roots.columns]).alias("_owner"),
            F.col(key).alias("_key"),
        )
        .where("_root is not null")
        .groupBy("_root")
        .agg(F.max_by("_owner", F.struct("_key")).alias("_owner"))
    )
    above = _directory(F.col(path))
    # a root of all paths is one row, and is no key of a join
    inner, top = owned.where("_root <> ''"), owned.where("_root = ''").select(F.col("_owner").alias("_top"))
    folders = df.where(F.col(path).isNotNull()).groupBy(above.alias("_dir")).agg(F.count("*").alias("_n"))
    up = folders.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("_root")).where("_root <> ''")
    best = up.join(inner, "_root").groupBy("_dir").agg(F.max_by("_owner", F.length("_root")).alias("_near"))
    found = durable(
        folders.join(best, "_dir", "left").join(F.broadcast(top), how="left")
        .select("_dir", "_n", F.coalesce("_near", "_top").alias("_near"))
    )
    crowded = found.where(F.col("_n") > CROWD).select("_dir", F.col("_near").alias("_far"), F.lit(True).alias("_crowd"))
    others = found.where(F.col("_n") <= CROWD).select(F.col("_dir").alias("_ask"), "_near")
    asked = df.withColumn("_dir", above).join(F.broadcast(crowded), "_dir", "left")
    # what is answered asks for names that no directory has
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64(path), F.lit(CROWD)).cast("string"))
    asked = asked.withColumn("_ask", F.when(F.col("_crowd"), none).otherwise(F.col("_dir"))).join(others, "_ask", "left")
    own = inner.select(F.col("_root").alias("_path"), F.col("_owner").alias("_own"))
    joined = asked.join(own, F.col(path) == F.col("_path"), "left").withColumn("_owner", F.coalesce("_own", "_far", "_near"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_owner.{c}").alias(c) for c in roots.columns])


def _directory(path: Column) -> Column:
    """What stands before the last slash; the empty text without one."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def anti_prefix_join(df: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows whose path no root owns."""
    paths = df.select(F.col(path).alias("_path")).distinct()
    up = paths.select("_path", F.explode(ancestors(F.col("_path"))).alias("_root"))
    owned = up.join(roots.select(F.col(root).alias("_root")).distinct(), "_root", "left_semi").select("_path").distinct()
    return df.join(owned, df[path] == owned["_path"], "left_anti")


def _place(df: DataFrame, name: str) -> Column:
    """A bound as a long: whole numbers as they are, times in microseconds."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp")) if kind in ("timestamp", "date") else F.col(name).cast("long")


def _stabbed(points: DataFrame, at: str, spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Pairs of equal keys where ``at`` of a point lies in [start, stop].

    A span lies in one or two cells of the grid whose cells are a power of two, not shorter
    than it; a point lies in one cell of each grid that has spans (64 at most). So this is a
    hash join on (keys, grid, cell), and one key with many spans is spread over its cells."""
    first, last = _place(spans, start), _place(spans, stop)
    # the least power of two above the length, from the number of binary digits
    grid = F.when(last > first, F.length(F.bin(last - first))).otherwise(0)
    cells = F.array_distinct(F.array(F.expr("shiftright(_first, _grid)"), F.expr("shiftright(_last, _grid)")))
    gridded = spans.withColumns({"_first": first, "_last": last, "_grid": grid}).where("_last >= _first")
    gridded = gridded.withColumn("_cell", F.explode(cells)).drop("_first", "_last")
    grids = [r["_grid"] for r in gridded.select("_grid").distinct().collect()]
    place = points.withColumns({"_at": _place(points, at), "_grid": F.explode(F.lit(grids).cast("array<int>"))})
    place = place.withColumn("_cell", F.expr("shiftright(_at, _grid)")).drop("_at")
    met = place.join(gridded, [*keys, "_grid", "_cell"]).drop("_grid", "_cell")
    return met.where((F.col(start) <= F.col(at)) & (F.col(stop) >= F.col(at)))


def containing_spans(
    points: DataFrame, spans: DataFrame, keys: list[str], begin: str, end: str, start: str, stop: str
) -> DataFrame:
    """Pairs of ``points`` and ``spans`` of equal keys where [begin, end] lies in
    [start, stop]."""
    return _stabbed(points, begin, spans, keys, start, stop).where(F.col(stop) >= F.col(end))


def innermost(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The longest name of each key; among equals the last in order."""
    return pairs.groupBy(*keys).agg(F.max_by(name, F.struct(F.length(name), F.col(name))).alias(name))


def overlapping_spans(
    points: DataFrame, spans: DataFrame, keys: list[str], begin: str, end: str, start: str, stop: str
) -> DataFrame:
    """Pairs of equal keys whose ranges share a place: the point begins in the span, or the
    span starts in the point, after its begin."""
    inside = _stabbed(points, begin, spans, keys, start, stop).where(F.col(end) >= F.col(begin))
    around = _stabbed(spans, start, points, keys, begin, end).where((F.col(start) > F.col(begin)) & (F.col(stop) >= F.col(start)))
    return inside.unionByName(around)


def validated_lookup(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` joined to ``known``, with ``is_known`` false where nothing matched."""
    marked = known.withColumn("_known", F.lit(True))
    return wanted.join(marked, keys, "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")


def coalesce_lookups(df: DataFrame, key: str, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """``df`` with ``value`` from ``first``, else from ``second``; both (key, value)."""
    a = first.select(F.col(first.columns[0]).alias(key), F.col(first.columns[1]).alias("_a"))
    b = second.select(F.col(second.columns[0]).alias(key), F.col(second.columns[1]).alias("_b"))
    return df.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def explode_join(df: DataFrame, array: str, table: DataFrame, key: str) -> DataFrame:
    """One row for each array element that the table has."""
    exploded = df.withColumn(key, F.explode_outer(array)).drop(array)
    return exploded.join(table, key)


def semi_restrict(df: DataFrame, explicit: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is listed, and listed keys alone that ``df`` lacks."""
    listed = explicit.select(key).distinct()
    inside = df.join(listed, key, "left_semi")
    alone = listed.join(df.select(key), key, "left_anti")
    return inside.unionByName(alone, allowMissingColumns=True)


def classify_by_lookups(df: DataFrame, key: str, positive: DataFrame, negative: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: the key is in ``positive`` and not in ``negative``."""
    yes = positive.select(F.col(positive.columns[0]).alias(key)).distinct().withColumn("_yes", F.lit(True))
    no = negative.select(F.col(negative.columns[0]).alias(key)).distinct().withColumn("_no", F.lit(True))
    joined = df.join(yes, key, "left").join(no, key, "left")
    return joined.withColumn(name, F.col("_yes").isNotNull() & F.col("_no").isNull()).drop("_yes", "_no")


def rule_matches(df: DataFrame, path: str, rules: DataFrame, pattern: str) -> DataFrame:
    """Pairs of rows and rules whose expression the path matches. Rules are a configuration
    file's entries and are broadcast, ``RULES`` at once; more of them go in blocks."""
    blocks = -(-rules.count() // RULES)
    if blocks <= 1:
        return df.join(F.broadcast(rules), F.rlike(F.col(path), F.col(pattern)))
    kept = durable(rules)
    numbered = kept.withColumn("_block", F.pmod(F.xxhash64(*kept.columns), F.lit(2 * blocks)))
    out = None
    for block in range(2 * blocks):
        own = F.broadcast(numbered.where(F.col("_block") == block).drop("_block"))
        met = df.join(own, F.rlike(F.col(path), F.col(pattern)))
        out = met if out is None else out.unionByName(met)
    return out


def ordered_matches(matches: DataFrame, path: str) -> DataFrame:
    """Rule matches by path, rule index and source."""
    return matches.orderBy(path, "rule_index", "source")


def first_value(*flags: tuple[Column, str]) -> Column:
    """Label of the first flag that holds."""
    out = None
    for test, label in flags:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out
