"""Removal of repeated line runs by a suffix array over line-ID sequences.

Documents become sequences of line IDs (128-bit hashes of lines that hold a word). Of
documents with one text the first stays and the others go; lines that occur once end a
sequence, and sequences of fewer than ``MIN_WORDS`` words are left out. Prefix doubling then
ranks all suffixes by their first 1, 4, 16, ... lines, two doublings a round, up to the longest
sequence: a suffix's rank at one depth is the place of the ranks of the four suffixes that
its lines are made of in a distributed sort. The last ranks are the suffix array. The common
prefixes of neighbours in it come from the same ranks, from the greatest depth down. Neighbours that share ``MIN_WORDS`` words or
more form a longest-common-prefix interval, and within each interval the array is walked in
both directions for the longest prefix that every suffix shares with one of an earlier
place (by doc_id, then line). These are the maximal repeated runs, and the later copy's
lines are deleted. A copy may overlap the run itself: of 51 equal one-word lines the last 50
go, as they repeat the first 50.

With ``edges``, equal words beside a line count too, up to inside the lines around it: a line
is also deleted if a passage of ``MIN_WORDS`` words that holds it starts earlier, with the
same whole line at the same place in it. One of the two sides of the line then has half of
the words that it lacks, so lines are first compared by those two halves, and windows are
made only for the lines of halves that have a line which the runs left.

Scale: ranks come from a range-partitioned sort of the distinct pairs, with one count for each
partition brought together. Suffixes that are equal to their ends are one entry of the array
after partial aggregation, so a passage in a third of all documents is a few rows. Counts and
ranks are written before they are joined back, so that adaptive execution can split what a
frequent line has. The walk streams an interval with a stack no deeper than its longest
prefix has lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, durable, map_batches, partitions, settled

MIN_WORDS = 50
#: Numbers in a table of runs that may be broadcast, after they have been counted.
BROADCAST_NUMBERS = 2_000_000
#: Suffixes in a table of ranks that may be broadcast, once for each level and side.
BROADCAST_ENTRIES = 50_000
_BLANK = bytes([0x20, *range(0x09, 0x0E)])
_KEY = ["doc_id", "t1", "t2"]
_DOC_KEY = "doc_id long, t1 long, t2 long"
_RANKS = ["a", "b1", "b2", "b3"]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _halves(raw: bytes) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(raw)
    return _signed(value >> 64), _signed(value & (2**64 - 1))


def _windows(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the number of lines of the least window of ``least`` words that starts
    there; 0 where there are too few words."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(total, total[:-1] + least, side="left")
    return np.where(end <= n, end - np.arange(n), 0)


def _half_sides(words: list[bytes], counts: np.ndarray, least: int) -> tuple[list, list]:
    """For each line of fewer than ``least`` words a hash of the half (rounded up) of the
    words that it lacks, right before it and right after it; None where there are too few."""
    before: list[int | None] = []
    after: list[int | None] = []
    import xxhash

    begin = 0
    for count in counts.tolist():
        half, end = (least - count + 1) // 2, begin + count
        left = half > 0 and begin >= half
        right = half > 0 and end + half <= len(words)
        before.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[begin - half : begin]))) if left else None)
        after.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[end : end + half]))) if right else None)
        begin = end
    return before, after


_LINES = f"{_DOC_KEY}, line int, h1 long, h2 long, words int, forward int, before long, after long"


def _lines(batches: Iterable[pa.RecordBatch], least: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """One row for each line with a word, numbered among those."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in _LINES.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        keys = zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True)
        for (doc_id, t1, t2), text in zip(keys, batch.column(1), strict=True):
            raw = text.as_py().encode()
            lines = [line for line in raw.split(b"\n") if line.strip(_BLANK)]
            if not lines:
                continue
            n = len(lines)
            words = np.array([len(line.split()) for line in lines])
            forward = _windows(words, least)
            ids = [_halves(line) for line in lines]
            sides = _half_sides(raw.split(), words, least) if edges else ([None] * n, [None] * n)
            columns = ([doc_id] * n, [t1] * n, [t2] * n, range(n), *zip(*ids, strict=True), words, forward, *sides)
            for kept, column in zip(out, columns, strict=True):
                kept.extend(column)
            if len(out[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def dense_rank(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``rank``: place in the order of ``keys`` over the whole table, from a
    range-partitioned sort and one row count for each partition."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(partitions(spark), *[F.col(k).asc_nulls_last() for k in keys])
    placed = durable(
        ordered.sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys]).withColumn(
            "_at", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select(
        "_part",
        (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
    )
    # one row for each shuffle partition
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_at", "_before")
    )


def _same_document(left: DataFrame, right: DataFrame):
    return (
        left["doc_id"].eqNullSafe(right["doc_id"]) & (left["t1"] == right["t1"]) & (left["t2"] == right["t2"])
    )


def suffix_ranks(lines: DataFrame, longest: int) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Levels of the doubling, and the suffix array (doc, line, rem, rank), of
    ``lines(doc, island, line, rem, rank)``; equal ranks are equal suffixes.

    A level (depth, table) has for each suffix its rank by its first ``depth`` lines, ``a``,
    and those of the suffixes one, two and three depths on (-1 beyond the sequence's end,
    which comes before every line): a round doubles the depth twice. ``rem`` is the number of
    lines to the end; ``longest`` is the greatest of these."""
    levels, depth, current = [], 1, lines
    order = Window.partitionBy("doc", "island").orderBy("line")
    while True:
        ahead = [F.coalesce(F.lead("rank", i * depth).over(order), F.lit(-1)).alias(f"b{i}") for i in (1, 2, 3)]
        level = durable(current.select("doc", "island", "line", "rem", F.col("rank").alias("a"), *ahead))
        levels.append((depth, level))
        named = dense_rank(level.select(*_RANKS).distinct(), *_RANKS)
        current = level.join(named, _RANKS).select("doc", "island", "line", "rem", "rank")
        depth *= 4
        if depth >= longest:
            return levels, durable(current.drop("island"))


def common_prefixes(entries: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``entries(f, doc, line, rem, ...)`` of the suffix array, one a rank, with ``lcp``: lines
    shared with the entry before it (0 for the first). ``f`` counts the entries.

    From the greatest depth down, two suffixes of equal rank at a depth are equal that far,
    and are compared further on from there."""
    before = entries.select((F.col("f") + 1).alias("f"), F.col("doc").alias("doc2"), F.col("line").alias("line2"))
    met = entries.join(before, "f", "left").withColumn("lcp", F.lit(0))
    small = levels[0][1].limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    for depth, level in reversed(levels):
        table = F.broadcast(level) if small else level
        here = table.select("doc", F.col("line").alias("at"), F.array(*_RANKS).alias("x"))
        there = table.select(F.col("doc").alias("doc2"), F.col("line").alias("at2"), F.array(*_RANKS).alias("y"))
        met = met.withColumns({"at": F.col("line") + F.col("lcp"), "at2": F.col("line2") + F.col("lcp")})
        met = met.join(here, ["doc", "at"], "left").join(there, ["doc2", "at2"], "left")
        equal = [(F.get("x", F.lit(i)) == F.get("y", F.lit(i))) & (F.get("x", F.lit(i)) >= 0) for i in range(3)]
        parts = F.when(equal[0] & equal[1] & equal[2], 3).when(equal[0] & equal[1], 2).when(equal[0], 1).otherwise(0)
        further = F.when(F.col("lcp") < F.col("rem"), F.least(F.col("lcp") + parts * depth, "rem"))
        # written each time, so that the driver holds two broadcast levels at once and not all
        met = durable(met.withColumn("lcp", F.coalesce(further, "lcp")).drop("x", "y", "at", "at2"))
    return met.drop("doc2", "line2")


def numbered_intervals(array: DataFrame) -> DataFrame:
    """Entries of ``array(f, lcp, forward, ...)`` that share their window of ``forward`` lines
    with a neighbour, with ``interval``, the place of their interval's first entry, and
    ``up``, the lines shared with the entry after them."""
    n = array.count()
    parts = partitions(array.sparkSession)
    # as many neighbouring entries a task as there are in a sorted partition
    part = F.floor(F.col("f") * parts / max(n, 1))
    order = Window.partitionBy("part").orderBy("f")
    marked = durable(array.withColumns({"part": part, "head": F.when(F.col("lcp") < F.col("forward"), F.col("f"))}))
    last = marked.groupBy("part").agg(F.max("head").alias("last"), F.min_by("lcp", "f").alias("first_lcp"), F.min_by(F.col("head").isNull(), "f").alias("joined"))
    # one row for each shuffle partition
    whole = Window.orderBy("part")
    carried = last.select(
        "part",
        F.max("last").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.lead("first_lcp").over(whole).alias("next_lcp"),
        F.lead("joined").over(whole).alias("next_joined"),
    )
    placed = marked.join(F.broadcast(carried), "part").withColumns(
        {
            "interval": F.coalesce(F.max("head").over(order.rowsBetween(Window.unboundedPreceding, 0)), "carried"),
            "up": F.coalesce(F.lead("lcp").over(order), "next_lcp"),
            "more": F.coalesce(F.lead(F.col("head").isNull()).over(order), "next_joined", F.lit(False)),
        }
    )
    return placed.where("head is null or more").withColumn("up", F.when(F.col("more"), F.col("up")).otherwise(0)).drop("part", "head", "carried", "next_lcp", "next_joined", "more")


def _longest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, line, forward, size): for each entry the most lines it shares with an entry that
    comes before it in the walk and has an earlier place; none if less than ``forward``.

    Rows (interval, shared, doc, line, forward) come by interval in the walk's order;
    ``shared`` is the prefix shared with the row before. The stack holds, for each length
    shared with the present entry, the earliest place that shares it."""
    interval, stack = None, []
    for batch in batches:
        out: list[tuple] = []
        for group, shared, doc, line, forward in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if group != interval:
                interval, stack = group, []
            place = None
            while stack and stack[-1][0] >= shared:
                other = stack.pop()[1]
                place = other if place is None else min(place, other)
            if place is not None:
                stack.append((shared, place))
            for size, place in reversed(stack):
                if size < forward:
                    break
                if place < (doc, line):
                    out.append((doc, line, size))
                    break
            stack.append((1 << 31, (doc, line)))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = [pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "line", "size"])


def later_copies(lines: DataFrame) -> DataFrame:
    """(doc, from, to) of runs of ``lines(doc, island, line, rem, rank, forward)`` with an earlier copy:
    for every line the longest one that starts there, of ``forward`` lines or more."""
    longest = lines.agg(F.max("rem")).first()[0] or 0
    levels, ranked = suffix_ranks(lines, longest)
    array = ranked.withColumnRenamed("rank", "own").join(lines.where("forward > 0 and forward <= rem").select("doc", "line", "forward"), ["doc", "line"])
    array = durable(array)
    place = F.struct("doc", "line", "rem", "forward")
    firsts = durable(array.groupBy("own").agg(F.min(place).alias("p")).select("own", "p.*"))
    # entries of too few words are left out, so the others are numbered anew
    entries = durable(dense_rank(firsts, "own").withColumnRenamed("rank", "f"))
    intervals = durable(numbered_intervals(common_prefixes(entries, levels)))
    n = partitions(lines.sparkSession)
    walk = intervals.repartition(n, "interval")
    columns = ["doc", "line", "forward"]
    down = walk.sortWithinPartitions("interval", "f").select("interval", F.when(F.col("f") == F.col("interval"), 0).otherwise(F.col("lcp")).alias("shared"), *columns)
    up = walk.sortWithinPartitions("interval", F.desc("f")).select("interval", F.col("up").alias("shared"), *columns)
    found = map_batches(down, _longest, "doc long, line int, size int").unionByName(map_batches(up, _longest, "doc long, line int, size int"))
    # a suffix that is equal to an earlier one up to its end
    first = firsts.select("own", F.struct("doc", "line").alias("first"))
    equal = array.join(first, "own").where(F.struct("doc", "line") > F.col("first")).select("doc", "line", F.col("rem").alias("size"))
    every = found.unionByName(equal)
    return every.select("doc", F.col("line").alias("from"), (F.col("line") + F.col("size")).alias("to"))


def maximal(windows: DataFrame) -> DataFrame:
    """The unions (doc, from, to) of overlapping or touching ``windows(doc, from, to)``."""
    order = Window.partitionBy("doc").orderBy("from", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = windows.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("from")).cast("int"))
    numbered = begun.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")


def _edge_windows(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc, line, h1, h2) for each window of ``least`` words that holds a listed line whole,
    by a hash of the line, its place in the window, and the window's words."""
    import xxhash

    names, kinds = ["doc", "line", "h1", "h2"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, doc, listed in zip(*[batch.column(i) for i in range(3)], strict=True):
            raw, doc = text.as_py().encode(), doc.as_py()
            lines = [line for line in raw.split(b"\n") if line.strip(_BLANK)]
            words = raw.split()
            total = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines])]).tolist()
            for at in listed.as_py():
                begin, end = total[at], total[at + 1]
                seed = xxhash.xxh3_128_digest(lines[at])
                for start in range(max(0, end - least), min(begin, len(words) - least) + 1):
                    window = b" ".join([seed, b"%d" % (begin - start), *words[start : start + least]])
                    for column, value in zip(out, (doc, at, *_halves(window)), strict=True):
                        column.append(value)
                if len(out[0]) >= 50_000:
                    yield batch_of(out)
                    out = [[], [], [], []]
        if out[0]:
            yield batch_of(out)


def edge_lines(placed: DataFrame, gone: DataFrame, documents: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, line) of the lines, other than those of ``gone`` (doc, line), that lie in a passage
    of ``min_words`` words with an earlier copy in which the line is whole too."""
    place = F.struct("doc", "line")
    side = placed.select("doc", "line", "rank", F.lit(0).alias("side"), F.col("before").alias("half")).unionByName(
        placed.select("doc", "line", "rank", F.lit(1).alias("side"), F.col("after").alias("half"))
    )
    key = ["rank", "side", "half"]
    side = side.where("half is not null")
    firsts = durable(side.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    alike = durable(side.join(broadcast_if_small(firsts), key).select("doc", "line", *key, "first"))
    still = durable(alike.where(place > F.col("first")).join(gone, ["doc", "line"], "left_anti").select("doc", "line", *key))
    asked = durable(alike.join(broadcast_if_small(durable(still.select(*key).distinct())), key, "left_semi").select("doc", "line").distinct())
    listed = asked.groupBy("doc").agg(F.collect_list("line").alias("lines"))
    listed = durable(listed.join(documents, "doc"))
    texts = _keyed(docs)
    own = texts.join(listed_if_small(listed, "lines"), _same_document(texts, listed))
    # rows that repeat a document give the same windows again
    windows = durable(
        map_batches(own.select("text", "doc", "lines"), lambda it: _edge_windows(it, min_words), "doc long, line int, h1 long, h2 long")
    )
    least = windows.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most")
    least = durable(least.drop("most"))
    later = windows.join(broadcast_if_small(least), ["h1", "h2"]).where(place > F.col("least")).select("doc", "line").distinct()
    return later.join(still.select("doc", "line").distinct(), ["doc", "line"], "left_semi")


def listed_if_small(df: DataFrame, array: str) -> DataFrame:
    """``broadcast_if_small`` for a written table of documents with an array each, by the
    count of all numbers in it."""
    numbers = df.agg(F.sum(F.size(array) + 4)).first()[0] or 0
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, edges: bool = False) -> DataFrame:
    """(doc_id, t1, t2, runs) of documents with lines to delete: ``runs`` holds the first
    and the end line (excluded) of one run after the other, lines with a word counted
    from 0; t1 and t2 are hashes of the text."""
    lines = durable(map_batches(_keyed(docs), lambda it: _lines(it, min_words, edges), _LINES))
    enough = F.max((F.col("line") == 0) & (F.col("forward") > 0)).alias("enough")
    whole = durable(lines.groupBy(*_KEY).agg((F.max("line") + 1).alias("n"), enough))
    earliest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("first")
    texts = durable(whole.groupBy("t1", "t2").agg(earliest, F.count("*").alias("texts")).where("texts > 1").drop("texts"))
    copies = durable(whole.join(texts, ["t1", "t2"]).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select(*_KEY, "n", "enough"))
    named_copies = broadcast_if_small(copies.select(*_KEY))
    own = lines.join(named_copies, _same_document(lines, named_copies), "left_anti")
    counted = own.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    named = dense_rank(counted.select("h1", "h2"), "h1", "h2")
    # rows that repeat a document (doc_id and text) are one
    some = durable(
        own.join(named, ["h1", "h2"]).select(*_KEY, "line", "rank", "words", "forward", "before", "after").distinct()
    )
    documents = durable(dense_rank(some.select(*_KEY).distinct(), *_KEY).withColumnRenamed("rank", "doc"))
    placed = durable(
        some.join(documents, _same_document(some, documents)).select("doc", "line", "rank", "words", "forward", "before", "after")
    )
    order = Window.partitionBy("doc").orderBy("line")
    island = placed.withColumn("island", F.col("line") - F.row_number().over(order))
    sequence = Window.partitionBy("doc", "island")
    measured = island.withColumns({"total": F.sum("words").over(sequence), "rem": F.max("line").over(sequence) - F.col("line") + 1})
    sequences = durable(measured.where(F.col("total") >= min_words).select("doc", "island", "line", "rem", "rank", "forward"))
    runs = durable(maximal(later_copies(sequences)))
    if edges:
        gone = runs.select("doc", F.explode(F.sequence("from", F.col("to") - 1)).alias("line"))
        more = edge_lines(placed, gone, documents, docs, min_words)
        more = more.select("doc", F.col("line").alias("from"), (F.col("line") + 1).alias("to"))
        runs = maximal(durable(runs.unionByName(more)))
    pairs = F.flatten(F.sort_array(F.collect_list(F.array("from", "to")))).alias("runs")
    found = runs.groupBy("doc").agg(pairs).join(documents, "doc").select(*_KEY, "runs")
    again = copies.where("enough").select(*_KEY, F.array(F.lit(0), "n").alias("runs"))
    return found.unionByName(again)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("#"), text).alias("t2"),
    )


def merged(runs: Iterable[int]) -> list[tuple[int, int]]:
    """The union of windows given as from, to, from, to, ..., in order."""
    flat = list(runs)
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without_runs(text: str, runs: Iterable[int]) -> tuple[str, int, int]:
    """``text`` without the lines of the runs, the lines deleted, and maximal runs; lines
    without a word stay unless no line with a word is left."""
    spans = merged(runs)
    drop = {i for begin, end in spans for i in range(begin, end)}
    kept, place, left = [], 0, 0
    for line in text.split("\n"):
        if line.encode().strip(_BLANK):
            if place not in drop:
                kept.append(line)
                left += 1
            place += 1
        else:
            kept.append(line)
    return ("\n".join(kept) if left else ""), len(drop), len(spans)


def _cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first columns as they are, then, from the last two (text and runs), the cleaned
    text and the counts."""
    for batch in batches:
        n = batch.num_columns - 2
        texts, runs = batch.column(n), batch.column(n + 1)
        lines, spans, changed = [0] * batch.num_rows, [0] * batch.num_rows, []
        listed = runs.is_valid()
        for i in np.flatnonzero(listed.to_numpy(zero_copy_only=False)):
            text, lines[i], spans[i] = without_runs(texts[int(i)].as_py(), runs[int(i)].as_py())
            changed.append(text)
        clean = pc.replace_with_mask(texts, listed, pa.array(changed, texts.type))
        made = [clean, pa.array(lines, pa.int64()), pa.array(spans, pa.int64())]
        names = [*batch.schema.names[:n], "clean_text", "n_removed", "n_runs"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names)


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, edges: bool = False) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_removed`` (lines) and ``n_runs`` added (columns of
    these names are replaced). With ``edges``, equal words beside whole lines count too.

    Null text is empty and stays so; a null doc_id comes after all others; rows that repeat
    doc_id and text are one document and are cleaned alike, while equal texts under
    different ids are copies, of which the first stays; a run that overlaps its own earlier
    copy is deleted too; an empty table gives no rows."""
    own = docs.drop("clean_text", "n_removed", "n_runs")
    runs = settled(lambda: repeated_runs(own, min_words, edges))
    text = F.coalesce(own["text"], F.lit(""))
    wide = own.select(
        *[own[c].alias(f"_d{i}") for i, c in enumerate(own.columns)],
        own["doc_id"].cast("long").alias("doc_id"),
        text.alias("_text"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("#"), text).alias("t2"),
    )
    # only documents with something to delete are listed
    joined = wide.join(listed_if_small(runs, "runs"), _same_document(wide, runs), "left")
    kept = joined.select(*[F.col(f"_d{i}") for i in range(len(own.columns))], "_text", "runs")
    types = [f"_d{i} {f.dataType.simpleString()}" for i, f in enumerate(own.schema.fields)]
    schema = ", ".join([*types, "clean_text string, n_removed long, n_runs long"])
    cleaned = map_batches(kept, _cleaned, schema)
    return cleaned.select(
        *[F.col(f"_d{i}").alias(c) for i, c in enumerate(own.columns)], "clean_text", "n_removed", "n_runs"
    )
