"""Near-duplicate components by MinHash with tensored banding.

Two small collections of ``tables`` keys of ``rows`` minhashes each are computed; a table
key is a pair of one key from either, so ``tables**2`` tables of ``2 * rows`` minhashes cost
``2 * tables * rows`` hash functions. Candidates are confirmed on full shingle sets.

How work stays bounded:

* Documents with equal sets form a class; only one of each class goes on.
* First every key has ``LEADERS`` leaders: the class that shares most keys with others, and
  the least ones by hashes of class and key. A class is compared with the leaders of its
  keys, ``OFFERS`` of them at most, and components are merged. What lies in one component
  needs no further comparison.
* Then keys whose classes are all in one component are dropped. Documents that share a table
  key of the others, across components, are joined exactly: a pair at the threshold has a common shingle among the rarest of either set, at places that its sizes
  allow (prefixes in an order by counts). They are joined by such shingles and by classes of
  sizes, and the least component of a shingle only with the others, so no bucket is
  expanded into pairs, and no link is lost.
* Before sets are compared, bitmaps of them give an upper bound of the intersection; a pair
  that the bound rules out is no link. One side's sets are moved to the other side's key.

With similarity s a link is missed if one collection has no common key: at most
``2 * (1 - s**rows) ** tables``. ``tables`` is chosen so that this is at most ``MISS`` at the
threshold (13 at 0.85, 18 at 0.8); above it, it is less. Shingles are compared by 64-bit
hashes: two different ones are equal with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .components import connected_components
from .linedup import dense_rank
from .storage import broadcast_if_small, durable, map_batches, release, settled

ROWS = 3
MISS = 1e-5
#: Leaders of a key, leaders a document is compared with, and 64-bit words of a bitmap.
LEADERS = 4
OFFERS = 16
BITMAP = 16
#: Bitmaps that may be broadcast, after they have been counted: 136 bytes each.
BROADCAST_BITMAPS = 50_000
#: Ratio of one class of set sizes to the next.
SIZE_STEP = 1.2
#: Cells in which shingles are counted to order them, at most so many numbers on the driver.
CELLS = 1 << 18
#: Steps of merging components after the first comparison.
EARLY_STEPS = 2
_SIGNED = pa.int64()
_DIGEST = ["n_shingles", "s1", "s2"]


def _functions(rows: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    n = 2 * rows * tables
    odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**64, n, dtype=np.uint64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64), _SIGNED))


def _signatures(batches: Iterable[pa.RecordBatch], k: int, rows: int, tables: int) -> Iterator[pa.RecordBatch]:
    odd, add = _functions(rows, tables)
    names = ["doc_id", "n_shingles", "s1", "s2", "keys"]
    width = 2 * tables
    salt = textnum.mix(np.arange(1, width + 1, dtype=np.uint64))
    for batch in batches:
        for lo, hi, data, offsets in textnum.slices(batch.column(1)):
            hashes, bounds = textnum.shingles(data, offsets, k)
            count = hi - lo
            size = np.zeros(count, np.int64)
            digest = np.zeros((2, count), np.uint64)
            for i in np.flatnonzero(np.diff(bounds)):
                own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                size[i] = len(own)
                digest[0, i] = np.add.reduce(textnum.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                digest[1, i] = np.add.reduce(textnum.mix(own + np.uint64(0x5851F42D4C957F2D)))
            some = np.flatnonzero(size)
            keys = np.zeros((count, width), np.uint64)
            if len(some):
                heads = bounds[:-1][some]
                scratch = np.empty_like(hashes)
                for t in range(width):
                    key = np.full(len(some), salt[t], np.uint64)
                    for f in range(t * rows, (t + 1) * rows):
                        np.multiply(hashes, odd[f], out=scratch)
                        np.add(scratch, add[f], out=scratch)
                        key = textnum.mix(key + np.minimum.reduceat(scratch, heads))
                    keys[some, t] = key
            filled = np.zeros(count + 1, np.int64)
            np.cumsum(np.where(size > 0, width, 0), out=filled[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, count).cast(_SIGNED),
                    pa.array(size),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    _lists(keys[some].reshape(-1), filled),
                ],
                names,
            )


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bitmap's words, then the number of its bits that are set."""
    bits = np.zeros(BITMAP * 64, bool)
    bits[textnum.mix(hashes) >> np.uint64(64 - (BITMAP * 64).bit_length() + 1)] = True
    return np.append(np.packbits(bits, bitorder="little").view(np.uint64), np.uint64(bits.sum()))


def _sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in textnum.slices(batch.column(1)):
            hashes, bounds = textnum.shingles(data, offsets, k)
            own = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo).cast(_SIGNED),
                    _lists(np.concatenate(own), ends),
                    _lists(np.concatenate([_bitmap(x) for x in own]), np.arange(hi - lo + 1) * (BITMAP + 1)),
                ],
                ["node", "shingles", "bits"],
            )


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(SIZE_STEP)).astype(np.int64)


def _prefixes(batches: Iterable[pa.RecordBatch], counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """(token, sizes, held, node, component, n, place) of the rarest shingles of each set.

    If two sets meet the threshold, the first shingle that they share in the order by counts
    is near the front of both: as many shingles as they share at least come from there on.
    ``held`` rows stand for a set as the smaller of a pair, and have its own class of sizes;
    the others for it as the larger, for every class of sizes that its place allows."""
    t = percent / 100
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            n = len(own)
            order = np.lexsort((own, counts[own & np.uint64(CELLS - 1)]))
            tokens = own[order[: n + 1 - -(-percent * n // 100)]].view(np.int64)
            place = np.arange(len(tokens))
            # the smaller set shares n * 2t / (1 + t) shingles at least with one not smaller
            held = place <= n - 2 * percent * n / (100 + percent) + 1e-6
            # a set of m shingles shares (n + m) * t / (1 + t) at least: no more than come after
            most = np.minimum((n - place) * (1 + t) / t - n + 1e-6, n)
            least = max(int(_size_class(np.array([t * n - 1e-6]).clip(1))[0]), 0)
            last = np.where(most >= 1, _size_class(most.clip(1)), -1)
            several = np.maximum(last - least + 1, 0)
            at = np.repeat(place, several)
            sizes = least + np.arange(len(at)) - np.repeat(np.cumsum(several) - several, several)
            rows = np.concatenate([place[held], at])
            size = np.concatenate([np.full(int(held.sum()), _size_class(np.array([n]))[0]), sizes])
            kind = np.concatenate([np.ones(int(held.sum()), bool), np.zeros(len(at), bool)])
            node, component = (pa.repeat(batch.column(c)[i], len(rows)) for c in (0, 1))
            number = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[rows]), number(size), pa.array(kind), node, component, number(np.full(len(rows), n)), number(rows)],
                ["token", "sizes", "held", "node", "component", "n", "place"],
            )


def tables_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Least number of keys in a collection with a chance of at most ``miss``."""
    alone = 1 - (percent / 100) ** rows
    tables = 1
    while 2 * alone**tables > miss:
        tables += 1
    return tables


def signatures(docs: DataFrame, k: int, tables: int, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys): set size, 128-bit set digest, and the keys of
    the two collections one after the other (none for an empty set)."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_batches(
        narrow,
        lambda it: _signatures(it, k, rows, tables),
        "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>",
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, q), written and distinct, whose sets meet the threshold, as links (u, v), by full
    intersection. The set of q goes to p; of the sets of p only one copy is moved."""
    sent = sets.join(broadcast_if_small(pairs), sets["node"] == F.col("q")).select("p", "q", F.col("shingles").alias("b"))
    asking = sets.join(broadcast_if_small(pairs.select("p")), sets["node"] == F.col("p"), "left_semi")
    both = sent.join(asking.select(F.col("node").alias("p"), F.col("shingles").alias("a")), "p")
    common = F.size(F.array_intersect("a", "b"))
    return (
        both.select("p", "q", common.alias("c"), (F.size("a") + F.size("b")).alias("total"))
        .where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("total") - F.col("c")))
        .select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))
    )


def _possible(n: Column, bits: Column, m: Column, bits2: Column, percent: int) -> Column:
    """Whether sets of sizes n and m with these bitmaps can meet the threshold. A bit that
    one set has alone is an element the other lacks, so this never denies a true link."""
    both = sum(
        (F.bit_count(F.get(bits, i).bitwiseAND(F.get(bits2, i))) for i in range(1, BITMAP)),
        F.bit_count(F.get(bits, 0).bitwiseAND(F.get(bits2, 0))),
    )
    most = both + F.least(n - F.get(bits, BITMAP), m - F.get(bits2, BITMAP))
    close = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    return close & (F.lit(100 + percent) * most >= F.lit(percent) * (n + m))


def _allowed(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """``pairs(p, q, ...)`` whose bitmaps (of a written table) do not rule a link out."""
    left = bitmaps.select(F.col("node").alias("p"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    right = bitmaps.select(F.col("node").alias("q"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    if bitmaps.limit(BROADCAST_BITMAPS + 1).count() <= BROADCAST_BITMAPS:
        left, right = F.broadcast(left), F.broadcast(right)
    met = pairs.join(right, "q").join(left, "p")
    return met.where(_possible(F.col("n1"), F.col("b1"), F.col("n2"), F.col("b2"), percent)).select(*pairs.columns)


def _leaders(met: DataFrame, popular: DataFrame) -> DataFrame:
    """(key, leaders) of ``met(node, key)``: the class that shares most keys with others, as
    the original of many edited copies does, and the least ones by hashes."""
    drawn = [F.min(F.struct(F.xxhash64("node", "key", F.lit(i)).alias("r"), "node")).alias(f"r{i}") for i in range(1, LEADERS)]
    first = F.max(F.struct("popular", F.xxhash64("node").alias("r"), "node")).alias("r0")
    named = F.array_distinct(F.array(*[F.col(f"r{i}.node") for i in range(LEADERS)]))
    known = met.select("node", "key").join(popular.select("node", "popular"), "node")
    return known.groupBy("key").agg(first, *drawn).select("key", named.alias("leaders"))


def _asked(met: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, q) of a node and a leader that share a key; of each node at most ``OFFERS``
    that bitmaps allow. The likeliest leaders, those of most keys, go first, and one chance is
    as good as another among equals; what is left out is met in ``_across``."""
    offers = (
        met.select(F.col("node").alias("q"), F.explode("leaders").alias("p"))
        .where("p <> q")
        .groupBy("q", "p")
        .agg(F.count("*").alias("shared"))
        .withColumn("r", F.xxhash64("q", "p"))
    )
    first = F.sort_array(F.collect_list(F.struct("shared", "r", "p")), asc=False)
    offers = offers.groupBy("q").agg(F.slice(first, 1, 2 * OFFERS).alias("first")).select("q", F.inline("first"))
    allowed = _allowed(offers, bitmaps, percent)
    return allowed.groupBy("q").agg(F.slice(first, 1, OFFERS).alias("best")).select(F.explode("best.p").alias("p"), "q")


def _tensored(labelled: DataFrame) -> DataFrame:
    """(node, component, a, b): nodes with keys of both collections that other components have
    too, and those keys. Two nodes share a table key, a pair of ``a`` and ``b``, if they share
    a key of either; so table keys are compared as such pairs, and never listed."""
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    sides = labelled.join(broadcast_if_small(durable(mixed)), "key", "left_semi").groupBy("node", "component").agg(
        F.collect_set(F.when(F.col("first"), F.col("key"))).alias("a"),
        F.collect_set(F.when(~F.col("first"), F.col("key"))).alias("b"),
    )
    return sides.where((F.size("a") > 0) & (F.size("b") > 0))


def _across(sides: DataFrame, sets: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, q) of ``sides`` in different components that share a table key, a shingle of
    either prefix, and that bitmaps allow."""
    own = sets.join(broadcast_if_small(sides.select("node", "component")), "node")
    cell = F.col("token").bitwiseAND(CELLS - 1).cast("int")
    counted = own.select(F.explode("shingles").alias("token")).groupBy(cell.alias("cell")).count().toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    listed = own.select("node", "component", "shingles")
    schema = "token long, sizes int, held boolean, node long, component long, n int, place int"
    tokens = durable(map_batches(listed, lambda it: _prefixes(it, counts, percent), schema))
    # what the least component of a token has is not paired with itself: the components that
    # grew have the least ids
    met = tokens.groupBy("token", "sizes").agg(
        F.min("component").alias("top"), F.max("component").alias("hi"), F.bool_or("held").alias("held"), F.bool_and("held").alias("only")
    )
    met = durable(met.where("top < hi and held and not only").select("token", "sizes", "top"))
    live = durable(tokens.join(broadcast_if_small(met), ["token", "sizes"]).withColumn("main", F.col("component") == F.col("top")).drop("top"))
    side = lambda held, names: live.where(held).select("token", "sizes", *[F.col(c).alias(c + names) for c in ("node", "component", "n", "place", "main")])
    fewer, more = side("held", "1"), side("not held", "2")
    shares = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    fits = (
        (F.struct("n1", "node1") < F.struct("n2", "node2"))
        & (F.col("component1") != F.col("component2"))
        & (F.lit(100 + percent) * shares >= F.lit(percent) * (F.col("n1") + F.col("n2")))
    )
    both = [
        fewer.where(x).join(more.where(y), ["token", "sizes"]).where(fits).select(F.col("node1").alias("p"), F.col("node2").alias("q"))
        for x, y in (("not main1", "true"), ("main1", "not main2"))
    ]
    pairs = both[0].unionByName(both[1]).distinct()
    keys = lambda name, x, y: sides.select(F.col("node").alias(name), F.col("a").alias(x), F.col("b").alias(y))
    met = durable(_allowed(pairs, bitmaps, percent)).join(keys("q", "a2", "b2"), "q").join(keys("p", "a1", "b1"), "p")
    return met.where(F.arrays_overlap("a1", "a2") & F.arrays_overlap("b1", "b2")).select("p", "q")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: components of
    documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` / 100
    or more; the least doc_id of a component names it and is kept.

    Null and empty texts have an empty set, link with nothing and are kept; a row without
    doc_id is never linked, has a null component and is kept; rows that repeat a doc_id are
    one document, so all of them are linked as one; an empty table gives no rows."""
    tables = tables_for(percent, rows)
    signed = durable(signatures(docs, k, tables, rows))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = durable(
        usable.groupBy(*_DIGEST).agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys"))
    )
    # rows of one doc_id that differ are linked by it; a doc_id is in one class otherwise
    digest = F.struct(*_DIGEST)
    ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    again = durable(ids.where("lo <> hi").select("doc_id"))
    repeated = not again.isEmpty()

    keyed = classes.select("node", F.posexplode("keys").alias("at", "key")).select("node", "key", (F.col("at") < tables).alias("first"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    met = durable(keyed.join(durable(shared.where("lo < hi").select("key", "n")), "key"))
    popular = met.groupBy("node").agg(F.sum("n").alias("popular"), F.bool_or("first").alias("a"), F.bool_and("first").alias("b"))
    popular = durable(popular)
    likely = popular.where("a and not b").select("node")
    leaders = durable(_leaders(met, popular))
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    own = narrow.join(broadcast_if_small(likely.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi")
    sets = durable(map_batches(own, lambda it: _sets(it, k), "node long, shingles array<long>, bits array<long>"))
    bitmaps = sets.select("node", F.size("shingles").alias("n"), "bits")

    pairs = durable(_asked(met.join(leaders, "key"), bitmaps, percent))
    links = _confirmed(pairs, sets, percent)
    if repeated:
        several = usable.join(broadcast_if_small(again), "doc_id", "left_semi").select("doc_id", *_DIGEST)
        named = several.join(classes.select("node", *_DIGEST), _DIGEST)
        links = links.unionByName(named.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    links = durable(links)
    early = durable(connected_components(links, EARLY_STEPS))
    labelled = met.join(broadcast_if_small(early), "node", "left").select("node", "key", "first", F.coalesce("component", "node").alias("component"))
    labelled = durable(labelled.join(broadcast_if_small(likely), "node", "left_semi"))
    release(met)
    sides = durable(_tensored(labelled))
    if not sides.isEmpty():
        pairs = durable(_across(sides, sets, bitmaps, percent))
        links = durable(links.unionByName(_confirmed(pairs, sets, percent)))
    release(sets)
    labels = durable(connected_components(links))
    # a class has its node's component, and its copies have the class's
    component = F.coalesce("component", "node").alias("component")
    named = classes.select("node", *_DIGEST).join(broadcast_if_small(labels), "node", "left").select(*_DIGEST, component)
    usable_digest = [F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in _DIGEST[1:]]
    answer = signed.select("doc_id", "n_shingles", *usable_digest).join(durable(named), _DIGEST, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")
    )
    if repeated:
        own = answer.join(broadcast_if_small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("shared"))
        answer = answer.join(broadcast_if_small(durable(own)), "doc_id", "left").withColumn("component", F.coalesce("shared", "component"))
    component = F.coalesce("component", "doc_id")
    return answer.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near-duplicates of kept documents. Rows repeating a doc_id
    become one, that of the least text hash. Rows without doc_id are documents by their
    text, numbered behind the greatest doc_id; of them those without a word all stay."""
    text = F.coalesce(docs["text"], F.lit(""))
    columns = [f"_d{i}" for i in range(len(docs.columns))]
    keyed = docs.select(
        *[docs[c].alias(d) for c, d in zip(docs.columns, columns, strict=True)],
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].alias("text"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("#"), text).alias("t2"),
    )
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    greatest, n = keyed.agg(F.max("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if n:
        node = (F.col("rank") + F.lit((-1 if greatest is None else greatest) + 1)).alias("_node")
        texts = keyed.where(nameless).select("t1", "t2").distinct()
        unnamed = settled(lambda: dense_rank(durable(texts), "t1", "t2").select("t1", "t2", node))
        # null hashes on rows that have a doc_id or no word, so that these match nothing
        asked = keyed.withColumns({c: F.when(nameless, F.col(c)) for c in ("t1", "t2")})
        met = asked.join(broadcast_if_small(unnamed), ["t1", "t2"], "left")
        keyed = met.select(*columns, F.coalesce("doc_id", "_node").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), F.xxhash64(F.lit("#"), F.coalesce("text", F.lit(""))).alias("t2"))
    dropped = settled(lambda: near_duplicates(keyed.select("doc_id", "text"), k, percent).where(~F.col("kept")).select("doc_id"))
    left = keyed.join(dropped, "doc_id", "left_anti")
    counted = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    again = durable(counted.where("n > 1").select("doc_id"))
    once = left
    if not again.isEmpty():
        once = left.join(broadcast_if_small(again), "doc_id", "left_anti")
    out = once.select(*[F.col(d).alias(c) for c, d in zip(docs.columns, columns, strict=True)])
    if once is left:
        return out
    row = F.min_by(F.struct(*columns), F.struct("t1", "t2")).alias("row")
    several = left.join(broadcast_if_small(again), "doc_id", "left_semi").groupBy("doc_id").agg(row)
    return out.unionByName(several.select(*[F.col("row")[d].alias(c) for c, d in zip(docs.columns, columns, strict=True)]))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y
      where 100 * c >= 85 * (nx.n + ny.n - c)),
u as (select x, y from e union select y, x from e),
r(root, node) as (select doc_id, doc_id from d union select r.root, u.y from r join u on r.node = u.x),
m as (select node, min(root) c from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id, d.doc_id = m.c kept
from d left join n using (doc_id) join m on m.node = d.doc_id"""
