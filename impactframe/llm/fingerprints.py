"""Canonical exact digests of documents.

A text's canonical form is its NFKC form, case-folded, with white-space runs folded to one
blank and none at the ends; its fingerprint is the 128-bit xxhash of that form. Documents of one digest are then
compared byte by byte: canonical forms that differ within a digest get ``-1``, ``-2``, ...
in byte order, so equal fingerprints mean equal canonical forms.

Scale: texts move once, to place each beside its successor in doc_id order (buckets of a
quantile of doc_id, with the first row of the next bucket copied over); the byte
comparison groups only the canonical forms of digests that come more than once, with
map-side partial aggregation, so a hot group of copies is one row for each task.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, durable, map_batches, partitions

DIGEST_BITS = 128
_LEAST = -(2**63)


def canonical(text: str | None) -> str:
    """NFKC, case folding, then white-space folding; casing can undo a normal form, so the
    normal form is taken again after folding."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest(form: str, bits: int = DIGEST_BITS) -> str:
    import xxhash

    value = xxhash.xxh3_128_intdigest(form.encode())
    return f"{value >> (128 - bits):0{(bits + 3) // 4}x}"


def second(form: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form.encode(), seed=1)


def edit(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by the first as many (or all)
    of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_PAIR_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, digest string, second string, "
    "edited_digest string, edited_second string, near_edited double, near_next double"
)


def _edited(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and place in it; a donor ends its bucket."""
    fields = [part.split() for part in _PAIR_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    held = None
    rows: list[tuple] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for (doc_id, bucket, donor), text in zip(zip(*columns, strict=True), batch.column(3), strict=True):
            text = text.as_py()
            form = canonical(text)
            own = digest(form, bits)
            if held is not None and held[0] == bucket:
                _, held_id, held_text, held_form, held_digest = held
                changed = edit(held_text, text)
                changed_form = canonical(changed)
                rows.append(
                    (
                        held_id,
                        len(held_text),
                        hashlib.sha256(changed.encode()).hexdigest(),
                        held_digest,
                        second(held_form),
                        digest(changed_form, bits),
                        second(changed_form),
                        float(changed_form == held_form),
                        float(form == held_form),
                    )
                )
            held = None if donor else (bucket, doc_id, text, form, own)
            if len(rows) >= 5000:
                yield _batch(rows, fields, kinds)
                rows = []
    if rows:
        yield _batch(rows, fields, kinds)


def _batch(rows: list[tuple], fields: list, kinds: dict) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def _bucket(key, bounds: list[int]):
    """Number of bounds below ``key``, by binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    listed = F.lit(bounds)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(a, _):
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(listed, middle) < key
        done = a["lo"] >= a["hi"]
        return F.struct(
            F.when(~done & below, middle + 1).otherwise(a["lo"]).alias("lo"),
            F.when(~done & ~below, middle).otherwise(a["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda a: a["lo"])


def successors(docs: DataFrame) -> DataFrame:
    """Rows by bucket in descending doc_id, each bucket ended by a copy of the next
    bucket's first row (``donor``); after the last bucket comes the first."""
    spark = docs.sparkSession
    n = partitions(spark)
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    ids = own.select("key")
    cuts = ids.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    # one row a bucket: bounded by the number of partitions
    tops = (
        ids.withColumn("bucket", _bucket(F.col("key"), bounds))
        .groupBy("bucket")
        .agg(F.max("key").alias("top"))
        .orderBy(F.desc("bucket"))
        .collect()
    )
    after = {tops[(i + 1) % len(tops)]["top"]: tops[i]["bucket"] for i in range(len(tops))}
    gives = F.lit(None).cast("int")
    if after:
        listed = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
        gives = F.when(F.col("key").isin(list(after)), listed[F.col("key")]).cast("int")
    places = F.array(
        F.struct(_bucket(F.col("key"), bounds).cast("int").alias("bucket"), F.lit(False).alias("donor")),
        F.struct(gives.alias("bucket"), F.lit(True).alias("donor")),
    )
    placed = own.select("doc_id", "key", "text", F.inline(places)).where("bucket is not null")
    return placed.repartitionById(n, F.col("bucket")).sortWithinPartitions(
        "bucket", "donor", F.desc("key"), "text"
    )


def fingerprint_documents(docs: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """For every row its canonical fingerprint, that of its edited text (the last third
    replaced by the start of the next document in descending doc_id), and whether its
    canonical form is that of the edited text and of the next document.

    Null text is empty; a null doc_id comes last and is returned as null; rows that repeat a
    doc_id are ordered by text; a single row follows itself; an empty table gives no rows;
    other columns are ignored. ``bits`` may be lowered to test the byte comparison."""
    placed = successors(docs).select("doc_id", "bucket", "donor", "text")
    pairs = durable(map_batches(placed, lambda it: _edited(it, bits), _PAIR_SCHEMA))
    ranks = durable(variant_ranks(docs, pairs.select("digest"), bits))
    if ranks.isEmpty():
        own, edited = F.col("digest"), F.col("edited_digest")
    else:
        for name in ("", "edited_"):
            named = ranks.select(
                F.col("digest").alias(f"{name}digest"),
                F.col("second").alias(f"{name}second"),
                F.concat(F.lit("-"), F.col("rank").cast("string")).alias(f"{name}suffix"),
            )
            pairs = pairs.join(named, [f"{name}digest", f"{name}second"], "left")
        own = F.concat("digest", F.coalesce("suffix", F.lit("")))
        edited = F.concat("edited_digest", F.coalesce("edited_suffix", F.lit("")))
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        own.alias("fingerprint"),
        edited.alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _forms(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([digest(f, bits) for f in forms], pa.string()),
                pa.array([second(f) for f in forms], pa.string()),
                pa.array(forms, pa.string()),
            ],
            ["digest", "second", "form"],
        )


def variant_ranks(docs: DataFrame, digests: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """(digest, second, rank) of every canonical form but the first, in byte order, of a
    digest that several forms share; normally empty. The forms themselves are compared;
    ``second``, another hash, only leads the rank back to the rows."""
    repeated = durable(digests.groupBy("digest").count().where("count > 1").select("digest"))
    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    forms = map_batches(texts, lambda it: _forms(it, bits), "digest string, second string, form string")
    distinct = (
        forms.join(broadcast_if_small(repeated), "digest", "left_semi").groupBy("digest", "second", "form").count()
    )
    variants = distinct.select("digest", "second", "form")
    several = variants.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    order = Window.partitionBy("digest").orderBy(F.col("form").cast("binary"))
    ranked = variants.join(several, "digest", "left_semi").withColumn("rank", F.row_number().over(order) - 1)
    return ranked.where("rank > 0").select("digest", "second", "rank")
