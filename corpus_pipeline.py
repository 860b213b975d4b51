"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents`` (doc_id, text, lang, source,
n_chars), whatever others there are beside them; the last returns the packed pieces. Only
doc_id, text and source are read. In every stage an empty table gives no rows, whole texts
are read whatever their length, and columns that clash with names made inside are kept
apart. What a null, an empty text, a tie or a repeated row means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import linedup, minhash, mixing, packing, quality
from impactframe.llm.storage import release, settled


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of ``df`` with ``text`` in place of the text, and n_chars to match."""
    put = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[put[c].alias(c) if c in put else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject failing documents; take boilerplate lines out of the others.

    Null and empty texts have fewer than the least words and go; a null source is a host of
    its own; repeated rows are judged alike, and count once for the frequency of lines."""
    return _with_text(quality.score_documents(docs).where("kept"), docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs, and documents that were nothing else.

    Of equal texts the one of least doc_id is first (null comes last); rows that repeat doc_id
    and text are one document and cleaned alike; null and empty texts lose nothing and stay."""
    cleaned = linedup.deduplicate_lines(docs, edges=True)
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("clean_text") != ""))
    return _with_text(left, docs.columns, "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8.

    The least doc_id of a group stays; rows that repeat a doc_id become one, that of the least
    text hash; rows without doc_id are documents by their text; null and empty texts are like
    nothing and stay."""
    return minhash.keep_one(docs, k=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the fitted rates say.

    Null and empty texts have no tokens and the prior as posterior; equal doc_ids draw alike;
    null and repeated ids in ``labels`` are allowed (the worst label counts), and without any
    label the posterior is even."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens.

    Null and empty texts are their end token alone; a null doc_id stays null; repeated rows are
    packed as often as they come."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]
#: Not expressible in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir))
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
