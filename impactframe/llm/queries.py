"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, licenses, linedup, minhash, mixing, packing, quality, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles at 85 percent."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.get("posterior", j).alias(f"p_{name}") for j, name in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "n_copies")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *quality.METRICS, "base_failed", "kept", "n_removed_words")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linedup.deduplicate_lines(table(spark, sf_dir, "documents"), edges=True)
    return cleaned.select(
        "doc_id",
        "n_removed",
        "n_runs",
        F.length("clean_text").cast("long").alias("n_chars"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_minhash": op2_minhash,
        "op3_language": op3_language,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_mixing": op6_mixing,
        "op7_licenses": op7_licenses,
        "op8_quality": op8_quality,
        "op9_chat": op9_chat,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash": minhash.ORACLE,
        "op5_sharding": sharding.oracle(),
        "op8_quality": quality.oracle(),
        "op9_chat": chat.ORACLE,
    }
