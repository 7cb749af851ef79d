"""The thin queries of the operators, as __spark_entry__ registers them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm import license_scan, media, mixing, near_dup, packing, quality, secret_scan, suffix_dedup, token_count, url_filter
from motifline.llm.common import Scratch
from motifline.llm.tokenizing import default_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(spark, documents(spark, sf_dir).select("doc_id", "text")).drop("kept")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("key")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a new ledger, so every blob is unseen."""
    paths, findings = secret_scan.scan(spark, documents(spark, sf_dir).select("doc_id", "text"), f"{Scratch(spark, 'ledger').root}/ledger")
    none = F.array().cast(secret_scan.SPANS)
    out = paths.join(findings, "blob", "left").select(F.col("_key").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "blob",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts are written to flat files first, which are then scanned."""
    files = Scratch(spark, "tokens").put(token_count.write(documents(spark, sf_dir).select("doc_id", "text"), default_path()), "files")
    return token_count.by_document(files)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(spark, documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_license_scan, op4_quality_rules, op5_best_fit_packing, op6_secret_scan, op7_token_counts, op8_mix_sources, op9_near_duplicates, op10_gif_media)}
SQL: dict[str, str] = {"op2_url_filter": url_filter.sql(), "op3_license_scan": license_scan.sql(), "op6_secret_scan": secret_scan.sql(), "op8_mix_sources": mixing.sql()}
