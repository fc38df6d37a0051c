"""The registered queries: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeframe.llm import (
    alignment, collocations, cotrain, exact_dedup, line_dedup, mixing, oracle, packing, pii, quality_rules, search, simhash, token_counts, warc,
)
from spikeframe.llm.common import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir)).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text("base_spans"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), _tokenizer(token_counts.MODEL))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return search.search(docs, docs.where(F.col("doc_id") % 20 == 0)).select("query_id", "rank", "doc_id", "score")


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer(packing.MODEL))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = shared_folder(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), archive)
    return warc.read_warc(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_documents(spark, sf_dir), _tokenizer(alignment.MODEL_A), _tokenizer(alignment.MODEL_B))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select(*[c for c in aligned.columns if c != "groups"], digest.alias("groups_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha256 = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    marked = exact_dedup.marks(_documents(spark, sf_dir), text_sha256=sha256)
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_pii": op2_pii,
        "op3_token_counts": op3_token_counts,
        "op4_mixing": op4_mixing,
        "op5_topk_search": op5_topk_search,
        "op6_cotraining": op6_cotraining,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_warc": op10_warc,
        "op11_collocations": op11_collocations,
        "op12_alignment": op12_alignment,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.STATEMENTS)
