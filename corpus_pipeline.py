"""From raw documents to packed sequences: the stages, in order, and a run over a whole table.

Each stage works on all rows that the one before kept. Every stage but the last returns the columns
of the documents; `n_chars` follows the text where a stage changes it.

In every stage a null text counts as empty, texts of any length are read whole, and an empty table gives
an empty one. Columns of any other names pass through. What becomes of empty texts, repeated rows and ties
stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeframe.llm import line_dedup, mixing, packing, quality_rules, simhash
from spikeframe.llm.common import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. An empty text has too few words and goes; repeated rows have one verdict."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share.

    A text of which nothing stays is empty, also a null one; each of several rows with one id counts as a document.
    """
    out = line_dedup.line_dedup(docs, counts=())
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates.

    Empty texts have the fingerprint 0 and are one group with what is near to it. Of repeated rows one stays; null ids
    come after all others.
    """
    return simhash.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, at most twice.

    A null source is one of its own, last in the order. Repeated rows are mixed each; an empty text has no size.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, a document as often as it is in the mix, in sequences.

    An empty text is its end token alone. Repeated rows are packed each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.MODEL))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", pack),
]
ORACLE_SQL = None  # fingerprints and packing are beyond SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over `documents`; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
