"""Helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikeframe.layout import kept_folder

# White space is \x20 and \x09-\x0D only.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

BROADCAST_ROWS = 200_000  # a counted table of at most so many narrow rows may be broadcast
SALT_ROWS = 1_000_000  # rows of one key that one task joins


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    return f"{kept_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = table.sparkSession
    path = shared_folder(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def sample_texts(docs: DataFrame, rows: int, most_bytes: int = 1 << 16) -> list[str]:
    """At most so many texts, none longer than `most_bytes`, for estimates that only set the speed.

    take() reads as few partitions as it needs, and both bounds hold at every size of the table.
    """
    short = docs.select("text").where(F.octet_length("text") <= most_bytes)
    return [row.text for row in short.take(rows)]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay. Texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null and blank texts. In Java patterns \\s is exactly the white space above."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), "")


def hash_pair(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for the values."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: int, count: str, how: str = "left") -> DataFrame:
    """Join `right`, of `rows` measured rows, one for each key, whose column `count` says how many rows `left` has of it.

    A small table is broadcast. Else the join is shuffled, with the rows of a key of more than SALT_ROWS
    spread over salts; the table of such keys holds at most 1/SALT_ROWS of the rows and is counted too.
    """
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(count)), on, how)
    heavy = right.where(F.col(count) > SALT_ROWS).select(
        *on, F.ceil(F.col(count) / F.lit(SALT_ROWS)).cast("int").alias("_salts"))
    heavy_rows = heavy.count()
    if not heavy_rows:
        return left.join(right.drop(count), on, how)
    if heavy_rows <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    salted = left.join(heavy, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = right.join(heavy, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts", count)
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def global_rank(table: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add the position of a row in the whole order, from 0, without one task for all rows."""
    parts = kept(table.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (parts.withColumn("_row", within).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_row") + F.col("_offset") - 1).drop("_part", "_row", "_offset"))


def word_chunks(data: bytes, chunk: int = 1 << 20):
    """The words of a text (UTF-8), as lists of bounded size; bytes.split() splits at exactly the white space above."""
    if len(data) <= chunk:
        yield data.split()
        return
    start, spaces = 0, SPACES.encode()
    while start < len(data):
        end = min(start + chunk, len(data))
        while end < len(data) and data[end] not in spaces:
            end += 1
        yield data[start:end].split()
        start = end


def groups(texts: list, size: int = 1 << 20):
    """Neighbouring texts in lists of about `size` bytes or characters; a longer text is alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group
