"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Texts count as equal after each run of white space became one space. Every step looks only at rows that
the step before could not tell apart, so the whole text is hashed for few of them. What goes from a step
to the next is a bitmap of the surviving keys: a table of a fixed most size, whatever the corpus holds,
so the filter is always a broadcast on the map side and no text is ever shuffled. Two keys that share a
bit only let a row through to the next step; the last one compares 256-bit hashes of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import join_counted, kept

PREFIX_CHARS = 128
BITMAP_BITS = 24  # bits of a bitmap, as a power of two: at most 2^18 rows of 64 bits


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null is empty. In Java patterns \\s is exactly [\\x20\\x09-\\x0D]."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")


def _bit(*key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in the bitmap."""
    place = F.shiftrightunsigned(F.xxhash64(*key), 64 - BITMAP_BITS)
    return F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The bitmap (word, bits) of the keys that two rows or more have."""
    word, bit = _bit(*[F.col(k) for k in key])
    twice = rows.groupBy(*key).agg(F.count("*").alias("_rows")).where("_rows > 1")
    bits = twice.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    return kept(bits, "bitmap")


def _marked(rows: DataFrame, bitmap: DataFrame, name: str, *key: str) -> DataFrame:
    """Add `name`: whether the row's key is in the bitmap, up to keys that share a bit."""
    word, bit = _bit(*[F.col(k) for k in key])
    # bounded by 2^(BITMAP_BITS - 6) rows
    found = rows.withColumn("_word", word).join(F.broadcast(bitmap.withColumnRenamed("word", "_word")), "_word", "left")
    here = F.call_function("getbit", F.col("bits"), bit) == 1
    return found.withColumn(name, F.coalesce(here, F.lit(False))).drop("_word", "bits")


def marks(docs: DataFrame, **more: Column) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, digest, and the columns `more` over `docs`.

    keep_id is the smallest doc_id of the rows with an equal text, null only where none has an id;
    group_size counts these rows, and `kept` says that the row has that id. Rows that repeat the id and the
    text of the row that stays are that row again and are marked so too. `digest` is the SHA-256 of the
    normalised text where it had to be read, else null. Needs doc_id and text, whatever other columns
    there are; null and empty texts are equal, and blank ones equal one space. An empty table gives an
    empty table.
    """
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_text"), *[c.alias(n) for n, c in more.items()])
    rows = rows.withColumn("_chars", F.char_length("_text"))
    rows = _marked(rows, _repeated(rows, "_chars"), "_near", "_chars")
    # the prefix is only hashed in rows that share their length
    rows = rows.withColumn("_prefix", F.when(F.col("_near"), F.xxhash64(F.substring("_text", 1, PREFIX_CHARS))))
    rows = _marked(rows, _repeated(rows.where("_near"), "_chars", "_prefix"), "_same", "_chars", "_prefix")
    rows = rows.withColumn("digest", F.when(F.col("_near") & F.col("_same"), F.sha2("_text", 256)))
    rows = rows.select("doc_id", "digest", *more, "_chars", "_prefix")

    groups = kept(rows.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "equal-texts")
    groups = groups.withColumn("_rows", F.col("group_size")).withColumnRenamed("digest", "_digest")
    # rows without a digest get keys that match nothing, spread evenly
    key = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("doc_id", "_chars").cast("string")))
    found = join_counted(rows.withColumn("_digest", key), groups, ["_digest"], groups.count(), "_rows")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "digest", *more)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, of which one stays for each text: one of the smallest doc_id.

    Only the rows that stay are shuffled, and only where rows repeat an id in a group.
    """
    marked = marks(docs, _row=F.struct("*")).where("kept")
    alone = marked.where("group_size = 1").select("_row.*")
    # rows that repeat an id and a text, other columns aside, are one document
    copied = marked.where("group_size > 1").dropDuplicates(["digest"]).select("_row.*")
    return alone.unionByName(copied)
