"""Dropping lines that many documents share.

Lines are normalised, hashed and counted by the documents they occur in (one row per document and
line, partial sums before the shuffle). Positions of frequent lines are gathered per document, and
only they are joined back to the texts, which are shuffled once and reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import SPACES, ascii_lower, hash_pair, join_counted, kept

MIN_DOCUMENTS = 10
MIN_CHARS = 1
COUNTS = "_n_lines", "_n_dropped"


def _keys(text: Column) -> Column:
    """The keys of all lines, by position."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))


def _long_enough(key: Column) -> Column:
    return F.char_length(key) >= MIN_CHARS


def frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Hashes (h1, h2) of the keys found in at least so many rows of `docs`, with that number.

    Needs `text`. The two hashes have 128 bits together.
    """
    keys = docs.select(F.explode(F.array_distinct(F.filter(_keys(F.col("text")), _long_enough))).alias("key"))
    h1, h2 = hash_pair(F.col("key"))
    return (keys.select(h1.alias("h1"), h2.alias("h2"))
            .groupBy("h1", "h2").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents))


def line_dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, counts: tuple[str, ...] = COUNTS) -> DataFrame:
    """All columns of `docs` with `text` replaced by the lines that stay, plus the numbers of lines and of dropped ones.

    `counts` names these two columns; a name that `docs` has already is refused, and () leaves both out.

    Every row counts as a document of its own, also a repeated one. A null or empty text is one
    empty line, which stays, and comes back as an empty text. Lines without a character never count.
    Needs `doc_id` and `text`; other columns, whatever their names, pass through. An empty table
    gives an empty table.
    """
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in counts}:
        raise ValueError(f"columns of these names are there already: {sorted(taken)}")
    d1, d2 = hash_pair(F.col("doc_id"), F.col("text"))
    rows = docs.select(d1.alias("d1"), d2.alias("d2"), F.col("text"), F.struct("*").alias("row"))
    frequent = kept(frequent_lines(docs, min_documents), "frequent-lines")
    number = frequent.count()

    lines = rows.select("d1", "d2", F.posexplode(_keys(F.col("text"))).alias("position", "key"))
    h1, h2 = hash_pair(F.col("key"))
    lines = lines.where(_long_enough(F.col("key"))).select("d1", "d2", "position", h1.alias("h1"), h2.alias("h2"))
    # A row (d1, d2) that is repeated has the same lines, so a set of positions serves all its copies.
    dropped = join_counted(lines, frequent, ["h1", "h2"], number, "documents", "inner").groupBy("d1", "d2").agg(
        F.collect_set("position").alias("dropped"))

    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    joined = rows.join(dropped, ["d1", "d2"], "left").withColumn("lines", split)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_sort(stay), lambda i: F.get(F.col("lines"), i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    numbers = F.size("lines").cast("long"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return joined.select(*columns, *[n.alias(c) for n, c in zip(numbers, counts)])
