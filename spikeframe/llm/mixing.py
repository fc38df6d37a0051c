"""Mixing sources to target weights.

Words are summed per source; the shares are capped at twice a source's size and the excess is
reshared until no source is above. The repetition rate of a source is target / size: each of its
documents is taken floor(rate) times, and once more with the fraction as probability, decided by a
hash of the document. All arithmetic up to the last division is in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import global_rank, join_counted, kept, words_of

# Weights of the sources in order, the size of the mix and the limit, as multiples of sizes.
WEIGHTS = (5, 2, 1)
SHARE_HALVES = 3  # 150 %
LIMIT = 2
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(docs: DataFrame) -> DataFrame:
    """Per source: source, source_size, documents, target. Needs `source` and `_size`; null is a source, the last."""
    sizes = docs.groupBy("source").agg(
        F.sum("_size").alias("source_size"), F.count("*").alias("documents"))
    ranked = global_rank(sizes, "place", F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    sources = kept(ranked.select(
        "source", "source_size", "documents", F.get(weights, F.col("place") % len(WEIGHTS)).alias("weight")), "sources")

    total = sources.agg(F.sum("source_size")).first()[0]
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    size, weight = F.col("source_size"), F.col("weight")
    above, state = F.lit(False), None
    while total:
        c, w = sources.agg(
            F.coalesce(F.sum(F.when(above, size)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0))).first()
        if (c, w) == state:
            break
        state = (c, w)
        # target = rest * weight / (2 * w) of the sources below the limit; it only grows from round to round
        rest = SHARE_HALVES * total - 2 * LIMIT * c
        above = big(rest) * weight > big(2 * LIMIT * w) * size
    if not total:
        return sources.select("source", size, "documents", F.lit(0.0).alias("target"))
    c, w = state
    rest = SHARE_HALVES * total - 2 * LIMIT * c
    fair = (big(rest) * weight).cast("double") / F.lit(float(2 * w))
    return sources.select(
        "source", size, "documents", F.when(above, (size * LIMIT).cast("double")).otherwise(fair).alias("target"))


def _draw() -> Column:
    """A number in [0, 1) from the document's id, or from its text where the id is null."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("t"), F.col("_text")), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(docs: DataFrame) -> DataFrame:
    """All columns of `docs` in a struct `row`, with size, source_size, target and the number of `copies`.

    Needs doc_id, text and source. Null and blank texts have size 0; a null source is a source of its
    own. Rows with one doc_id share their draw. An empty table gives an empty table; extra columns stay in `row`.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"),
        F.col("source").alias("_source"), size_of(F.col("text")).alias("_size"))
    targets = kept(source_targets(rows.select(F.col("_source").alias("source"), "_size")), "targets")
    number = targets.count()
    # the key is never null, so that a plain join finds the null source too
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_key")
    joined = join_counted(
        rows.withColumn("source", F.col("_source")).select("*", key).drop("source", "_source"),
        targets.select(key, "source_size", "documents", "target"), ["_key"], number, "documents", "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.select(
        "row", F.col("_size").alias("size"), "source_size", "target",
        (whole + F.when(_draw() < rate - whole, 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as its source's rate asks for, in the columns of `docs`."""
    return copies(docs).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
