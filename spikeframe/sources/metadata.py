"""The recording metadata table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_meta(spark: SparkSession, path: str, optional: bool = False, header: bool = True) -> DataFrame:
    """Read the metadata table from CSV or Parquet.

    The mandatory columns come first; `optional` adds region, upperLayerChannels
    and hasHP. Further columns of a CSV file are not read. Columns of a file without
    a header go by position, in that order. A recording that is listed twice, also
    once with and once without ".txt", raises an error.
    """
    fields = schemas.META.fields + (schemas.META_OPTIONAL.fields if optional else [])
    names = [f.name for f in fields]
    if path.rstrip("/").endswith(".parquet"):
        return check_listed_once(spark.read.parquet(path).select(*names))
    # By name, so that a file with more columns or another order reads the same.
    table = spark.read.option("header", header).csv(path)
    if not header:
        if len(table.columns) < len(names):
            raise ValueError(f"{path} has {len(table.columns)} columns, {len(names)} are needed")
        table = table.select(*[F.col(c).alias(n) for c, n in zip(table.columns, names)])
    return check_listed_once(table.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields]))


def tidy_meta(meta: DataFrame) -> DataFrame:
    """Rows with an animal, without the columns whose name starts with "NA"."""
    unnamed = [c for c in meta.columns if c.lower().startswith("na")]
    return meta.where(F.col("animalID").isNotNull()).drop(*unnamed)


def base_name(name: str = "fileName") -> Column:
    """The name of a recording without ".txt"."""
    return F.regexp_replace(F.col(name), r"\.txt$", "")


def duplicate_recordings(meta: DataFrame) -> DataFrame:
    """Recordings listed more than once, by base name. Joins expect this to be empty."""
    named = meta.where(F.col("fileName").isNotNull()).groupBy(base_name().alias("fileName"))
    return named.agg(F.count("*").cast(T.LongType()).alias("n")).where(F.col("n") > 1)


def check_listed_once(meta: DataFrame) -> DataFrame:
    """The table itself, if no recording is listed twice; else an error with the first names."""
    if names := [r.fileName for r in duplicate_recordings(meta).orderBy("fileName").take(20)]:
        raise ValueError(f"recordings listed more than once: {', '.join(names)}")
    return meta


def listed_once(meta: DataFrame, **columns: Column) -> DataFrame:
    """fileName and these columns, one row per recording, for a join.

    The query fails with the name when a recording turns up twice, so a join can
    never multiply spikes. The check is part of the plan and costs no job.
    """
    named = meta.where(F.col("fileName").isNotNull()).groupBy(base_name().alias("_file")).agg(
        F.count("*").alias("_n"), F.first("fileName").alias("fileName"), *[F.first(c).alias(n) for n, c in columns.items()])
    message = F.concat(F.lit("recording listed more than once: "), F.col("_file"))
    name = F.when(F.col("_n") == 1, F.col("fileName")).otherwise(F.raise_error(message).cast("string"))
    return named.select(name.alias("fileName"), *columns)
