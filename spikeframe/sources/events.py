"""The `events` table of the test data seen as spikes of electrode recordings.

Ten users make one recording, each user is one channel, and 30 days of events
are scaled to 300 seconds. Used by the registered queries and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layout import Layout

# Fixed values of the mapping.
USERS_PER_RECORDING = 10
START = "2024-01-01 00:00:00"
MICROS_PER_SECOND = 8.64e9  # micros of event time per second of recording
MICROS_PER_MILLI = 8.64e6
RECORDING_SECONDS = 300.0


# Given, so that reading needs no job of its own to look into the files.
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _recording(user: str) -> tuple:
    rec = F.expr(f"{user} div {USERS_PER_RECORDING}")
    c = F.expr(f"{user} % {USERS_PER_RECORDING}")
    return rec, c


def _file_name(rec: Column) -> Column:
    """rec_ and at least three digits; a row-wise format_string costs ten times as much."""
    digits = rec.cast("string")
    return F.concat(F.lit("rec_"), F.when(rec < 1000, F.lpad(digits, 3, "0")).otherwise(digits))


def spikes_from_events(events: DataFrame) -> tuple[DataFrame, Layout]:
    """Spike rows without channel totals, and their layout."""
    rec, c = _recording("user_id")
    start = F.lit(START).cast("timestamp_ntz").cast("timestamp")
    timed = events.select(
        _file_name(rec).alias("fileName"),
        F.when(rec % 2 == 0, "WT").otherwise("KO").alias("genotype"),
        (21 + 10 * (c % 6) + F.floor(c / 6)).cast("int").alias("channel_id"),
        F.lit(RECORDING_SECONDS).alias("maxRecording"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)).alias("us"),
    ).withColumn("s", F.col("us") / F.lit(MICROS_PER_SECOND))

    layout = Layout.measure(timed)
    channels = layout.channels
    timed = channels.previous(channels.split(timed, "s"), "us_before", "us", "s", "seq")
    isi = (F.col("us") - F.col("us_before")) / F.lit(MICROS_PER_MILLI)
    spikes = timed.withColumn("isi", isi).withColumn("frequency", F.try_divide(F.lit(1000.0), F.col("isi")))
    return spikes.drop("us", "us_before"), layout


def meta_from_events(events: DataFrame) -> DataFrame:
    """Metadata table with one row per recording."""
    rec = F.col("rec")
    return (
        events.select(_recording("user_id")[0].alias("rec")).distinct().select(
            F.concat(F.lit("a"), rec.cast("string")).alias("animalID"),
            _file_name(rec).alias("fileName"),
            F.when(rec % 2 == 0, "WT").otherwise("KO").alias("genotype"),
            F.lit(RECORDING_SECONDS).alias("maxRecording"),
            F.when(rec % 7 == 3, "YES").alias("exclude"),
            F.when(rec % 4 == 1, "21,52").alias("channels2exclude"),
            F.when(rec % 5 == 4, "NA").otherwise("SSC").alias("region"),
            F.when(rec % 6 != 5, "21,31,41").alias("upperLayerChannels"),
            F.when(rec % 8 == 2, "YES").alias("hasHP"),
        )
    )
