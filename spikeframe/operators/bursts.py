"""Bursts: runs of spikes that follow each other closely on one channel.

A spike is flagged if its interval to the spike before is above 0 and below the
threshold. Every spike without the flag opens a run, which is that spike and
the flagged ones after it, so a run holds the spike before its first short
interval. Flagged spikes at the very start of a channel are a run of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..layout import Layout, kept

ORDER = ("s", "seq")
BURST_COLUMNS = [f.name for f in schemas.BURSTS.fields]


def flag_isi(spikes: DataFrame, isi_threshold: float = 50) -> DataFrame:
    """Add `isiThreshold`; false where the interval is missing."""
    isi = F.col("isi")
    return spikes.withColumn("isiThreshold", F.coalesce((isi < isi_threshold) & (isi > 0), F.lit(False)))


def spike_runs(spikes: DataFrame, layout: Layout, isi_threshold: float = 50) -> DataFrame:
    """Add `isiThreshold` and `run`, the running number of the run in its channel."""
    channels = layout.channels
    flagged = flag_isi(channels.split(spikes, "s"), isi_threshold)
    return channels.running_sum(flagged, "run", (~F.col("isiThreshold")).cast("long"), *ORDER)


def find_bursts(
    spikes: DataFrame, layout: Layout,
    isi_threshold: float = 50, spikes_per_burst: int = 5, burst_duration_max: float | None = None,
) -> DataFrame:
    """One row per burst, numbered in time order within its channel."""
    channels = layout.channels
    runs = spike_runs(spikes, layout, isi_threshold)
    # Spikes that stay alone in their run cannot be part of a burst: drop them
    # before the aggregation. The last row of a slice may go on in the next one.
    goes_on = F.coalesce(F.lead("isiThreshold").over(channels.window(*ORDER)), F.lit(True))
    members = runs.withColumn("_goes_on", goes_on).where(F.col("isiThreshold") | F.col("_goes_on"))
    short = F.when(F.col("isiThreshold"), F.col("isi"))
    bursts = (
        members.groupBy(*schemas.RECORDING, "channel_id", *channels.marker, "run")
        .agg(
            F.count("*").alias("spike_count"),
            F.count(short).alias("_short"),
            F.avg(short).alias("isi_mean"),
            F.stddev_samp(short).alias("isi_sd"),
            F.min("s").alias("start_time_s"),
            F.max("s").alias("end_time_s"),
        )
        .where((F.col("spike_count") >= spikes_per_burst) & (F.col("_short") > 0))
        .withColumn("duration_s", F.col("end_time_s") - F.col("start_time_s"))
    )
    if burst_duration_max is not None:
        bursts = bursts.where(F.col("duration_s") < burst_duration_max)
    bursts = channels.split(bursts, "start_time_s")
    numbered = channels.running_sum(bursts, "burst_id", F.lit(1), "start_time_s", "run")
    return numbered.withColumn("burst_id", F.col("burst_id").cast("int")).select(*BURST_COLUMNS)


def bursts_of(labelled: DataFrame) -> DataFrame:
    """The burst table out of labelled spikes, which then are sorted only once: a plain aggregation."""
    short = F.when(F.col("isiThreshold"), F.col("isi"))
    return (
        labelled.where(F.col("burst_id").isNotNull())
        .groupBy(*schemas.RECORDING, "channel_id", "burst_id")
        .agg(
            F.count("*").alias("spike_count"),
            F.avg(short).alias("isi_mean"),
            F.stddev_samp(short).alias("isi_sd"),
            F.min("s").alias("start_time_s"),
            F.max("s").alias("end_time_s"),
        )
        .withColumn("duration_s", F.col("end_time_s") - F.col("start_time_s"))
        .select(*BURST_COLUMNS)
    )


def label_spikes(
    spikes: DataFrame, layout: Layout,
    isi_threshold: float = 50, spikes_per_burst: int = 5, burst_duration_max: float | None = None,
) -> DataFrame:
    """Add `isiThreshold` and `burst_id` (NULL outside bursts) to every spike.

    Works on windows only: joining the bursts back would shuffle the spikes again.
    """
    channels = layout.channels
    runs = spike_runs(spikes, layout, isi_threshold)
    # These windows share one sort with the numbering, which is ordered by run first.
    run = Window.partitionBy(*channels.group, "run").orderBy(*ORDER)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = {
        "_n": F.count("*"),
        "_short": F.count(F.when(F.col("isiThreshold"), True)),
        "_first": F.min("s"),
        "_last": F.max("s"),
    }
    sized = runs.withColumns({
        "_starts": F.row_number().over(run) == 1,
        **{name: value.over(whole) for name, value in size.items()},
    })
    if channels.hot is not None:
        # Runs that cross a cut: at most one per slice, so the table stays small.
        crossing = (
            channels.only_hot(runs)
            .groupBy(*channels.keys, "run")
            .agg(
                *[value.alias(f"{name}_all") for name, value in size.items()],
                F.min(channels.column).alias("_from"), F.max(channels.column).alias("_to"),
            )
            .where(F.col("_from") < F.col("_to"))
        )
        sized = sized.join(channels.hinted(kept(crossing)), [*channels.keys, "run"], "left")
        sized = sized.withColumns({
            "_starts": F.col("_starts") & F.coalesce(F.col(channels.column) == F.col("_from"), F.lit(True)),
            **{name: F.coalesce(F.col(f"{name}_all"), F.col(name)) for name in size},
        })

    burst = (F.col("_n") >= spikes_per_burst) & (F.col("_short") > 0)
    if burst_duration_max is not None:
        burst = burst & (F.col("_last") - F.col("_first") < burst_duration_max)
    sized = sized.withColumn("_burst", burst)
    starts = (F.col("_burst") & F.col("_starts")).cast("int")
    numbered = channels.running_sum(sized, "_number", starts, "run", *ORDER)
    return numbered.withColumn("burst_id", F.when(F.col("_burst"), F.col("_number").cast("int"))).select(
        *spikes.columns, "isiThreshold", "burst_id")
