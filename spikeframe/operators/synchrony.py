"""Activity that several channels show within the same time bin of a recording.

Bins count from the first burst, or spike, of the recording. That first time is
an aggregate joined back, so a recording never has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.channels import channels_n
from ..functions.missing import complete_zero
from ..layout import Layout


def bin_times(df: DataFrame, layout: Layout, time: str, width: float) -> DataFrame:
    """Add `window_bin`, the number of the time bin within the recording."""
    first = df.groupBy("fileName").agg(F.min(time).alias("_first"))
    binned = layout.recordings.lookup(df, first)
    number = F.floor((F.col(time) - F.col("_first")) / F.lit(float(width)))
    return binned.withColumn("window_bin", number.cast("long")).drop("_first")


def _numbered(events: DataFrame, layout: Layout, name: str, position: str) -> DataFrame:
    """Number the events of a recording by bin."""
    recordings = layout.recordings
    events = recordings.split(events, position)
    return recordings.running_sum(events, name, F.lit(1), "window_bin").withColumn(name, F.col(name).cast("int"))


def _join_numbers(binned: DataFrame, events: DataFrame, layout: Layout, name: str, time: str) -> DataFrame:
    """Give rows the number of the event in their bin; NULL in bins without one."""
    recordings = layout.recordings
    on = ["fileName", "window_bin"]
    labels = events.select(*on, name)
    if recordings.hot is not None:
        # A bin of a heavy recording may be wide: join it slice by slice.
        part = recordings.column
        ends = recordings.split(events.withColumnRenamed(part, "_from"), "last_s").withColumnRenamed(part, "_to")
        labels = ends.select(*on, name, F.explode(F.sequence("_from", "_to")).alias(part))
        binned = recordings.split(binned, time)
        on = [*on, part]
    return binned.join(labels, on, "left")


def _burst_events(bursts: DataFrame, layout: Layout, window: float) -> DataFrame:
    events = (
        layout.recordings.mark(bin_times(bursts, layout, "start_time_s", window))
        .groupBy("fileName", "genotype", *layout.recordings.marker, "window_bin")
        .agg(
            F.count("*").alias("bursts_n"),
            channels_n().alias("channels_n"),
            F.min("start_time_s").alias("start_s"),
            F.max("start_time_s").alias("last_s"),
            # End of the burst that starts last.
            F.max_by("end_time_s", F.struct("start_time_s", "channel_id")).alias("end_s"),
            F.sum("spike_count").alias("spikes_n"),
        )
        .where(F.col("bursts_n") > 1)
    )
    return _numbered(events, layout, "syncburst_id", "start_s")


def sync_burst_events(bursts: DataFrame, layout: Layout, window: float = 0.050) -> DataFrame:
    """Bins with more than one burst, also if all are on one channel."""
    return _burst_events(bursts, layout, window).select(
        "fileName", "genotype", "window_bin", "syncburst_id", "bursts_n", "channels_n",
        "start_s", "end_s", "spikes_n")


def label_sync_bursts(bursts: DataFrame, layout: Layout, window: float = 0.050) -> DataFrame:
    """Add `window_bin` and `syncburst_id` to every burst."""
    binned = bin_times(bursts, layout, "start_time_s", window)
    events = _burst_events(bursts, layout, window)
    return _join_numbers(binned, events, layout, "syncburst_id", "start_time_s").select(
        *bursts.columns, "window_bin", "syncburst_id")


def label_burst_spikes(labelled: DataFrame, bursts: DataFrame, layout: Layout, window: float = 0.050) -> DataFrame:
    """Add to every labelled spike the `syncburst_id` of its burst; NULL outside bursts and sync events.

    The table has one row per burst in an event. A burst of a heavy channel may have many
    spikes: it is joined slice by slice.
    """
    channels = layout.channels
    on = ["fileName", "channel_id", "burst_id"]
    events = label_sync_bursts(bursts, layout, window).where(F.col("syncburst_id").isNotNull())
    if channels.hot is None:
        return labelled.join(events.select(*on, "syncburst_id"), on, "left").select(*labelled.columns, "syncburst_id")
    part = channels.column
    starts = channels.split(events, "start_time_s").withColumnRenamed(part, "_from")
    ends = channels.split(starts, "end_time_s").withColumnRenamed(part, "_to")
    parts = ends.select(*on, "syncburst_id", F.explode(F.sequence("_from", "_to")).alias(part))
    return channels.split(labelled, "s").join(parts, [*on, part], "left").select(*labelled.columns, "syncburst_id")


def sync_burst_statistics(events: DataFrame) -> DataFrame:
    """Per recording with an event. Channel numbers only count events on several channels."""
    channels = F.when(F.col("channels_n") > 1, F.col("channels_n"))
    duration = F.col("end_s") - F.col("start_s")
    zero = F.lit(0)
    return events.groupBy("fileName").agg(
        F.count("*").alias("syncburst_countNEW"),
        F.sum("bursts_n").alias("syncburst_bursts_totalNEW"),
        F.avg("bursts_n").alias("syncburst_bursts_meanNEW"),
        F.coalesce(F.avg(channels), zero).alias("syncburst_channels_mean"),
        F.coalesce(F.min(channels), zero).alias("syncburst_channels_min"),
        F.coalesce(F.max(channels), zero).alias("syncburst_channels_max"),
        F.avg(duration).alias("syncburst_bursts_duration_mean"),
        F.stddev_samp(duration).alias("syncburst_bursts_duration_sd"),
        F.sum("spikes_n").alias("syncburst_spikes_total"),
        F.avg("spikes_n").alias("syncburst_spikes_mean"),
    )


def sync_burst_features(summary: DataFrame, bursts: DataFrame, layout: Layout, window: float = 0.050) -> DataFrame:
    """Add the burst synchrony features; 0 for recordings without an event."""
    events = sync_burst_events(bursts, layout, window)
    return complete_zero(summary, sync_burst_statistics(events), schemas.SYNCBURST_FEATURES)


def _spike_bins(spikes: DataFrame, layout: Layout, window: float, min_prop: float) -> DataFrame:
    return (
        layout.recordings.mark(bin_times(spikes, layout, "s", window))
        .groupBy("fileName", "activeChannels", *layout.recordings.marker, "window_bin")
        .agg(
            F.count("*").alias("spikes_n"),
            channels_n().alias("channels_n"),
            F.min("s").alias("start_s"),
            F.max("s").alias("last_s"),
        )
        .where((F.col("channels_n") > 1) & (F.col("channels_n") >= F.lit(float(min_prop)) * F.col("activeChannels")))
    )


def _spike_events(spikes: DataFrame, layout: Layout, window: float, min_prop: float) -> DataFrame:
    return _numbered(_spike_bins(spikes, layout, window, min_prop), layout, "syncspike_id", "start_s")


def sync_spike_events(
    spikes: DataFrame, layout: Layout, window: float = 0.010, min_prop_involved: float = 0.01,
) -> DataFrame:
    """Bins with spikes on several channels and on enough of the active ones."""
    return _spike_events(spikes, layout, window, min_prop_involved).select(
        "fileName", "window_bin", "syncspike_id", "spikes_n", "channels_n")


def label_sync_spikes(
    spikes: DataFrame, layout: Layout, window: float = 0.010, min_prop_involved: float = 0.01,
) -> DataFrame:
    """Add `window_bin` and `syncspike_id` to every spike."""
    binned = bin_times(spikes, layout, "s", window)
    events = _spike_events(spikes, layout, window, min_prop_involved)
    return _join_numbers(binned, events, layout, "syncspike_id", "s").select(
        *spikes.columns, "window_bin", "syncspike_id")


def sync_spike_features(
    summary: DataFrame, spikes: DataFrame, layout: Layout,
    window: float = 0.010, min_prop_involved: float = 0.01,
) -> DataFrame:
    """Add the spike synchrony features; 0 for recordings without an event."""
    statistics = _spike_bins(spikes, layout, window, min_prop_involved).groupBy("fileName").agg(
        F.count("*").alias("syncspike_count"),
        F.sum("spikes_n").alias("syncspike_spikes_total"),
        F.avg("spikes_n").alias("syncspike_spikes_mean"),
        F.avg("channels_n").alias("syncspike_channels_mean"),
        F.min("channels_n").alias("syncspike_channels_min"),
        F.max("channels_n").alias("syncspike_channels_max"),
    )
    return complete_zero(summary, statistics, schemas.SYNCSPIKE_FEATURES)
