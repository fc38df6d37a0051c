"""Filters over spike tables. None of them changes the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import capped, channel_list, in_interval, ratio
from ..layout import Layout
from ..sources.metadata import listed_once, tidy_meta
from .channels import ACTIVE_RATE, stamp_channel_counts


def sample_filter(
    spikes: DataFrame, meta: DataFrame, layout: Layout,
    exclude: bool = True, marker: str | None = None, has_hp: bool = False,
) -> DataFrame:
    """Drop recordings that the metadata mark.

    Any entry in `exclude` marks a recording, or only the value `marker` if one
    is given. `has_hp` also drops recordings with "YES" in hasHP.
    """
    tidy = tidy_meta(meta)
    marked = F.lit(False)
    if exclude:
        listed = F.col("exclude").isNotNull() if marker is None else F.col("exclude").eqNullSafe(marker)
        marked = marked | listed
    if has_hp:
        marked = marked | F.col("hasHP").eqNullSafe("YES")
    return layout.recordings.lookup(spikes, tidy.where(marked).select("fileName"), "left_anti", bounded=False)


def region_filter(spikes: DataFrame) -> DataFrame:
    """Keep spikes whose region is known."""
    return spikes.where(F.col("region") != "NA")


def layer_filter(spikes: DataFrame, layer: str, layout: Layout, rate: float = ACTIVE_RATE) -> DataFrame:
    """Keep one layer and count the channels again on it.

    Recordings without a layer list have a NULL layer and drop out.
    """
    return stamp_channel_counts(spikes.where(F.col("layer") == layer), layout, rate).select(*spikes.columns)


def length_filter(spikes: DataFrame, max_duration: float | None = None) -> DataFrame:
    """Keep the first `max_duration` seconds; None keeps everything."""
    if max_duration is None:
        return spikes
    limit = float(max_duration)
    return spikes.where(F.col("s") <= limit).withColumn("maxRecording", capped("maxRecording", limit))


def interval_filter(spikes: DataFrame, low: float, high: float, column: str = "s") -> DataFrame:
    """Keep rows strictly between two values."""
    return spikes.where(in_interval(column, low, high))


def active_filter(spikes: DataFrame, layout: Layout, threshold: float = ACTIVE_RATE, inclusive: bool = True) -> DataFrame:
    """Keep channels that spike at the threshold rate (inclusive) or above it."""
    rates = spikes.groupBy("fileName", "channel_id", "maxRecording").agg(F.count("*").alias("n"))
    rate = ratio("n", "maxRecording")
    active = rates.where(rate >= threshold if inclusive else rate > threshold)
    return layout.channels.lookup(spikes, active.select("fileName", "channel_id"), "left_semi")


def channel_filter(spikes: DataFrame, meta: DataFrame, layout: Layout) -> DataFrame:
    """Drop the channels that the metadata exclude, and recordings they do not list."""
    listed = listed_once(meta, _excluded=channel_list("channels2exclude"))
    keep = F.col("_excluded").isNull() | ~F.array_contains("_excluded", F.col("channel_id"))
    return (
        layout.recordings.lookup(spikes, listed, bounded=False)
        .where(keep)
        .select(*spikes.columns)
    )
