"""What a recording's metadata and channel counts add to its spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import channel_list, ratio
from ..layout import Layout
from ..sources.metadata import listed_once

ACTIVE_RATE = 0.01  # fixed value: Hz from which a channel counts as active


def stamp_metadata(spikes: DataFrame, meta: DataFrame, layout: Layout, columns=("genotype", "maxRecording")) -> DataFrame:
    """Take the given columns from the metadata; spikes of unlisted recordings drop out."""
    kept = spikes.drop(*columns)
    listed = listed_once(meta, **{c: F.col(c) for c in columns})
    return layout.recordings.lookup(kept, listed, bounded=False)


def channel_counts(spikes: DataFrame, rate: float = ACTIVE_RATE) -> DataFrame:
    """Per recording: channels with a spike, and channels with at least `rate` Hz."""
    return (
        spikes.groupBy("fileName", "channel_id", "maxRecording")
        .agg(F.count("*").alias("n"))
        .groupBy("fileName")
        .agg(
            F.count("*").cast("int").alias("totalChannels"),
            F.count(F.when(ratio("n", "maxRecording") >= rate, True)).cast("int").alias("activeChannels"),
        )
    )


def stamp_channel_counts(spikes: DataFrame, layout: Layout, rate: float = ACTIVE_RATE) -> DataFrame:
    """(Re)compute totalChannels and activeChannels from these spikes."""
    kept = spikes.drop("totalChannels", "activeChannels")
    return layout.recordings.lookup(kept, channel_counts(kept, rate))


def tag_layers(spikes: DataFrame, meta: DataFrame, layout: Layout) -> DataFrame:
    """Add `layer`: "upper" for the listed channels, else "lower"; NULL without a list."""
    upper = listed_once(meta, _upper=channel_list("upperLayerChannels"))
    layer = (
        F.when(F.col("_upper").isNull(), None)
        .when(F.array_contains("_upper", F.col("channel_id")), "upper")
        .otherwise("lower")
    )
    return layout.recordings.lookup(spikes, upper, "left", bounded=False).withColumn("layer", layer).drop("_upper")
