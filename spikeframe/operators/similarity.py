"""How closely the events of one channel are matched on another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..layout import Layout, kept

_FIRST = float("-inf")


def channel_similarity(events: DataFrame, layout: Layout, time: str = "s") -> DataFrame:
    """Sum over the events of `ref_channel` of the squared distance to the nearest on `comp_channel`.

    Works for spikes and, with time="start_time_s", for bursts. One row per
    ordered pair of channels, 0 on the diagonal.

    An event of a channel is its nearest one from half way after the event before
    it. So each event also gives a row at that moment, and one pass in time order
    over a recording holds the nearest event of every channel: a running maximum
    for each channel id of the layout, of which there are at most 128. A recording
    too large for one task goes by time slice, and each slice starts with the
    nearest events that hold at its start. Events without a time or channel are left out.
    """
    recordings, group = layout.recordings, layout.recordings.group
    known = F.col(time).isNotNull() & F.col("channel_id").isNotNull()
    points = events.where(known).select("fileName", "channel_id", F.col(time).alias("t"))
    # One exchange by recording serves the windows by channel and by time, and the sums.
    points = recordings.split(points, "t").repartition(*group)
    before = F.lag("t").over(Window.partitionBy(*group, "channel_id").orderBy("t"))
    if recordings.hot is None:
        points = points.withColumn("before", before)
    else:
        points = points.withColumn("_before", before)
        earlier = recordings.hinted(_carried(points, "t", layout), len(layout.channel_ids))
        points = points.join(earlier, [*group, "channel_id"], "left").withColumn("before", F.coalesce("_before", "_carry"))
    rows = _with_turns(points)
    if recordings.hot is not None:
        # A turn may lie in an earlier slice than its event.
        rows = recordings.split(rows, "at")
        start = _carried(rows, "nearest", layout).select(
            *group, "channel_id", F.lit(_FIRST).alias("at"), F.lit(False).alias("own"), F.col("_carry").alias("nearest"))
        rows = rows.unionByName(start)
    # Sorted while narrow; the window takes this order. Its frame ends with the rows of the same
    # time, so a turn holds for events at its very moment. Text, since there are columns for each channel.
    rows = rows.sortWithinPartitions(*group, "at")
    upto = f"OVER (PARTITION BY {', '.join(group)} ORDER BY at)"
    ids = layout.channel_ids
    gaps = rows.selectExpr("*", *[f"max(IF(channel_id = {c}, nearest, NULL)) {upto} AS _{c}" for c in ids]).where("own")
    sums = gaps.groupBy("fileName", F.col("channel_id").alias("ref_channel")).agg(
        F.expr(f"array({', '.join(f'sum((at - _{c}) * (at - _{c}))' for c in ids)})").cast("array<double>").alias("sums"))
    pairs = sums.select("fileName", "ref_channel", F.posexplode("sums").alias("at", "value")).where(F.col("value").isNotNull())
    comp = F.get(F.lit(list(ids)).cast("array<int>"), F.col("at"))
    value = F.when(F.col("ref_channel") == F.col("comp_channel"), 0.0).otherwise(F.col("value"))
    return pairs.select("fileName", "ref_channel", comp.alias("comp_channel"), "value").withColumn("value", value)


def _with_turns(points: DataFrame) -> DataFrame:
    """Every event, and the moment from which it is the nearest one of its channel."""
    half = F.col("before") + (F.col("t") - F.col("before")) / 2
    # Between neighbouring numbers half way is rounded to one of them; only the event itself will do then.
    turn = F.when(F.col("before").isNull(), _FIRST).when(half > F.col("before"), half).otherwise(F.col("t"))
    event = F.struct(F.col("t").alias("at"), F.lit(True).alias("own"), F.lit(None).cast("double").alias("nearest"))
    turned = F.struct(turn.alias("at"), F.lit(False).alias("own"), F.col("t").alias("nearest"))
    return points.select("fileName", "channel_id", F.inline(F.array(event, turned)))


def _carried(rows: DataFrame, value: str, layout: Layout) -> DataFrame:
    """The latest `value` of a channel before a slice of a cut recording; it never decreases with time.

    At most one row per slice and channel, kept, since two steps read it.
    """
    recordings = layout.recordings
    part = recordings.column
    last = recordings.only_hot(rows).groupBy("fileName", part, "channel_id").agg(F.max(value).alias("_carry"))
    later = F.lead(part).over(Window.partitionBy("fileName", "channel_id").orderBy(part))
    last = last.where(F.col("_carry").isNotNull()).withColumn("_next", later)
    last = last.join(recordings.hinted(recordings.hot.select("fileName", "_cuts")), "fileName")
    upto = F.coalesce(F.col("_next"), F.col("_cuts") - 1)
    # Each stands up to the next slice that has a value.
    carried = last.where(upto > F.col(part)).select(
        "fileName", "channel_id", "_carry", F.explode(F.sequence(F.col(part) + 1, upto)).alias(part))
    return kept(carried).withColumn(recordings.marker[0], F.lit(True))


def similarity_log(similarity: DataFrame) -> DataFrame:
    """Pairs with a distance, and its binary logarithm."""
    return similarity.where(F.col("value") != 0).withColumn("value_log", F.log2("value"))


def similarity_symmetric(similarity: DataFrame) -> DataFrame:
    """Mean of both directions of a pair, once per pair."""
    pairs = similarity_log(similarity)
    low = F.least("ref_channel", "comp_channel")
    high = F.greatest("ref_channel", "comp_channel")
    # Both directions fall into one group, which needs no self-join.
    return (
        pairs.groupBy("fileName", low.alias("ref_channel"), high.alias("comp_channel"))
        .agg(F.count("*").alias("_n"), F.avg("value").alias("mean_value"), F.avg("value_log").alias("mean_value_log"))
        .where((F.col("_n") == 2) & (F.col("comp_channel") > F.col("ref_channel")))
        .drop("_n")
    )


def similarity_midpoint(similarity: DataFrame) -> DataFrame:
    """Median logarithm per recording, over all pairs and over the symmetric ones.

    The exact median holds one value per pair of electrodes of a recording.
    """
    full = similarity_log(similarity).groupBy("fileName").agg(F.median("value_log").alias("midpoint"))
    pairs = similarity_symmetric(similarity).groupBy("fileName").agg(F.median("mean_value_log").alias("midpoint_sym"))
    return full.join(pairs, "fileName", "left")
