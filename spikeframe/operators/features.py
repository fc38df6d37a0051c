"""Features with one row per recording, and their normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.missing import complete_zero, r_mean, r_sd, ratio
from ..layout import Layout, global_rank
from .bursts import ORDER


def spike_features(spikes: DataFrame, layout: Layout, isi_mode: str = "pooled") -> DataFrame:
    """Recording columns and spike features.

    The pooled interval statistics come from per-channel counts, means and
    variances, so the spikes are shuffled once, and only as partial aggregates.
    Channel means are centred on the recording's, so near-constant intervals keep
    their digits.
    `isi_mode="positional"` takes them from `positional_isi` instead.
    """
    isi = F.when(F.col("isi") > 0, F.col("isi"))
    channels = spikes.groupBy(*schemas.RECORDING, "channel_id").agg(
        F.count("*").alias("n"),
        F.count(isi).alias("isi_n"),
        F.avg(isi).alias("isi_avg"),
        F.var_samp(isi).alias("isi_var"),
    )
    # One row per electrode of a recording in this window.
    whole = Window.partitionBy(*schemas.RECORDING)
    centre = F.try_divide(F.sum(F.col("isi_n") * F.col("isi_avg")).over(whole), F.sum("isi_n").over(whole))
    channels = channels.withColumn("_centre", centre)
    rate = ratio("n", "maxRecording")
    n = F.sum("isi_n")
    shift = F.col("isi_avg") - F.col("_centre")
    # A channel without a positive interval has no mean and adds nothing.
    squares = F.sum((F.col("isi_n") - 1) * F.coalesce(F.col("isi_var"), F.lit(0.0)) + F.col("isi_n") * shift * shift)
    variance = F.try_divide(squares, n - 1)
    summary = channels.groupBy(*schemas.RECORDING).agg(
        F.sum("n").alias("spike_n"),
        ratio(F.sum("n"), F.first("maxRecording")).alias("sliceSpikeRate"),
        r_mean(rate).alias("spikeRate_mean"),
        r_sd(rate).alias("spikeRate_sd"),
        F.first("_centre").alias("isi_mean"),
        F.when(n > 1, F.sqrt(variance)).alias("isi_sd"),
    )
    if isi_mode == "positional":
        summary = summary.drop("isi_mean", "isi_sd").join(positional_isi(spikes, layout), "fileName", "left")
    elif isi_mode != "pooled":
        raise ValueError(f"unknown isi_mode: {isi_mode}")
    return summary.select(*schemas.RECORDING, *schemas.SPIKE_FEATURES)


def positional_isi(spikes: DataFrame, layout: Layout) -> DataFrame:
    """Interval mean and sd per recording with channel means put in by position.

    Channels are numbered over the whole table in order of first appearance. The
    positive intervals of a recording are concatenated channel by channel, and
    after channel number j has been appended, element j becomes the mean of that
    channel; a vector that is still shorter is padded with missing values up to j.

    So channel j ends at L_j = max(L_before + n_j, j), which is a running maximum
    over the channels of a recording, and the statistics are those of all
    intervals, less the elements at positions j, plus the channel means.
    """
    positive = layout.channels.split(spikes, "s").where(F.col("isi") > 0)
    first = spikes.groupBy("channel_id").agg(F.min(F.struct("fileName", "seq")).alias("_first"))
    ordinals, last = global_rank(first, "j", "_first", "channel_id")
    ordinals = ordinals.select("channel_id", "j")
    channels = (
        positive.groupBy("fileName", "channel_id")
        .agg(F.count("*").alias("n"), F.avg("isi").alias("m"), F.var_samp("isi").alias("v"))
        .join(ordinals, "channel_id")
    )
    # At most one row per electrode in each of these windows.
    upto = Window.partitionBy("fileName").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("fileName").orderBy("j")
    channels = channels.withColumn("_sum", F.sum("n").over(upto))
    padding = F.max(F.greatest(F.col("j") - F.col("_sum"), F.lit(0))).over(upto)
    channels = channels.withColumn("_end", F.col("_sum") + padding)
    channels = channels.withColumn("_start", F.coalesce(F.lag("_end").over(before), F.lit(0)))
    centre = Window.partitionBy("fileName")
    channels = channels.withColumn(
        "c", F.sum(F.col("n") * F.col("m")).over(centre) / F.sum("n").over(centre))

    # Elements that a channel mean replaces: only the first j_max of a channel can be.
    ranked = layout.channels.running_sum(positive, "_rank", F.lit(1), *ORDER)
    early = ranked.where(F.col("_rank") <= last).select("fileName", "channel_id", "isi", "_rank")
    replaced = (
        early.join(channels.select("fileName", "channel_id", "_start"), ["fileName", "channel_id"])
        .select("fileName", (F.col("_start") + F.col("_rank")).alias("j"), "isi")
        .join(channels.select("fileName", "j", "c"), ["fileName", "j"])
        .groupBy("fileName")
        .agg(
            F.count("*").alias("r_n"),
            F.sum(F.col("isi") - F.col("c")).alias("r_1"),
            F.sum((F.col("isi") - F.col("c")) * (F.col("isi") - F.col("c"))).alias("r_2"),
        )
    )
    shift = F.col("m") - F.col("c")
    whole = channels.groupBy("fileName").agg(
        F.first("c").alias("c"),
        F.sum("n").alias("n"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0)) + F.col("n") * shift * shift).alias("s_2"),
        F.count("*").alias("m_n"),
        F.sum(shift).alias("m_1"),
        F.sum(shift * shift).alias("m_2"),
    )
    zero = F.lit(0)
    n = F.col("n") + F.col("m_n") - F.coalesce("r_n", zero)
    s1 = F.col("m_1") - F.coalesce("r_1", zero)
    s2 = F.col("s_2") + F.col("m_2") - F.coalesce("r_2", zero)
    return whole.join(replaced, "fileName", "left").select(
        "fileName",
        (F.col("c") + s1 / n).alias("isi_mean"),
        F.when(n > 1, F.sqrt(F.greatest(F.try_divide(s2 - s1 * s1 / n, n - 1), F.lit(0.0)))).alias("isi_sd"),
    )


def burst_statistics(bursts: DataFrame, layout: Layout, per_minute: bool = False) -> DataFrame:
    """Burst features of the recordings that have bursts: one pass over the bursts."""
    channels = layout.channels
    bursts = channels.split(bursts, "start_time_s")
    order = ("start_time_s", "burst_id")
    bursts = channels.following(bursts, "_next", "start_time_s", *order)
    bursts = channels.running_sum(bursts, "_upto", F.lit(1), *order)
    in_burst = ratio("spike_count", "duration_s")
    # The last burst of a channel carries the number of its bursts. They are counted:
    # after a filter the numbers of the bursts have gaps.
    per_channel = F.when(F.col("_next").isNull(), F.try_divide(F.col("_upto"), F.col("maxRecording")) / 60)
    scale = F.lit(3600.0 if per_minute else 1.0)
    ibi = F.col("_next") - F.col("end_time_s")
    return bursts.groupBy("fileName").agg(
        F.count("*").alias("burst_n"),
        r_mean("isi_mean").alias("isi_inBurst_mean"),
        r_mean("isi_sd").alias("isi_inBurst_sd"),
        F.sum("spike_count").alias("burst_spikes_total"),
        F.avg("spike_count").alias("burst_spikes_mean"),
        F.stddev_samp("spike_count").alias("burst_spikes_sd"),
        r_mean(in_burst).alias("spikeRate_inBurst_mean"),
        r_sd(in_burst).alias("spikeRate_inBurst_sd"),
        (F.avg(per_channel) * scale).alias("burstRate_mean"),
        (F.stddev_samp(per_channel) * scale).alias("burstRate_sd"),
        r_mean("duration_s").alias("burst_dur_mean"),
        r_sd("duration_s").alias("burst_dur_sd"),
        F.avg(ibi).alias("ibi_mean"),
        F.stddev_samp(ibi).alias("ibi_sd"),
    )


def burst_features(
    summary: DataFrame, bursts: DataFrame, layout: Layout,
    per_minute: bool = False, strict: bool = False,
) -> DataFrame:
    """Add the burst features; recordings without bursts get 0 in each.

    The burst rate is n / maxRecording / 60 unless `per_minute` asks for bursts
    per minute. `strict` raises if there is no burst at all (runs a query).
    """
    if strict and bursts.isEmpty():
        raise ValueError("no bursts in the data: burst features cannot be extracted")
    return complete_zero(summary, burst_statistics(bursts, layout, per_minute), schemas.BURST_FEATURES)


def norm_prop(summary: DataFrame, param_sync: bool = False) -> DataFrame:
    """Add counts per active channel and proportions.

    Burst ratios need the burst features; without them only the spike and
    channel ratios are added.
    """
    ratios = {
        "spike_n_NORM": ("spike_n", "activeChannels"),
        "burst_n_NORM": ("burst_n", "activeChannels"),
        "activeChannels_PROP2totalChannels": ("activeChannels", "totalChannels"),
        "burst_spikes_PROP2totalSpikes": ("burst_spikes_total", "spike_n"),
    }
    if param_sync:
        ratios |= {
            "syncburst_spikes_total_PROP2totalSpikes": ("syncburst_spikes_total", "spike_n"),
            "syncburst_bursts_total_PROP2totalBursts": ("syncburst_bursts_totalNEW", "burst_n"),
            "syncburst_channels_min_PROP2activeChannels": ("syncburst_channels_min", "activeChannels"),
            "syncburst_channels_mean_PROP2activeChannels": ("syncburst_channels_mean", "activeChannels"),
            "syncburst_channels_max_PROP2activeChannels": ("syncburst_channels_max", "activeChannels"),
            "syncspike_spikes_total_PROP2totalSpikes": ("syncspike_spikes_total", "spike_n"),
            "syncspike_channels_min_PROP2activeChannels": ("syncspike_channels_min", "activeChannels"),
            "syncspike_channels_mean_PROP2activeChannels": ("syncspike_channels_mean", "activeChannels"),
            "syncspike_channels_max_PROP2activeChannels": ("syncspike_channels_max", "activeChannels"),
        }
    known = set(summary.columns)
    return summary.withColumns({
        name: ratio(a, b) for name, (a, b) in ratios.items()
        if a in known and b in known
    })
