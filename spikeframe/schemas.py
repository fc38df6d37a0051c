"""Column layouts of the tables that pass between the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per recording, filled in by the experimenter.
META = T.StructType([
    T.StructField("animalID", T.StringType()),
    T.StructField("fileName", T.StringType()),
    T.StructField("genotype", T.StringType()),
    T.StructField("maxRecording", T.DoubleType()),
    T.StructField("exclude", T.StringType()),
    T.StructField("channels2exclude", T.StringType()),
])

# Columns that some metadata tables carry on top of META.
META_OPTIONAL = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("upperLayerChannels", T.StringType()),
    T.StructField("hasHP", T.StringType()),
])

# One row per spike. `s` is in seconds from the start of the recording, `isi`
# in milliseconds, and `seq` keeps the stored order of spikes with equal `s`.
SPIKES = T.StructType([
    T.StructField("fileName", T.StringType()),
    T.StructField("genotype", T.StringType()),
    T.StructField("totalChannels", T.IntegerType()),
    T.StructField("activeChannels", T.IntegerType()),
    T.StructField("channel_id", T.IntegerType()),
    T.StructField("maxRecording", T.DoubleType()),
    T.StructField("seq", T.LongType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("isi", T.DoubleType()),
    T.StructField("frequency", T.DoubleType()),
])

# One row per burst. `isi_sd` is kept next to `isi_mean` so that the burst
# features need no second pass over the spikes.
BURSTS = T.StructType([
    T.StructField("fileName", T.StringType()),
    T.StructField("genotype", T.StringType()),
    T.StructField("totalChannels", T.IntegerType()),
    T.StructField("activeChannels", T.IntegerType()),
    T.StructField("channel_id", T.IntegerType()),
    T.StructField("burst_id", T.IntegerType()),
    T.StructField("maxRecording", T.DoubleType()),
    T.StructField("spike_count", T.LongType()),
    T.StructField("isi_mean", T.DoubleType()),
    T.StructField("isi_sd", T.DoubleType()),
    T.StructField("start_time_s", T.DoubleType()),
    T.StructField("end_time_s", T.DoubleType()),
    T.StructField("duration_s", T.DoubleType()),
])

# Constant within a recording, so they ride along as grouping keys.
RECORDING = ["fileName", "genotype", "maxRecording", "totalChannels", "activeChannels"]

SPIKE_FEATURES = [
    "spike_n", "sliceSpikeRate", "spikeRate_mean", "spikeRate_sd", "isi_mean", "isi_sd",
]
BURST_FEATURES = [
    "burst_n", "isi_inBurst_mean", "isi_inBurst_sd",
    "burst_spikes_total", "burst_spikes_mean", "burst_spikes_sd",
    "spikeRate_inBurst_mean", "spikeRate_inBurst_sd",
    "burstRate_mean", "burstRate_sd", "burst_dur_mean", "burst_dur_sd",
    "ibi_mean", "ibi_sd",
]
SYNCBURST_FEATURES = [
    "syncburst_countNEW", "syncburst_bursts_totalNEW", "syncburst_bursts_meanNEW",
    "syncburst_channels_mean", "syncburst_channels_min", "syncburst_channels_max",
    "syncburst_bursts_duration_mean", "syncburst_bursts_duration_sd",
    "syncburst_spikes_total", "syncburst_spikes_mean",
]
SYNCSPIKE_FEATURES = [
    "syncspike_count", "syncspike_spikes_total", "syncspike_spikes_mean",
    "syncspike_channels_mean", "syncspike_channels_min", "syncspike_channels_max",
]

# An 8 x 8 electrode grid, named 10 * column + row, whose four
# corners carry no electrode.
GRID_SIDE = 8
GRID_CORNERS = (11, 18, 81, 88)
