"""Hand-worked cases with their expected numbers."""

import pytest
from helpers import close, spike_table

from spikeframe import schemas
from spikeframe.layout import Layout
from spikeframe.operators import bursts, channels, electrodes, features, filters, groups, similarity, synchrony

TIMES = [1.000, 1.010, 1.030, 1.060, 1.100, 1.600, 1.660, 1.660, 1.670, 1.680, 1.690, 1.700]
ISI = [None, 10.0, 20.0, 30.0, 40.0, 500.0, 60.0, 0.0, 10.0, 10.0, 10.0, 10.0]


@pytest.fixture(scope="module")
def train(spark):
    return spike_table(spark, [("a", 12, s, i) for s, i in zip(TIMES, ISI)])


def test_bursts(train):
    spikes, layout = train
    got = bursts.find_bursts(spikes, layout).orderBy("burst_id").collect()
    assert [(b.burst_id, b.spike_count, b.start_time_s, b.end_time_s) for b in got] == [
        (1, 5, 1.0, 1.1), (2, 5, 1.66, 1.7)]
    assert close(got[0].isi_mean, 25) and close(got[1].isi_mean, 10)
    assert close(got[0].isi_sd, 12.909944487) and got[1].isi_sd == 0


def test_labels(train):
    spikes, layout = train
    got = bursts.label_spikes(spikes, layout).orderBy("seq").collect()
    assert [r.isiThreshold for r in got] == [False] + [True] * 4 + [False] * 3 + [True] * 4
    assert [r.burst_id for r in got] == [1] * 5 + [None] * 2 + [2] * 5


def test_parameters(train):
    spikes, layout = train
    assert bursts.find_bursts(spikes, layout, spikes_per_burst=6).count() == 0
    one = bursts.find_bursts(spikes, layout, burst_duration_max=0.05).collect()
    assert [(b.burst_id, b.start_time_s) for b in one] == [(1, 1.66)]
    labels = bursts.label_spikes(spikes, layout, burst_duration_max=0.05).orderBy("seq").collect()
    assert [r.burst_id for r in labels] == [None] * 7 + [1] * 5


def test_features(train):
    spikes, layout = train
    summary = features.spike_features(spikes, layout)
    row = features.burst_features(summary, bursts.find_bursts(spikes, layout), layout).first().asDict()
    expected = {
        "spike_n": 12, "sliceSpikeRate": 0.04, "isi_mean": 70, "isi_sd": 152.0233900,
        "isi_inBurst_mean": 17.5, "isi_inBurst_sd": 6.4549722, "burst_n": 2,
        "burst_spikes_total": 10, "burst_spikes_mean": 5, "burst_spikes_sd": 0,
        "spikeRate_inBurst_mean": 87.5, "spikeRate_inBurst_sd": 53.0330086,
        "burstRate_mean": 0.000111111, "burstRate_sd": None,
        "burst_dur_mean": 0.07, "burst_dur_sd": 0.0424264, "ibi_mean": 0.56, "ibi_sd": None,
    }
    for name, value in expected.items():
        assert close(row[name], value, 1e-5), (name, row[name])
    assert row["spikeRate_mean"] == 0.04 and row["spikeRate_sd"] is None


def test_positional_mode(train):
    spikes, layout = train
    row = features.spike_features(spikes, layout, "positional").first()
    assert close(row.isi_mean, 76, 1e-8) and close(row.isi_sd, 150.5692901, 1e-8)
    with pytest.raises(ValueError):
        features.spike_features(spikes, layout, "other")


def test_no_burst_gives_zero(train):
    spikes, layout = train
    none = bursts.find_bursts(spikes, layout, spikes_per_burst=6)
    summary = features.spike_features(spikes, layout)
    row = features.burst_features(summary, none, layout).first().asDict()
    assert all(row[name] == 0 for name in schemas.BURST_FEATURES)
    with pytest.raises(ValueError, match="no bursts"):
        features.burst_features(summary, none, layout, strict=True)


def test_per_minute(train):
    spikes, layout = train
    row = features.burst_statistics(bursts.find_bursts(spikes, layout), layout, per_minute=True).first()
    assert close(row.burstRate_mean, 2 / 300 * 60)


def test_absent_and_present(spark):
    """One burst: its spread is unknown. None: its spread is 0."""
    rows = [("a", 12, s, i) for s, i in zip(TIMES[:5], ISI[:5])] + [("b", 12, 1.0, None), ("b", 12, 2.0, 1000.0)]
    spikes, layout = spike_table(spark, rows)
    summary = features.spike_features(spikes, layout)
    got = {r.fileName: r for r in features.burst_features(summary, bursts.find_bursts(spikes, layout), layout).collect()}
    assert got["a"].burst_n == 1 and got["a"].burst_spikes_sd is None and got["a"].ibi_mean is None
    assert got["b"].burst_n == 0 and got["b"].burst_spikes_sd == 0 and got["b"].ibi_mean == 0


def test_length_filter_bounds(spark):
    spikes = spike_table(spark, [("a", 12, 200.0, None), ("a", 12, 200.1, 100.0), ("b", 12, 1.0, None, "WT", None),
                                 ("c", 12, 1.0, None, "WT", 100.0)], layout=False)
    got = {r.fileName: r for r in filters.length_filter(spikes, 200).collect()}
    assert got["a"].s == 200.0 and got["a"].maxRecording == 200.0
    assert got["b"].maxRecording is None and got["c"].maxRecording == 100.0
    assert filters.length_filter(spikes).count() == 4


def test_active_filter_bounds(spark):
    spikes, layout = spike_table(spark, [("a", 12, float(i), None) for i in range(3)])
    assert filters.active_filter(spikes, layout, 0.01, inclusive=True).count() == 3
    assert filters.active_filter(spikes, layout, 0.01, inclusive=False).count() == 0


def test_isi_at_threshold_is_not_short(spark):
    spikes = spike_table(spark, [("a", 12, 1.0, 50.0), ("a", 12, 2.0, 49.9), ("a", 12, 3.0, 0.0), ("a", 12, 4.0, None)], layout=False)
    assert [r.isiThreshold for r in bursts.flag_isi(spikes).orderBy("s").collect()] == [False, True, False, False]


def test_interval_is_open(spark):
    spikes = spike_table(spark, [("a", 12, float(i), None) for i in range(5)], layout=False)
    assert [r.s for r in filters.interval_filter(spikes, 1, 3).collect()] == [2.0]


def test_run_from_the_first_row(spark):
    """A channel whose first interval is short: the burst starts at the first row."""
    rows = [("a", 12, 1 + i / 100, 10.0) for i in range(5)] + [("a", 12, 9.0, 7000.0)]
    spikes, layout = spike_table(spark, rows)
    burst = bursts.find_bursts(spikes, layout).collect()
    assert [(b.spike_count, b.start_time_s, b.burst_id) for b in burst] == [(5, 1.0, 1)]
    assert [r.burst_id for r in bursts.label_spikes(spikes, layout).orderBy("seq").collect()] == [1] * 5 + [None]
    assert bursts.find_bursts(spikes, layout, spikes_per_burst=6).count() == 0


def _burst_rows(spark, rows):
    data = [("a", "WT", 3, 3, c, 1, 300.0, n, 10.0, 1.0, start, end, end - start) for c, start, end, n in rows]
    df = spark.createDataFrame(data, schemas.BURSTS)
    return df, Layout.measure(df, "start_time_s")


def test_sync_bursts(spark):
    table, layout = _burst_rows(spark, [
        (12, 1.00, 1.10, 5), (13, 1.02, 1.05, 6), (12, 1.06, 1.2, 5), (13, 1.20, 1.3, 5), (14, 1.21, 1.3, 5)])
    got = synchrony.label_sync_bursts(table, layout).orderBy("start_time_s").collect()
    assert [r.window_bin for r in got] == [0, 0, 1, 3, 4]
    assert [r.syncburst_id for r in got] == [1, 1, None, None, None]
    row = synchrony.sync_burst_statistics(synchrony.sync_burst_events(table, layout)).first()
    assert row[1:7] == (1, 2, 2.0, 2.0, 2, 2)
    # From the first start to the end of the burst that starts last.
    assert close(row.syncburst_bursts_duration_mean, 0.05) and row.syncburst_bursts_duration_sd is None
    assert row.syncburst_spikes_total == 11


def test_sync_bursts_on_one_channel(spark):
    table, layout = _burst_rows(spark, [(12, 1.00, 1.01, 5), (12, 1.02, 1.03, 5)])
    row = synchrony.sync_burst_statistics(synchrony.sync_burst_events(table, layout)).first()
    assert row.syncburst_countNEW == 1
    assert (row.syncburst_channels_mean, row.syncburst_channels_min, row.syncburst_channels_max) == (0, 0, 0)


def test_sync_spikes(spark):
    rows = [("a", c, s, None) for c, s in [(12, 0.100), (13, 0.104), (12, 0.112), (14, 0.131), (14, 0.133)]]
    spikes, layout = spike_table(spark, rows + [("b", 12, 5.0, None)])
    got = synchrony.label_sync_spikes(spikes, layout).where("fileName = 'a'").orderBy("s").collect()
    assert [r.window_bin for r in got] == [0, 0, 1, 3, 3]
    assert [r.syncspike_id for r in got] == [1, 1, None, None, None]
    summary = features.spike_features(spikes, layout)
    stats = {r.fileName: r for r in synchrony.sync_spike_features(summary, spikes, layout).collect()}
    assert stats["a"].syncspike_count == 1 and stats["a"].syncspike_spikes_total == 2
    assert all(stats["b"][name] == 0 for name in schemas.SYNCSPIKE_FEATURES)


def test_similarity(spark):
    spikes, layout = spike_table(spark, [("a", 12, 1.0, None), ("a", 12, 2.0, None), ("a", 13, 1.5, None), ("a", 13, 4.0, None)])
    values = similarity.channel_similarity(spikes, layout)
    got = {(r.ref_channel, r.comp_channel): r.value for r in values.collect()}
    assert got == {(12, 12): 0.0, (12, 13): 0.5, (13, 12): 4.25, (13, 13): 0.0}
    pair = similarity.similarity_symmetric(values).collect()
    assert [(r.ref_channel, r.comp_channel, r.mean_value) for r in pair] == [(12, 13, 2.375)]
    assert close(pair[0].mean_value_log, (-1 + 2.0874628412503395) / 2)
    assert similarity.similarity_log(values).count() == 2


def _summary(spark, rows):
    return spark.createDataFrame(rows, "fileName string, genotype string, maxRecording double, x double, y double")


def test_welch(spark):
    summary = _summary(spark, [
        ("1", "WT", 300.0, 10.0, 1.0), ("2", "wt-b", 300.0, 12.0, 1.0), ("3", "WT", 300.0, 14.0, 1.0),
        ("4", "KO", 300.0, 20.0, 1.0), ("5", "KO", 300.0, 25.0, None)])
    test = {r.variable: r for r in groups.welch_t(summary).collect()}
    assert set(test) == {"x", "y"}  # the constant length is dropped
    assert close(test["x"].t, 3.8129335, 1e-7) and close(test["x"].df, 1.4394229, 1e-7)
    table = groups.bi_summary(summary).collect()
    assert table[0].asDict() | {"P_value": 0} == {
        "Variable": "x", "WT_mean": 12.0, "WT_sem": table[0].WT_sem, "GM_mean": 22.5, "GM_sem": 2.5, "T_stat": 3.81, "P_value": 0}
    assert close(table[0].WT_sem, 1.1547005, 1e-7)
    # A missing value makes the mean missing; constant data have no t.
    assert table[1].GM_mean is None and table[1].T_stat is None and table[1].P_value is None


def test_length_is_kept_where_it_differs(spark):
    summary = _summary(spark, [("1", "WT", 300.0, 1.0, 1.0), ("2", "WT", 200.0, 2.0, 1.0), ("3", "KO", 300.0, 3.0, 1.0)])
    assert "maxRecording" in {r.variable for r in groups.group_means(summary).collect()}
    many = {r.variable: r for r in groups.multi_summary(summary, ["WT", "KO", "HET"]).collect()}
    assert many["x"].WT_mean == 1.5 and many["x"].KO_n == 1 and many["x"].HET_mean is None
    bounds = {(r.variable, r.genotype): r for r in groups.group_error_bounds(summary).collect()}
    assert close(bounds[("x", "WT")].ymin, 1.0) and close(bounds[("x", "WT")].ymax, 2.0)


def test_norm_prop_without_bursts(train):
    spikes, layout = train
    names = features.norm_prop(features.spike_features(spikes, layout)).columns
    assert "spike_n_NORM" in names and "activeChannels_PROP2totalChannels" in names
    assert "burst_n_NORM" not in names


def test_ratio_to_zero_is_null(spark):
    table = spark.createDataFrame([(5, 0, 0, 2, 1)], "spike_n int, activeChannels int, totalChannels int, burst_n int, burst_spikes_total int")
    row = features.norm_prop(table).first()
    assert row.spike_n_NORM is None and row.burst_spikes_PROP2totalSpikes == 0.2


def test_filters_by_metadata(spark):
    rows = [(f, c, 1.0, None) for f in "abcd" for c in (21, 31)]
    spikes, layout = spike_table(spark, rows)
    meta = spark.createDataFrame([
        ("1", "a", None, " 21, x,99", None), ("2", "b", "bad", None, "YES"), (None, "c", "YES", "", None)],
        "animalID string, fileName string, exclude string, channels2exclude string, hasHP string")
    def left(df):
        return sorted({(r.fileName, r.channel_id) for r in df.collect()})
    assert {f for f, _ in left(filters.sample_filter(spikes, meta, layout))} == {"a", "c", "d"}
    assert {f for f, _ in left(filters.sample_filter(spikes, meta, layout, marker="YES"))} == {"a", "b", "c", "d"}
    assert {f for f, _ in left(filters.sample_filter(spikes, meta, layout, exclude=False, has_hp=True))} == {"a", "c", "d"}
    assert left(filters.channel_filter(spikes, meta, layout)) == [("a", 31), ("b", 21), ("b", 31), ("c", 21), ("c", 31)]


def test_layers(spark):
    rows = [("a", 21, float(i), None) for i in range(5)] + [("a", 31, 1.0, None), ("a", 41, 1.0, None), ("b", 21, 1.0, None)]
    spikes, layout = spike_table(spark, rows)
    meta = spark.createDataFrame([("a", "21,31"), ("b", None)], "fileName string, upperLayerChannels string")
    tagged = channels.tag_layers(spikes, meta, layout)
    got = {(r.fileName, r.channel_id): r.layer for r in tagged.collect()}
    assert got == {("a", 21): "upper", ("a", 31): "upper", ("a", 41): "lower", ("b", 21): None}
    upper = filters.layer_filter(tagged, "upper", layout)
    assert {(r.fileName, r.totalChannels, r.activeChannels) for r in upper.collect()} == {("a", 2, 1)}


def test_regions(spark):
    spikes = spark.createDataFrame([("a", "NA"), ("b", None), ("c", "SSC")], "fileName string, region string")
    assert [r.fileName for r in filters.region_filter(spikes).collect()] == ["c"]


def test_maps(spark):
    spikes, layout = spike_table(spark, [("a", 12, 0.5, None), ("a", 12, 1.5, 1000.0), ("a", 88, 3.0, None)])
    grid = electrodes.activity_map(spikes).collect()
    assert len(grid) == 60 and {r.channel_id for r in grid}.isdisjoint({11, 18, 81, 88})
    assert [(r.x, r.y, r.n) for r in grid if not r.not_used] == [(1, 2, 2)]
    labelled = bursts.label_spikes(spikes, layout)
    still = {(r.channel_id, r.from_s): r.spikes for r in electrodes.activity_map_windowed(labelled, 1).collect()}
    assert still == {(12, 0.0): 1, (12, 1.0): 1, (88, 3.0): 1}
    slide = {(r.channel_id, r.from_s): r.spikes for r in electrodes.activity_map_windowed(labelled, 2, 1, end=3).collect()}
    assert slide == {(12, 0.0): 2, (12, 1.0): 1}
    with pytest.raises(ValueError):
        electrodes.activity_map_windowed(labelled, 1, 0.3)
    points = electrodes.raster_points(labelled, xlim=1.5).collect()
    assert [(p.s, p.in_burst) for p in points] == [(0.5, False), (1.5, False)]
