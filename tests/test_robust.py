"""Inputs outside the fixtures: near-constant intervals, filtered bursts, names given twice, frames."""

import statistics

import pytest
from helpers import close, random_rows, spike_table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_sources import EXPORT, META, write

from spikeframe.layout import Layout
from spikeframe.operators import bursts, channels, distributions, electrodes, features, filters, groups
from spikeframe.plans import analysis
from spikeframe.sources import metadata, recordings, snapshots


def test_near_constant_intervals_keep_their_spread(spark):
    gaps = [50_000 + (1e-4 if k % 2 else -1e-4) for k in range(40)]  # ms
    rows, at = [], {21: 0.0, 31: 0.0}
    for k, gap in enumerate(gaps):
        channel = 21 if k < 20 else 31
        at[channel] += gap / 1000
        rows.append(("a", channel, at[channel], gap))
    spikes, layout = spike_table(spark, rows)
    row = features.spike_features(spikes, layout).first()
    assert close(row.isi_sd, statistics.stdev(gaps), 1e-4) and close(row.isi_mean, 50_000)


def test_burst_rate_counts_the_bursts_that_are_left(spark, settings):
    rows = random_rows(seed=4, most=300)
    for size in (4_000_000, 20):
        settings("spark.spikeframe.rowsPerSlice", size)
        spikes, layout = spike_table(spark, rows)
        some = bursts.find_bursts(spikes, layout).where("spike_count >= 7")
        by_channel = {}
        for r in some.collect():
            by_channel.setdefault(r.fileName, {}).setdefault(r.channel_id, []).append(r)
        for r in features.burst_statistics(some, layout).collect():
            rates = [len(b) / 300 / 60 for b in by_channel[r.fileName].values()]
            assert close(r.burstRate_mean, statistics.fmean(rates))
            assert close(r.burstRate_sd, statistics.stdev(rates) if len(rates) > 1 else None)


def test_files_of_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "a.txt", EXPORT)
    lines = recordings.read_lines(spark, str(tmp_path / "*"))
    assert recordings.parse_lines(lines).count() == 8
    meta = spark.createDataFrame([("m", "a", "WT", 300.0, None, None)], META)
    with pytest.raises(ValueError, match="several files for one recording.*x/a.txt.*y/a.txt"):
        recordings.compile_recordings(spark, meta, str(tmp_path / "*"))
    other = spark.createDataFrame([("m", "b", "WT", 300.0, None, None)], META)
    assert recordings.compile_recordings(spark, other, str(tmp_path / "*"))[0].count() == 0


def test_small_files_packed_into_one_task(spark, settings, tmp_path):
    settings("spark.sql.files.openCostInBytes", 1)
    for k in range(12):
        write(tmp_path / f"f{k:02}.txt", EXPORT.replace("0.52", f"0.{60 + k}"))
    meta = spark.createDataFrame([("m", f"f{k:02}", "WT", 300.0, None, None) for k in range(12)], META)
    spikes, _ = recordings.compile_recordings(spark, meta, str(tmp_path))
    got = sorted((r.fileName, r.s) for r in spikes.collect() if r.channel_id == 12)
    assert got == sorted((f"f{k:02}", s) for k in range(12) for s in (0.5, (60 + k) / 100))


def test_the_raw_stage_is_written(spark, tmp_path):
    write(tmp_path / "a.txt", EXPORT)
    meta = spark.createDataFrame([("m", "a", "WT", 300.0, None, None)], META)
    spikes, _ = recordings.compile_recordings(spark, meta, str(tmp_path), directory=str(tmp_path / "out"), prefix="P5")
    assert spikes.count() == 4 and (tmp_path / "out" / "P5_00_raw" / "spikes").is_dir()
    text = spikes._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in text


@pytest.mark.parametrize("names", [("r", "r"), ("r", "r.txt")])
def test_a_recording_listed_twice_raises(spark, tmp_path, names):
    spikes, layout = spike_table(spark, [("r", 21, 0.1 * k, 100.0) for k in range(5)])
    meta = spark.createDataFrame([("m", n, "WT", 300.0, None, None) for n in names], META).withColumn("upperLayerChannels", F.lit("21"))
    for join in (lambda: filters.channel_filter(spikes, meta, layout), lambda: channels.stamp_metadata(spikes, meta, layout),
                 lambda: channels.tag_layers(spikes, meta, layout),
                 lambda: recordings.stamp_recordings(spikes.withColumnRenamed("fileName", "file").drop("genotype", "maxRecording"), meta)):
        with pytest.raises(PySparkException, match="listed more than once: r"):
            join().collect()
    path = str(tmp_path / "meta.csv")
    meta.drop("upperLayerChannels").coalesce(1).write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="listed more than once: r"):
        metadata.read_meta(spark, path)


def test_metadata_without_a_header(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text('m1,a,WT,600,,"21,52",more\nm2,b,KO,300,YES,,\n')
    rows = metadata.read_meta(spark, str(path), header=False).orderBy("fileName").collect()
    assert [(r.animalID, r.fileName, r.maxRecording, r.exclude, r.channels2exclude) for r in rows] == [
        ("m1", "a", 600.0, None, "21,52"), ("m2", "b", 300.0, "YES", None)]
    path.write_text("m1,a\n")
    with pytest.raises(ValueError, match="2 columns"):
        metadata.read_meta(spark, str(path), header=False)


def test_only_whole_windows_lie_in_a_frame(spark):
    spikes, layout = spike_table(spark, [("a", 21, 7.5 + k / 4, 250.0) for k in range(20)] + [("a", 31, 1.0, None)])
    labelled = bursts.label_spikes(spikes, layout)
    got = electrodes.activity_map_windowed(labelled, 2, 1, start=8.5, end=12).collect()
    assert {r.from_s: r.spikes for r in got} == {9.0: 8, 10.0: 8}
    whole = electrodes.activity_map_frame(labelled, 8.5, 12, 2, 1).collect()
    assert len(whole) == 60 * 2 and {r.genotype for r in whole} == {"WT"}
    assert {(r.channel_id, r.spikes) for r in whole if r.spikes} == {(21, 8)}
    assert {r.channel_id for r in whole if not r.not_used} == {21, 31}
    assert electrodes.activity_map_frame(labelled, 8.5, 9.5, 2, 1).count() == 0


def test_groups_of_the_data(spark):
    rows = [("1", "WT", 1.0), ("2", "KO", 3.0), ("3", "HET", 5.0), ("4", None, 7.0)]
    summary = spark.createDataFrame(rows, "fileName string, genotype string, x double")
    many = groups.multi_summary(summary)
    assert [c for c in many.columns if c.endswith("_mean")] == ["HET_mean", "KO_mean", "WT_mean", "NA_mean"]
    row = many.first()
    assert (row.HET_mean, row.KO_mean, row.WT_mean, row.NA_mean, row.NA_n) == (5.0, 3.0, 1.0, 7.0, 1)
    with pytest.raises(ValueError, match="HET"):
        groups.multi_summary(summary, ["WT", "KO", None])


def test_the_ks_method_is_chosen(spark):
    rates = spark.createDataFrame(
        [(str(k), g, 21, float(k + (12 if g == "KO" else 0))) for k in range(1, 131) for g in ("WT", "KO")],
        "fileName string, genotype string, channel_id int, Hz double")
    exact, limit = (distributions.ks_test(rates, method=m).first() for m in ("exact", "asymptotic"))
    assert (exact.method, limit.method) == ("exact", "asymptotic") and exact.n * exact.m > 10000
    assert exact.D == limit.D and exact.p_value != limit.p_value and close(exact.p_value, limit.p_value, 0.2)
    with pytest.raises(ValueError):
        distributions.ks_test(rates, method="auto")


def test_bursts_of_labelled_spikes(spark, settings):
    rows = random_rows(seed=9, most=200)
    for size in (4_000_000, 15):
        settings("spark.spikeframe.rowsPerSlice", size)
        spikes, layout = spike_table(spark, rows)
        for longest in (None, 0.2):
            found = bursts.find_bursts(spikes, layout, burst_duration_max=longest)
            labelled = bursts.bursts_of(bursts.label_spikes(spikes, layout, burst_duration_max=longest))
            key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
            assert key(found) == key(labelled) and found.columns == labelled.columns


def scans(df, path):
    return df._jdf.queryExecution().executedPlan().toString().count(path)


def test_an_analysis_reads_the_spikes_once(spark, tmp_path):
    rows = random_rows(seed=3, most=200)
    spike_table(spark, rows, layout=False).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    meta = spark.createDataFrame([("m", f"file_{k}", "WT", 300.0, None, None) for k in range(3)], META)
    result = analysis.run(stored, meta, Layout.measure(stored), active_threshold=0)
    # Only the written table with the labels is left in the plan: for the spikes and for the bursts.
    assert scans(result.summary, f"{tmp_path}/stored") == 0
    assert result.summary._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


def test_options_of_a_run(spark, tmp_path):
    rows = random_rows(seed=3, most=200)
    spikes, layout = spike_table(spark, rows)
    meta = spark.createDataFrame([("m", f"file_{k}", "WT", 300.0, None, None) for k in range(3)], META)
    run = lambda **how: analysis.run(spikes, meta, layout, active_threshold=0, **how)
    by_file = lambda a: {r.fileName: r for r in a.summary.collect()}
    plain, minutes, placed = by_file(run()), by_file(run(per_minute=True)), by_file(run(isi_mode="positional"))
    for name, row in plain.items():
        assert close(minutes[name].burstRate_mean, 3600 * row.burstRate_mean)
        assert placed[name].isi_mean != row.isi_mean
    with pytest.raises(ValueError, match="no bursts"):
        run(spikes_per_burst=10_000, strict=True)
    synced = run(synchrony={"syncburst_window": 1, "run_syncspike_id": True}, directory=str(tmp_path), prefix="P5")
    assert "syncspike_id" in synced.spikes.columns and "syncburst_id" in synced.bursts.columns
    assert "syncburst_countNEW" in synced.summary.columns
    for stage, table in (("bursts", "spikes"), ("bursts", "bursts"), ("spike_features", "summary"), ("burst_features", "summary"),
                         ("sync_bursts", "bursts"), ("sync_spikes", "spikes"), ("norm", "summary")):
        assert snapshots.read_stage(spark, str(tmp_path), stage, table, "P5").count() > 0
