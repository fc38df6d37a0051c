"""Text exports, metadata tables, stage tables."""

import pytest
from pyspark.sql import functions as F

from spikeframe import schemas
from spikeframe.operators.electrodes import raster_points, write_raster
from spikeframe.operators.groups import bi_summary
from spikeframe.plans.analysis import add_features, add_synchrony, detect_bursts, run
from spikeframe.sources import metadata, recordings, snapshots

EXPORT = """header text

t\t12\t12\t

[s]\t[ms]\t[Hz]\t
0.5\tNaN\tNaN\t
0.52\t20\t50\t

t\t13\t13\t

[s]\t[ms]\t[Hz]\t

t\t14\t14\t

[s]\t[ms]\t[Hz]\t
1.5\tNaN\tNaN\t
1.53\t30\t33.3\t


Bined Parameters:
t\t12\t12\t
9\t9\t9\t
"""

META = "animalID string, fileName string, genotype string, maxRecording double, exclude string, channels2exclude string"


def write(path, text, newline="\n"):
    path.write_bytes(text.replace("\n", newline).encode())


def compile_one(spark, tmp_path, text, decimal=".", newline="\n"):
    write(tmp_path / "slice 1 5048.txt", text, newline)
    meta = spark.createDataFrame([("m", "slice 1 5048.txt", "WT", 300.0, None, None)], META)
    spikes, _ = recordings.compile_recordings(spark, meta, str(tmp_path), decimal)
    return spikes.orderBy("channel_id", "seq").collect()


def check(rows):
    assert [(r.channel_id, r.s, r.isi, r.frequency) for r in rows] == [
        (12, 0.5, None, None), (12, 0.52, 20.0, 50.0), (14, 1.5, None, None), (14, 1.53, 30.0, 33.3)]
    assert {(r.fileName, r.genotype, r.maxRecording, r.totalChannels, r.activeChannels) for r in rows} == {
        ("slice 1 5048.txt", "WT", 300.0, 2, 0)}


@pytest.mark.parametrize("change", [
    lambda t: t,
    lambda t: t.replace("\t\n", "\n"),
    lambda t: t.replace("Bined", "Binned"),
], ids=["as is", "no tab at the end", "other spelling"])
def test_export(spark, tmp_path, change):
    check(compile_one(spark, tmp_path, change(EXPORT)))


def test_export_with_windows_line_ends(spark, tmp_path):
    check(compile_one(spark, tmp_path, EXPORT, newline="\r\n"))


def test_export_with_decimal_commas(spark, tmp_path):
    check(compile_one(spark, tmp_path, EXPORT.replace("0.5", "0,5").replace("1.5", "1,5").replace("33.3", "33,3"), ","))


def test_last_channel_without_spikes(spark, tmp_path):
    rows = compile_one(spark, tmp_path, EXPORT.replace("1.5\tNaN\tNaN\t\n1.53\t30\t33.3\t\n", ""))
    assert [r.channel_id for r in rows] == [12, 12]


def test_signs_in_file_names(spark, tmp_path):
    for name in ("a+b 100%.txt", "plain.txt"):
        write(tmp_path / name, EXPORT)
    meta = spark.createDataFrame([("m", "a+b 100%", "WT", 300.0, None, None)], META)
    spikes, _ = recordings.compile_recordings(spark, meta, str(tmp_path))
    assert {r.fileName for r in spikes.collect()} == {"a+b 100%"}


def long_export(channels, spikes):
    out = ["header", ""]
    for c in channels:
        out += [f"t\t{c}\t{c}\t", "", "[s]\t[ms]\t[Hz]\t"]
        out += [f"{i / 8}\t{'NaN' if i == 0 else 125}\t{'NaN' if i == 0 else 8}\t" for i in range(spikes)] + [""]
    return "\n".join(out + ["", "Bined Parameters:", "t\t99\t99\t", "1\t1\t1\t", "t\t98\t98\t", "2\t2\t2\t", ""])


def test_a_file_in_many_splits(spark, settings, tmp_path):
    """Splits shorter than a channel, so channel and end of data come from splits before."""
    settings("spark.sql.files.maxPartitionBytes", 700)
    settings("spark.sql.files.openCostInBytes", 1)
    for name in ("a", "b"):
        write(tmp_path / f"{name}.txt", long_export([12, 13, 14], 100))
    write(tmp_path / "unlisted.txt", long_export([12], 10))
    meta = spark.createDataFrame([("m", "a", "WT", 300.0, None, None), ("n", "b.txt", "KO", 300.0, None, None)], META)
    lines = recordings.read_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 10
    spikes, layout = recordings.compile_recordings(spark, meta, str(tmp_path))
    rows = spikes.orderBy("fileName", "channel_id", "seq").collect()
    assert [(r.fileName, r.channel_id, r.s) for r in rows] == [
        (f, c, i / 8) for f in ("a", "b.txt") for c in (12, 13, 14) for i in range(100)]
    assert {(r.totalChannels, r.activeChannels) for r in rows} == {(3, 3)}
    assert layout.recordings.count == 2 and layout.channels.count == 6


def test_layers_and_regions_of_an_export(spark, tmp_path):
    write(tmp_path / "a.txt", EXPORT)
    meta = spark.createDataFrame([("m", "a", "WT", 300.0, "SSC", "12")],
                                 "animalID string, fileName string, genotype string, maxRecording double, region string, upperLayerChannels string")
    spikes, _ = recordings.compile_recordings(spark, meta, str(tmp_path), layers=True)
    assert spikes.columns[:5] == ["fileName", "genotype", "region", "layer", "totalChannels"]
    assert {(r.channel_id, r.region, r.layer) for r in spikes.collect()} == {(12, "SSC", "upper"), (14, "SSC", "lower")}


def test_metadata(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("animalID,fileName,genotype,maxRecording,exclude,channels2exclude,region\n"
                    'm1,a,WT,600,,"21,52",SSC\n,b,KO,abc,YES,,NA\n')
    meta = metadata.read_meta(spark, str(path))
    assert meta.columns == [f.name for f in schemas.META.fields]
    rows = meta.collect()
    assert rows[0].maxRecording == 600.0 and rows[0].channels2exclude == "21,52" and rows[0].exclude is None
    assert rows[1].animalID is None and rows[1].maxRecording is None
    tidy = metadata.tidy_meta(meta.withColumn("NA..1", F.lit(1)).withColumn("naming", F.lit(1)))
    assert tidy.columns == meta.columns and tidy.count() == 1
    assert metadata.duplicate_recordings(meta.union(meta.limit(1))).collect()[0].n == 2
    meta.write.parquet(str(tmp_path / "meta.parquet"))
    assert metadata.read_meta(spark, str(tmp_path / "meta.parquet")).count() == 2


@pytest.fixture(scope="module")
def inputs(spark):
    from spikeframe.operators.channels import stamp_channel_counts
    from spikeframe.sources.events import meta_from_events, read_events, spikes_from_events
    events = read_events(spark, "/root/testdata/sf0.001/events.parquet")
    spikes, layout = spikes_from_events(events)
    return stamp_channel_counts(spikes, layout), meta_from_events(events), layout


def test_a_staged_run_gives_the_lazy_result(spark, inputs, tmp_path):
    spikes, meta, layout = inputs
    how = dict(max_duration=250, isi_threshold=2500, spikes_per_burst=4)
    lazy = run(spikes, meta, layout, **how)
    staged = run(spikes, meta, layout, **how, directory=str(tmp_path), prefix="P5")
    # Sums over rows in another order may differ in the last digit.
    def key(rows):
        return sorted(str([round(v, 8) if isinstance(v, float) else v for v in r]) for r in rows)

    assert key(staged.summary.collect()) == key(lazy.summary.collect())
    stored = snapshots.read_stage(spark, str(tmp_path), "norm", "summary", "P5")
    assert key(stored.collect()) == key(lazy.summary.collect())
    assert snapshots.read_stage(spark, str(tmp_path), "bursts", "bursts", "P5").count() == lazy.bursts.count()


def test_synchrony_goes_onto_the_tables(inputs):
    spikes, _, layout = inputs
    result = add_synchrony(add_features(detect_bursts(spikes, layout, 2500, 5)), 5, 0.1, run_syncspike_id=True)
    assert {"window_bin", "syncspike_id", "burst_id"} <= set(result.spikes.columns)
    assert "syncburst_id" in result.bursts.columns
    assert "syncspike_channels_max_PROP2activeChannels" in result.summary.columns
    assert result.summary.count() == 2


def test_summaries_of_several_ages(spark, inputs, tmp_path):
    spikes, _, layout = inputs
    for prefix, threshold in (("P5", 1000), ("P15", 2000), ("P60", 2500)):
        summary = add_features(detect_bursts(spikes, layout, threshold, 5)).summary
        if prefix == "P60":
            summary = summary.withColumn("extra", F.lit(1.0))
        snapshots.write_stage({"summary": summary}, str(tmp_path), "norm", prefix)
    table = snapshots.compile_summaries(spark, str(tmp_path))
    got = {r["index"]: r.n for r in table.groupBy("index").agg(F.count("*").alias("n")).collect()}
    assert got == {"P5": 2, "P15": 2, "P60": 2}
    assert table.where("extra is not null").select("index").distinct().collect()[0][0] == "P60"
    stacked = snapshots.stack_summaries({
        p: snapshots.read_stage(spark, str(tmp_path), "norm", "summary", p) for p in ("P5", "P60")})
    assert stacked.count() == 4 and "extra" in stacked.columns


def test_summary_table_file(spark, inputs, tmp_path):
    spikes, _, layout = inputs
    table = bi_summary(add_features(detect_bursts(spikes, layout, 2500, 5)).summary)
    snapshots.write_summary_table(table, str(tmp_path / "table"))
    stored = spark.read.option("header", True).csv(str(tmp_path / "table"))
    assert stored.columns == ["Variable", "WT_mean", "WT_sem", "GM_mean", "GM_sem", "T_stat", "P_value"]
    assert [r.Variable for r in stored.collect()][:3] == ["totalChannels", "activeChannels", "spike_n"]


def test_raster_files(spark, inputs, tmp_path):
    spikes, _, layout = inputs
    points = raster_points(detect_bursts(spikes, layout, 2500, 5).spikes)
    write_raster(points, str(tmp_path / "raster"))
    assert spark.read.parquet(str(tmp_path / "raster")).count() == points.count() == 1000
