"""Heavy keys are cut, small tables are counted before a broadcast, plans stay narrow."""

import re

import pytest
from helpers import random_rows, spike_table
from pyspark.sql import functions as F

from spikeframe import layout as L
from spikeframe.layout import BROADCAST_ROWS_CONF, ROWS_PER_SLICE_CONF, Layout, Slicing
from spikeframe.operators import bursts, filters


def skewed(spark, n=9000):
    """A third of all rows on one channel; the others share the rest."""
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 50).cast("string"))).alias("fileName"),
        F.lit("WT").alias("genotype"), F.lit(1).alias("totalChannels"), F.lit(1).alias("activeChannels"),
        F.lit(21).alias("channel_id"), F.lit(300.0).alias("maxRecording"), F.col("id").alias("seq"),
        (F.col("id") / 100).alias("s"), F.lit(10.0).alias("isi"), F.lit(1.0).alias("frequency"))
    return df


def test_nothing_is_cut_below_the_limit(spark):
    layout = Layout.measure(skewed(spark))
    assert layout.channels.hot is None and layout.recordings.hot is None
    assert layout.recordings.count == 51 and layout.channels.count == 51
    assert layout.channels.group == ["fileName", "channel_id"]


def test_a_heavy_channel_is_divided(spark, settings):
    settings(ROWS_PER_SLICE_CONF, 500)
    df = skewed(spark)
    layout = Layout.measure(df)
    assert [r.fileName for r in layout.channels.hot.collect()] == ["hot"]
    split = layout.channels.split(df, "s")
    sizes = split.groupBy("fileName", "slice").count().collect()
    assert sum(r["count"] for r in sizes) == 9000
    assert max(r["count"] for r in sizes if r.fileName == "hot") <= 500
    assert len([r for r in sizes if r.fileName == "hot"]) == 6 * L.SLICES_PER_SHARE == layout.channels.slices
    assert all(r.slice == 0 for r in sizes if r.fileName != "hot")
    # Slices follow time.
    ends = split.where("fileName = 'hot'").groupBy("slice").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("slice").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def slice_sizes(spark, times, limit):
    df = spark.createDataFrame([("k", float(t)) for t in times], "key string, t double")
    slicing = Slicing.measure(df, ["key"], "t", "part")
    return [r["count"] for r in slicing.split(df, "t").groupBy("part").count().collect()]


def test_cuts_follow_the_rows(spark, settings):
    settings(ROWS_PER_SLICE_CONF, 500)
    outlier = slice_sizes(spark, [k / 100 for k in range(20_000)] + [1e9], 500)
    assert sum(outlier) == 20_001 and max(outlier) <= 1000
    bunched = slice_sizes(spark, [k / 2000 for k in range(18_000)] + [9 + k / 2 for k in range(2000)], 500)
    assert sum(bunched) == 20_000 and max(bunched) <= 1000


def test_any_number_of_keys_is_cut(spark, settings):
    """More heavy keys than fit any fixed list, and none of them broadcast."""
    settings(ROWS_PER_SLICE_CONF, 3)
    settings(BROADCAST_ROWS_CONF, 0)
    df = spark.range(5000 * 8).select((F.col("id") % 5000).cast("string").alias("key"), (F.col("id") / 7).alias("t"))
    slicing = Slicing.measure(df, ["key"], "t", "part")
    assert slicing.hot.count() == 5000
    sizes = slicing.split(df, "t").groupBy("key", "part").count()
    assert sizes.agg(F.sum("count"), F.max("count")).first()[0] == 40_000
    assert sizes.agg(F.max("count")).first()[0] <= 6
    numbered = slicing.running_sum(slicing.split(df, "t"), "n", F.lit(1), "t")
    last = numbered.groupBy("key").agg(F.max("n").alias("n"), F.countDistinct("n").alias("d"))
    assert last.where("n = 8 and d = 8").count() == 5000


def test_equal_times_cannot_be_cut(spark, settings):
    settings(ROWS_PER_SLICE_CONF, 5)
    spikes, layout = spike_table(spark, [("a", 21, 1.0, None) for _ in range(20)])
    assert layout.channels.hot is None
    assert bursts.label_spikes(spikes, layout).count() == 20


def test_an_empty_table(spark):
    spikes, layout = spike_table(spark, [])
    assert layout.recordings.count == 0 and layout.channels.count == 0
    assert bursts.find_bursts(spikes, layout).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit,rows", [(1000, 500), (0, 500), (0, 100000)])
def test_lookup_gives_the_plain_join(spark, settings, how, limit, rows):
    settings(ROWS_PER_SLICE_CONF, rows)
    settings(BROADCAST_ROWS_CONF, limit)
    df = skewed(spark)
    table = df.select("fileName").distinct().where("fileName < 'f3' or fileName = 'hot'").withColumn("x", F.lit(7))
    if how.startswith("left_"):
        table = table.drop("x")
    layout = Layout.measure(df)
    for bounded in (True, False):
        got = layout.recordings.lookup(df, table, how, bounded)
        want = df.join(table, "fileName", how)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_rows_are_salted_in_a_shuffled_lookup(spark, settings):
    settings(ROWS_PER_SLICE_CONF, 500)
    settings(BROADCAST_ROWS_CONF, 0)
    settings("spark.sql.autoBroadcastJoinThreshold", -1)
    df = skewed(spark)
    layout = Layout.measure(df)
    totals = df.groupBy("fileName").agg(F.count("*").alias("n"))
    assert re.search(r"SortMergeJoin \[fileName#\d+, _salt#\d+\]", plan(layout.recordings.lookup(df, totals)))


def test_bursts_shuffle_the_spikes_once(spark):
    spikes, layout = spike_table(spark, random_rows(seed=1))
    found = plan(bursts.find_bursts(spikes, layout))
    assert found.count("Exchange hashpartitioning") == 1
    assert plan(bursts.label_spikes(spikes, layout)).count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spikes, _ = spike_table(spark, random_rows(seed=1))
    spikes.write.parquet(str(tmp_path / "spikes"))
    stored = spark.read.parquet(str(tmp_path / "spikes"))
    text = plan(filters.length_filter(stored, 5).select("fileName", "s"))
    assert "LessThanOrEqual(s,5.0)" in text and "ReadSchema: struct<fileName:string,s:double>" in text


def test_tables_are_kept_in_the_shared_folder(spark, monkeypatch, tmp_path):
    # The setting cannot be changed in a running session.
    monkeypatch.setattr(L, "kept_folder", lambda _: f"file://{tmp_path}/spikeframe-x")
    before = spark.sparkContext.getCheckpointDir()
    table = L.kept(spark.range(3).toDF("a"))
    assert sorted(r.a for r in table.collect()) == [0, 1, 2]
    assert table.inputFiles()[0].startswith("file:") and f"{tmp_path}/spikeframe-x" in table.inputFiles()[0]
    assert spark.sparkContext.getCheckpointDir() == before
    L.discard_kept(spark)
    assert not list(tmp_path.iterdir())


def test_scans_do_not_depend_on_the_session(spark, settings, tmp_path):
    """Labelling with all keys cut reads the spikes a fixed number of times."""
    spikes, _ = spike_table(spark, random_rows(seed=1))
    spikes.write.parquet(str(tmp_path / "spikes"))
    stored = spark.read.parquet(str(tmp_path / "spikes"))
    settings(ROWS_PER_SLICE_CONF, 5)
    layout = Layout.measure(stored)
    text = plan(bursts.label_spikes(stored, layout))
    assert text.count(f"{tmp_path}/spikes") <= 1
