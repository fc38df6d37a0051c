"""Many genotypes against WT, sliding maps, channel masks, ranks, burst overlays and constants of a recording."""

import random
import statistics

import pytest
from helpers import close, random_rows, spike_table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spikeframe.layout import ROWS_PER_SLICE_CONF, Layout, global_rank
from spikeframe.operators import bursts, electrodes, features, groups, synchrony


def summary(spark, values):
    """{genotype: values of one feature}"""
    rows = [(f"{g}{k}", g, 300.0, v) for g, vs in values.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "fileName string, genotype string, maxRecording double, x double")


def test_every_genotype_against_wt(spark):
    rng = random.Random(4)
    draw = lambda mean, n: [rng.gauss(mean, 1) for _ in range(n)]
    values = {"wt_a": draw(0, 5), "WT": draw(0, 4), "A": draw(0.8, 6), "B": draw(2.5, 5), "C": draw(0.3, 7), None: draw(1, 4), "one": [3.0], "flat": [1.0, None]}
    got = {r.genotype: r for r in groups.vs_wt(summary(spark, values)).collect()}
    assert set(got) == {"A", "B", "C", None, "one", "flat"} and {r.variable for r in got.values()} == {"x"}
    wt = values["wt_a"] + values["WT"]
    for g in ("A", "B", "C", None):
        r, own = got[g], values[g]
        a, b = statistics.variance(wt) / len(wt), statistics.variance(own) / len(own)
        t = abs(statistics.fmean(wt) - statistics.fmean(own)) / (a + b) ** 0.5
        df = (a + b) ** 2 / (a * a / (len(wt) - 1) + b * b / (len(own) - 1))
        assert (r.WT_n, r.GM_n) == (9, len(own)) and close(r.t, t) and close(r.df, df) and close(r.WT_mean, statistics.fmean(wt))
        two = groups.bi_summary(summary(spark, {"WT": wt, "GM": own})).first()
        assert close(round(r.p, 4), two.P_value)
    assert got["one"].p is None and got["one"].p_adjusted is None and got["flat"].GM_mean is None
    highest = 0.0
    for k, r in enumerate(sorted((r for r in got.values() if r.p is not None), key=lambda r: r.p)):
        highest = max(highest, min(1.0, r.p * (4 - k)))
        assert close(r.p_adjusted, highest)


def test_columns_for_a_missing_genotype(spark):
    values = {"NA": [1.0, 2.0], None: [3.0], "WT": [4.0]}
    table = groups.multi_summary(summary(spark, values))
    assert len(set(table.columns)) == len(table.columns)
    row = table.first()
    assert (row["NA_mean"], row["missing_mean"], row["WT_mean"]) == (1.5, 3.0, 4.0)


def test_too_many_genotypes_for_columns(spark, monkeypatch):
    monkeypatch.setattr(groups, "MOST_GROUPS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        groups.multi_summary(summary(spark, {"A": [1.0], "B": [1.0], "C": [1.0]}))


def loop_windows(rows, per, first=0, last=None):
    """rows: (channel, step, burst or None) -> {(channel, window): (spikes, bursts)}"""
    out = {}
    for channel, step, burst in rows:
        for w in range(max(step - per + 1, first), (step if last is None else min(step, last)) + 1):
            spikes, found = out.setdefault((channel, w), [0, set()])
            out[channel, w][0] = spikes + 1
            if burst is not None:
                found.add(burst)
    return {key: (n, len(found)) for key, (n, found) in out.items()}


@pytest.mark.parametrize("per", [2, 7, 1000])
def test_sliding_windows(spark, per):
    rng = random.Random(per)
    rows = [(rng.choice([21, 31]), rng.randint(0, 40 if per < 100 else 3000), rng.choice([None, None, 1, 2, 3])) for _ in range(60)]
    labelled = spark.createDataFrame(
        [("a", "WT", c, s + 0.5, b) for c, s, b in rows], "fileName string, genotype string, channel_id int, s double, burst_id int")
    slid = electrodes.activity_map_windowed(labelled, per, 1)
    got = {(r.channel_id, round(r.from_s)): (r.spikes, r.bursts) for r in slid.collect()}
    assert got == loop_windows(rows, per)
    frame = electrodes.activity_map_windowed(labelled, per, 1, start=5, end=20 + per)
    inside = [r for r in rows if 5 <= r[1] < 20 + per]
    assert {(r.channel_id, round(r.from_s)): (r.spikes, r.bursts) for r in frame.collect()} == loop_windows(inside, per, 5, 20)


def test_sliding_windows_write_only_results(spark):
    labelled = spark.createDataFrame([("a", "WT", 21, 0.5, None)], "fileName string, genotype string, channel_id int, s double, burst_id int")
    plan = electrodes.activity_map_windowed(labelled, 1000, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.index("Generate") < plan.index("Aggregate")  # the copies come last


def test_channel_masks(spark):
    rng = random.Random(9)
    rows = [(f"f{rng.randint(0, 4)}", rng.choice([None, *range(128)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "f string, channel_id int")
    from spikeframe.functions.channels import channels_n

    got = {r.f: r.n for r in df.groupBy("f").agg(channels_n().alias("n")).collect()}
    assert got == {f: len({c for g, c in rows if g == f and c is not None}) for f, _ in rows}
    with pytest.raises(PySparkException, match="this is 128"):
        df.unionByName(spark.createDataFrame([("x", 128)], df.schema)).groupBy("f").agg(channels_n()).collect()


def test_synchrony_is_a_hash_aggregation(spark):
    spikes, layout = spike_table(spark, random_rows(1))
    plan = synchrony.sync_spike_events(spikes, layout)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "HashAggregate" in plan


def test_positional_intervals_need_no_single_partition(spark):
    spikes, layout = spike_table(spark, random_rows(2))
    plan = features.positional_isi(spikes, layout)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    ranked, rows = global_rank(df, "place", "x")
    assert rows == 1000 and [r.place for r in ranked.orderBy("x").collect()] == list(range(1, 1001))
    ranked, rows = global_rank(df.limit(0), "place", "x")
    assert rows == 0 and ranked.count() == 0


@pytest.mark.parametrize("size", [4_000_000, 15])
def test_burst_overlay(spark, settings, size):
    settings(ROWS_PER_SLICE_CONF, size)
    spikes, layout = spike_table(spark, random_rows(seed=12, most=80))
    labelled = bursts.label_spikes(spikes, layout)
    table = bursts.find_bursts(spikes, layout)
    numbers = {(r.fileName, r.channel_id, r.burst_id): r.syncburst_id for r in synchrony.label_sync_bursts(table, layout, 2).collect()}
    out = synchrony.label_burst_spikes(labelled, table, layout, 2)
    rows = out.collect()
    assert out.columns == [*labelled.columns, "syncburst_id"] and len(rows) == spikes.count()
    assert all(r.syncburst_id == numbers.get((r.fileName, r.channel_id, r.burst_id)) for r in rows)
    marked = electrodes.raster_points(out).where("in_syncburst").count()
    assert 0 < marked == sum(r.syncburst_id is not None for r in rows)


def test_a_recording_has_one_genotype_and_length(spark):
    good = [("a", 21, 1.0, None, "WT", 300.0), ("b", 21, 1.0, None, "KO", 200.0)]
    Layout.measure(spike_table(spark, good, layout=False))
    for row in (("a", 31, 2.0, None, "KO", 300.0), ("a", 31, 2.0, None, "WT", 301.0), ("a", 31, 2.0, None, None, 300.0)):
        with pytest.raises(ValueError, match="differs within 1 recordings: a"):
            Layout.measure(spike_table(spark, [*good, row], layout=False))
    both = [*good, ("a", 31, 2.0, None, "KO", 300.0), ("b", 31, 2.0, None, "WT", 200.0)]
    with pytest.raises(ValueError, match="2 recordings: a to b"):
        Layout.measure(spike_table(spark, both, layout=False))


def test_similarity_stays_in_spark(spark):
    from spikeframe.operators import similarity

    spikes, layout = spike_table(spark, random_rows(seed=41))
    assert layout.channel_ids == (21, 31, 41, 51)
    plan = similarity.channel_similarity(spikes, layout)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
