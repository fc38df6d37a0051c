"""Random trains against literal loops, on plain plans and with every channel cut."""

import itertools
import math

import pytest
from helpers import by_channel, close, loop_bursts, loop_positional, loop_similarity, random_rows, spike_table
from pyspark.sql import functions as F

from spikeframe import schemas
from spikeframe.functions.pvalues import kolmogorov_p_value, student_p_value
from spikeframe.layout import BROADCAST_ROWS_CONF, ROWS_PER_SLICE_CONF, Layout
from spikeframe.operators import bursts, distributions, features, similarity, synchrony

CUT = [None, 5]


@pytest.fixture(params=CUT, ids=["plain", "cut"])
def cut(request, settings):
    if request.param:
        settings(ROWS_PER_SLICE_CONF, request.param)
        settings(BROADCAST_ROWS_CONF, 0)
    return request.param


@pytest.mark.parametrize("least,longest", [(5, None), (2, None), (3, 0.2)])
def test_bursts_equal_the_run_loop(spark, cut, least, longest):
    rows = random_rows(seed=least)
    spikes, layout = spike_table(spark, rows)
    assert (layout.channels.hot is not None) == bool(cut)
    want, labels = loop_bursts(rows, 50, least, longest)
    found = bursts.find_bursts(spikes, layout, 50, least, longest).collect()
    got = sorted((b.fileName, b.channel_id, b.burst_id, b.spike_count, b.start_time_s, b.end_time_s) for b in found)
    assert got == sorted(w[:6] for w in want) and got
    means = {(b.fileName, b.channel_id, b.burst_id): b.isi_mean for b in found}
    assert all(close(means[w[:3]], w[6]) for w in want)
    # Labels, and what always has to hold.
    labelled = bursts.label_spikes(spikes, layout, 50, least, longest).orderBy("seq").collect()
    place = {}
    for r in labelled:
        k = place.setdefault((r.fileName, r.channel_id), itertools.count())
        assert r.burst_id == labels.get((r.fileName, r.channel_id, next(k)))
    assert sum(b.spike_count for b in found) == sum(r.burst_id is not None for r in labelled)


def test_a_run_over_many_slices(spark, settings):
    """One burst holds most rows of one channel and crosses every cut of it."""
    settings(ROWS_PER_SLICE_CONF, 10)
    rows = [("a", 21, i / 100, None if i == 0 else 10.0) for i in range(200)] + [("a", 21, 9.0, 7010.0), ("b", 21, 1.0, None)]
    spikes, layout = spike_table(spark, rows)
    found = bursts.find_bursts(spikes, layout).collect()
    assert [(b.burst_id, b.spike_count, b.start_time_s, b.end_time_s) for b in found] == [(1, 200, 0.0, 1.99)]
    labelled = bursts.label_spikes(spikes, layout)
    assert labelled.where("burst_id = 1").count() == 200 and labelled.where("burst_id is null").count() == 2


def test_interval_between_bursts(spark, cut):
    rows = random_rows(seed=11)
    spikes, layout = spike_table(spark, rows)
    want, _ = loop_bursts(rows, 50, 3)
    gaps = {}
    for _, group in itertools.groupby(sorted(want), key=lambda w: w[:2]):
        group = list(group)
        gaps.setdefault(group[0][0], []).extend(b[4] - a[5] for a, b in zip(group, group[1:]))
    found = bursts.find_bursts(spikes, layout, 50, 3)
    stats = {r.fileName: r for r in features.burst_statistics(found, layout).collect()}
    assert set(stats) == {w[0] for w in want}
    for file, row in stats.items():
        assert close(row.ibi_mean, math.fsum(gaps[file]) / len(gaps[file])) and min(gaps[file]) >= 0
        per_channel = [sum(w[:2] == (file, c) for w in want) / 300 / 60 for c in {w[1] for w in want if w[0] == file}]
        assert close(row.burstRate_mean, math.fsum(per_channel) / len(per_channel))


def test_positional_intervals_equal_the_growing_vector(spark, cut):
    # Few spikes per channel: the vector is shorter than the channel number and gets padded.
    rows = random_rows(seed=3, files=4, channels=6, most=3) + random_rows(seed=4, files=1, channels=5, most=20)
    rows = [r for r in rows if r[0] != "file_0"] + [("file_9",) + r[1:] for r in rows if r[0] == "file_0"]
    rows.sort(key=lambda r: r[0])
    spikes, layout = spike_table(spark, rows)
    want = loop_positional(rows)
    got = {r.fileName: r for r in features.positional_isi(spikes, layout).collect()}
    assert set(got) == set(want)
    for file, (mean, sd) in want.items():
        assert close(got[file].isi_mean, mean) and close(got[file].isi_sd, sd)


def test_similarity_equals_all_pairs(spark, cut):
    rows = random_rows(seed=5, most=30, short=0.2)
    spikes, layout = spike_table(spark, rows)
    want = loop_similarity(rows)
    got = {(r.fileName, r.ref_channel, r.comp_channel): r.value for r in similarity.channel_similarity(spikes, layout).collect()}
    assert set(got) == set(want)
    assert all(close(got[k], want[k], 1e-7) for k in want)


def test_similarity_of_odd_times(spark, cut):
    # Equal times, neighbouring numbers, an event half way, channels of one event, missing times and channels.
    up = math.nextafter(1.0, 2.0)
    times = {12: [1.0, 1.0, up, 3.0, 3.0], 13: [2.0, up], 87: [2.0], 14: [1.0, up, 3.0] * 4}
    rows = [("a", c, t, None) for c, ts in times.items() for t in ts] + [("b", 12, 5.0, None)]
    spikes, layout = spike_table(spark, rows + [("a", 12, None, None), ("b", 15, None, None), ("a", None, 9.0, None)])
    got = {(r.fileName, r.ref_channel, r.comp_channel): r.value for r in similarity.channel_similarity(spikes, layout).collect()}
    want = {("a", a, b): sum(min((t - u) ** 2 for u in times[b]) for t in times[a]) for a in times for b in times}
    want[("b", 12, 12)] = 0.0
    # Half way is rounded; a channel that is matched event by event still has exactly 0.
    assert set(got) == set(want) and all(close(got[k], want[k]) and (got[k] == 0) == (want[k] == 0) for k in want)
    none = spikes.where("false")
    assert similarity.channel_similarity(none, Layout.measure(none)).count() == 0


@pytest.mark.parametrize("width", [0.05, 5.0])
def test_spike_synchrony_equals_the_bins(spark, cut, width):
    rows = random_rows(seed=6, channels=3)
    spikes, layout = spike_table(spark, rows)
    got = {r.seq: r for r in synchrony.label_sync_spikes(spikes, layout, width).collect()}
    assert len(got) == len(rows)
    first = {}
    for r in rows:
        first[r[0]] = min(first.get(r[0], r[2]), r[2])
    bins = {}
    for r in rows:
        bins.setdefault((r[0], math.floor((r[2] - first[r[0]]) / width)), set()).add(r[1])
    numbers = {}
    for file in first:
        events = sorted(b for f, b in bins if f == file and len(bins[(f, b)]) > 1)
        numbers |= {(file, b): n for n, b in enumerate(events, 1)}
    assert numbers
    for i, r in enumerate(rows):
        place = (r[0], math.floor((r[2] - first[r[0]]) / width))
        assert got[i + 1].window_bin == place[1] and got[i + 1].syncspike_id == numbers.get(place)


def _rates(spark, a, b):
    rows = [(f"{g}{i}", g, 21, float(x)) for g, xs in (("WT", a), ("KO", b)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "fileName string, genotype string, channel_id int, Hz double")


def _gap(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in [*a, *b])


@pytest.mark.parametrize("a,b", [([1, 2, 3, 4], [3, 5, 6]), ([1, 1, 2, 2, 3], [2, 3, 3, 4]), ([1, 2], [1, 2]), ([1, 2, 3], [7, 8, 9])])
def test_exact_ks_counts_all_orders(spark, cut, a, b):
    row = distributions.ks_test(_rates(spark, a, b), method="exact").first()
    pooled, d = a + b, _gap(a, b)
    picks = list(itertools.combinations(range(len(pooled)), len(a)))
    as_far = 0
    for pick in picks:
        left = [pooled[i] for i in pick]
        right = [pooled[i] for i in range(len(pooled)) if i not in pick]
        as_far += _gap(left, right) >= d - 1e-12
    assert close(row.D, d) and close(row.p_value, as_far / len(picks))


def test_exact_ks_of_large_samples(spark):
    """The work follows the band below D: hundreds of thousands of rates, against the limit for large samples."""
    n = 100_000
    hz = F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") * 1.004 + 0.4).cast("double")
    rates = spark.range(2 * n).select(
        F.col("id").cast("string").alias("fileName"), F.when(F.col("id") % 2 == 0, "WT").otherwise("KO").alias("genotype"),
        F.lit(21).alias("channel_id"), hz.alias("Hz"))
    exact, limit = (distributions.ks_test(rates, method=m).first() for m in ("exact", "asymptotic"))
    assert (exact.n, exact.m, exact.D) == (n, n, limit.D) and 0.1 < exact.p_value < 0.9
    assert close(exact.p_value, limit.p_value, 0.01)



def test_ks_without_a_second_group(spark):
    row = distributions.ks_test(_rates(spark, [1, 2, 3], [])).first()
    assert row.n == 3 and row.m == 0 and row.D is None and row.p_value is None


def test_ecdf_equals_the_fraction(spark, cut):
    a, b = [1, 2, 2, 3, 50, 0.01, 7, 7, 7], [4, 4]
    for r in distributions.ecdf(_rates(spark, a, b)).collect():
        xs = a if r.genotype == "WT" else b
        assert close(r.ecdf, sum(x <= r.Hz for x in xs) / len(xs)) and r.n == xs.count(r.Hz)


def test_p_values_against_tables(spark):
    # Two-sided points of the Student distribution and points of the Kolmogorov one.
    table = [(2.228139, 10.0, 0.05), (12.706205, 1.0, 0.05), (3.169273, 10.0, 0.01), (1.959964, 1e7, 0.05), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5)]
    df = spark.createDataFrame(table + [(None, 3.0, None)], "t double, df double, p double")
    for r in df.withColumn("got", student_p_value(df.t, df.df)).collect():
        assert close(r.got, r.p, 2e-5), r
    points = spark.createDataFrame([(1.358, 0.05), (1.628, 0.01), (0.828, 0.5), (0.3, 0.99999)], "z double, p double")
    n = 10**6
    d = points.z / math.sqrt(n / 2)
    from pyspark.sql import functions as F
    for r in points.withColumn("got", kolmogorov_p_value(d, F.lit(n), F.lit(n))).collect():
        assert close(r.got, r.p, 5e-3), r


def test_proportions_stay_in_range(spark):
    rows = random_rows(seed=8)
    spikes, layout = spike_table(spark, rows)
    from spikeframe.operators.channels import stamp_channel_counts
    spikes = stamp_channel_counts(spikes, layout)
    summary = features.burst_features(features.spike_features(spikes, layout), bursts.find_bursts(spikes, layout), layout)
    for r in features.norm_prop(summary).collect():
        assert 0 <= r.activeChannels_PROP2totalChannels <= 1 and 0 <= r.burst_spikes_PROP2totalSpikes <= 1
        assert r.spike_n == sum(row[0] == r.fileName for row in rows)
        assert r.totalChannels == len({k for k in by_channel(rows) if k[0] == r.fileName})
    assert set(schemas.SPIKE_FEATURES) < set(summary.columns)
