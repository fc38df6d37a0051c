"""DuckDB statements that give the results of the registered queries.

Written from the definitions, not from the Spark plans: brute force where that
is the shorter definition. Doubles are rounded as the queries round them.
"""

from __future__ import annotations

from spikeframe.schemas import (
    BURST_FEATURES, GRID_CORNERS, SPIKE_FEATURES, SYNCBURST_FEATURES, SYNCSPIKE_FEATURES,
)

BASE = """
ev AS (
  SELECT event_id AS seq, epoch_us(ts) - 1704067200000000 AS us, user_id // 10 AS rec, user_id % 10 AS c FROM events),
raw AS (
  SELECT printf('rec_%03d', rec) AS fileName, CASE WHEN rec % 2 = 0 THEN 'WT' ELSE 'KO' END AS genotype,
         CAST(21 + 10 * (c % 6) + c // 6 AS INTEGER) AS channel_id, CAST(300 AS DOUBLE) AS maxRecording, seq,
         us / 8.64e9 AS s, (us - lag(us) OVER (PARTITION BY rec, c ORDER BY us, seq)) / 8.64e6 AS isi
  FROM ev),
per_channel AS (SELECT fileName, channel_id, count(*) AS n FROM raw GROUP BY ALL),
totals AS (
  SELECT fileName, CAST(count(*) AS INTEGER) AS totalChannels,
         CAST(count(*) FILTER (n / CAST(300 AS DOUBLE) >= 0.01) AS INTEGER) AS activeChannels
  FROM per_channel GROUP BY ALL),
spikes AS (
  SELECT fileName, genotype, totalChannels, activeChannels, channel_id, maxRecording, seq, s, isi,
         CAST(1000 AS DOUBLE) / isi AS frequency
  FROM raw JOIN totals USING (fileName)),
meta AS (
  SELECT 'a' || rec AS animalID, printf('rec_%03d', rec) AS fileName,
         CASE WHEN rec % 2 = 0 THEN 'WT' ELSE 'KO' END AS genotype, CAST(300 AS DOUBLE) AS maxRecording,
         CASE WHEN rec % 7 = 3 THEN 'YES' END AS exclude,
         CASE WHEN rec % 4 = 1 THEN '21,52' END AS channels2exclude,
         CASE WHEN rec % 5 = 4 THEN 'NA' ELSE 'SSC' END AS region,
         CASE WHEN rec % 6 <> 5 THEN '21,31,41' END AS upperLayerChannels,
         CASE WHEN rec % 8 = 2 THEN 'YES' END AS hasHP, rec
  FROM (SELECT DISTINCT rec FROM ev))"""

RECORDING = "fileName, genotype, maxRecording, totalChannels, activeChannels"
SPIKES = f"""fileName, genotype, totalChannels, activeChannels, channel_id, maxRecording, seq,
  round(s, 6) AS s, round(isi, 6) AS isi, round(frequency, 6) AS frequency"""
INTEGERS = {
    "spike_n", "burst_n", "burst_spikes_total", "syncburst_countNEW", "syncburst_bursts_totalNEW",
    "syncburst_channels_min", "syncburst_channels_max", "syncburst_spikes_total",
    "syncspike_count", "syncspike_spikes_total", "syncspike_channels_min", "syncspike_channels_max",
}


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(
        f"CAST({n} AS BIGINT) AS {n}" if n in INTEGERS else f"round({n}, {digits}) AS {n}" for n in names)


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *[c.strip() for c in ctes]]) + "\n" + select.strip()


def _runs(threshold: float, source: str = "spikes") -> str:
    return f"""
runs AS (
  SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (
           PARTITION BY fileName, channel_id ORDER BY s, seq ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, coalesce(isi < {threshold} AND isi > 0, false) AS flag FROM {source}))"""


def _bursts(threshold: float, n: int = 5, longest: float | None = None, source: str = "spikes") -> str:
    cap = f" AND max(s) - min(s) < {longest}" if longest else ""
    return _runs(threshold, source) + f""",
bursts AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY fileName, channel_id ORDER BY start_time_s) AS INTEGER) AS burst_id
  FROM (
    SELECT {RECORDING}, channel_id, run, count(*) AS spike_count,
           avg(isi) FILTER (flag) AS isi_mean, stddev_samp(isi) FILTER (flag) AS isi_sd,
           min(s) AS start_time_s, max(s) AS end_time_s, max(s) - min(s) AS duration_s
    FROM runs GROUP BY ALL HAVING count(*) FILTER (flag) >= {n - 1}{cap}))"""


BURST_COLUMNS = ("fileName, genotype, totalChannels, activeChannels, channel_id, burst_id, maxRecording, spike_count, "
                 + _rounded("isi_mean", "start_time_s", "end_time_s", "duration_s"))

LABELLED = """
labelled AS (
  SELECT r.*, b.burst_id FROM runs r LEFT JOIN bursts b USING (fileName, channel_id, run))"""


def _spike_summary(source: str = "spikes") -> str:
    return f"""
rates AS (
  SELECT {RECORDING}, channel_id, count(*) / maxRecording AS rate FROM {source} GROUP BY {RECORDING}, channel_id),
rate_summary AS (
  SELECT fileName, avg(rate) AS spikeRate_mean, stddev_samp(rate) AS spikeRate_sd FROM rates GROUP BY ALL),
spike_summary AS (
  SELECT {RECORDING}, count(*) AS spike_n, count(*) / maxRecording AS sliceSpikeRate,
         any_value(spikeRate_mean) AS spikeRate_mean, any_value(spikeRate_sd) AS spikeRate_sd,
         avg(isi) FILTER (isi > 0) AS isi_mean, stddev_samp(isi) FILTER (isi > 0) AS isi_sd
  FROM {source} JOIN rate_summary USING (fileName) GROUP BY {RECORDING})"""


_ZEROED = ", ".join(f"CASE WHEN b.burst_n IS NULL THEN 0 ELSE b.{n} END AS {n}" for n in BURST_FEATURES)
BURST_SUMMARY = f"""
channel_bursts AS (
  SELECT fileName, channel_id, count(*) / maxRecording / 60 AS rate FROM bursts GROUP BY fileName, channel_id, maxRecording),
channel_rates AS (
  SELECT fileName, avg(rate) AS burstRate_mean, stddev_samp(rate) AS burstRate_sd FROM channel_bursts GROUP BY ALL),
gaps AS (
  SELECT fileName, lead(start_time_s) OVER (PARTITION BY fileName, channel_id ORDER BY start_time_s) - end_time_s AS ibi
  FROM bursts),
gap_summary AS (SELECT fileName, avg(ibi) AS ibi_mean, stddev_samp(ibi) AS ibi_sd FROM gaps GROUP BY ALL),
burst_stats AS (
  SELECT fileName, count(*) AS burst_n,
         CASE WHEN count(isi_mean) = count(*) THEN avg(isi_mean) END AS isi_inBurst_mean,
         CASE WHEN count(isi_sd) = count(*) THEN avg(isi_sd) END AS isi_inBurst_sd,
         sum(spike_count) AS burst_spikes_total, avg(spike_count) AS burst_spikes_mean,
         stddev_samp(spike_count) AS burst_spikes_sd,
         avg(spike_count / duration_s) AS spikeRate_inBurst_mean,
         stddev_samp(spike_count / duration_s) AS spikeRate_inBurst_sd,
         avg(duration_s) AS burst_dur_mean, stddev_samp(duration_s) AS burst_dur_sd
  FROM bursts GROUP BY ALL),
burst_all AS (
  SELECT * FROM burst_stats JOIN channel_rates USING (fileName) JOIN gap_summary USING (fileName)),
burst_summary AS (
  SELECT s.*, {_ZEROED} FROM spike_summary s LEFT JOIN burst_all b USING (fileName))"""

NORM_COLUMNS = [
    "spike_n_NORM", "burst_n_NORM", "activeChannels_PROP2totalChannels", "burst_spikes_PROP2totalSpikes",
]
NORM = """
norm AS (
  SELECT *, spike_n / nullif(CAST(activeChannels AS DOUBLE), 0) AS spike_n_NORM,
         burst_n / nullif(CAST(activeChannels AS DOUBLE), 0) AS burst_n_NORM,
         activeChannels / nullif(CAST(totalChannels AS DOUBLE), 0) AS activeChannels_PROP2totalChannels,
         burst_spikes_total / nullif(CAST(spike_n AS DOUBLE), 0) AS burst_spikes_PROP2totalSpikes
  FROM burst_summary)"""


def _sync_bursts(width: float) -> str:
    return f"""
binned_bursts AS (
  SELECT b.*, CAST(floor((start_time_s - first_s) / CAST({width} AS DOUBLE)) AS BIGINT) AS window_bin
  FROM bursts b JOIN (SELECT fileName, min(start_time_s) AS first_s FROM bursts GROUP BY ALL) USING (fileName)),
burst_events AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY fileName ORDER BY window_bin) AS INTEGER) AS syncburst_id
  FROM (
    SELECT fileName, genotype, window_bin, count(*) AS bursts_n,
           CAST(count(DISTINCT channel_id) AS INTEGER) AS channels_n, min(start_time_s) AS start_s,
           arg_max(end_time_s, start_time_s) AS end_s, CAST(sum(spike_count) AS BIGINT) AS spikes_n
    FROM binned_bursts GROUP BY ALL HAVING count(*) > 1)),
burst_sync AS (
  SELECT fileName, count(*) AS syncburst_countNEW, sum(bursts_n) AS syncburst_bursts_totalNEW,
         avg(bursts_n) AS syncburst_bursts_meanNEW,
         coalesce(avg(channels_n) FILTER (channels_n > 1), 0) AS syncburst_channels_mean,
         coalesce(min(channels_n) FILTER (channels_n > 1), 0) AS syncburst_channels_min,
         coalesce(max(channels_n) FILTER (channels_n > 1), 0) AS syncburst_channels_max,
         avg(end_s - start_s) AS syncburst_bursts_duration_mean,
         stddev_samp(end_s - start_s) AS syncburst_bursts_duration_sd,
         sum(spikes_n) AS syncburst_spikes_total, avg(spikes_n) AS syncburst_spikes_mean
  FROM burst_events GROUP BY ALL)"""


def _sync_spikes(width: float, prop: float = 0.01) -> str:
    return f"""
binned_spikes AS (
  SELECT p.*, CAST(floor((s - first_s) / CAST({width} AS DOUBLE)) AS BIGINT) AS window_bin
  FROM spikes p JOIN (SELECT fileName, min(s) AS first_s FROM spikes GROUP BY ALL) USING (fileName)),
spike_events AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY fileName ORDER BY window_bin) AS INTEGER) AS syncspike_id
  FROM (
    SELECT fileName, window_bin, count(*) AS spikes_n, CAST(count(DISTINCT channel_id) AS INTEGER) AS channels_n
    FROM binned_spikes GROUP BY fileName, window_bin, activeChannels
    HAVING count(DISTINCT channel_id) > 1 AND count(DISTINCT channel_id) >= CAST({prop} AS DOUBLE) * activeChannels)),
spike_sync AS (
  SELECT fileName, count(*) AS syncspike_count, sum(spikes_n) AS syncspike_spikes_total,
         avg(spikes_n) AS syncspike_spikes_mean, avg(channels_n) AS syncspike_channels_mean,
         min(channels_n) AS syncspike_channels_min, max(channels_n) AS syncspike_channels_max
  FROM spike_events GROUP BY ALL)"""


def _completed(names: list[str], alias: str, marker: str) -> str:
    return ", ".join(f"CASE WHEN {alias}.{marker} IS NULL THEN 0 ELSE {alias}.{n} END AS {n}" for n in names)


SYNC_RATIOS = {
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
SUMMARY_COLUMNS = ["maxRecording", "totalChannels", "activeChannels", *SPIKE_FEATURES, *BURST_FEATURES, *NORM_COLUMNS]
LONG = "long AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT fileName, genotype, '{n}' AS variable, {i} AS position, CAST({n} AS DOUBLE) AS value FROM norm"
    for i, n in enumerate(SUMMARY_COLUMNS)) + ")"
GROUPED = """
grouped AS (
  SELECT variable, position, genotype, count(*) AS n,
         CASE WHEN count(value) = count(*) THEN avg(value) END AS mean,
         CASE WHEN count(value) = count(*) THEN stddev_samp(value) / sqrt(count(*)) END AS sem
  FROM long WHERE variable <> 'maxRecording' GROUP BY ALL)"""
WELCH = """
sides AS (
  SELECT variable, position, CASE WHEN lower(genotype) LIKE '%wt%' THEN 'WT' ELSE 'GM' END AS side, value
  FROM long WHERE variable <> 'maxRecording'),
by_side AS (
  SELECT variable, position, side, count(value) AS n, avg(value) AS m, var_samp(value) AS v,
         CASE WHEN count(value) = count(*) THEN avg(value) END AS mean,
         CASE WHEN count(value) = count(*) THEN stddev_samp(value) / sqrt(count(*)) END AS sem
  FROM sides GROUP BY ALL),
welch AS (
  SELECT variable, position, w.mean AS WT_mean, w.sem AS WT_sem, g.mean AS GM_mean, g.sem AS GM_sem,
         CASE WHEN w.n > 1 AND g.n > 1 AND sqrt(w.v / w.n + g.v / g.n) > 0
               AND sqrt(w.v / w.n + g.v / g.n) >= 10 * 2.220446049250313e-16 * greatest(abs(w.m), abs(g.m))
              THEN abs(w.m - g.m) / sqrt(w.v / w.n + g.v / g.n) END AS t,
         CASE WHEN w.n > 1 AND g.n > 1 AND sqrt(w.v / w.n + g.v / g.n) > 0
               AND sqrt(w.v / w.n + g.v / g.n) >= 10 * 2.220446049250313e-16 * greatest(abs(w.m), abs(g.m))
              THEN pow(w.v / w.n + g.v / g.n, 2)
                   / (pow(w.v / w.n, 2) / (w.n - 1) + pow(g.v / g.n, 2) / (g.n - 1)) END AS df
  FROM (SELECT * FROM by_side WHERE side = 'WT') w FULL JOIN (SELECT * FROM by_side WHERE side = 'GM') g
  USING (variable, position))"""


def _channel_hz(table: str) -> str:
    return f"""
hz AS (
  SELECT fileName, genotype, channel_id, count(*) / maxRecording AS Hz FROM {table} WHERE genotype <> 'NA'
  GROUP BY fileName, genotype, channel_id, maxRecording)"""


KS = """
steps AS (
  SELECT Hz, sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb,
         sum(a) OVER () AS n, sum(b) OVER () AS m
  FROM (SELECT Hz, CAST(count(*) FILTER (genotype = 'WT') AS DOUBLE) AS a,
               CAST(count(*) FILTER (genotype = 'KO') AS DOUBLE) AS b FROM hz GROUP BY ALL)
  WINDOW w AS (ORDER BY Hz ROWS UNBOUNDED PRECEDING)),
ks AS (
  SELECT 'WT - KO' AS pair, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, max(abs(fa - fb)) AS D FROM steps)"""


def _similarity(table: str, time: str) -> str:
    return f"""
points AS (SELECT fileName, channel_id, {time} AS t FROM {table}),
nearest AS (
  SELECT a.fileName, a.channel_id AS ref_channel, a.t, b.channel_id AS comp_channel, min((a.t - b.t) * (a.t - b.t)) AS d
  FROM points a JOIN points b ON a.fileName = b.fileName
  GROUP BY a.fileName, a.channel_id, a.t, b.channel_id),
similarity AS (
  SELECT fileName, ref_channel, comp_channel, sum(d) AS value FROM nearest GROUP BY ALL),
sim_log AS (SELECT *, log2(value) AS value_log FROM similarity WHERE value <> 0),
sim_sym AS (
  SELECT a.fileName, a.ref_channel, a.comp_channel, (a.value + b.value) / 2 AS mean_value,
         (a.value_log + b.value_log) / 2 AS mean_value_log
  FROM sim_log a JOIN sim_log b
    ON a.fileName = b.fileName AND a.ref_channel = b.comp_channel AND a.comp_channel = b.ref_channel
  WHERE a.comp_channel > a.ref_channel)"""


GRID = f"""
grid AS (
  SELECT CAST(10 * x + y AS INTEGER) AS channel_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y
  FROM range(1, 9) a(x), range(1, 9) b(y) WHERE 10 * x + y NOT IN {GRID_CORNERS})"""


def statements() -> dict[str, str]:
    dense, sparse = _bursts(2500), _bursts(1000)
    summary = (_spike_summary(), BURST_SUMMARY)
    feature_columns = f"{RECORDING}, " + _rounded(*SPIKE_FEATURES, *BURST_FEATURES)
    sync_burst_select = f"""
      SELECT s.fileName, {_completed(SYNCBURST_FEATURES, 'b', 'syncburst_countNEW')}
      FROM spike_summary s LEFT JOIN burst_sync b USING (fileName)"""
    sync_all = f"""
synced AS (
  SELECT n.*, {_completed(SYNCBURST_FEATURES, 'b', 'syncburst_countNEW')},
         {_completed(SYNCSPIKE_FEATURES, 'p', 'syncspike_count')}
  FROM norm n LEFT JOIN burst_sync b USING (fileName) LEFT JOIN spike_sync p USING (fileName))"""
    sync_ratios = ", ".join(
        f"round({a} / nullif(CAST({b} AS DOUBLE), 0), 6) AS {n}" for n, (a, b) in SYNC_RATIOS.items())

    def feature_part(*names):
        return _sql(f"SELECT fileName, {_rounded(*names)} FROM burst_summary", sparse, *summary)

    def windowed(step, per):
        return _sql(f"""
SELECT fileName, channel_id, CAST(channel_id // 10 AS INTEGER) AS x, CAST(channel_id % 10 AS INTEGER) AS y,
       round(w * CAST({step} AS DOUBLE), 6) AS from_s, count(*) AS spikes, count(DISTINCT burst_id) AS bursts
FROM (SELECT *, unnest(range(greatest(CAST(floor(s / CAST({step} AS DOUBLE)) AS BIGINT) - {per - 1}, 0),
                             CAST(floor(s / CAST({step} AS DOUBLE)) AS BIGINT) + 1)) AS w FROM labelled)
GROUP BY fileName, channel_id, w""", dense, LABELLED)

    out = {
        # sources
        "meta_scan": _sql("SELECT * EXCLUDE (rec) FROM meta"),
        "meta_tidy": _sql("""SELECT animalID, fileName, genotype, maxRecording, exclude, channels2exclude
                             FROM meta WHERE rec % 9 <> 8"""),
        "ingest_text": _sql(f"""SELECT {SPIKES.replace('seq,', '')},
            row_number() OVER (PARTITION BY fileName, channel_id ORDER BY s) AS nth FROM spikes"""),
        "spikes_with_meta": _sql("""
SELECT s.fileName, m.genotype, m.maxRecording, m.region, s.channel_id, s.seq, round(s.s, 6) AS s, round(s.isi, 6) AS isi
FROM spikes s JOIN meta m USING (fileName)"""),
        "channel_totals": _sql("SELECT * FROM totals"),
        "layer_tag": _sql("""
SELECT fileName, channel_id, seq, CASE WHEN upperLayerChannels IS NULL THEN NULL
       WHEN list_contains(string_split(upperLayerChannels, ','), CAST(channel_id AS VARCHAR)) THEN 'upper'
       ELSE 'lower' END AS layer FROM spikes JOIN meta USING (fileName)"""),
        "compile_summaries": " UNION ALL ".join(
            f"(SELECT '{i}' AS index, * FROM ({_sql(f'SELECT {feature_columns} FROM burst_summary', _bursts(t), *summary)}))"
            for i, t in (("P5", 1000), ("P15", 1500), ("P60", 2500))),
        # filters
        "sample_filter": _sql(f"""SELECT {SPIKES} FROM spikes WHERE fileName NOT IN
            (SELECT fileName FROM meta WHERE exclude IS NOT NULL)"""),
        "sample_filter_flag": _sql(f"""SELECT {SPIKES} FROM spikes WHERE fileName NOT IN
            (SELECT fileName FROM meta WHERE exclude = 'YES' OR hasHP = 'YES')"""),
        "region_filter": _sql(f"SELECT {SPIKES} FROM spikes JOIN (SELECT fileName, region FROM meta) USING (fileName) WHERE region <> 'NA'"),
        "layer_filter": _sql("""
SELECT fileName, CAST(n AS INTEGER) AS totalChannels, CAST(act AS INTEGER) AS activeChannels, channel_id, seq,
       round(s, 6) AS s
FROM upper_spikes JOIN (
  SELECT fileName, count(*) AS n, count(*) FILTER (k / CAST(300 AS DOUBLE) >= 0.01) AS act
  FROM (SELECT fileName, channel_id, count(*) AS k FROM upper_spikes GROUP BY ALL) GROUP BY ALL) USING (fileName)""", """
upper_spikes AS (
  SELECT s.* FROM spikes s JOIN meta m USING (fileName)
  WHERE upperLayerChannels IS NOT NULL AND channel_id IN (21, 31, 41))"""),
        "length_filter": _sql(f"SELECT {SPIKES.replace('maxRecording,', 'CAST(200 AS DOUBLE) AS maxRecording,')} FROM spikes WHERE s <= 200"),
        "channel_filter": _sql(f"""SELECT {SPIKES} FROM spikes JOIN
            (SELECT fileName, channels2exclude FROM meta) USING (fileName)
            WHERE channels2exclude IS NULL OR channel_id NOT IN (21, 52)"""),
        "interval_filter": _sql(f"SELECT {SPIKES} FROM spikes WHERE s > 100 AND s < 200"),
        # bursts
        "isi_flag": _sql("SELECT fileName, channel_id, seq, flag AS isiThreshold FROM runs", _runs(2500)),
        "spike_runs": _sql("SELECT fileName, channel_id, seq, flag AS isiThreshold, CAST(run AS BIGINT) AS run FROM runs", _runs(2500)),
        "bursts": _sql(f"SELECT {BURST_COLUMNS} FROM bursts", dense),
        "bursts_max_duration": _sql(f"SELECT {BURST_COLUMNS} FROM bursts", _bursts(2500, longest=5)),
        "spikes_labelled": _sql(f"SELECT {SPIKES}, flag AS isiThreshold, burst_id FROM labelled", dense, LABELLED),
        # spike features
        "spike_counts": _sql(f"SELECT fileName, genotype, {_rounded('spike_n', 'sliceSpikeRate')} FROM spike_summary", _spike_summary()),
        "spike_rates": _sql(f"SELECT fileName, genotype, {_rounded('spikeRate_mean', 'spikeRate_sd')} FROM spike_summary", _spike_summary()),
        "isi_pooled": _sql(f"SELECT fileName, genotype, {_rounded('isi_mean', 'isi_sd')} FROM spike_summary", _spike_summary()),
        "isi_positional": _sql("""
SELECT fileName, round(avg(value), 6) AS isi_mean, round(stddev_samp(value), 6) AS isi_sd
FROM (SELECT p.fileName, coalesce(m.mean, p.isi) AS value FROM placed p LEFT JOIN means m
      ON p.fileName = m.fileName AND p.place = m.j)
GROUP BY fileName""", """
ord AS (
  SELECT channel_id, row_number() OVER (ORDER BY fileName, seq) AS j
  FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY fileName, seq) AS k FROM spikes) WHERE k = 1),
placed AS (
  SELECT fileName, j, isi, row_number() OVER (PARTITION BY fileName ORDER BY j, s, seq) AS place
  FROM spikes JOIN ord USING (channel_id) WHERE isi > 0),
means AS (SELECT fileName, j, avg(isi) AS mean FROM placed GROUP BY ALL)"""),
        "spike_features": _sql(f"SELECT {RECORDING}, {_rounded(*SPIKE_FEATURES)} FROM spike_summary", _spike_summary()),
        # burst features
        "burst_counts": feature_part("burst_n"),
        "isi_in_burst": feature_part("isi_inBurst_mean", "isi_inBurst_sd"),
        "burst_spikes": feature_part("burst_spikes_total", "burst_spikes_mean", "burst_spikes_sd"),
        "burst_spike_rate": feature_part("spikeRate_inBurst_mean", "spikeRate_inBurst_sd"),
        "burst_rate": feature_part("burstRate_mean", "burstRate_sd"),
        "burst_rate_filtered": _sql("""
SELECT s.fileName, CAST(coalesce(sum(n), 0) AS BIGINT) AS burst_n, round(CASE WHEN sum(n) IS NULL THEN 0 ELSE avg(n / maxRecording / 60) END, 6) AS burstRate_mean,
       round(CASE WHEN sum(n) IS NULL THEN 0 ELSE stddev_samp(n / maxRecording / 60) END, 6) AS burstRate_sd
FROM (SELECT DISTINCT fileName FROM spikes) s
LEFT JOIN (SELECT fileName, channel_id, maxRecording, count(*) AS n FROM bursts WHERE spike_count >= 6 GROUP BY ALL) USING (fileName)
GROUP BY s.fileName""", dense),
        "burst_duration": feature_part("burst_dur_mean", "burst_dur_sd"),
        "inter_burst_interval": feature_part("ibi_mean", "ibi_sd"),
        "burst_features": _sql(f"SELECT {feature_columns} FROM burst_summary", dense, *summary),
        "burst_features_sparse": _sql(f"SELECT {feature_columns} FROM burst_summary", sparse, *summary),
        # synchrony
        "syncburst_bins": _sql("""SELECT b.fileName, channel_id, burst_id, window_bin, syncburst_id
            FROM binned_bursts b LEFT JOIN burst_events e USING (fileName, window_bin)""", dense, _sync_bursts(5)),
        "syncburst_events": _sql("""SELECT fileName, genotype, window_bin, syncburst_id, bursts_n, channels_n,
            round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, spikes_n FROM burst_events""", dense, _sync_bursts(5)),
        "syncspike_events": _sql("SELECT * FROM spike_events", _sync_spikes(0.1)),
        "syncspike_features": _sql(f"SELECT fileName, {_rounded(*SYNCSPIKE_FEATURES)} FROM (SELECT s.fileName, "
                                   f"{_completed(SYNCSPIKE_FEATURES, 'p', 'syncspike_count')} FROM spike_summary s "
                                   "LEFT JOIN spike_sync p USING (fileName))", _spike_summary(), _sync_spikes(0.1)),
        "syncspike_features_narrow": _sql(f"SELECT fileName, {_rounded(*SYNCSPIKE_FEATURES)} FROM (SELECT s.fileName, "
                                          f"{_completed(SYNCSPIKE_FEATURES, 'p', 'syncspike_count')} FROM spike_summary s "
                                          "LEFT JOIN spike_sync p USING (fileName))", _spike_summary(), _sync_spikes(0.01, 0.15)),
        "syncspike_labels": _sql("""SELECT fileName, channel_id, seq, window_bin, syncspike_id
            FROM binned_spikes LEFT JOIN spike_events USING (fileName, window_bin)""", _sync_spikes(0.1)),
        # normalisation
        "norm_prop": _sql(f"SELECT fileName, {_rounded(*NORM_COLUMNS)} FROM norm", sparse, *summary, NORM),
        "norm_prop_sync": _sql(f"SELECT fileName, {sync_ratios} FROM synced",
                               dense, *summary, NORM, _sync_bursts(5), _sync_spikes(0.1), sync_all),
        # groups
        "feature_long": _sql("SELECT fileName, genotype, variable, position, round(value, 6) AS value FROM long",
                             dense, *summary, NORM, LONG),
        "group_means": _sql(f"SELECT variable, position, genotype, n, {_rounded('mean', 'sem')} FROM grouped",
                            dense, *summary, NORM, LONG, GROUPED),
        "group_error_bounds": _sql("SELECT variable, genotype, round(mean - sem, 6) AS ymin, round(mean + sem, 6) AS ymax FROM grouped",
                                   dense, *summary, NORM, LONG, GROUPED),
        "welch_t": _sql(f"SELECT variable, {_rounded('WT_mean', 'WT_sem', 'GM_mean', 'GM_sem', 't', 'df', digits=5)} FROM welch",
                        dense, *summary, NORM, LONG, WELCH),
        # The p-value by Simpson's rule over the density of the Student distribution.
        "bi_summary": _sql(f"""
SELECT variable AS Variable, {_rounded('WT_mean', 'WT_sem', 'GM_mean', 'GM_sem')}, round(t, 2) AS T_stat,
       round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 12000
         * list_sum(list_transform(range(0, 4001), lambda i:
             (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
             * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2))), 4) AS P_value
FROM welch""", dense, *summary, NORM, LONG, WELCH),
        "multi_summary": _sql("SELECT variable, " + ", ".join(
            f"round(max(mean) FILTER (genotype = '{g}'), 6) AS {g}_mean, round(max(sem) FILTER (genotype = '{g}'), 6) AS {g}_sem, "
            f"max(n) FILTER (genotype = '{g}') AS {g}_n" for g in ("WT", "KO")) + " FROM grouped GROUP BY variable",
            dense, *summary, NORM, LONG, GROUPED),
        "multi_summary_all": _sql("SELECT variable, " + ", ".join(
            f"round(max(mean) FILTER (genotype = '{g}'), 6) AS {g}_mean, round(max(sem) FILTER (genotype = '{g}'), 6) AS {g}_sem, "
            f"max(n) FILTER (genotype = '{g}') AS {g}_n" for g in ("HET", "KO", "WT")) + " FROM grouped GROUP BY variable",
            dense, *summary, NORM.replace("norm AS", "two AS") + """,
norm AS (SELECT * REPLACE (CASE WHEN CAST(substr(fileName, 5) AS BIGINT) % 3 = 2 THEN 'HET' ELSE genotype END AS genotype) FROM two)""",
            LONG, GROUPED),
        "multi_summary_vs_wt": _sql("""
SELECT variable, genotype, WT_n, round(WT_mean, 4) AS WT_mean, round(WT_sem, 4) AS WT_sem, GM_n, round(GM_mean, 4) AS GM_mean,
       round(GM_sem, 4) AS GM_sem, round(t, 4) AS t, round(df, 4) AS df, round(p, 4) AS p,
       CASE WHEN p IS NOT NULL THEN round(max(step) OVER (PARTITION BY variable ORDER BY p NULLS LAST, genotype), 4) END AS p_adjusted
FROM (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, p * (count(p) OVER (PARTITION BY variable)
             - row_number() OVER (PARTITION BY variable ORDER BY p NULLS LAST, genotype) + 1)) END AS step FROM tested)""",
            dense, *summary, NORM.replace("norm AS", "two AS") + """,
norm AS (SELECT * REPLACE (['WT', 'KO', 'HET', 'TG'][1 + CAST(substr(fileName, 5) AS BIGINT) % 4] AS genotype) FROM two)""",
            LONG, """
side AS (
  SELECT variable, genotype, count(value) AS n, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean,
         CASE WHEN count(value) = count(*) THEN stddev_samp(value) / sqrt(count(*)) END AS sem,
         avg(value) AS average, var_samp(value) AS var
  FROM long WHERE variable <> 'maxRecording' GROUP BY ALL),
against AS (
  SELECT g.variable, g.genotype, w.n AS WT_n, w.mean AS WT_mean, w.sem AS WT_sem, g.n AS GM_n, g.mean AS GM_mean, g.sem AS GM_sem,
         w.var / w.n AS a, g.var / g.n AS b, abs(w.average - g.average) AS gap, greatest(abs(w.average), abs(g.average)) AS scale
  FROM side g JOIN side w ON g.variable = w.variable AND w.genotype = 'WT' WHERE g.genotype <> 'WT'),
welched AS (
  SELECT *, CASE WHEN ok THEN gap / sqrt(a + b) END AS t,
         CASE WHEN ok THEN (a + b) * (a + b) / (a * a / (WT_n - 1) + b * b / (GM_n - 1)) END AS df
  FROM (SELECT *, WT_n > 1 AND GM_n > 1 AND sqrt(a + b) > 0 AND sqrt(a + b) >= 10 * 2.220446049250313e-16 * scale AS ok FROM against)),
tested AS (
  SELECT *, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 12000
         * list_sum(list_transform(range(0, 4001), lambda i:
             (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
             * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2))) AS p
  FROM welched)"""),
        # distributions
        "raster_points": _sql("""SELECT fileName, genotype, channel_id, round(s, 6) AS s, burst_id IS NOT NULL AS in_burst
            FROM labelled WHERE s >= 0 AND s <= 250 AND channel_id BETWEEN 10 AND 60""", dense, LABELLED),
        "raster_points_sync": _sql("""SELECT l.fileName, l.genotype, l.channel_id, round(l.s, 6) AS s,
            burst_id IS NOT NULL AS in_burst, syncspike_id IS NOT NULL AS in_syncspike
            FROM labelled l JOIN binned_spikes b USING (fileName, channel_id, seq)
            LEFT JOIN spike_events e ON b.fileName = e.fileName AND b.window_bin = e.window_bin""",
                                   dense, LABELLED, _sync_spikes(0.1)),
        "raster_points_syncburst": _sql("""SELECT l.fileName, l.genotype, l.channel_id, round(l.s, 6) AS s,
            l.burst_id IS NOT NULL AS in_burst, e.syncburst_id IS NOT NULL AS in_syncburst
            FROM labelled l LEFT JOIN binned_bursts b USING (fileName, channel_id, burst_id)
            LEFT JOIN burst_events e ON b.fileName = e.fileName AND b.window_bin = e.window_bin""",
                                        dense, LABELLED, _sync_bursts(5)),
        "channel_rates_spike": _sql(f"SELECT fileName, genotype, channel_id, {_rounded('Hz')} FROM hz", _channel_hz("spikes")),
        "channel_rates_burst": _sql(f"SELECT fileName, genotype, channel_id, {_rounded('Hz')} FROM hz", dense, _channel_hz("bursts")),
        "ecdf": _sql("""SELECT DISTINCT genotype, round(Hz, 6) AS Hz, round(cume_dist() OVER (PARTITION BY genotype ORDER BY Hz), 6) AS ecdf,
            count(*) OVER (PARTITION BY genotype, Hz) AS n FROM hz""", _channel_hz("spikes")),
        "ks_statistic": _sql("SELECT pair, n, m, round(D, 6) AS D FROM ks", _channel_hz("spikes"), KS),
        "ks_test": _sql("""
SELECT pair, n, m, round(D, 6) AS D, 'asymptotic' AS method, round(greatest(0, least(1,
       2 * list_sum(list_transform(range(1, 201), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
           * exp(-2.0 * k * k * D * D * CAST(n AS DOUBLE) * m / (n + m)))))), 6) AS p_value
FROM ks""", _channel_hz("spikes"), KS),
        # All orders of the pooled sample, as shares of ways that stayed below D so far.
        "ks_test_exact": _sql("""
SELECT pair, n, m, round(D, 6) AS D, 'exact' AS method,
       round(1 - (SELECT sum(mass) FROM walk, ks k2 WHERE walk.k = k2.n + k2.m), 6) AS p_value FROM ks""",
                              _channel_hz("spikes"), KS, """
ends AS (
  SELECT CAST(sum(count(*)) OVER (ORDER BY Hz) AS BIGINT) AS k FROM hz GROUP BY Hz),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS mass
  UNION ALL
  SELECT k, i, sum(mass) FROM (
    SELECT w.k + 1 AS k, w.i + step AS i, n, m, D,
           w.mass * (CASE WHEN step = 1 THEN n - w.i ELSE m - w.k + w.i END) / CAST(n + m - w.k AS DOUBLE) AS mass
    FROM walk w, ks, (VALUES (0), (1)) v(step) WHERE w.k < n + m)
  WHERE mass > 0 AND NOT (k IN (SELECT k FROM ends) AND abs(i * m - (k - i) * n) >= round(D * n * m))
  GROUP BY k, i)""").replace("WITH", "WITH RECURSIVE", 1),
        # similarity
        "channel_similarity": _sql(f"SELECT fileName, ref_channel, comp_channel, {_rounded('value', digits=3)} FROM similarity",
                                   _similarity("spikes", "s")),
        "channel_similarity_log": _sql(f"SELECT fileName, ref_channel, comp_channel, {_rounded('value', 'value_log', digits=3)} FROM sim_log",
                                       _similarity("spikes", "s")),
        "channel_similarity_sym": _sql(f"SELECT fileName, ref_channel, comp_channel, {_rounded('mean_value', 'mean_value_log', digits=3)} FROM sim_sym",
                                       _similarity("spikes", "s")),
        "similarity_midpoint": _sql("""
SELECT fileName, round(f.m, 4) AS midpoint, round(s.m, 4) AS midpoint_sym
FROM (SELECT fileName, median(value_log) AS m FROM sim_log GROUP BY ALL) f
LEFT JOIN (SELECT fileName, median(mean_value_log) AS m FROM sim_sym GROUP BY ALL) s USING (fileName)""",
                                    _similarity("spikes", "s")),
        "burst_similarity": _sql(f"SELECT fileName, ref_channel, comp_channel, {_rounded('value', digits=3)} FROM similarity",
                                 dense, _similarity("bursts", "start_time_s")),
        # electrodes
        "electrode_grid": _sql("""
SELECT channel_id, x, y, coalesce(recordings, 0) AS recordings, coalesce(n, 0) AS n
FROM grid LEFT JOIN (SELECT channel_id, count(DISTINCT fileName) AS recordings, count(*) AS n FROM spikes GROUP BY ALL)
USING (channel_id)""", GRID),
        "spike_coordinates": _sql("""SELECT fileName, channel_id, seq, CAST(channel_id // 10 AS INTEGER) AS x,
            CAST(channel_id % 10 AS INTEGER) AS y FROM spikes"""),
        "activity_map": _sql("""
SELECT r.fileName, r.genotype, g.channel_id, g.x, g.y, coalesce(n, 0) AS n, n IS NULL AS not_used
FROM (SELECT DISTINCT fileName, genotype FROM spikes) r CROSS JOIN grid g
LEFT JOIN per_channel p ON p.fileName = r.fileName AND p.channel_id = g.channel_id""", GRID),
        "activity_map_frame": _sql("""
SELECT r.fileName, r.genotype, g.channel_id, g.x, g.y, CAST(w * 10 AS DOUBLE) AS from_s,
       count(l.s) AS spikes, count(DISTINCT l.burst_id) AS bursts, p.n IS NULL AS not_used
FROM (SELECT DISTINCT fileName, genotype FROM spikes) r CROSS JOIN grid g CROSS JOIN range(11, 14) t(w)
LEFT JOIN per_channel p ON p.fileName = r.fileName AND p.channel_id = g.channel_id
LEFT JOIN labelled l ON l.fileName = r.fileName AND l.channel_id = g.channel_id AND l.s >= w * 10 AND l.s < w * 10 + 20
GROUP BY ALL""", dense, LABELLED, GRID),
        "activity_map_windowed": windowed(10, 1),
        "activity_map_sliding": windowed(1, 10),
    }
    for inclusive, key in ((">=", "active_filter_incl"), (">", "active_filter_excl")):
        out[key] = _sql(f"""SELECT {SPIKES} FROM spikes JOIN per_channel USING (fileName, channel_id)
            WHERE n / CAST(300 AS DOUBLE) {inclusive} 0.22""")
    parts = {
        "syncburst_counts": SYNCBURST_FEATURES[:3], "syncburst_channels": SYNCBURST_FEATURES[3:6],
        "syncburst_duration": SYNCBURST_FEATURES[6:], "syncburst_features": SYNCBURST_FEATURES,
    }
    for key, names in parts.items():
        out[key] = _sql(f"SELECT fileName, {_rounded(*names)} FROM ({sync_burst_select})",
                        _spike_summary(), dense, _sync_bursts(5))
    # The whole way: channels, length, activity, bursts, features, ratios.
    kept = """
kept0 AS (
  SELECT s.* REPLACE (CAST(200 AS DOUBLE) AS maxRecording) FROM spikes s JOIN meta m USING (fileName)
  WHERE s <= 200 AND (channels2exclude IS NULL OR channel_id NOT IN (21, 52))),
kept AS (
  SELECT k.* FROM kept0 k JOIN (
    SELECT fileName, channel_id FROM kept0 GROUP BY ALL HAVING count(*) / CAST(200 AS DOUBLE) > 0.22)
  USING (fileName, channel_id))"""
    out["analysis_summary"] = _sql(
        f"SELECT {RECORDING}, {_rounded(*SPIKE_FEATURES, *BURST_FEATURES, *NORM_COLUMNS)} FROM norm",
        kept, _bursts(2500, source="kept"), _spike_summary("kept"), BURST_SUMMARY, NORM)
    # What is written and read back is what was written.
    for stored, as_written in (("meta_read", "meta_scan"), ("ingest_files", "ingest_text"), ("compile_stages", "compile_summaries"),
                               ("stage_snapshot", "spikes_labelled"), ("summary_export", "bi_summary")):
        out[stored] = out[as_written]
    zeros = ", ".join(f"CAST(0 AS {'BIGINT' if n in INTEGERS else 'DOUBLE'}) AS {n}" for n in BURST_FEATURES)
    out["burst_features_none"] = _sql(f"SELECT {RECORDING}, {_rounded(*SPIKE_FEATURES)}, {zeros} FROM spike_summary", _spike_summary())
    out["norm_prop_no_bursts"] = _sql(f"""
SELECT {RECORDING}, CAST(spike_n AS BIGINT) AS spike_n,
       round(spike_n / nullif(CAST(activeChannels AS DOUBLE), 0), 6) AS spike_n_NORM,
       round(activeChannels / nullif(CAST(totalChannels AS DOUBLE), 0), 6) AS activeChannels_PROP2totalChannels
FROM spike_summary""", _spike_summary())
    return out
