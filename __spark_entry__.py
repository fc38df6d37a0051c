"""

The queries view the whole `events` table as spikes (`spikeframe.sources.events`).
Doubles are rounded at the very end, so that both engines print the same digits.
"""

from __future__ import annotations

import importlib.util
import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from spikeframe import schemas  # noqa: E402
from spikeframe.layout import Layout, kept, kept_folder  # noqa: E402
from spikeframe.operators import (  # noqa: E402
    bursts as B, channels as C, distributions as D, electrodes as E, features as X,
    filters as FL, groups as G, similarity as S, synchrony as Y,
)
from spikeframe.plans import analysis as A  # noqa: E402
from spikeframe.sources import events as EV, metadata as M, recordings as R, snapshots as N  # noqa: E402

# The text operators and their pipeline can be taken out of the repository as a whole.
WITH_TEXT = all(importlib.util.find_spec(name) is not None for name in ("spikeframe.llm", "corpus_pipeline"))
if WITH_TEXT:
    import corpus_pipeline
    from spikeframe.llm import queries as text_queries

Query = Callable[[SparkSession, str], DataFrame]
DENSE, SPARSE = 2500, 1000  # ms: bursts in every recording, bursts in some
LINE_RANGE = 1 << 16  # bytes of a text file that one task reads
SPIKES = [f.name for f in schemas.SPIKES.fields]
RECORDING = schemas.RECORDING
NORM = ["spike_n_NORM", "burst_n_NORM", "activeChannels_PROP2totalChannels", "burst_spikes_PROP2totalSpikes"]


@dataclass(frozen=True)
class Data:
    spikes: DataFrame
    meta: DataFrame
    layout: Layout

    def bursts(self, threshold: float = DENSE, **how) -> DataFrame:
        return B.find_bursts(self.spikes, self.layout, threshold, 5, **how)

    def labelled(self) -> DataFrame:
        return B.label_spikes(self.spikes, self.layout, DENSE, 5)

    def summary(self) -> DataFrame:
        return X.spike_features(self.spikes, self.layout)

    def features(self, threshold: float = DENSE) -> DataFrame:
        return X.burst_features(self.summary(), self.bursts(threshold), self.layout)

    def norm(self, threshold: float = DENSE) -> DataFrame:
        return X.norm_prop(self.features(threshold))

    def synced(self) -> DataFrame:
        """Spike, burst and both synchrony feature sets with all ratios."""
        bursts = kept(self.bursts())  # found once, read three times
        out = X.burst_features(self.summary(), bursts, self.layout)
        out = Y.sync_burst_features(out, bursts, self.layout, 5)
        return X.norm_prop(Y.sync_spike_features(out, self.spikes, self.layout, 0.1), param_sync=True)


def load(spark: SparkSession, sf_dir: str) -> Data:
    events = EV.read_events(spark, f"{sf_dir}/events.parquet")
    spikes, layout = EV.spikes_from_events(events)
    return Data(C.stamp_channel_counts(spikes, layout), EV.meta_from_events(events), layout)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _query(build: Callable[[Data], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: _rounded(build(load(spark, sf_dir)), digits)


def entry(spark: SparkSession) -> DataFrame:
    """Bursts per recording on the smallest tables."""
    data = load(spark, "/root/testdata/sf0.001")
    return _rounded(data.features().select("fileName", "genotype", "spike_n", *schemas.BURST_FEATURES))


def _tidy(d: Data) -> DataFrame:
    rec = F.substring("animalID", 2, 18).cast("long")
    meta = d.meta.select(*[f.name for f in schemas.META.fields]).withColumns({
        "animalID": F.when(rec % 9 != 8, F.col("animalID")), "NA_1": F.lit(1), "na..2": F.lit(2)})
    return M.tidy_meta(meta)


def _new_folder(d: Data) -> str:
    return f"{kept_folder(d.spikes.sparkSession)}/{uuid.uuid4().hex}"


def _meta_file(d: Data) -> DataFrame:
    """The metadata, written as CSV files and read from them."""
    path = _new_folder(d)
    d.meta.write.option("header", True).csv(path)
    return M.read_meta(d.meta.sparkSession, path, optional=True)


def _snapshot(d: Data) -> DataFrame:
    """The labelled spikes out of a finished stage."""
    folder = _new_folder(d)
    N.write_stage({"spikes": d.labelled(), "bursts": d.bursts()}, folder, "bursts", "P60")
    return N.read_stage(d.spikes.sparkSession, folder, "bursts", "spikes", "P60").select(*SPIKES, "isiThreshold", "burst_id")


def _exported(d: Data) -> DataFrame:
    """The comparison of two groups, written as CSV and read back."""
    path = _new_folder(d)
    table = G.bi_summary(d.norm())
    N.write_summary_table(table, path)
    return d.spikes.sparkSession.read.option("header", True).schema(table.schema).csv(path)


def _compiled(d: Data) -> DataFrame:
    """Summaries of three stages, written under their prefixes and read as one table."""
    folder = _new_folder(d)
    for prefix, threshold in (("P5", 1000), ("P15", 1500), ("P60", 2500)):
        N.write_stage({"summary": d.features(threshold)}, folder, "norm", prefix)
    return N.compile_summaries(d.spikes.sparkSession, folder)


def _export_lines(d: Data) -> DataFrame:
    """The spikes as lines of text exports, in blocks of one second of one channel."""
    base = F.col("channel_id").cast("long") * 10**12
    tab = lambda *c: F.concat_ws("\t", *c, F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
    line = lambda n, value: F.struct(F.lit(n).cast("long").alias("line"), value.alias("value"))
    spikes, channels = d.spikes, d.spikes.select("fileName", "channel_id").distinct()
    rows = spikes.select(
        F.concat("fileName", F.lit(".txt")).alias("file"),
        (base + (1 + F.floor("s")) * 10**9).alias("block"),
        (F.col("s") * 10**10).cast("long").alias("line"),
        tab(text("s"), text("isi"), text("frequency")).alias("value"),
    )
    channel = F.col("channel_id").cast("string")
    heads = channels.select(
        F.concat("fileName", F.lit(".txt")).alias("file"), base.alias("block"),
        F.inline(F.array(
            line(0, tab(F.lit("t"), channel, channel)), line(1, F.lit("")),
            line(2, tab(F.lit("[s]"), F.lit("[ms]"), F.lit("[Hz]"))))),
    )
    ends = channels.select("fileName").distinct().select(
        F.concat("fileName", F.lit(".txt")).alias("file"), F.lit(10**15).alias("block"),
        F.inline(F.array(
            line(0, F.lit("")), line(1, F.lit("Bined Parameters:")), line(2, F.lit("t\t99\t99\t")),
            line(3, F.lit("9\t9\t9\t")))),
    )
    return heads.unionByName(rows).unionByName(ends)


def _line_files(d: Data) -> DataFrame:
    """The lines of the text exports, written to a file for each recording and read by byte ranges."""
    folder = _new_folder(d)
    lines = _export_lines(d).withColumn("rec", M.base_name("file"))
    lines.repartition("rec").sortWithinPartitions("rec", "block", "line").select("rec", "value").write.partitionBy("rec").text(folder)
    read = R.read_lines(d.spikes.sparkSession, f"{folder}/rec=*", LINE_RANGE)
    return read.withColumn("file", F.concat(F.regexp_extract("file", "rec%3D([^/]+)/", 1), F.lit(".txt")))


def _ingest(d: Data, lines: Callable[[Data], DataFrame] = _export_lines) -> DataFrame:
    parsed = R.stamp_recordings(R.parse_lines(lines(d)), d.meta)
    spikes, layout = R.finish_spikes(kept(parsed), d.meta)
    channels = layout.channels
    return channels.running_sum(channels.split(spikes, "s"), "nth", F.lit(1), "s", "seq").select(
        *[c for c in SPIKES if c != "seq"], "nth")


def _raster_sync(d: Data) -> DataFrame:
    return E.raster_points(Y.label_sync_spikes(d.labelled(), d.layout, 0.1))


def _analysis(d: Data) -> DataFrame:
    result = A.run(d.spikes, d.meta, d.layout, max_duration=200, active_threshold=0.22, isi_threshold=DENSE)
    return result.summary.select(*RECORDING, *schemas.SPIKE_FEATURES, *schemas.BURST_FEATURES, *NORM)


def _three_genotypes(d: Data) -> DataFrame:
    """The summary with every third recording as a genotype of its own."""
    third = F.substring("fileName", 5, 12).cast("long") % 3 == 2
    return d.norm().withColumn("genotype", F.when(third, "HET").otherwise(F.col("genotype")))


def _four_genotypes(d: Data) -> DataFrame:
    """The summary with WT against three genotypes, by the number of the recording."""
    number = F.substring("fileName", 5, 12).cast("long") % 4
    names = F.array(*[F.lit(g) for g in ("WT", "KO", "HET", "TG")])
    return d.norm().withColumn("genotype", F.get(names, number.cast("int")))


def _features(*names: str) -> Query:
    return _query(lambda d: d.features(SPARSE).select("fileName", *names))


def _sync_bursts(*names: str) -> Query:
    return _query(lambda d: Y.sync_burst_features(d.summary(), d.bursts(), d.layout, 5).select("fileName", *names))


def _spikes_of(build: Callable[[Data], DataFrame]) -> Query:
    return _query(lambda d: build(d).select(*SPIKES))


def _similarity(d: Data) -> DataFrame:
    return S.channel_similarity(d.spikes, d.layout)


def queries() -> dict[str, Query]:
    burst_columns = [c for c in B.BURST_COLUMNS if c != "isi_sd"]
    spike_key = ["fileName", "channel_id", "seq"]
    sync = schemas.SYNCBURST_FEATURES
    all_features = [*RECORDING, *schemas.SPIKE_FEATURES, *schemas.BURST_FEATURES]
    registered = {
        # sources
        "meta_scan": _query(lambda d: d.meta),
        "meta_read": _query(_meta_file),
        "meta_tidy": _query(_tidy),
        "ingest_text": _query(_ingest),
        "ingest_files": _query(lambda d: _ingest(d, _line_files)),
        "spikes_with_meta": _query(lambda d: C.stamp_metadata(
            d.spikes, d.meta, d.layout, ("genotype", "maxRecording", "region")).select(
            "fileName", "genotype", "maxRecording", "region", "channel_id", "seq", "s", "isi")),
        "channel_totals": _query(lambda d: C.channel_counts(d.spikes)),
        "layer_tag": _query(lambda d: C.tag_layers(d.spikes, d.meta, d.layout).select(*spike_key, "layer")),
        "compile_summaries": _query(lambda d: N.stack_summaries({
            "P5": d.features(1000), "P15": d.features(1500), "P60": d.features(2500)}).select("index", *all_features)),
        "compile_stages": _query(lambda d: _compiled(d).select("index", *all_features)),
        "stage_snapshot": _query(_snapshot),
        "summary_export": _query(_exported),
        # filters
        "sample_filter": _spikes_of(lambda d: FL.sample_filter(d.spikes, d.meta, d.layout)),
        "sample_filter_flag": _spikes_of(lambda d: FL.sample_filter(
            d.spikes, d.meta, d.layout, marker="YES", has_hp=True)),
        "region_filter": _spikes_of(lambda d: FL.region_filter(
            C.stamp_metadata(d.spikes, d.meta, d.layout, ("region",)))),
        "layer_filter": _query(lambda d: FL.layer_filter(
            C.tag_layers(d.spikes, d.meta, d.layout), "upper", d.layout).select(
            "fileName", "totalChannels", "activeChannels", "channel_id", "seq", "s")),
        "length_filter": _spikes_of(lambda d: FL.length_filter(d.spikes, 200)),
        "active_filter_incl": _spikes_of(lambda d: FL.active_filter(d.spikes, d.layout, 0.22, True)),
        "active_filter_excl": _spikes_of(lambda d: FL.active_filter(d.spikes, d.layout, 0.22, False)),
        "channel_filter": _spikes_of(lambda d: FL.channel_filter(d.spikes, d.meta, d.layout)),
        "interval_filter": _spikes_of(lambda d: FL.interval_filter(d.spikes, 100, 200)),
        # bursts
        "isi_flag": _query(lambda d: B.flag_isi(d.spikes, DENSE).select(*spike_key, "isiThreshold")),
        "spike_runs": _query(lambda d: B.spike_runs(d.spikes, d.layout, DENSE).select(*spike_key, "isiThreshold", "run")),
        "bursts": _query(lambda d: d.bursts().select(*burst_columns)),
        "bursts_max_duration": _query(lambda d: d.bursts(burst_duration_max=5).select(*burst_columns)),
        "spikes_labelled": _query(lambda d: d.labelled().select(*SPIKES, "isiThreshold", "burst_id")),
        # spike features
        "spike_counts": _query(lambda d: d.summary().select("fileName", "genotype", "spike_n", "sliceSpikeRate")),
        "spike_rates": _query(lambda d: d.summary().select("fileName", "genotype", "spikeRate_mean", "spikeRate_sd")),
        "isi_pooled": _query(lambda d: d.summary().select("fileName", "genotype", "isi_mean", "isi_sd")),
        "isi_positional": _query(lambda d: X.positional_isi(d.spikes, d.layout)),
        "spike_features": _query(lambda d: d.summary()),
        # burst features
        "burst_counts": _features("burst_n"),
        "isi_in_burst": _features("isi_inBurst_mean", "isi_inBurst_sd"),
        "burst_spikes": _features("burst_spikes_total", "burst_spikes_mean", "burst_spikes_sd"),
        "burst_spike_rate": _features("spikeRate_inBurst_mean", "spikeRate_inBurst_sd"),
        "burst_rate": _features("burstRate_mean", "burstRate_sd"),
        "burst_rate_filtered": _query(lambda d: X.burst_features(
            d.summary(), d.bursts().where("spike_count >= 6"), d.layout).select("fileName", "burst_n", "burstRate_mean", "burstRate_sd")),
        "burst_duration": _features("burst_dur_mean", "burst_dur_sd"),
        "inter_burst_interval": _features("ibi_mean", "ibi_sd"),
        "burst_features": _query(lambda d: d.features().select(*all_features)),
        "burst_features_sparse": _query(lambda d: d.features(SPARSE).select(*all_features)),
        "burst_features_none": _query(lambda d: d.features(-1).select(*all_features)),
        # synchrony
        "syncburst_bins": _query(lambda d: Y.label_sync_bursts(d.bursts(), d.layout, 5).select(
            "fileName", "channel_id", "burst_id", "window_bin", "syncburst_id")),
        "syncburst_events": _query(lambda d: Y.sync_burst_events(d.bursts(), d.layout, 5)),
        "syncburst_counts": _sync_bursts(*sync[:3]),
        "syncburst_channels": _sync_bursts(*sync[3:6]),
        "syncburst_duration": _sync_bursts(*sync[6:]),
        "syncburst_features": _sync_bursts(*sync),
        "syncspike_events": _query(lambda d: Y.sync_spike_events(d.spikes, d.layout, 0.1)),
        "syncspike_features": _query(lambda d: Y.sync_spike_features(
            d.summary(), d.spikes, d.layout, 0.1).select("fileName", *schemas.SYNCSPIKE_FEATURES)),
        "syncspike_features_narrow": _query(lambda d: Y.sync_spike_features(
            d.summary(), d.spikes, d.layout, 0.01, 0.15).select("fileName", *schemas.SYNCSPIKE_FEATURES)),
        "syncspike_labels": _query(lambda d: Y.label_sync_spikes(d.spikes, d.layout, 0.1).select(
            *spike_key, "window_bin", "syncspike_id")),
        # normalisation
        "norm_prop": _query(lambda d: d.norm(SPARSE).select("fileName", *NORM)),
        "norm_prop_no_bursts": _query(lambda d: X.norm_prop(d.summary()).select(
            *RECORDING, "spike_n", "spike_n_NORM", "activeChannels_PROP2totalChannels")),
        "norm_prop_sync": _query(lambda d: d.synced().select("fileName", *oracle_queries.SYNC_RATIOS)),
        # groups
        "feature_long": _query(lambda d: G.feature_long(d.norm())),
        "group_means": _query(lambda d: G.group_means(d.norm())),
        "group_error_bounds": _query(lambda d: G.group_error_bounds(d.norm()).select("variable", "genotype", "ymin", "ymax")),
        "welch_t": _query(lambda d: G.welch_t(d.norm()).drop("position"), digits=5),
        "bi_summary": _query(lambda d: G.bi_summary(d.norm())),
        "multi_summary": _query(lambda d: G.multi_summary(d.norm(), ["WT", "KO"]).drop("position")),
        "multi_summary_all": _query(lambda d: G.multi_summary(_three_genotypes(d)).drop("position")),
        "multi_summary_vs_wt": _query(lambda d: G.vs_wt(_four_genotypes(d)).drop("position"), digits=4),
        # distributions
        "raster_points": _query(lambda d: E.raster_points(d.labelled(), xlim=250, channel_max=60)),
        "raster_points_sync": _query(_raster_sync),
        "raster_points_syncburst": _query(lambda d: E.raster_points(
            Y.label_burst_spikes(d.labelled(), d.bursts(), d.layout, 5))),
        "channel_rates_spike": _query(lambda d: D.channel_rates(d.spikes)),
        "channel_rates_burst": _query(lambda d: D.channel_rates(d.bursts())),
        "ecdf": _query(lambda d: D.ecdf(D.channel_rates(d.spikes))),
        "ks_statistic": _query(lambda d: D.ks_test(D.channel_rates(d.spikes)).drop("p_value", "method")),
        "ks_test": _query(lambda d: D.ks_test(D.channel_rates(d.spikes), method="asymptotic")),
        "ks_test_exact": _query(lambda d: D.ks_test(D.channel_rates(d.spikes), method="exact")),
        # similarity
        "channel_similarity": _query(_similarity, digits=3),
        "channel_similarity_log": _query(lambda d: S.similarity_log(_similarity(d)), digits=3),
        "channel_similarity_sym": _query(lambda d: S.similarity_symmetric(_similarity(d)), digits=3),
        "similarity_midpoint": _query(lambda d: S.similarity_midpoint(_similarity(d)), digits=4),
        "burst_similarity": _query(lambda d: S.channel_similarity(d.bursts(), d.layout, "start_time_s"), digits=3),
        # electrodes
        "electrode_grid": _query(lambda d: E.electrode_grid(d.spikes)),
        "spike_coordinates": _query(lambda d: E.add_coordinates(d.spikes).select(*spike_key, "x", "y")),
        "activity_map": _query(lambda d: E.activity_map(d.spikes)),
        "activity_map_windowed": _query(lambda d: E.activity_map_windowed(d.labelled(), 10)),
        "activity_map_sliding": _query(lambda d: E.activity_map_windowed(d.labelled(), 10, 1)),
        "activity_map_frame": _query(lambda d: E.activity_map_frame(d.labelled(), 103, 158, 20, 10)),
        # the whole way from spikes to a normalised summary
        "analysis_summary": _query(_analysis),
    }
    if WITH_TEXT:
        registered |= {**text_queries.queries(), "pipeline": corpus_pipeline.run}
    return registered


def oracle_sql() -> dict[str, str]:
    """One statement for each registered query that SQL can express."""
    statements = oracle_queries.statements()
    if WITH_TEXT:
        statements |= text_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements
