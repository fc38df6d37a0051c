"""The operators put together: from spikes and metadata to a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..layout import Layout, kept
from ..operators.bursts import bursts_of, label_spikes
from ..operators.features import burst_features, norm_prop, spike_features
from ..operators.filters import active_filter, channel_filter, length_filter
from ..operators.synchrony import (
    label_sync_bursts, label_sync_spikes, sync_burst_features, sync_spike_features,
)
from ..sources.snapshots import Stage


@dataclass(frozen=True)
class Analysis:
    """What the stages pass on: three tables and the layout of the spikes."""

    spikes: DataFrame
    bursts: DataFrame
    summary: DataFrame | None
    layout: Layout

    def write(self, directory: str, stage: str, prefix: str = "") -> Analysis:
        """Write the tables of this stage and go on from the written ones.

        Later stages then read the result instead of computing it again, also
        after an executor is lost. The folder has to be shared by the cluster.
        """
        tables = {"spikes": self.spikes, "bursts": self.bursts}
        if self.summary is not None:
            tables["summary"] = self.summary
        whole = Stage(self.spikes.sparkSession, directory, stage, prefix).begin()
        written = {name: whole.write(name, table, _in_buckets(self.layout)) for name, table in tables.items()}
        whole.commit()
        return replace(self, **written)


def _in_buckets(layout: Layout) -> bool:
    """A cut channel is spread over tasks and would be one file of a bucket."""
    return layout.channels.hot is None


def detect_bursts(
    spikes: DataFrame, layout: Layout,
    isi_threshold: float = 50, spikes_per_burst: int = 5, burst_duration_max: float | None = None,
    directory: str | None = None, prefix: str = "", resume: bool = False, parameters: dict | None = None,
) -> Analysis:
    """Label the spikes and collect the bursts.

    The labelled spikes are written once, as the burst stage or else to the shared
    folder, and the bursts are an aggregation of the written table. With `resume` a
    finished stage of the same parameters is read instead.
    """
    labelled = label_spikes(spikes, layout, isi_threshold, spikes_per_burst, burst_duration_max)
    if directory is None:
        labelled = kept(labelled)
        return Analysis(labelled, bursts_of(labelled), None, layout)
    stage = Stage(spikes.sparkSession, directory, "bursts", prefix, parameters)
    if not (resume and stage.finished()):
        stage.begin()
        stored = stage.write("spikes", labelled, _in_buckets(layout))
        stage.write("bursts", bursts_of(stored), _in_buckets(layout))
        stage.commit()
    return Analysis(stage.read("spikes"), stage.read("bursts"), None, layout)


def add_features(analysis: Analysis, isi_mode: str = "pooled", per_minute: bool = False) -> Analysis:
    """Spike features, burst features and their normalisation."""
    summary = spike_features(analysis.spikes, analysis.layout, isi_mode)
    summary = burst_features(summary, analysis.bursts, analysis.layout, per_minute)
    return replace(analysis, summary=norm_prop(summary))


def add_synchrony(
    analysis: Analysis, syncburst_window: float = 0.050, syncspike_window: float = 0.010,
    min_prop_involved: float = 0.01, run_syncspike_id: bool = False,
) -> Analysis:
    """Synchrony features and their ratios; the events go onto the bursts, and on request onto the spikes."""
    layout = analysis.layout
    summary = sync_burst_features(analysis.summary, analysis.bursts, layout, syncburst_window)
    summary = sync_spike_features(summary, analysis.spikes, layout, syncspike_window, min_prop_involved)
    spikes = analysis.spikes
    if run_syncspike_id:
        spikes = label_sync_spikes(spikes, layout, syncspike_window, min_prop_involved)
    bursts = label_sync_bursts(analysis.bursts, layout, syncburst_window)
    return replace(analysis, spikes=spikes, bursts=bursts, summary=norm_prop(summary, param_sync=True))


def run(
    spikes: DataFrame, meta: DataFrame, layout: Layout,
    max_duration: float | None = 300, active_threshold: float = 0.01, active_inclusive: bool = False,
    isi_threshold: float = 50, spikes_per_burst: int = 5, burst_duration_max: float | None = None,
    isi_mode: str = "pooled", per_minute: bool = False, strict: bool = False, synchrony: dict | None = None,
    directory: str | None = None, prefix: str = "", resume: bool = False,
) -> Analysis:
    """Filter the channels, the length and the activity, find bursts and extract all features.

    `isi_mode`, `per_minute` and `strict` go to the features; `synchrony` holds the
    arguments of `add_synchrony`, which is left out without it. With a directory
    every stage from the bursts on is written there, and the next one reads it. A run that
    broke off goes on with `resume`: finished stages are read, others written again, and
    stages written with other arguments are an error. The spikes must be those of that run.
    """
    spark = spikes.sparkSession
    spikes = channel_filter(spikes, meta, layout)
    spikes = length_filter(spikes, max_duration)
    spikes = active_filter(spikes, layout, active_threshold, active_inclusive)
    parameters = {
        "max_duration": max_duration, "active_threshold": active_threshold, "active_inclusive": active_inclusive,
        "isi_threshold": isi_threshold, "spikes_per_burst": spikes_per_burst, "burst_duration_max": burst_duration_max}
    analysis = detect_bursts(
        spikes, layout, isi_threshold, spikes_per_burst, burst_duration_max, directory, prefix, resume, parameters)

    def staged(stage: str, name: str, build: Callable[[], DataFrame], **more) -> DataFrame:
        """The table of a stage of one table, written and read back if there is a directory."""
        parameters.update(more)
        if directory is None:
            return build()
        whole = Stage(spark, directory, stage, prefix, parameters)
        if not (resume and whole.finished()):
            whole.begin().write(name, build(), _in_buckets(layout))
            whole.commit()
        return whole.read(name)

    summary = staged("spike_features", "summary", lambda: spike_features(analysis.spikes, layout, isi_mode), isi_mode=isi_mode)
    with_bursts = staged(
        "burst_features", "summary", lambda: burst_features(summary, analysis.bursts, layout, per_minute, strict), per_minute=per_minute)
    analysis = replace(analysis, summary=norm_prop(with_bursts))
    if synchrony is not None:
        synced = add_synchrony(analysis, **synchrony)
        analysis = replace(
            synced, bursts=staged("sync_bursts", "bursts", lambda: synced.bursts, synchrony=synchrony),
            spikes=staged("sync_spikes", "spikes", lambda: synced.spikes))
    return replace(analysis, summary=staged("norm", "summary", lambda: analysis.summary, synchrony=synchrony))
