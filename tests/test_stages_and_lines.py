"""Stages that break off and go on, bucketed tables, and lines by byte ranges."""

import io
import itertools
import random

import pytest
from helpers import random_rows, spike_table
from pyspark.sql import functions as F
from test_sources import EXPORT, META, write

from spikeframe.layout import ROWS_PER_SLICE_CONF, Layout
from spikeframe.operators import bursts
from spikeframe.plans import analysis
from spikeframe.sources import recordings, snapshots
from spikeframe.sources.text_ranges import source


@pytest.fixture
def inputs(spark):
    spikes, layout = spike_table(spark, random_rows(seed=3, most=200))
    meta = spark.createDataFrame([("m", f"file_{k}", "WT", 300.0, None, None) for k in range(3)], META)
    return spikes, meta, layout


def rows(df):
    return sorted(str([round(v, 8) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_a_broken_run_goes_on(spark, inputs, tmp_path, monkeypatch):
    how = {"active_threshold": 0, "directory": str(tmp_path), "prefix": "P5"}
    want = analysis.run(*inputs, active_threshold=0)

    def breaks(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(analysis, "bursts_of", breaks)  # between the two tables of the burst stage
        with pytest.raises(RuntimeError, match="lost"):
            analysis.run(*inputs, **how)
    with pytest.raises(ValueError, match="not finished"):
        snapshots.read_stage(spark, str(tmp_path), "bursts", "spikes", "P5")
    with monkeypatch.context() as patch:
        patch.setattr(analysis, "norm_prop", breaks)  # behind the burst features
        with pytest.raises(RuntimeError, match="lost"):
            analysis.run(*inputs, **how, resume=True)
    assert snapshots.Stage(spark, str(tmp_path), "burst_features", "P5").record()["tables"]["summary"]["rows"] == 3
    with monkeypatch.context() as patch:
        patch.setattr(snapshots.Stage, "write", lambda self, name, table, channels=False: want_norm(self, name, table))

        def want_norm(self, name, table, write=snapshots.Stage.write):
            raise AssertionError(f"{self.path} was written again") if "10_NORM" not in self.path else RuntimeError("last")

        with pytest.raises(RuntimeError, match="last"):
            analysis.run(*inputs, **how, resume=True)  # only the last stage is left to write
    done = analysis.run(*inputs, **how, resume=True)
    assert rows(done.summary) == rows(want.summary) and rows(done.bursts) == rows(want.bursts)
    with pytest.raises(ValueError, match="was written with"):
        analysis.run(*inputs, **how, resume=True, isi_threshold=60)
    # without resume everything is written anew
    assert rows(analysis.run(*inputs, **how, isi_threshold=20).summary) != rows(want.summary)


def test_stored_spikes_need_no_shuffle_by_channel(spark, inputs, tmp_path):
    done = analysis.run(*inputs, active_threshold=0, directory=str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(bursts.bursts_of(done.spikes))
    assert "Exchange" not in plan(done.spikes.groupBy("fileName", "genotype", "channel_id").agg(F.avg("isi")))
    # another session finds the buckets through the record
    path = snapshots.Stage(spark, str(tmp_path), "bursts").record()["tables"]["spikes"]["path"]
    spark.sql(f"DROP TABLE {snapshots._catalog_name(path)}")
    again = snapshots.read_stage(spark, str(tmp_path), "bursts", "spikes")
    assert "Exchange" not in plan(bursts.bursts_of(again)) and rows(again) == rows(done.spikes)


def test_cut_channels_are_not_put_into_buckets(spark, inputs, settings, tmp_path):
    settings(ROWS_PER_SLICE_CONF, 20)
    spikes, meta, _ = inputs
    layout = Layout.measure(spikes)
    done = analysis.run(spikes, meta, layout, active_threshold=0, directory=str(tmp_path))
    tables = snapshots.Stage(spark, str(tmp_path), "bursts").record()["tables"]
    assert tables["spikes"]["buckets"] == 0 and done.summary.count() == 3


TEXTS = [b"", b"\n", b"a", b"a\n", b"a\r\nb\r\n\r\nc", b"\r\r\n\n\r", b"one\rtwo\nthree\r\n", "﻿é\nü".encode()]


def plain_lines(data):
    text = data.decode()
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        out.append((at, line.rstrip("\r\n")))
        at += len(line.encode())
    return out


@pytest.mark.parametrize("data", TEXTS)
def test_lines_of_files_cut_at_every_byte(data):
    cut = source().cut
    for size in (1, 2, 3, 7, 100):
        for chunk in (1, 2, 5, 100):
            got = [x for a in range(0, len(data), size) for x in cut(io.BytesIO(data), a, min(a + size, len(data)), chunk)]
            assert [(a, line.decode()) for a, line in got] == plain_lines(data)


def test_lines_of_random_files():
    cut, rng = source().cut, random.Random(8)
    for _ in range(300):
        data = "".join(rng.choice(["x", "yz", "\n", "\r", "\r\n"]) for _ in range(rng.randint(0, 20))).encode()
        ends = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(3))})
        got = [x for a, b in itertools.pairwise(ends) for x in cut(io.BytesIO(data), a, b, rng.randint(1, 4))]
        assert [(a, line.decode()) for a, line in got] == plain_lines(data)


def test_read_lines(spark, tmp_path):
    texts = {"a b.txt": "x\r\ny\n\nz", "100%+.txt": "p\nq\n", "empty.txt": "", "other.csv": "no\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "c.txt").write_bytes(b"no\n")
    got = {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in recordings.read_lines(spark, str(tmp_path), 2).collect()}
    assert got == {(name.replace(" ", "%20").replace("100%+", "100%25%2B"), *line) for name, text in texts.items()
                   if name.endswith(".txt") for line in plain_lines(text.encode())}
    assert recordings.read_lines(spark, str(tmp_path)).coalesce(1).count() == len(got)
    assert [recordings._bytes_of(s) for s in ("128MB", "7", "2k", "134217728b", "1g")] == [1 << 27, 7, 2048, 1 << 27, 1 << 30]


@pytest.mark.parametrize("size", [3, 11, 64])
def test_parsing_does_not_depend_on_the_ranges(spark, tmp_path, size):
    write(tmp_path / "a.txt", EXPORT)
    parse = lambda lines: sorted((r.channel_id, r.s, r.isi) for r in recordings.parse_lines(lines).collect())
    want = parse(recordings.read_lines_in_splits(spark, str(tmp_path)))
    assert want and parse(recordings.read_lines(spark, str(tmp_path), size).coalesce(1)) == want
