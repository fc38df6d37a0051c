"""Small spike tables and literal loops to compare with."""

import math
import random
import statistics

from spikeframe import schemas
from spikeframe.layout import Layout


def spike_table(spark, rows, layout=True):
    """rows: (fileName, channel_id, s, isi) with optional genotype and maxRecording."""
    data = []
    for i, row in enumerate(rows):
        file, channel, s, isi = row[:4]
        genotype = row[4] if len(row) > 4 else "WT"
        length = row[5] if len(row) > 5 else 300.0
        data.append((file, genotype, 2, 2, channel, length, i + 1, s, isi, None))
    df = spark.createDataFrame(data, schemas.SPIKES)
    return (df, Layout.measure(df)) if layout else df


def random_rows(seed, files=3, channels=4, most=60, short=0.7, weights=None):
    """Channels with many short intervals, some of them 0 and at the threshold of 50 ms."""
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        for c in range(channels):
            n = rng.randint(1, most)
            if weights:
                n *= weights.get((f, c), 1)
            us = rng.randint(0, 2_000_000)
            last = None
            for _ in range(n):
                rows.append((f"file_{f}", 21 + 10 * c, us / 1e6, None if last is None else (us - last) / 1e3,
                             "WT" if f % 2 == 0 else "KO"))
                last = us
                kind = rng.random()
                us += 0 if kind < 0.05 else 50_000 if kind < 0.1 else (
                    rng.randint(1, 49_000) if kind < 0.1 + short else rng.randint(51_000, 3_000_000))
    return rows


def by_channel(rows):
    out = {}
    for row in rows:
        out.setdefault((row[0], row[1]), []).append(row)
    return out


def loop_bursts(rows, threshold=50, least=5, longest=None):
    """Run by run: (file, channel, id, spikes, start, end, mean interval)."""
    out, labels = [], {}
    for (file, channel), spikes in by_channel(rows).items():
        flags = [r[3] is not None and 0 < r[3] < threshold for r in spikes]
        i, number = 0, 0
        while i < len(spikes):
            if not flags[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(spikes) and flags[j + 1]:
                j += 1
            first = max(i - 1, 0)
            count = j - first + 1
            start, end = spikes[first][2], spikes[j][2]
            if count >= least and (longest is None or end - start < longest):
                number += 1
                mean = statistics.fmean(r[3] for r in spikes[i:j + 1])
                out.append((file, channel, number, count, start, end, mean))
                for k in range(first, j + 1):
                    labels[(file, channel, k)] = number
            i = j + 1
    return out, labels


def loop_positional(rows):
    """Element by element, as a growing vector per recording."""
    channels = []
    for r in rows:
        if r[1] not in channels:
            channels.append(r[1])
    out = {}
    for file in dict.fromkeys(r[0] for r in rows):
        vector = []
        for j, channel in enumerate(channels, 1):
            isi = [r[3] for r in rows if r[0] == file and r[1] == channel and r[3] is not None and r[3] > 0]
            if not isi:
                continue
            vector += isi
            vector += [None] * (j - len(vector))
            vector[j - 1] = statistics.fmean(isi)
        known = [v for v in vector if v is not None]
        if known:
            out[file] = (statistics.fmean(known), statistics.stdev(known) if len(known) > 1 else None)
    return out


def loop_similarity(rows):
    times = {}
    for (file, channel), spikes in by_channel(rows).items():
        times.setdefault(file, {})[channel] = [r[2] for r in spikes]
    return {
        (file, a, b): math.fsum(min((t - u) ** 2 for u in channels[b]) for t in channels[a])
        for file, channels in times.items() for a in channels for b in channels
    }


def close(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=1e-9)
