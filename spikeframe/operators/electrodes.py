"""Spikes on the electrode grid and along time: the data behind maps and rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GRID_CORNERS, GRID_SIDE


def grid_channels() -> list[int]:
    """Ids of the electrodes: 10 * column + row, without the corners."""
    side = range(1, GRID_SIDE + 1)
    return [10 * x + y for x in side for y in side if 10 * x + y not in GRID_CORNERS]


def coordinates(channel: str = "channel_id") -> dict[str, Column]:
    """Column and row of an electrode."""
    return {
        "x": F.floor(F.col(channel) / 10).cast("int"),
        "y": (F.col(channel) % 10).cast("int"),
    }


def add_coordinates(spikes: DataFrame) -> DataFrame:
    return spikes.withColumns(coordinates())


def on_grid(recordings: DataFrame) -> DataFrame:
    """One row per recording and electrode."""
    ids = F.array(*[F.lit(c) for c in grid_channels()])
    return recordings.withColumn("channel_id", F.explode(ids)).withColumns(coordinates())


def electrode_grid(spikes: DataFrame) -> DataFrame:
    """The grid with the use of each electrode over all recordings."""
    used = (
        spikes.groupBy("channel_id", "fileName").agg(F.count("*").alias("n"))
        .groupBy("channel_id").agg(F.count("*").alias("recordings"), F.sum("n").alias("n"))
    )
    grid = on_grid(spikes.sparkSession.range(1)).drop("id")
    zero = F.lit(0)
    return grid.join(used, "channel_id", "left").select(
        "channel_id", "x", "y",
        F.coalesce("recordings", zero).alias("recordings"), F.coalesce("n", zero).alias("n"))


def activity_map(spikes: DataFrame) -> DataFrame:
    """Spikes per recording on the whole grid; `not_used` marks electrodes without any."""
    counts = spikes.groupBy("fileName", "genotype", "channel_id").agg(F.count("*").alias("n"))
    grid = on_grid(counts.select("fileName", "genotype").distinct())
    joined = grid.join(counts.drop("genotype"), ["fileName", "channel_id"], "left")
    return joined.select(
        "fileName", "genotype", "channel_id", "x", "y",
        F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("not_used"))


def activity_map_windowed(
    labelled: DataFrame, width: float = 1.0, step: float | None = None,
    start: float | None = None, end: float | None = None,
) -> DataFrame:
    """Spikes and bursts per electrode and time window [from_s, from_s + width).

    Windows start at multiples of `step` (default: the width, so they do not
    overlap). `start` and `end` keep the windows that lie wholly in that time frame.
    Electrodes without a spike in a window have no row; `activity_map_frame` has them.
    """
    step = float(step or width)
    per_window = round(width / step)
    if abs(per_window * step - width) > 1e-9 * width:
        raise ValueError("width must be a multiple of step")
    first, last = _frame(width, step, start, end)
    if first is not None:
        labelled = labelled.where(F.col("s") >= first * step)
    if last is not None:
        labelled = labelled.where(F.col("s") < last * step + width)
    # Counted per step and burst before a row is copied to its windows.
    steps = (
        labelled.withColumn("_step", F.floor(F.col("s") / F.lit(step)).cast("long"))
        .groupBy("fileName", "channel_id", "_step", "burst_id").agg(F.count("*").alias("n"))
    )
    if per_window == 1:
        counts = steps.groupBy("fileName", "channel_id", F.col("_step").alias("window")).agg(
            F.sum("n").alias("spikes"), F.count("burst_id").alias("bursts"))
    else:
        counts = _slid(steps, per_window, first or 0, last)
    return (
        counts.withColumn("from_s", F.col("window") * F.lit(step))
        .withColumns(coordinates())
        .select("fileName", "channel_id", "x", "y", "from_s", "spikes", "bursts")
    )


def _slid(steps: DataFrame, per_window: int, first: int, last: int | None) -> DataFrame:
    """Spikes and bursts per window of `per_window` steps, by what enters and what leaves from window to window.

    The spikes of a step are in the windows from step - per_window + 1 to step. A burst
    that has spikes in several steps counts once: its windows begin behind those that the
    step before has covered. Running sums over the changes of an electrode, at most two
    for each step of the recording, hold from one change to the next; only these results
    are written out window by window.
    """
    key = ["fileName", "channel_id"]
    before = F.lag("_step").over(Window.partitionBy(*key, "burst_id").orderBy("_step"))
    begins = F.greatest(F.col("_step") - (per_window - 1), F.lit(first))
    ends = F.col("_step") + 1 if last is None else F.least(F.col("_step"), F.lit(last)) + 1
    burst = F.when(F.col("burst_id").isNotNull(), 1).otherwise(0).cast("long")
    change = lambda at, n, b: F.struct(at.alias("window"), n.alias("spikes"), b.alias("bursts"))
    zero = F.lit(0).cast("long")
    spans = steps.withColumn("_new", F.greatest(begins, F.coalesce(before + 1, begins))).withColumn("_end", ends)
    changes = spans.where(F.col("_end") > begins).select(*key, F.inline(F.array(
        change(begins, F.col("n"), zero), change(F.col("_new"), zero, burst), change(F.col("_end"), -F.col("n"), -burst))))
    summed = changes.groupBy(*key, "window").agg(F.sum("spikes").alias("spikes"), F.sum("bursts").alias("bursts"))
    order = Window.partitionBy(*key).orderBy("window")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = summed.select(
        *key, "window", F.lead("window").over(order).alias("_next"),
        F.sum("spikes").over(upto).alias("spikes"), F.sum("bursts").over(upto).alias("bursts")).where(F.col("spikes") > 0)
    windows = F.transform(F.sequence(F.col("window"), F.col("_next") - 1), lambda w: F.struct(w.alias("window")))
    return held.select(*key, "spikes", "bursts", F.inline(windows))


def _frame(width: float, step: float, start: float | None, end: float | None) -> tuple[int | None, int | None]:
    """Numbers of the first and the last window inside a time frame; the slack is for decimal fractions."""
    first = None if start is None else max(0, math.ceil(start / step - 1e-9))
    last = None if end is None else math.floor((end - width) / step + 1e-9)
    return first, last


def activity_map_frame(
    labelled: DataFrame, start: float, end: float, width: float = 1.0, step: float | None = None,
) -> DataFrame:
    """Spikes and bursts on the whole grid for every recording and window inside the time frame.

    0 stands for an electrode without a spike in the window; `not_used` marks
    electrodes without any in the recording.
    """
    step = float(step or width)
    counts = activity_map_windowed(labelled, width, step, start, end).drop("x", "y")
    first, last = _frame(width, step, start, end)
    used = labelled.select("fileName", "genotype", "channel_id").distinct()
    windows = F.explode(F.sequence(F.lit(first), F.lit(last))) if last >= first else F.explode(F.array().cast("array<int>"))
    grid = (
        on_grid(used.select("fileName", "genotype").distinct())
        .join(used.select("fileName", "channel_id", F.lit(True).alias("_used")), ["fileName", "channel_id"], "left")
        .withColumn("window", windows).withColumn("from_s", F.col("window") * F.lit(step))
    )
    zero = F.lit(0)
    return grid.join(counts, ["fileName", "channel_id", "from_s"], "left").select(
        "fileName", "genotype", "channel_id", "x", "y", "from_s",
        F.coalesce("spikes", zero).alias("spikes"), F.coalesce("bursts", zero).alias("bursts"),
        F.col("_used").isNull().alias("not_used"))


def raster_points(
    labelled: DataFrame, xlim: float = 1050, channel_min: int = 10, channel_max: int = 88,
) -> DataFrame:
    """Points of the spike raster inside the axis limits, with markers for the overlays.

    `in_syncspike` needs spikes that carry a syncspike_id, `in_syncburst` ones with the
    syncburst_id of their burst (`synchrony.label_burst_spikes`).
    """
    points = labelled.where(
        F.col("s").between(0.0, float(xlim)) & F.col("channel_id").between(channel_min, channel_max))
    columns = ["fileName", "genotype", "channel_id", "s", F.col("burst_id").isNotNull().alias("in_burst")]
    if "syncburst_id" in labelled.columns:
        columns.append(F.col("syncburst_id").isNotNull().alias("in_syncburst"))
    if "syncspike_id" in labelled.columns:
        columns.append(F.col("syncspike_id").isNotNull().alias("in_syncspike"))
    return points.select(*columns)


def write_raster(points: DataFrame, path: str) -> None:
    """Write the points clustered by recording, so that reading one skips the other files.

    Ranges are cut by row count, which also divides a large recording.
    """
    order = ["fileName", "channel_id", "s"]
    points.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
