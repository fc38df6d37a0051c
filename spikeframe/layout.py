"""How the rows of a table spread over its recordings and channels.

Most operators read a channel in time order, and a plain window gives each
channel to one task. That holds until one channel, or one recording, has a
large share of all rows. So the library measures the row counts first
(`Layout.measure`, one narrow aggregation) and cuts every key above
`spark.spikeframe.rowsPerSlice` rows into time slices of about half as many
rows, at quantiles of the time. Ordered operators then work inside (key, slice)
and take what they need from the neighbouring slices out of a small carry table
with one row per slice of a cut key.

There is no limit on the number of cut keys. Each has more than rowsPerSlice
rows, so there are at most rows / rowsPerSlice of them, and about twice as many
slices; they are counted, and joined by broadcast only up to
`spark.spikeframe.broadcastRows`. When nothing is above the limit the plans are
plain windows.

The counts stay valid as upper limits after filters, so one measurement serves
a whole analysis.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .functions.channels import CHANNELS, channel_masks, members, members_n

ROWS_PER_SLICE = 1 << 22
BROADCAST_ROWS = 1_000_000
FEW_KEYS = 10_000
SLICES_PER_SHARE = 2  # slices for each rowsPerSlice rows of a cut key
ACCURACY = 20  # error of a quantile: at most this part of a slice of the largest key

CONSTANT = ("genotype", "maxRecording")  # a recording has one value of each

ROWS_PER_SLICE_CONF = "spark.spikeframe.rowsPerSlice"
BROADCAST_ROWS_CONF = "spark.spikeframe.broadcastRows"
SHARED_CONF = "spark.checkpoint.dir"


def rows_per_slice(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_SLICE_CONF, str(ROWS_PER_SLICE)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS)))


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    # Goes away with the process.
    return tempfile.TemporaryDirectory(prefix="spikeframe-")


def kept_folder(spark: SparkSession) -> str:
    """Where this application keeps intermediate tables: below the folder that spark.checkpoint.dir names.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    base = spark.conf.get(SHARED_CONF, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_CONF} to a folder that all executors share")
        base = f"file://{_local_folder().name}"
    # With its scheme, so that the path means the same to readers other than Spark.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base, f"spikeframe-{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/(?!/)", "file:///", files.makeQualified(path).toString())


def kept(table: DataFrame) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it back.

    The session is not changed. `discard_kept` removes the tables of an application.
    """
    path = f"{kept_folder(table.sparkSession)}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def discard_kept(spark: SparkSession) -> None:
    """Delete the kept tables of this application, when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Slicing:
    """The keys of a table and, for the heavy ones, where their time axis is cut."""

    keys: tuple[str, ...]
    column: str
    count: int  # number of keys
    hot: DataFrame | None = None  # keys, _bounds (where slices 1, 2, ... begin), _cuts (their number with slice 0)
    slices: int = 0  # of all cut keys
    longest: int = 0  # most slices of a key

    @classmethod
    def measure(cls, df: DataFrame, keys: list[str], position: str, column: str) -> Slicing:
        """Count the rows per key of any table and cut the heavy keys."""
        counts = _counts(df, keys)
        head = counts.agg(F.count("*").alias("keys"), F.max("_n").alias("peak")).first()
        return cls._cut(df, counts, keys, position, column, head["keys"], head["peak"])

    @classmethod
    def _cut(cls, df: DataFrame, counts: DataFrame, keys, position: str, column: str, count: int, peak: int | None) -> Slicing:
        spark = counts.sparkSession
        limit = rows_per_slice(spark)
        whole = cls(tuple(keys), column, count)
        if peak is None or peak <= limit:
            return whole
        heavy = kept(counts.where(F.col("_n") > limit).select(*keys, "_n"))
        size = heavy.agg(F.count("*").alias("keys"), F.max("_n").alias("peak")).first()
        if not size["keys"]:
            return whole
        at = F.col(position).cast("double")
        rows = df.select(*keys, at.alias("_at")).join(_hinted(heavy, size["keys"]), [*keys])
        # All keys get the quantiles of the largest one; a smaller key takes its share of them.
        most = math.ceil(size["peak"] / limit * SLICES_PER_SHARE)
        quantiles = rows.groupBy(*keys).agg(
            F.percentile_approx("_at", [k / most for k in range(1, most)], ACCURACY * most).alias("_all"),
            F.min("_at").alias("_lo"), F.max("_n").alias("_n"))
        parts = F.ceil(F.col("_n") / F.lit(limit) * SLICES_PER_SHARE)
        chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.get("_all", F.round(k * F.lit(most) / parts).cast("int") - 1))
        bounds = F.array_sort(F.array_distinct(F.filter(chosen, lambda b: b > F.col("_lo"))))
        hot = kept(quantiles.withColumn("_bounds", bounds).where(F.size("_bounds") > 0).select(
            *keys, "_bounds", (F.size("_bounds") + 1).alias("_cuts")))
        slices, longest = hot.agg(F.coalesce(F.sum("_cuts"), F.lit(0)), F.coalesce(F.max("_cuts"), F.lit(0))).first()
        return cls(tuple(keys), column, count, hot, slices, longest) if slices else whole

    def hinted(self, table: DataFrame, per_slice: int = 1) -> DataFrame:
        """A table with at most so many rows per slice of the cut keys, to be broadcast if that is few."""
        return _hinted(table, self.slices * per_slice)

    # ---- slices -------------------------------------------------------------

    @property
    def marker(self) -> list[str]:
        """Name of the column that is true for cut keys, if any key is cut.

        It is part of every window and grouping on the way, so that a filter on
        it moves down to the scan and a carry table only costs the cut keys.
        """
        return [] if self.hot is None else [f"{self.column}_cut"]

    @property
    def group(self) -> list[str]:
        """Columns whose combination is small enough for one task."""
        return [*self.keys] if self.hot is None else [*self.keys, *self.marker, self.column]

    def split(self, df: DataFrame, position: str) -> DataFrame:
        """Add the slice and the marker. The slice never decreases along `position` within a key."""
        if self.hot is None or self.column in df.columns:
            return df
        # Binary search for the number of bounds up to the position.
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(self.longest.bit_length()))])
        at = F.col(position).cast("double")
        part = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("_bounds", n + step - 1) <= at, n + step).otherwise(n))
        cut = F.col("_cuts").isNotNull()
        out = df.join(self.hinted(self.hot), [*self.keys], "left").withColumn(
            self.column, F.when(cut & F.col(position).isNotNull(), part).otherwise(0))
        if self.marker[0] not in df.columns:
            out = out.withColumn(self.marker[0], cut)
        return out.drop("_bounds", "_cuts")

    def mark(self, df: DataFrame) -> DataFrame:
        """Add the marker alone, ahead of an aggregation whose result will be split."""
        if self.hot is None or self.marker[0] in df.columns:
            return df
        marks = self.hot.select(*self.keys, F.lit(True).alias("_cut"))
        marked = df.join(self.hinted(marks), [*self.keys], "left")
        return marked.withColumn(self.marker[0], F.col("_cut").isNotNull()).drop("_cut")

    def window(self, *order: str) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*order)

    def only_hot(self, df: DataFrame) -> DataFrame:
        """Rows of the cut keys of a table that was split."""
        return df.where(F.col(self.marker[0]))

    def _carry(self, df: DataFrame, value: Column, over: WindowSpec, total) -> DataFrame:
        """One row per slice of a cut key with what it takes over from its neighbours.

        The aggregation is partial on the map side. The result is kept, or else
        every ordered step would compute all steps before it twice.
        """
        per_slice = self.only_hot(df).groupBy(*self.group).agg(value.alias("_value"))
        return kept(per_slice.select(*self.group, total("_value").over(over).alias("_carry")))

    def _attach(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        return df.join(self.hinted(carry), self.group, "left")

    def _earlier(self) -> WindowSpec:
        slices = Window.partitionBy(*self.keys).orderBy(self.column)
        return slices.rowsBetween(Window.unboundedPreceding, -1)

    def _later(self) -> WindowSpec:
        slices = Window.partitionBy(*self.keys).orderBy(F.desc(self.column))
        return slices.rowsBetween(Window.unboundedPreceding, -1)

    # ---- ordered columns ----------------------------------------------------

    def running_sum(self, df: DataFrame, name: str, value: Column, *order: str) -> DataFrame:
        """Sum of `value` from the first row of the key up to this row."""
        frame = self.window(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumn(name, F.sum(value).over(frame))
        if self.hot is None:
            return out
        carry = self._carry(df, F.sum(value), self._earlier(), F.sum)
        return (
            self._attach(out, carry)
            .withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop("_carry")
        )

    def previous(self, df: DataFrame, name: str, value: str, *order: str) -> DataFrame:
        """`value` of the row before, for a value that never decreases along `order`."""
        out = df.withColumn(name, F.lag(value).over(self.window(*order)))
        if self.hot is None:
            return out
        carry = self._carry(df, F.max(value), self._earlier(), F.max)
        return (
            self._attach(out, carry)
            .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
            .drop("_carry")
        )

    def following(self, df: DataFrame, name: str, value: str, *order: str) -> DataFrame:
        """`value` of the row after, for a value that never decreases along `order`."""
        out = df.withColumn(name, F.lead(value).over(self.window(*order)))
        if self.hot is None:
            return out
        carry = self._carry(df, F.min(value), self._later(), F.min)
        return (
            self._attach(out, carry)
            .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
            .drop("_carry")
        )

    # ---- lookups ------------------------------------------------------------

    def lookup(self, df: DataFrame, table: DataFrame, how: str = "inner", bounded: bool = True) -> DataFrame:
        """Join a table that has at most one row per key.

        `bounded` says that the table only has keys of the measured table, so
        their counted number decides on the broadcast. Any other table is counted,
        unless the measured one has so few keys that Spark's own size estimate
        will do. Where the join shuffles, rows of a heavy key are spread over
        salts and its table row is repeated.
        """
        on = [*self.keys]
        limit = broadcast_rows(df.sparkSession)
        if bounded:
            small = self.count <= limit
        else:
            small = (self.hot is not None or self.count > FEW_KEYS) and table.limit(limit + 1).count() <= limit
        if small:
            return df.join(F.broadcast(table), on, how)
        if self.hot is None:
            return df.join(table, on, how)
        parts = self.hinted(self.hot.select(*on, "_cuts"))
        salt = F.pmod(F.xxhash64(*df.columns), F.col("_cuts")).cast("int")
        left = df.join(parts, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_cuts")
        right = (
            table.join(parts, on, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_cuts"), F.lit(1)) - 1)))
            .drop("_cuts")
        )
        return left.join(right, [*on, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class Layout:
    """Row counts of a spike table by recording and by channel, and the ids of its channels."""

    recordings: Slicing
    channels: Slicing
    channel_ids: tuple[int, ...] = tuple(range(CHANNELS))

    @classmethod
    def measure(cls, spikes: DataFrame, position: str = "s") -> Layout:
        """Count the rows. The same pass checks that a recording has one genotype and one length; else it is an error."""
        constant = [c for c in CONSTANT if c in spikes.columns]
        low, high = channel_masks()
        files = _counts(spikes, ["fileName"], low.alias("low"), high.alias("high"), *[_varies(c).alias(f"_{c}") for c in constant])
        varies = F.when(F.exists(F.array(F.lit(False), *[F.col(f"_{c}") for c in constant]), lambda v: v), F.col("fileName"))
        head = files.agg(
            F.count("*").alias("files"),
            F.coalesce(F.sum(members_n(F.col("low")) + members_n(F.col("high"))), F.lit(0)).alias("channels"),
            F.bit_or("low").alias("low"), F.bit_or("high").alias("high"),
            F.max("_n").alias("peak"),
            F.count(varies).alias("varying"), F.min(varies).alias("first"), F.max(varies).alias("last"),
        ).first()
        if head["varying"]:
            names = head["first"] if head["varying"] == 1 else f"{head['first']} to {head['last']}"
            raise ValueError(f"{' or '.join(constant)} differs within {head['varying']} recordings: {names}")
        recordings = Slicing._cut(spikes, files, ["fileName"], position, "recording_slice", head["files"], head["peak"])
        keys, ids = ["fileName", "channel_id"], members(head["low"], head["high"])
        if head["peak"] is None or head["peak"] <= rows_per_slice(spikes.sparkSession):
            # No channel has more rows than its recording.
            return cls(recordings, Slicing(tuple(keys), "slice", head["channels"]), ids)
        counts = _counts(spikes, keys)
        return cls(recordings, Slicing._cut(spikes, counts, keys, position, "slice", head["channels"], head["peak"]), ids)


def _varies(column: str) -> Column:
    """Aggregate: whether a column has several values, of which a missing one is one."""
    some, missing = F.count(column), F.count("*") - F.count(column)
    return F.coalesce(F.min(column) < F.max(column), F.lit(False)) | ((some > 0) & (missing > 0))


def global_rank(table: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """Add the position of each row in the whole order, from 1, and the number of rows.

    Rows are sorted in ranges; the driver only sees the number of rows of each range. No task gets all rows.
    """
    parts = kept(table.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, rows in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += rows
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    place = within + F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else within
    return parts.withColumn(name, place.cast("int")).drop("_part"), before


def _counts(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*more, F.count("*").alias("_n"))


def _hinted(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= broadcast_rows(table.sparkSession) else table
