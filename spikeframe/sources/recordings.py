"""Spike detections from the text exports of the recording software.

An export has one part per channel: a line "t<TAB>id<TAB>id", a line that is
skipped, the column header, and rows with time in s, interval in ms and
frequency in Hz. Binned statistics follow after a line of their own, and every
line from there on is ignored, its "t<TAB>" line included. Lines may end in a
TAB, and numbers may have a decimal comma.

Files are read in splits, line by line, so a large export is divided between
tasks. A line gets its channel from the last channel line before it within its
split, or else from the splits before, which hand on one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..layout import Layout, kept
from ..operators.channels import stamp_channel_counts, tag_layers
from .metadata import base_name, listed_once
from .snapshots import read_stage, write_stage

# Fixed values of the export format.
CHANNEL_LINE = "t\t"
END_LINES = ("Bined Parameters:", "Binned Parameters:")


def read_lines(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Lines of all text files in the folder `path`: file, block, line and value.

    `block` is the first byte of the range of the file that holds the line, and `line` the
    byte at which the line begins, so the order is that of the file, whatever tasks read it.
    Ranges have `range_bytes`, by default spark.sql.files.maxPartitionBytes. The folder is
    read by pyarrow's file systems; for a store that only Spark's readers open there is
    `read_lines_in_splits`.
    """
    from .text_ranges import source

    spark.dataSource.register(source())
    if range_bytes is None:
        range_bytes = _bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if any(c in path for c in "*?[{"):
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        path = "\n".join(f.getPath().toString().replace("file:/", "/", 1) for f in found)  # one folder per line
    lines = spark.read.format("spikeframe_lines").option("rangeBytes", str(range_bytes)).load(path)
    return lines.select("file", "block", "line", "value")


def _bytes_of(size: str) -> int:
    """A size of the configuration: a number of bytes, or with one of the units b, k, m, g, t."""
    size = size.strip().lower().removesuffix("b")
    power = "kmgt".find(size[-1:]) + 1 if size[-1:].isalpha() else 0
    return int(size[:-1] if power else size) << 10 * power


def read_lines_in_splits(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's text reader, where the order of lines within a split rests on the order of its rows."""
    return spark.read.text(path, pathGlobFilter="*.txt").select(
        # The whole path: files of equal names in different folders are different files.
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Rows of a split come in file order.
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def _base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.txt$", "")


def _decoded(name: Column) -> Column:
    """File names come with % codes, but with a plain + sign."""
    return F.when(name.contains("%"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def _number(text: Column, decimal: str) -> Column:
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_lines(lines: DataFrame, decimal: str = ".") -> DataFrame:
    """Spikes with file, channel_id, seq, s, isi and frequency.

    `lines` has file, block, line and value; within a file, block and line give
    the order, and `block` grows by at least the number of lines per block.
    """
    value = F.col("value")
    one_tab_less = value.substr(F.lit(1), F.length(value) - value.endswith("\t").cast("int"))
    fields = F.split(one_tab_less, "\t")
    is_channel = value.startswith(CHANNEL_LINE)
    ends = F.rtrim(value).isin(*END_LINES)
    parsed = lines.select(
        "file", "block", "line",
        # Only lines that can hold a marker or a time go on, as numbers, into the shuffle.
        (is_channel | ends | value.rlike(r"^\s*[-+.,0-9]")).alias("used"),
        F.when(is_channel, F.trim(F.try_element_at(fields, F.lit(2))).try_cast("int")).alias("channel_line"),
        ends.alias("ends"),
        F.when(~is_channel & (F.size(fields) == 3), F.transform(fields, lambda f: _number(f, decimal))).alias("row"),
    ).select(
        "file", "block", "line", "used", "channel_line", "ends",
        F.col("row")[0].alias("s"), F.col("row")[1].alias("isi"), F.col("row")[2].alias("frequency"),
    )
    # A split has at most spark.sql.files.maxPartitionBytes of text.
    split = Window.partitionBy("file", "block").orderBy("line")
    here = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parsed.where("used").withColumns({
        "channel_here": F.last("channel_line", ignorenulls=True).over(here),
        "ended_here": F.max("ends").over(here),
        "number": F.row_number().over(split),
    })

    # What a split takes over from those before it: one row per split, out of a
    # scan that looks at the start of each line and converts no number.
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at_end = parsed.groupBy("file", "block").agg(
        F.max_by("channel_line", F.when(F.col("channel_line").isNotNull(), F.col("line"))).alias("last_channel"),
        F.max("ends").alias("ended"),
    )
    carry = at_end.select(
        "file", "block",
        F.last("last_channel", ignorenulls=True).over(blocks).alias("channel_before"),
        F.coalesce(F.max("ended").over(blocks), F.lit(False)).alias("ended_before"),
    )
    spikes = placed.join(carry, ["file", "block"]).where(
        F.col("s").isNotNull() & ~F.col("ended_here") & ~F.col("ended_before"))
    return spikes.select(
        "file",
        F.coalesce("channel_here", "channel_before").alias("channel_id"),
        # A line has at least one byte, so numbers of different splits do not meet.
        (F.col("block") + F.col("number")).alias("seq"),
        "s", "isi", "frequency",
    ).where(F.col("channel_id").isNotNull())


def stamp_recordings(parsed: DataFrame, meta: DataFrame, region: bool = False) -> DataFrame:
    """Give parsed spikes the metadata columns; files without metadata drop out.

    File names, without their folders, match with or without ".txt"; the spelling
    of the metadata stays.
    """
    columns = ["genotype", "maxRecording"] + (["region"] if region else [])
    listed = listed_once(meta, **{c: F.col(c) for c in columns}).withColumn("_file", base_name())
    named = parsed.withColumn("_file", _base_name(_decoded(F.substring_index("file", "/", -1))))
    # The metadata table is read from a file, so Spark knows its size.
    return named.join(listed, "_file").drop("_file", "file")


def compile_recordings(
    spark: SparkSession, meta: DataFrame, path: str,
    decimal: str = ".", layers: bool = False, directory: str | None = None, prefix: str = "",
    reader: Callable[[SparkSession, str], DataFrame] = read_lines,
) -> tuple[DataFrame, Layout]:
    """Read all recordings that the metadata list: the raw spike table and its layout.

    `layers` adds region and layer. The text is parsed once: the parsed spikes are
    written to the shared folder, and counted and stamped from there. With a
    `directory` the finished table is written as the raw stage and read back.
    """
    check_one_file(spark, meta, path)
    parsed = stamp_recordings(parse_lines(reader(spark, path), decimal), meta, region=layers)
    spikes, layout = finish_spikes(kept(parsed), meta, layers)
    if directory is not None:
        write_stage({"spikes": spikes}, directory, "raw", prefix)
        spikes = read_stage(spark, directory, "raw", "spikes", prefix)
    return spikes, layout


def check_one_file(spark: SparkSession, meta: DataFrame, path: str) -> None:
    """Raise if two files under `path` belong to one recording of the metadata. Only lists the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(
        _base_name(_decoded(F.substring_index("_metadata.file_path", "/", -1))).alias("_file"), "path")
    listed = meta.select(base_name().alias("_file")).distinct()
    double = files.join(listed, "_file", "left_semi").groupBy("_file").agg(
        F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).where("n > 1")
    if found := double.orderBy("_file").take(20):
        raise ValueError("several files for one recording: " + "; ".join(f"{r.first}, {r.last}" for r in found))


def finish_spikes(spikes: DataFrame, meta: DataFrame, layers: bool = False) -> tuple[DataFrame, Layout]:
    """Add the channel counts (and layers) and put the columns in order."""
    layout = Layout.measure(spikes)
    spikes = stamp_channel_counts(spikes, layout)
    names = [f.name for f in schemas.SPIKES.fields]
    if layers:
        spikes = tag_layers(spikes, meta, layout)
        names[2:2] = ["region", "layer"]
    return spikes.select(*names), layout
