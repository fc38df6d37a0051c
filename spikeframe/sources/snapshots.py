"""Stage tables on disk, and summaries of several experiments put together."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of the stages.
STAGES = {
    "raw": "00_raw",
    "excl": "01_excl",
    "region": "02_region",
    "layer": "02a_layer",
    "length": "03_max",
    "active": "04_active",
    "bursts": "05_burstID",
    "spike_features": "06_spikeFeatures",
    "burst_features": "07_burstFeatures",
    "sync_bursts": "08_syncburstFeature",
    "sync_spikes": "09_syncspikeFeature",
    "norm": "10_NORM",
}


RECORD = "_record.json"
CHANNEL = ["fileName", "channel_id"]


def stage_path(directory: str, stage: str, prefix: str = "") -> str:
    return os.path.join(directory, f"{prefix}_{STAGES[stage]}")


class Stage:
    """The tables of a stage, and the record that makes them count.

    The record holds the parameters, and rows, schema and layout of each table. It is
    written after all tables, under another name first, and taken away before anything of
    the stage is written again. So tables without a record are those of a run that broke
    off: they are refused, and a run that resumes writes them anew.

    Tables with a recording and a channel are stored in buckets, sorted, so that later
    steps by channel need no shuffle. `channels` says that no channel is too large for
    one bucket file.
    """

    def __init__(self, spark: SparkSession, directory: str, stage: str, prefix: str = "", parameters: dict | None = None):
        self.spark, self.path = spark, stage_path(directory, stage, prefix)
        self.parameters = json.loads(json.dumps(parameters or {}))
        self.tables: dict[str, dict] = {}
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(self.path, name)
        self._files = self._at(RECORD).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def record(self) -> dict | None:
        """The record, or None where the stage is not finished."""
        if not self._files.exists(self._at(RECORD)):
            return None
        stream = self._files.open(self._at(RECORD))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def finished(self) -> bool:
        """Whether the stage can be read; one that was written with other parameters is an error."""
        if (record := self.record()) is None:
            return False
        if record["parameters"] != self.parameters:
            raise ValueError(f"{self.path} was written with {record['parameters']}, not {self.parameters}")
        return True

    def begin(self) -> Stage:
        self._files.delete(self._at(RECORD), False)
        return self

    def write(self, name: str, table: DataFrame, channels: bool = False) -> DataFrame:
        """Write a table and read it back. It counts once `commit` has been called."""
        path = self._files.makeQualified(self._at(name)).toString()
        buckets = 0
        if channels and set(CHANNEL) <= set(table.columns):
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        about = {"path": path, "schema": table.schema.jsonValue(), "buckets": buckets}
        if buckets:
            self._forget(path)
            writer = table.repartition(buckets, *CHANNEL).write.bucketBy(buckets, *CHANNEL).sortBy(*CHANNEL)
            writer.mode("overwrite").option("path", path).saveAsTable(_catalog_name(path))
        else:
            table.write.mode("overwrite").parquet(path)
        written = _stored(self.spark, about)
        about["rows"] = written.count()  # out of the footers
        self.tables[name] = about
        return written

    def _forget(self, path: str) -> None:
        # The files stay: a table with a path of its own only leaves the catalog.
        self.spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(path)}")

    def commit(self) -> None:
        text = json.dumps({"parameters": self.parameters, "tables": self.tables}, sort_keys=True)
        stream = self._files.create(self._at(RECORD + ".tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._files.rename(self._at(RECORD + ".tmp"), self._at(RECORD)):
            raise OSError(f"cannot write the record of {self.path}")

    def read(self, name: str) -> DataFrame:
        if (record := self.record()) is None:
            raise ValueError(f"{self.path} is not finished: it has no record")
        if name not in record["tables"]:
            raise ValueError(f"{self.path} has no table {name}")
        return _stored(self.spark, record["tables"][name])


def _catalog_name(path: str) -> str:
    return "spikeframe_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _stored(spark: SparkSession, about: dict) -> DataFrame:
    """A written table. The catalog of this session may not know its buckets yet."""
    schema = T.StructType.fromJson(about["schema"])
    if not about["buckets"]:
        return spark.read.schema(schema).parquet(about["path"])
    name, keys = _catalog_name(about["path"]), ", ".join(CHANNEL)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
              f"INTO {about['buckets']} BUCKETS LOCATION '{about['path']}'")
    return spark.table(name)


def write_stage(tables: dict[str, DataFrame], directory: str, stage: str, prefix: str = "") -> str:
    """Write the tables of a stage as Parquet, then its record, and return their folder."""
    whole = Stage(next(iter(tables.values())).sparkSession, directory, stage, prefix).begin()
    for name, table in tables.items():
        whole.write(name, table)
    whole.commit()
    return whole.path


def read_stage(spark: SparkSession, directory: str, stage: str, table: str, prefix: str = "") -> DataFrame:
    """A table of a finished stage; one that is not finished is an error."""
    return Stage(spark, directory, stage, prefix).read(table)


def write_summary_table(table: DataFrame, path: str) -> None:
    """Write the comparison of two groups as one CSV file: it has a row per variable."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stack_summaries(summaries: dict[str, DataFrame]) -> DataFrame:
    """Put summaries under each other with their key as `index`; missing columns are NULL."""
    out = None
    for index, summary in summaries.items():
        part = summary.withColumn("index", F.lit(index))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compile_summaries(
    spark: SparkSession, directory: str, stage: str = "norm", index: tuple[str, ...] = ("P5", "P15", "P60"),
) -> DataFrame:
    """Read the summaries written with these prefixes as one table with `index`."""
    return stack_summaries({prefix: read_stage(spark, directory, stage, "summary", prefix) for prefix in index})
