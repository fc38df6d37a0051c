"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by page id and digest and dealt out to shards by ranges that end where so many
payload bytes are reached, which depends on the data alone. A
task streams its shards into files that roll by compressed size; a file is written under a temporary
name of the attempt and moved to its own name when complete, and a manifest, itself committed by
Spark, lists the files that count. So a task that is lost and run again, or run twice, leaves the
same archive. Payloads are shuffled once; which records are revisits is found from digests alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikeframe.llm.common import join_counted, kept

REVISIT_BYTES = 1000  # shorter payloads are written each time
SHARD_BYTES = 256 << 20  # payload
LEAST_SHARDS, LEAST_ROWS = 32, 64  # small inputs still make so many shards, of so many rows at least
FILE_BYTES = 16 << 20  # compressed: several files for a shard of usual pages
MOST_TASKS = 1 << 14  # beyond it a task writes several shards, one after the other
HEAD_BYTES = 512  # counted for the headers of a record
UNPACKED_ROWS = 64  # rows of a batch that a writer holds as Python values
SIGN = np.uint64(1 << 63)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest"


def _payload():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(digests: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of a larger id has too.

    `digests` has page_id, digest and bytes per page. A null id is smaller than any other. Rows that
    repeat the largest id are responses, all of them.
    """
    long = digests.where(F.col("bytes") >= REVISIT_BYTES)
    groups = kept(long.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows"))
                  .where("rows > 1 and refers_to is not null"), "payload-groups")
    joined = join_counted(long, groups, ["digest", "bytes"], groups.count(), "rows", "inner")
    return joined.where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _keys(ids: list, digests: list) -> np.ndarray:
    """Page ids and hexadecimal digests as bytes of one length, in the order of (id, null first; digest)."""
    out = np.zeros((len(ids), 49), np.uint8)
    out[:, 0] = [i is not None for i in ids]
    biased = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64) ^ SIGN
    out[:, 1:9] = np.where(out[:, :1] > 0, biased.astype(">u8").view(np.uint8).reshape(-1, 8), 0)
    out[:, 9:] = np.array(digests, "S40").view(np.uint8).reshape(-1, 40)
    return out.reshape(-1).view("S49")


def shard_limits(digests: DataFrame, rows: int, total: int) -> np.ndarray:
    """The smallest keys of the shards after the first.

    A shard ends at the first key of which so many bytes lie before that they fill it. The keys are in order
    over all tasks, so the limits depend only on ids, digests and sizes. One key for each shard comes to the
    driver, 49 bytes for SHARD_BYTES of payload.
    """
    size = max(1, min(SHARD_BYTES, -(-total // max(1, min(LEAST_SHARDS, -(-rows // LEAST_ROWS))))))
    order = F.col("page_id").asc_nulls_first(), F.col("digest").asc()
    keys = digests.groupBy("page_id", "digest").agg(F.sum(F.col("bytes") + HEAD_BYTES).alias("bytes"))
    parts = kept(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "warc-keys")
    before = lambda window: F.coalesce(F.sum("bytes").over(
        window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("part").agg(F.sum("bytes").alias("bytes")).select(
        "part", before(Window.orderBy("part")).alias("offset"))  # a row for each partition
    placed = parts.withColumn("within", before(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(offsets), "part")
    shard = F.floor((F.col("offset") + F.col("within")) / F.lit(size)).alias("shard")
    first = F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "digest")).alias("first")
    found = [r["first"] for r in placed.groupBy(shard).agg(first).collect()]
    return np.sort(_keys([r.page_id for r in found], [r.digest for r in found]))[1:]


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **fields,
            "WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _page_urn(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}:{copy}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None) -> bytes:
    """A response, or a revisit of page `refers_to` without the payload. Control characters in a url are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {} if url is None else {"WARC-Target-URI": re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)}
    fields |= {"WARC-Payload-Digest": _digest(payload)}
    if refers_to is None:
        return _record("response", _page_urn(page_id, digest, copy),
                       fields | {"Content-Type": "application/http; msgtype=response"}, http + payload)
    fields |= {"WARC-Refers-To": _page_urn(refers_to, digest, 0), "WARC-Profile": PROFILE}
    return _record("revisit", _page_urn(page_id, digest, copy), fields | {"Content-Type": "application/http; msgtype=response"}, http)


class _Files:
    """The files of one shard after the other, under temporary names until they are complete."""

    def __init__(self, directory: str, attempt: str, most: int):
        self.fs, self.base = fs.FileSystem.from_uri(directory)
        self.attempt, self.most, self.stream, self.done = attempt, most, None, []

    def write(self, shard: int, record: bytes) -> None:
        if self.stream is not None and (shard != self.shard or self.size >= self.most):
            self.close()
            self.number = self.number + 1 if shard == self.shard else 0
        elif self.stream is None:
            self.number = 0
        if self.stream is None:
            self.shard, self.size, self.records, self.hash = shard, 0, 0, hashlib.sha1()
            self.name = f"pages-{shard:06d}-{self.number:04d}.warc.gz"
            folder = f"{self.base}/_temporary/{self.attempt}"
            self.fs.create_dir(folder, recursive=True)
            self.at = f"{folder}/{self.name}"
            self.stream = self.fs.open_output_stream(self.at)
            self._member(_record("warcinfo", f"<urn:warc:{self.name}>", {
                "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        self._member(record)
        self.records += 1

    def _member(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
        packed = packer.compress(data) + packer.flush()
        self.stream.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream, to = None, f"{self.base}/{self.name}"
        if self.fs.get_file_info(to).type != fs.FileType.NotFound:
            self.fs.delete_file(to)  # of an attempt before, with the same content
        self.fs.move(self.at, to)
        self.done.append((self.name, self.shard, self.records, self.size, self.hash.hexdigest()))


def write_warc(pages: DataFrame, directory: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of `pages` below `directory`, a URI that all executors reach, and return the manifest.

    Needs page_id, url and html; null html is empty, a null url has no header, null ids go first, spread over
    shards by their digests. Repeated rows are written each, those of one id and payload in one shard.
    An empty table gives an empty manifest. Other columns are not written.
    """
    spark = pages.sparkSession
    digests = kept(pages.select("page_id", F.sha1(_payload()).alias("digest"), F.octet_length(_payload()).alias("bytes")), "digests")
    rows, total = digests.agg(F.count("*"), F.coalesce(F.sum(F.col("bytes") + HEAD_BYTES), F.lit(0))).first()
    limits = shard_limits(digests, rows, total)

    tasks = min(len(limits) + 1, MOST_TASKS)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(limits, _keys(ids.to_pylist(), hashes.to_pylist()), side="right"), pa.int32())

    columns = "page_id", "digest", "refers_to", "url", "payload"
    empty = F.lit(None)
    told = revisits(digests).select("page_id", "digest", "refers_to", empty.cast("string").alias("url"), empty.cast("binary").alias("payload"))
    told = told.select(F.lit(0).alias("kind"), *columns)
    written = pages.select("page_id", "url", _payload().alias("payload")).select(
        F.lit(1).alias("kind"), "page_id", F.sha1("payload").alias("digest"), empty.cast("long").alias("refers_to"), "url", "payload")
    # What a page refers to comes just before the page itself, so the writer needs no join.
    dealt = told.unionByName(written).withColumn("shard", shard_of("page_id", "digest"))
    dealt = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions(
        "shard", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files = _Files(directory, f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}", file_bytes)
        last, copy, refers_to = None, 0, None
        for batch in batches:
            parts = (batch.slice(k, UNPACKED_ROWS) for k in range(0, batch.num_rows, UNPACKED_ROWS))
            for row in (row for part in parts for row in part.to_pylist()):
                if (key := (row["page_id"], row["digest"])) != last:
                    last, copy, refers_to = key, 0, None
                if row["kind"] == 0:
                    refers_to = row["refers_to"]
                else:
                    files.write(row["shard"], page_record(row["page_id"], row["url"], row["payload"], row["digest"], copy, refers_to))
                    copy += 1
        files.close()
        names = ["file", "shard", "records", "bytes", "sha1"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in files.done], pa.schema(
            [("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    dealt.mapInArrow(write, "file string, shard int, records long, bytes long, sha1 string").write.parquet(f"{directory}/{MANIFEST}")
    return spark.read.parquet(f"{directory}/{MANIFEST}")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked; one member is held at a time."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(chunk)):
            break
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("an archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a wrong length or digest raises."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields, block


def read_warc(spark: SparkSession, directory: str, payload: bool = False) -> DataFrame:
    """The page records of all files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With `payload` also the bytes of responses. Length and digest of every block are checked.
    """
    listed = spark.read.parquet(f"{directory}/{MANIFEST}").select("file")
    names = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})

    def page_of(urn: str) -> int | None:
        page = urn.split(":")[2]
        return None if page == "null" else int(page)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(directory)
        schema = pa.schema(list(names.items()))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}") as stream:
                    for member in _members(stream):
                        fields, block = parse(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        refers = fields.get("WARC-Refers-To")
                        rows.append({
                            "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
                            "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]), "payload_digest": digest,
                            "record_type": fields["WARC-Type"], "refers_to": refers and page_of(refers)})
                        if payload:
                            rows[-1]["payload"] = body if refers is None else None
                            held += len(body)
                        if len(rows) >= 10_000 or held >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = max(1, listed.count())
    return listed.repartition(files).mapInArrow(read, schema + (", payload binary" if payload else ""))
