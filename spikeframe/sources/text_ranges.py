"""A data source of text lines with the byte at which each begins, read by ranges of the files."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource


def source() -> type[DataSource]:
    """The data source class. Defined in a function, so that it travels to the executors by value."""
    from collections.abc import Iterator
    from dataclasses import dataclass

    import pyarrow as pa
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    CHUNK = 1 << 20

    def opened(path: str):
        from pyarrow import fs

        if "://" in path or path.startswith("file:"):
            return fs.FileSystem.from_uri(path)
        return fs.LocalFileSystem(), path

    def chunks(stream, start: int, size: int) -> Iterator[bytes]:
        stream.seek(start)
        while data := stream.read(size):
            yield data

    def lines_of(stream, start: int, end: int, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
        """(first byte, line) of the lines that begin in [start, end); a line ends at \n, \r or \r\n.

        Reading begins two bytes before the range, which tell whether a line begins at its first byte.
        """
        at = max(0, start - 2)
        held, begins = b"", at  # what is read of the current line, and where that begins
        skipped = at > 0  # the first piece may be the end of a line that began before
        after_return = False
        for data in chunks(stream, at, size):
            if after_return and data[:1] == b"\n":
                data, begins = data[1:], begins + 1
            after_return = False
            first = 0
            # \r and \r\n as \n would move the bytes, so line ends are looked for one by one
            while True:
                feed, ret = data.find(b"\n", first), data.find(b"\r", first)
                stop = min((p for p in (feed, ret) if p >= 0), default=-1)
                if stop < 0:
                    break
                line = held + data[first:stop]
                if not skipped and begins >= start:
                    if begins >= end:
                        return
                    yield begins, line
                skipped = False
                width = 2 if data[stop:stop + 2] == b"\r\n" else 1
                after_return = data[stop:] == b"\r"
                begins, held = begins + len(line) + width, b""
                first = stop + width
            held += data[first:]
            if begins >= end and not skipped:
                return
        if held and not skipped and start <= begins < end:
            yield begins, held

    @dataclass
    class Range(InputPartition):
        path: str
        name: str
        start: int
        end: int

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.size = options["path"], int(options.get("rangeBytes", 1 << 27))

        def partitions(self):
            from urllib.parse import quote

            from pyarrow import fs

            files = []
            for path in self.path.split("\n"):
                store, base = opened(path)
                about = store.get_file_info(base)
                files += store.get_file_info(fs.FileSelector(base)) if about.type == fs.FileType.Directory else [about]
            ranges = [
                # names are percent-encoded, as Spark's own readers give them
                Range(f.path, quote(f.path), start, min(start + self.size, f.size))
                for f in sorted(files, key=lambda f: f.path)
                if f.type == fs.FileType.File and f.base_name.endswith(".txt") for start in range(0, f.size, self.size)]
            return ranges or [Range("", "", 0, 0)]

        def read(self, partition):
            schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.string())])
            if not partition.path:
                return
            store, _ = opened(self.path.split("\n")[0])
            with store.open_input_file(partition.path) as stream:
                numbers, values, held = [], [], 0

                def batch():
                    n = len(numbers)
                    return pa.RecordBatch.from_arrays(
                        [pa.array([partition.name] * n, pa.string()), pa.array([partition.start] * n, pa.int64()),
                         pa.array(numbers, pa.int64()), pa.array(values, pa.string())], schema=schema)

                for at, line in lines_of(stream, partition.start, partition.end):
                    if not at:
                        line = line.removeprefix(b"\xef\xbb\xbf")
                    numbers.append(at)
                    values.append(line.decode(errors="replace"))
                    held += len(line)
                    if len(numbers) >= 10_000 or held >= 1 << 22:
                        yield batch()
                        numbers, values, held = [], [], 0
                if numbers:
                    yield batch()

    class Lines(DataSource):
        cut = staticmethod(lines_of)

        @classmethod
        def name(cls):
            return "spikeframe_lines"

        def schema(self):
            return "file string, block long, line long, value string"

        def reader(self, schema):
            return Reader(self.options)

    return Lines
