"""Packing documents into training sequences by harmonic classes.

A class holds pieces of at most 1/k of a sequence, and its bins are filled with exactly k pieces. A
document is cut into whole sequences, then into pieces of exactly 1/2, 1/4, ... of one, whose bins
are full; what remains is shorter than SMALLEST and goes, uncut, to the class of its length. Every
partition fills its own bins: nothing is shuffled, and only open bins are held in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import groups, word_chunks

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
SMALLEST = 128  # pieces of exact classes are not shorter
END_ID = 1
CACHED = 800_000  # words whose ids a worker remembers
CACHED_BYTES = 48


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit integers.

    This tokenizer drops white space and never looks across it, so the ids of a text are those of
    its words, one after the other.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[word] = packed
        return packed

    def learn(self, words: set[bytes]) -> None:
        """Encode new words together, which costs less than one by one; offsets tell whose the ids are.

        A full stop or comma at the end, after a letter or digit, is a token sequence of its own, so
        words are encoded without it.
        """
        new = [w for w in words if w not in self and len(w) <= CACHED_BYTES]
        if len(self) + 2 * len(new) > CACHED:
            self.clear()
            new = [w for w in words if len(w) <= CACHED_BYTES][: CACHED // 2]
        stems = {w: w.rstrip(b".,") for w in new if w[-1:] in (b".", b",")}
        stems = {w: stem for w, stem in stems.items() if stem[-1:].isalnum()}
        plain = [w for w in new if w not in stems]
        plain += {stem for stem in stems.values() if stem not in self}.difference(plain)
        for k in range(0, len(plain), 1000):
            part = plain[k:k + 1000]
            texts = [w.decode() for w in part]
            starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            first = np.searchsorted([o[0] for o in encoded.offsets], starts) * 4
            packed = np.array(encoded.ids, "<u4").tobytes()
            self.update((w, packed[i:j]) for w, i, j in zip(part, first.tolist(), first[1:].tolist()))
        self.update((w, self[stem] + self[w[len(stem):]]) for w, stem in stems.items())

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; texts are taken together up to a bounded size."""
        for group in groups(texts):
            if len(group) == 1:
                chunks = []
                for words in word_chunks(group[0]):
                    self.learn(set(words))
                    chunks.append(b"".join(map(self.__getitem__, words)))
                yield b"".join(chunks)
                continue
            split = [_words(text) for text in group]
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.__getitem__, words))


def _words(text: bytes) -> list[bytes]:
    """The words, in ASCII lower case as the tokenizer has them, unless that could make up a special token."""
    return (text if b"<|" in text else text.lower()).split()


@cache
def word_ids(path: str) -> WordIds:
    """The words a worker has seen, for all tasks that it runs."""
    return WordIds(path)


def cut(length: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces, size = [], capacity
    while length >= smallest:
        while length >= size:
            pieces.append(size)
            length -= size
        size //= 2
    return pieces + [length] * (length > 0)


class Bins:
    """The open bins of one partition: one for each class, filled with a fixed number of pieces."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.open: dict[int, list[tuple]] = {}
        self.next_id, self.capacity, self.rows = first_id, capacity, []

    def add(self, piece: tuple) -> None:
        """piece: (doc_id, start, length, crc, doc_tokens)"""
        per_bin = self.capacity // piece[2]
        bin = self.open.setdefault(per_bin, [])
        bin.append(piece)
        if len(bin) == per_bin:
            self.close(self.open.pop(per_bin))

    def close(self, bin: list[tuple]) -> None:
        offset = 0
        for piece in bin:
            self.rows.append((*piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1

    def finish(self) -> None:
        """What is left of all classes shares bins, the longest pieces first."""
        left = sorted((p for bin in self.open.values() for p in bin), key=lambda p: -p[2])
        bins: list[tuple[int, list]] = []
        self.open = {}
        while left:
            room, bin, rest = self.capacity, [], []
            for piece in left:
                if piece[2] <= room:
                    bin.append(piece)
                    room -= piece[2]
                else:
                    rest.append(piece)
            bins.append((room, bin))
            left = rest
        for _, bin in bins:
            self.close(bin)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `path` is the tokenizer's file, at the same place on all executors. Needs doc_id and text; a null
    or blank text is the end id alone. Every row is packed, also a repeated one; an empty table gives
    an empty table. Sequence ids tell partitions apart by their upper bits. Packings depend on the
    partitions of `docs`, which a scan deals out alike each time.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type = docs.schema["doc_id"].dataType
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins, kind = word_ids(path), Bins(TaskContext.get().partitionId() << 40, capacity), None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*bins.rows)) or [()] * len(names)
            bins.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, packed in zip(batch.column(0).to_pylist(), words.of(batch.column(1).to_pylist())):
                ids = memoryview(packed + end)
                total, start = len(ids) // 4, 0
                for length in cut(total, capacity):
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    bins.add((doc_id, start, length, crc, total))
                    start += length
                if len(bins.rows) >= 50_000:
                    yield rows()
            yield rows()
        if kind is not None:
            bins.finish()
            yield rows()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    schema = ", ".join([f"doc_id {id_type.simpleString()}", *[f"`{n}` long" for n in names[1:]]])
    return docs.select("doc_id", text).mapInArrow(work, schema)
