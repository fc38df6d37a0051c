"""Collocations: frequent phrases of two to five words, scored against what their parts would give by chance.

Words and word pairs are first counted in a sketch: two vectors of small counters by hash, summed as a
tree. A counter is never less than what it counts, so a suffix of the text that begins with a pair of a
low counter, in either vector, cannot begin a frequent phrase. The other suffixes, cut where they cannot go on, are merged in
each task and routed by their leading words to ranges of their order. In a range, pointers to the
suffixes go through a multikey three-way quicksort down to the most words: the sizes of the equal parts
are the counts, and parts below the least count are abandoned, at any depth. Only phrases that begin the
first or last suffix of a range may go on in another one; their counts are summed over the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spikeframe.llm.common import SPACES, kept

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
NO_LANG = "und"
SKETCH_BITS = 23  # counters of one of the two vectors, as a power of two; their size only sets the speed
CHUNKS = 64  # parts of a sketch that are summed by themselves
SUMMED = 64  # sketches that one step of the tree sums
HELD_WORDS, HELD_DISTINCT = 1 << 22, 1 << 20  # words that a task holds at a time, and distinct ones
CHUNK_BYTES = 1 << 20
RANGE_ROWS = 1 << 19  # suffixes of a range, about
END = "\n"  # behind each word of a phrase, while it is counted; no word has it

# A-Z in lower case, tabs as spaces, and the characters that end a piece as line ends.
_SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words(dict):
    """Numbers of words in order of appearance, from 1; 0 is the end of a piece and -1 nothing."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})
        self.list = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.list)
        self.list.append(word)
        return number


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size, cut before white space."""
    start, spaces = 0, SPACES.encode()
    while len(text) - start > CHUNK_BYTES:
        end = start + CHUNK_BYTES
        while end < len(text) and text[end] not in spaces:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def word_numbers(langs: list[str], texts: list[bytes], held: dict[str, tuple[Words, list[np.ndarray]]]) -> int:
    """Add the numbers of the words of all texts, by language, to `held`; returns how many words and ends were added."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        by_lang.setdefault(lang, []).append(text)
    added = 0
    for lang, own in by_lang.items():
        words, parts = held.setdefault(lang, (Words(), []))
        group, size = [], 0
        for text in [*own, None]:
            if text is None or size + len(text) > CHUNK_BYTES:
                for chunk in _chunks(b"\n".join(group)):
                    tokens = chunk.translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")
                    numbers = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
                    parts.append(numbers[numbers >= 0])
                    added += len(parts[-1])
                parts.append(np.zeros(1, np.int32))  # a piece does not go on in another text
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
    return added


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words, np.ndarray]]:
    """Language, words and their numbers in text order, some millions of words at a time. Columns: lang, text."""
    held, n = {}, 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for first in range(0, len(langs), 256):
            n += word_numbers(langs[first:first + 256], [t.as_py() for t in texts.slice(first, 256)], held)
            if n >= HELD_WORDS or max((len(w) for w, _ in held.values()), default=0) >= HELD_DISTINCT:
                yield from ((lang, words, np.concatenate(parts)) for lang, (words, parts) in held.items())
                held, n = {}, 0
    yield from ((lang, words, np.concatenate(parts)) for lang, (words, parts) in held.items())


def _places(lang: str, words: Words, numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both vectors: of each word by its number, and of the pair that begins at each position but the last."""
    seed = np.uint64(xxh64_intdigest(lang.encode()))
    hashes = np.fromiter(map(xxh64_intdigest, words.list), np.uint64, len(words.list)) ^ seed
    first, second = hashes * _FACTORS[0], (hashes * _FACTORS[1]) >> np.uint64(7)
    return _both(hashes ^ (hashes >> np.uint64(29)), bits), _both(first[numbers[:-1]] ^ second[numbers[1:]], bits)


def _both(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in the first vector and in the second, which lies behind it."""
    keys, shift = keys * _FACTORS[2], np.uint64(64 - bits)
    other = (keys ^ (keys >> np.uint64(31))) * _FACTORS[1]
    return np.stack([(keys >> shift).astype(np.int32), (other >> shift).astype(np.int32) + np.int32(1 << bits)])


def _sketch(rows: DataFrame, least: int, bits: int) -> tuple[DataFrame, dict[str, int]]:
    """Counters up to `least`, as rows (chunk, counts), and the number of words of each language."""
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, totals = np.zeros(2 << bits, kind), {}
        for lang, words, numbers in _gathered(batches):
            word, pair = _places(lang, words, numbers, bits)
            real = numbers > 0
            totals[lang] = totals.get(lang, 0) + int(real.sum())
            both = real[:-1] & real[1:]
            for half, own in enumerate(np.split(counters, 2)):
                for places in (word[half][numbers[real]], pair[half][both]):
                    added = np.bincount(places - np.int32(half << bits), minlength=1 << bits)
                    own[:] = np.minimum(added + own, least)
        if totals:
            chunks = counters.reshape(CHUNKS, -1)
            some = [k for k in range(CHUNKS) if chunks[k].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some + [-1] * len(totals), pa.int32()), pa.array([chunks[k].tobytes() for k in some] + [None] * len(totals), pa.binary()),
                 pa.array([None] * len(some) + list(totals), pa.string()), pa.array([None] * len(some) + list(totals.values()), pa.int64())],
                ["chunk", "counts", "lang", "n"])

    made = kept(rows.mapInArrow(count, "chunk int, counts binary, lang string, n long").withColumn("task", F.spark_partition_id()), "sketches")
    totals = made.where("chunk < 0").groupBy("lang").agg(F.sum("n").alias("n"))

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros((2 << bits) // CHUNKS, np.int64)
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(counts, kind)
        chunk, task = table.column("chunk")[:1], table.column("task")[:1]
        return pa.table({"chunk": chunk, "counts": [np.minimum(total, least).astype(kind).tobytes()], "task": task})

    parts = made.where("chunk >= 0").select("chunk", "counts", "task")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        step = parts.withColumn("task", F.floor(F.col("task") / F.lit(SUMMED)).cast("int"))
        parts = kept(step.groupBy("chunk", "task").applyInArrow(summed, "chunk int, counts binary, task int"), "sketches")
        tasks = -(-tasks // SUMMED)
        if tasks == 1:
            return parts, totals


def _suffixes(rows: DataFrame, often: object, bits: int, most_words: int) -> DataFrame:
    """The suffixes that may begin a frequent phrase, merged within a task: lang, suffix, words, n; and all such words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.unpackbits(np.frombuffer(often.value, np.uint8), bitorder="little").view(bool)
        for lang, words, numbers in _gathered(batches):
            word, pair = _places(lang, words, numbers, bits)
            texts = [w.decode() + END for w in words.list]
            times = np.bincount(numbers, minlength=len(texts))
            times[0] = 0
            some = np.flatnonzero((times > 0) & high[word].all(axis=0))
            yield _rows(lang, [texts[k] for k in some.tolist()], np.ones(len(some), np.int32), times[some])
            real = numbers > 0
            goes_on = np.append(real[:-1] & real[1:] & high[pair].all(axis=0), False)
            at = np.flatnonzero(goes_on)
            # the words of a suffix, 0 from where no pair of a high counter goes on
            table, alive = np.zeros((len(at), most_words), np.int32), np.ones(len(at), bool)
            table[:, 0] = numbers[at]
            for k in range(1, most_words):
                alive &= goes_on[np.minimum(at + k - 1, len(numbers) - 1)]
                table[alive, k] = numbers[at[alive] + k]
            order = np.lexsort(table.T[::-1])
            table = table[order]
            new = np.ones(len(table), bool)
            new[1:] = (table[1:] != table[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            n, table = np.diff(np.append(first, len(order))), table[first]
            length = (table > 0).sum(axis=1).astype(np.int32)
            for k in range(0, len(table), 1 << 16):
                part = table[k:k + (1 << 16)].tolist()
                joined = ["".join([texts[w] for w in row if w]) for row in part]
                yield _rows(lang, joined, length[k:k + (1 << 16)], n[k:k + (1 << 16)])

    def _rows(lang, suffixes, length, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(suffixes), pa.string()), pa.array(suffixes, pa.string()), pa.array(length, pa.int32()), pa.array(n, pa.int64())],
            ["lang", "suffix", "words", "n"])

    return kept(rows.mapInArrow(cut, "lang string, suffix string, words int, n long"), "suffixes")


def frequent_parts(table: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to rows of `table`, whose first column leads and 0 ends a row.

    Yields (a row, number of columns, count) for every equal part of at least `least`, from two columns on.
    Parts below `least` are abandoned: nothing in them can be frequent.
    """
    stack = [(np.arange(len(table)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows) or weight[rows].sum() < least:
            continue
        values = table[rows, depth]
        some = np.sort(values[:: max(1, len(values) // 15)])
        pivot = int(some[len(some) // 2])
        equal = rows[values == pivot]
        if len(equal) < len(rows):
            stack.append((rows[values < pivot], depth))
            stack.append((rows[values > pivot], depth))
        if depth and not pivot:
            continue  # these suffixes end here
        count = int(weight[equal].sum())
        if count >= least:
            if depth:
                yield int(equal[0]), depth + 1, count
            if depth + 1 < table.shape[1]:
                stack.append((equal, depth + 1))


def _phrases(suffixes: DataFrame, least: int, most_words: int) -> DataFrame:
    """lang, phrase (each word with its end), words and a, for phrases of two words or more."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        held = pa.Table.from_batches(held)
        lang, suffix, weight = held.column("lang").combine_chunks(), held.column("suffix").combine_chunks(), held.column("n").to_numpy()
        split = pc.split_pattern(suffix, END)  # the last part is empty
        numbers = pc.dictionary_encode(split.flatten()).indices.to_numpy() + 1
        starts = split.offsets.to_numpy()
        length = np.diff(starts) - 1
        codes = pc.dictionary_encode(lang)
        table = np.zeros((len(suffix), most_words + 1), np.int32)
        table[:, 0] = codes.indices.to_numpy() + 1
        for k in range(most_words):
            here = length > k
            table[here, k + 1] = numbers[starts[:-1][here] - starts[0] + k]
        # a language leads all rows, so that three columns are a phrase of two words
        found = {(lang[row].as_py(), _begin(suffix[row].as_py(), columns - 1)): (columns - 1, count)
                 for row, columns, count in frequent_parts(table, weight, least) if columns > 2}
        # what begins the first or the last suffix of the range is passed on whatever its count
        pairs = list(zip(lang.to_pylist(), suffix.to_pylist()))  # strings compare by code point, which is the order of their bytes
        for end in (min(range(len(pairs)), key=pairs.__getitem__), max(range(len(pairs)), key=pairs.__getitem__)):
            for k in range(2, int(length[end]) + 1):
                same = (table[:, : k + 1] == table[end, : k + 1]).all(axis=1)
                found[lang[end].as_py(), _begin(suffix[end].as_py(), k)] = k, int(weight[same].sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
             pa.array([v[0] for v in found.values()], pa.int32()), pa.array([v[1] for v in found.values()], pa.int64())],
            ["lang", "phrase", "words", "a"])

    rows = suffixes.where("words > 1")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    parts = rows.repartitionByRange(ranges, "lang", "suffix").mapInArrow(sort, "lang string, phrase string, words int, a long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _begin(suffix: str, words: int) -> str:
    return END.join(suffix.split(END, words)[:words]) + END


def _exact(name: str):
    return F.col(name).cast("decimal(38,0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """Per language the first `top` collocations: lang, rank, phrase, a, l, r, n, score.

    Needs text and lang. A null language is "und", as one with that name; a null or empty text has no
    words. Every row counts, also a repeated one. Phrases do not cross pieces or texts. Equal scores go
    by count, then by the bytes of the phrase. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("text") != "").select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    sketch, totals = _sketch(rows, min_count, sketch_bits)
    # one bit for each counter, whatever the corpus holds
    size, kind = (2 << sketch_bits) // CHUNKS, np.min_scalar_type(min_count)
    high = np.zeros((CHUNKS, size), bool)
    for chunk, counts in sketch.select("chunk", "counts").toLocalIterator():
        high[chunk] = np.frombuffer(bytes(counts), kind) >= min_count
    often = spark.sparkContext.broadcast(np.packbits(high, bitorder="little").tobytes())
    suffixes = _suffixes(rows, often, sketch_bits, max_words)
    words = suffixes.where("words = 1").groupBy("lang", "suffix").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    phrases = _phrases(suffixes, min_count, max_words)
    counts = kept(phrases.unionByName(words.select("lang", F.col("suffix").alias("phrase"), F.lit(1).alias("words"), "a")), "phrases")
    longer = counts.where("words > 1")

    # A phrase inside one that is as frequent: then one word more already is as frequent.
    parts = F.split(F.rtrim(F.col("phrase"), F.lit(END)), END, -1)
    joined = lambda first, n: F.concat(F.array_join(F.slice(parts, first, n), END), F.lit(END))
    inner = counts.where("words > 2").select(
        "lang", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    open_ = longer.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")

    cuts = open_.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = counts.select(F.col("lang"), F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumns({"_over": F.lit(1000) * _exact("a") * _exact("n"), "_under": _exact("l") * _exact("r")})
    scored = scored.withColumn("score", F.expr("_over div _under"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", F.rtrim(F.translate("phrase", END, " "), F.lit(" ")).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
