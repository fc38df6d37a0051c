"""Alignment of the tokens of two tokenizers, and how often their tokens end together in the corpus.

A text is cut into units that no token of either vocabulary crosses; a worker aligns each distinct unit
once. The first pass gives the distinct linked id pairs and partial counts. The distinct pairs go to
buckets of a minimal perfect hash function, which keeps them as verified keys; partial counts become
dense vectors by index, which are summed as a tree, some at a time. The second pass aligns the texts
again and looks the counts of their links up.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import groups, hash_pair, join_counted, kept
from spikeframe.llm.perfect_hash import LEVELS, PerfectHash, mixed

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
B_BITS = 24  # a pair is one number: A id << B_BITS | B id
CACHED, CACHED_CHARS = 600_000, 1 << 24  # units that a worker remembers, and their bytes together
GROUP_CHARS = 1 << 21  # texts that are aligned together
FLUSH_PAIRS = 1 << 20  # pairs that a task holds before it passes their counts on
BUCKET_KEYS = 1 << 15  # distinct pairs of a bucket, about
SUMMED = 64  # vectors that one step of the tree sums
BROADCAST_PAIRS = 1 << 22  # a counted table of at most so many pairs (17 bytes each) goes to all tasks

_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_UNIT = re.compile("[ \n]+[^ \n.,]*|[.,]+[^ \n.,]*")
_APART = re.compile("[^A-Za-z.,][.,]")  # a full stop or comma that may belong to what is before it
_CROSSES = re.compile("[A-Za-z][.,]")
_PLAIN = re.compile(" [!-~]+")  # units of ASCII that can stand behind each other: all begin with a space
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: words of byte-level vocabularies
_MARK = "▁"  # how vocabulary B writes a space
_PRINTED = re.compile("[ -~\n\u00a1-\u00ac\u00ae-\u024f]*")  # in these texts every part ends with a printed character


@cache
def _bytes_of_unicode() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (a public convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Column:
    """A column of numbers that grows; `of` is a view of all."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.empty(self.n + len(values), self.held.dtype)])
        self.held[self.n:self.n + len(values)] = values
        self.n += len(values)

    @property
    def of(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Both tokenizers, and what the units seen so far come to: a worker keeps them over its tasks and passes."""

    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        back = _bytes_of_unicode()
        vocabulary = sorted((i, bytes(back[c] for c in token)) for token, i in self.a.get_vocab(with_added_tokens=False).items())
        if [i for i, _ in vocabulary] != list(range(len(vocabulary))):
            raise ValueError("the ids of a vocabulary have gaps")
        self.bytes_a, self.bytes_b = [token for _, token in vocabulary], []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
            if _MARK in piece.lstrip(_MARK) or ("\n" in piece and len(piece) > 1) or _CROSSES.search(piece):
                raise ValueError("pieces of this vocabulary cross units; texts cannot be cut into them")
        # Merges in the order of the ids are ranks, which another library goes through faster. It is asked for ASCII
        # alone, where both split words alike.
        merges = json.loads(self.a.to_str())["model"]["merges"]
        of = self.a.get_vocab(with_added_tokens=False)
        ranked = len(merges) + 256 == len(of) and all(of["".join(m)] == 256 + k for k, m in enumerate(merges))
        self.ranks = ranked and tiktoken.Encoding(
            "units", pat_str=_WORDS, mergeable_ranks={token: i for i, token in vocabulary}, special_tokens={})
        self.sizes = [np.array([len(token) for token in tokens], np.int64) for tokens in (self.bytes_a, self.bytes_b)]
        numbers = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.printed = {end: np.array([n + end for n in numbers], object) for end in (",", "|", ";", "")}
        self.before, self.version = len(self.b.encode("\n")), 0
        self.forget()

    def forget(self) -> None:
        """Drop all units; their numbers mean nothing any more."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # token groups as text, by the number of the unit
        self.held, self.version = 0, self.version + 1
        self.pairs = _Column(np.int64)
        self.n_a, self.n_b, self.links, self.first = (_Column(np.int64) for _ in range(4))  # n_a is -1 where the tokens do not spell the unit

    def _tokens_a(self, units_: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The A tokens of units, one unit after the other, and how many each has."""
        plain = np.fromiter((bool(self.ranks and _PLAIN.fullmatch(u)) for u in units_), bool, len(units_))
        joined = np.array(self.ranks.encode_ordinary("".join(compress(units_, plain))) if plain.any() else [], np.int64)
        others = [e.ids for e in self.a.encode_batch_fast(list(compress(units_, ~plain)), add_special_tokens=False)]
        n = np.zeros(len(units_), np.int64)
        n[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        n[plain] = np.diff(np.searchsorted(np.cumsum(self.sizes[0][joined]), np.append(0, np.cumsum(size[plain])), side="right"))
        ids, from_joined = np.empty(int(n.sum()), np.int64), np.repeat(plain, n)
        ids[from_joined] = joined
        ids[~from_joined] = np.fromiter(chain.from_iterable(others), np.int64, int(n[~plain].sum()))
        return ids, n

    def learn(self, new: list[str]) -> None:
        """Tokenize and align new units together."""
        data = [u.encode() for u in new]
        size = np.fromiter(map(len, data), np.int64, len(data))
        # after a line end nothing is put in front of the unit
        of_b = [x[self.before:] for x in self.b.encode(["\n" + u for u in new], num_threads=1)]
        n_b = np.fromiter(map(len, of_b), np.int64, len(new))
        a, n_a = self._tokens_a(new, size)
        b = np.fromiter(chain.from_iterable(of_b), np.int64, int(n_b.sum()))
        # do the tokens spell their units?
        units_a, units_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        good = np.ones(len(new), bool)
        for ids, unit, tokens, sizes in ((a, units_a, self.bytes_a, self.sizes[0]), (b, units_b, self.bytes_b, self.sizes[1])):
            good &= np.bincount(unit, weights=sizes[ids], minlength=len(new)) == size
            if b"".join(map(tokens.__getitem__, ids.tolist())) != b"".join(data):
                ends = np.searchsorted(unit, np.arange(len(new) + 1)).tolist()
                for k, d in enumerate(data):
                    good[k] &= b"".join(map(tokens.__getitem__, ids[ends[k]:ends[k + 1]].tolist())) == d
        if not good.all():
            a, b = a[good[units_a]], b[good[units_b]]
        # over all units, one behind the other: where do tokens of both end?
        ends_a, ends_b, ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]), np.cumsum(size[good])
        shared, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = np.zeros(len(new), np.int64)
        links[good] = np.bincount(np.searchsorted(ends, shared), minlength=int(good.sum()))
        # the tokens of a group as text: those of A, then those of B
        group_a, group_b = np.searchsorted(at_a, np.arange(len(a))), np.searchsorted(at_b, np.arange(len(b)))
        text = np.empty(len(a) + len(b), object)
        last = self.printed[","][a]
        last[at_a] = self.printed["|"][a[at_a]]
        text[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = last
        last = self.printed[","][b]
        last[at_b] = np.where(np.isin(shared, ends, assume_unique=True), self.printed[""][b[at_b]], self.printed[";"][b[at_b]])
        text[np.arange(len(b)) + at_a[group_b] + 1] = last
        text, at = text.tolist(), np.cumsum(np.append(0, (n_a + n_b) * good)).tolist()
        self.groups += ["".join(text[i:j]) for i, j in zip(at, at[1:])]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.first.add(self.pairs.n + np.cumsum(links) - links)
        self.pairs.add(a[at_a] << B_BITS | b[at_b])
        for column, values in ((self.n_a, np.where(good, n_a, -1)), (self.n_b, n_b), (self.links, links)):
            column.add(values)
        self.held += int(size.sum())

    def texts(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """The units of each text by number, none for texts without tokens; some texts at a time, for which the numbers hold."""
        for group in groups(texts, GROUP_CHARS):
            split = [units(text) if text else [] for text in group]
            every = set().union(*split)
            new = list(every - self.known.keys())
            if len(self.known) + len(new) > CACHED or self.held > CACHED_CHARS:
                self.forget()
                new = list(every)
            if new:
                self.learn(new)
            found = [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in split]
            yield [own if (self.n_a.of[own] >= 0).all() else own[:0] for own in found]

    def pairs_of(self, numbers: np.ndarray) -> np.ndarray:
        """The linked pairs of units, one unit after the other."""
        links = self.links.of[numbers]
        ends = np.cumsum(links)
        return self.pairs.of[np.arange(int(links.sum())) + np.repeat(self.first.of[numbers] - (ends - links), links)]


def units(text: str) -> list[str]:
    """The parts of a text behind a space, cut before spaces and line ends that follow a printed character,
    and before full stops and commas that follow a letter.

    Both tokenizers begin a token there. Where the character before is one of the white space of either
    tokenizer, or of no class at all, the parts stay together.
    """
    text = " " + text
    parts = _UNIT.findall(text)
    if _PRINTED.fullmatch(text) and not _APART.search(text):
        return parts
    out, held = [], ""
    for part in [*parts, None]:
        if held and (part is None or (held[-1] in _LETTERS if part[0] in ".," else held[-1].isprintable() and held[-1] not in " " + _MARK)):
            out.append(held)
            held = ""
        held += part or ""
    return out


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(path_a, path_b)


def _counts_by_task(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """First pass: linked pairs with their counts, each pair once for a flush of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, flushed = aligner(path_a, path_b), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(pairs)).astype(np.int64)

        def flush(pairs, times):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times), pa.array(np.full(len(pairs), flushed, np.int32))], ["pair", "n", "flush"])

        for batch in batches:
            for found in both.texts(batch.column(0).to_pylist()):
                times = np.bincount(np.concatenate(found))
                used = np.flatnonzero(times)
                held.append((both.pairs_of(used), np.repeat(times[used], both.links.of[used])))
                if sum(len(p) for p, _ in held) >= FLUSH_PAIRS:
                    held = [merged()]
                    if len(held[0][0]) >= FLUSH_PAIRS // 2:
                        yield flush(*held.pop())
                        flushed += 1
        if held:
            yield flush(*merged())

    return kept(rows.mapInArrow(count, "pair long, n long, flush int").withColumn("task", F.spark_partition_id()), "pair-counts")


def _buckets(pairs: int) -> int:
    return max(1, -(-pairs // BUCKET_KEYS))


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(pairs.view(np.uint64), LEVELS) % np.uint64(buckets)).astype(np.int32)


def _functions(distinct: DataFrame) -> DataFrame:
    """The perfect hash function of every bucket: bucket, keys, and its parts as bytes."""

    def build(table: pa.Table) -> pa.Table:
        # in order, so that the function does not depend on the order of the shuffle
        made = PerfectHash.of(np.sort(table.column("pair").to_numpy()).view(np.uint64))
        bits, sizes, keys = made.parts()
        return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([len(made.keys)]), "bits": [bits], "sizes": [sizes], "pairs": [keys]})

    return kept(distinct.groupBy("bucket").applyInArrow(build, "bucket int, keys long, bits binary, sizes binary, pairs binary"), "perfect-hash")


def pair_counts(partial: DataFrame) -> tuple[DataFrame, int]:
    """Per bucket the pairs by index and their counts, as bytes of 64-bit numbers, and the number of pairs.

    `partial` has pair, n, task and flush. No task holds more than SUMMED vectors of a bucket at a time.
    """
    number = partial.select("pair").distinct().count()
    buckets = _buckets(number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_bucket(batch.column(0).to_numpy(), buckets))], [*batch.schema.names, "bucket"])

    placed = partial.mapInArrow(place, "pair long, n long, flush int, task int, bucket int")
    functions = _functions(placed.select("bucket", "pair").distinct())

    # flushes in groups of SUMMED: every (bucket, group) becomes one vector
    total = partial.select("task", "flush").distinct().count()
    branches = max(1, -(-total // SUMMED))
    grouped = placed.withColumn("group", F.pmod(F.xxhash64("task", "flush"), F.lit(branches)).cast("int"))
    cells = kept(grouped.select("bucket", "group").distinct(), "cells")
    cut = functions.join(cells, "bucket")

    def vector(rows: pa.Table, function: pa.Table) -> pa.Table:
        if not function.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "group": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        made = PerfectHash.from_parts(*(function.column(c)[0].as_py() for c in ("bits", "sizes", "pairs")))
        at = made.index(rows.column("pair").to_numpy().view(np.uint64))
        if (at < 0).any():
            raise ValueError("a pair is not among the keys of its bucket")
        counts = np.zeros(len(made.keys), np.int64)
        np.add.at(counts, at, rows.column("n").to_numpy())
        return pa.table({"bucket": function.column("bucket")[:1], "group": function.column("group")[:1], "counts": [counts.tobytes()]})

    vectors = kept(grouped.groupBy("bucket", "group").cogroup(cut.groupBy("bucket", "group")).applyInArrow(
        vector, "bucket int, group int, counts binary"), "vectors")

    def summed(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(v, np.int64) for v in table.column("counts").to_pylist())
        return pa.table({"bucket": table.column("bucket")[:1], "group": table.column("group")[:1], "counts": [counts.tobytes()]})

    while branches > 1:
        branches = -(-branches // SUMMED)
        step = vectors.withColumn("group", F.floor(F.col("group") / F.lit(SUMMED)).cast("int"))
        vectors = kept(step.groupBy("bucket", "group").applyInArrow(summed, "bucket int, group int, counts binary"), "vectors")
    return functions.join(vectors.select("bucket", "counts"), "bucket"), number


def _counted(table: DataFrame) -> DataFrame:
    """Rows pair, count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pairs, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["pair", "count"])

    return table.select("pairs", "counts").mapInArrow(rows, "pair long, count long")


def _sums(values: np.ndarray, group: np.ndarray, groups_: int) -> np.ndarray:
    """Whole-number sums per group, which bincount would take through doubles."""
    out = np.zeros(groups_, np.int64)
    np.add.at(out, group, values)
    return out


class Counts:
    """The functions and vectors of all buckets, and the highest count of each B id."""

    def __init__(self, buckets: int, rows: list, most: list):
        self.buckets = buckets
        self.functions = {r.bucket: PerfectHash.from_parts(r.bits, r.sizes, r.pairs) for r in rows}
        self.counts = {r.bucket: np.frombuffer(r.counts, np.int64) for r in rows}
        self.most = np.zeros(max((r.b for r in most), default=0) + 1, np.int64)
        self.most[[r.b for r in most]] = [r.most for r in most]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, and whether it is the highest of its B id."""
        bucket, counts = _bucket(pairs, self.buckets), np.empty(len(pairs), np.int64)
        for b in np.unique(bucket).tolist():
            here = np.flatnonzero(bucket == b)
            at = self.functions[b].index(pairs[here].view(np.uint64))
            if (at < 0).any():
                raise ValueError("a pair of the second pass was not counted in the first")
            counts[here] = self.counts[b][at]
        return counts, counts == self.most[pairs & ((1 << B_BITS) - 1)]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (all token groups as text).

    Needs doc_id and text; the tokenizers' files are at the same places on all executors. A null or empty
    text, or one whose tokens do not spell it, has no tokens: zeros, and the empty text as groups. Repeated
    rows count each. Null ids pass through. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    partial = _counts_by_task(docs.select(F.coalesce("text", F.lit("")).alias("text")), path_a, path_b)
    table, number = pair_counts(partial)
    of_b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = _counted(table).groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))  # at most a row for each id of B
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = "n_a long, n_b long, n_groups long, n_links long"
    if number <= BROADCAST_PAIRS:
        known = spark.sparkContext.broadcast((_buckets(number), table.collect(), most.collect()))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both, counts, version = aligner(path_a, path_b), Counts(*known.value), None
            for batch in batches:
                first = 0
                for found in both.texts(batch.column(1).to_pylist()):
                    if version != both.version:
                        version, sums = both.version, np.full((2, 0), -1, np.int64)
                    every, ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
                    sums = np.pad(sums, ((0, 0), (0, both.links.n - sums.shape[1])), constant_values=-1)
                    used = np.unique(every[sums[0][every] < 0])  # units that this task has not looked up yet
                    count, best = counts.of(both.pairs_of(used))
                    own = np.repeat(np.arange(len(used)), both.links.of[used])
                    sums[0, used], sums[1, used] = _sums(best.astype(np.int64), own, len(used)), _sums(count, own, len(used))
                    texts = [";".join(map(both.groups.__getitem__, own.tolist())) for own in found]
                    columns = [np.append(0, np.cumsum(c[every])) for c in (both.n_a.of, both.n_b.of, both.links.of, both.links.of, *sums)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(found)), *[pa.array(c[ends[1:]] - c[ends[:-1]]) for c in columns], pa.array(texts, pa.string())],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
                    first += len(found)

        return rows.mapInArrow(look_up, f"doc_id {id_type}, {counted}, n_best long, count_sum long, groups string")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            first = 0
            for found in both.texts(batch.column(1).to_pylist()):
                each = [np.unique(both.pairs_of(own), return_counts=True) for own in found]
                numbers = [pa.array([int(c.of[own].sum()) for own in found]) for c in (both.n_a, both.n_b, both.links, both.links)]
                texts = [";".join(map(both.groups.__getitem__, own.tolist())) for own in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(found)), *numbers, pa.array(texts, pa.string()),
                     *[pa.array([list(e[k]) for e in each], pa.list_(pa.int64())) for k in (0, 1)]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                first += len(found)

    # more pairs than go to every task: the distinct links of a row are joined to the table
    written = kept(rows.mapInArrow(links, f"doc_id {id_type}, {counted}, groups string, pairs array<long>, times array<long>"), "links")
    d1, d2 = hash_pair(F.col("doc_id"), F.col("groups"))
    written = written.withColumns({"d1": d1, "d2": d2})
    each = written.dropDuplicates(["d1", "d2"]).select(
        "d1", "d2", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    often = each.groupBy("pair").agg(F.count("*").alias("rows"))
    flat = kept(_counted(table).withColumn("b", of_b).join(F.broadcast(most), "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")).join(often, "pair"), "pair-table")
    sums = join_counted(each, flat, ["pair"], number, "rows", "inner").groupBy("d1", "d2").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return written.drop("pairs", "times").join(sums, ["d1", "d2"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups")
