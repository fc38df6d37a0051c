"""Near duplicates by SimHash fingerprints and a binary trie self-join.

Fingerprints are made on the map side. The distinct ones are range-sorted into blocks of about equal
size; a block is a run of neighbouring subtrees of one binary trie. Pairs of blocks whose common
prefixes already differ in too many bits are pruned; each other pair is walked down together, bit by
bit, and pruned where the differing bits exceed the budget. A pair returns a spanning forest of its
links, and components are found by contracting the links in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import hash_pair, join_counted, kept, word_chunks

SHINGLE = 3
MAX_BITS = 2
SEED = 42
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 13, 1 << 16, 1 << 12  # distinct fingerprints of a block, and the number of blocks aimed at
SIGN = np.uint64(1 << 63)
FRAMES = 1 << 17  # node pairs that a task holds for one step


def fingerprint(data: bytes) -> int:
    """SimHash of a text in UTF-8: a bit is 1 if set in over half of its shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest

    counts, n, carry = np.zeros(64, np.int64), 0, []
    for words in word_chunks(data):
        words = carry + [w.lower() for w in words] if carry else [w.lower() for w in words]
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        carry = words[-(SHINGLE - 1):]
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` without its text, with the fingerprint `fp` as a signed long. Needs `text`, first of all columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(fps.view(np.int64))], [*batch.schema.names[1:], "fp"])

    rest = [f for f in docs.schema.fields if f.name != "text"]
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *[f.name for f in rest])
    return rows.mapInArrow(work, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "fp long"]))


def _zeros_before(values: np.ndarray, bit: int) -> np.ndarray:
    """At each position, how many values before it have the bit unset."""
    return np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1) == 0)])


def trie_pairs(a: np.ndarray, b: np.ndarray | None = None, budget: int = MAX_BITS) -> np.ndarray:
    """Positions (i, j) of all values of two sorted arrays that differ in at most `budget` bits; of one array, each pair once.

    The values of an array are distinct. A node of its trie is a range of positions. Pairs of nodes go
    down together, the ones furthest down first, so that few are held; single values are compared at once.
    """
    own, b = b is None, a if b is None else b
    zeros: dict[int, tuple] = {}
    found, stack = [], [(63, np.array([[0, len(a), 0, len(b), budget]], np.int64))]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes) > FRAMES:
            stack += [(bit, nodes[: len(nodes) // 2]), (bit, nodes[len(nodes) // 2:])]
            continue
        alo, ahi, blo, bhi, left = nodes.T
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(nodes), bool)
        single = (ahi - alo == 1) & (bhi - blo == 1)
        i, j = alo[single & ~same], blo[single & ~same]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        found.append(np.stack([i[near], j[near]], axis=1))
        if single.all():
            continue
        alo, ahi, blo, bhi, left = nodes[~single].T
        same = same[~single]
        if bit not in zeros:
            za = _zeros_before(a, bit)
            zeros[bit] = za, za if own else _zeros_before(b, bit)
        za, zb = zeros[bit]
        amid, bmid = alo + za[ahi] - za[alo], blo + zb[bhi] - zb[blo]
        down = np.concatenate([
            np.stack([alo, amid, blo, bmid, left], axis=1), np.stack([amid, ahi, bmid, bhi, left], axis=1),
            np.stack([alo, amid, bmid, bhi, left - 1], axis=1),
            np.stack([amid, ahi, blo, bmid, left - 1], axis=1)[~same],  # else the pair before, turned round
        ])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] >= 0)]
        if len(down):
            stack.append((bit - 1, down))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs lead to."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], label[pairs[:, 0]])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of a partition as one row: block, low, high, and the sorted values as bytes."""
    values = [batch.column(0).to_numpy() for batch in batches]
    if values and sum(map(len, values)):
        block = np.sort(np.concatenate(values))
        yield pa.RecordBatch.from_pydict({
            "block": [TaskContext.get().partitionId()], "low": block[:1], "high": block[-1:],
            "fps": [(block.view(np.uint64) ^ SIGN).tobytes()]}, pa.schema(
                [("block", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("fps", pa.binary())]))


def _prefixes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of each block as bits, and how many leading bits all its values share."""
    low, high = low.view(np.uint64) ^ SIGN, high.view(np.uint64) ^ SIGN
    return low, np.array([64 - int(x).bit_length() for x in low ^ high], np.uint64)


def _near(low: np.ndarray, length: np.ndarray, i: int, budget: int) -> np.ndarray:
    """Which blocks may hold values within the budget of block i: prefixes are compared as far as both share one."""
    shared = np.minimum(length[i], length)
    differ = np.where(shared == 0, np.uint64(0), (low[i] ^ low) >> ((np.uint64(64) - shared) % np.uint64(64)))
    return np.bitwise_count(differ) <= budget


def links(distinct: DataFrame, rows: int, budget: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all fingerprints of a component; `distinct` has `rows` distinct values `fp`.

    A block is one row. A pair of blocks is the unit of work, of a bounded size whatever the values are;
    only the limits of the blocks, two numbers for each, come to the driver and go to all tasks.
    """
    spark = distinct.sparkSession
    size = min(max(LEAST_BLOCK, rows // BLOCKS), MOST_BLOCK)
    # flipping the highest bit makes signed order the order of the bits
    flipped = distinct.select(F.col("fp").bitwiseXOR(F.lit(-1 << 63)).alias("value"))
    blocks = kept(flipped.repartitionByRange(max(1, -(-rows // size)), "value").mapInArrow(
        _packed, "block int, low long, high long, fps binary"), "simhash-blocks")
    limits = np.array(sorted(map(tuple, blocks.select("low", "high", "block").collect())), np.int64).reshape(-1, 3)
    known = spark.sparkContext.broadcast((limits[:, 2], *_prefixes(limits[:, 0].copy(), limits[:, 1].copy())))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, low, length = known.value
        place = {block: k for k, block in enumerate(ids.tolist())}
        for batch in batches:
            for block in batch.column(0).to_pylist():
                later = np.flatnonzero(_near(low, length, place[block], budget))
                later = ids[later[later >= place[block]]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(later), block, np.int32)), pa.array(later)], ["i", "j"])

    pairs = blocks.select("block").repartition(max(1, len(limits) // 64)).mapInArrow(neighbours, "i int, j int")
    pairs = pairs.repartition(max(1, len(limits)), "j")
    left = blocks.select(F.col("block").alias("i"), F.col("fps").alias("a"))
    right = blocks.select(F.col("block").alias("j"), F.col("fps").alias("b"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, b in zip(*(column.to_pylist() for column in batch.columns)):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                near = trie_pairs(a, None if i == j else b, budget)
                nodes = a if i == j else np.concatenate([a, b])
                root = _forest(len(nodes), near + (0 if i == j else [0, len(a)]))
                inner = np.flatnonzero(root != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[inner].view(np.int64)), pa.array(nodes[root[inner]].view(np.int64))], ["a", "b"])

    return pairs.join(left, "i").join(right, "j").select("i", "j", "a", "b").mapInArrow(walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges: node, label, where label is one node of its component, the same for all its nodes.

    Rounds of contraction, alike at every size. In a round each node goes over to the first, by a hash, of
    itself and its neighbours, and an edge joins what its two ends went over to. A component that has
    become one node has no edges left and is settled. A node that is last by the hash is never gone over
    to, so every round leaves fewer; the hash changes every second round, since one round turns a star into
    a star around its first node and the next, with the same hash, ends it. Then the rounds are
    followed from the last back to the first. Rows of hubs are spread over salts, and every round is written.
    """
    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while edges.count():
        ranked = lambda node: F.struct(F.xxhash64(F.lit(len(rounds) // 2), node).alias("rank"), node.alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(ranked(F.col("b"))).alias("near"), F.count("*").alias("rows"))
        taken = kept(first.select(
            F.col("a").alias("node"), F.least("near", ranked(F.col("a")))["node"].alias("to"), "rows"), "contraction")
        rounds.append(taken)
        number = taken.count()
        for end in ("a", "b"):
            ends = taken.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"), "rows")
            edges = join_counted(edges, ends, [end], number, "rows", "inner")
        edges = kept(edges.where("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1].select("node", F.col("to").alias("label"))
    for taken in reversed(rounds[:-1]):
        further = labels.select(F.col("node").alias("to"), "label")
        ends = kept(taken.groupBy("to").agg(F.count("*").alias("rows")).join(further, "to", "left").select(
            "to", F.coalesce("label", "to").alias("label"), "rows"), "contraction")
        labels = kept(join_counted(taken.select("node", "to"), ends, ["to"], ends.count(), "rows", "inner").select("node", "label"), "labels")
    return labels


def simhash_groups(docs: DataFrame, *rest: str) -> DataFrame:
    """Per row: fp (signed), component_id, label (a fingerprint that names the component), and the columns `rest`.

    Needs doc_id and text. A null or blank text has the fingerprint 0 and is linked like any other.
    component_id is the smallest doc_id that links reach; null ids count only where there is no other.
    Equal fingerprints are one node, so repeated rows and copies share a component without any pairs of
    rows. An empty table gives an empty table.
    """
    rows = kept(fingerprints(docs.select("text", "doc_id", *rest)), "fingerprints")
    nodes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    number = nodes.count()
    linked = components(links(nodes.select("fp"), number))
    labelled = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "rows", "least", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = kept(labelled.join(smallest, "label").select("fp", "rows", "label", "component_id"), "components")
    return join_counted(rows, named, ["fp"], number, "rows", "inner")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, of which one stays for each component: the one of the smallest doc_id.

    Of several rows with that id one stays; a component without any id keeps one row too. A null or blank
    text has the fingerprint 0, so all such rows are one group. An empty table gives an empty table.
    """
    d1, d2 = hash_pair(F.col("doc_id"), F.col("text"))
    keyed = docs.select(d1.alias("d1"), d2.alias("d2"), F.col("doc_id"), F.col("text"))
    groups = simhash_groups(keyed, "d1", "d2")
    no_id = F.col("doc_id").isNull()
    # by label, since components without an id share the null, and a repeated id may name several
    best = groups.groupBy("label").agg(
        F.min(F.struct(no_id.alias("no_id"), "doc_id", "d1", "d2")).alias("best")).select("best.d1", "best.d2")
    rows = docs.select(d1.alias("d1"), d2.alias("d2"), F.struct("*").alias("row"))
    return rows.join(best, ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"]).select("row.*")
