"""Collocations, alignment and exact duplicates: edge cases, every way of running, and parts against plain versions."""

import random

import numpy as np
import public_tokenizers
import pytest

import oracle
import plain
from spikeframe.llm import alignment, collocations, common, exact_dedup, perfect_hash, queries
from test_llm_edges import CLASHES, SCHEMA, docs, none, pairs, table  # noqa: F401

PATHS = [public_tokenizers.path(m) for m in (alignment.MODEL_A, alignment.MODEL_B)]
SF = f"{oracle.DATA}/sf0.01"


def aligned(df):
    return pairs(tuple(r) for r in alignment.align(df, *PATHS).collect())


def test_alignment_over_a_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain.alignment([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert aligned(df) == pairs(want)
    rows = queries.queries()["op12_alignment"](spark, SF).collect()
    assert pairs((r.doc_id, r.count_sum, r.groups_sha256) for r in rows) == pairs((w[0], w[6], plain.sha256(w[7]) if w[1] else "") for w in want)


def test_alignment_edges(docs, none, monkeypatch):  # noqa: F811
    want = pairs(plain.alignment([r[:2] for r in table()]))
    assert aligned(docs) == want
    assert alignment.align(none, *PATHS).count() == 0
    # many small flushes, buckets and steps of the tree; then without a table for all tasks
    for name, value in (("FLUSH_PAIRS", 5), ("BUCKET_KEYS", 7), ("SUMMED", 2), ("CACHED", 50), ("GROUP_CHARS", 100)):
        monkeypatch.setattr(alignment, name, value)
    assert aligned(docs) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert aligned(docs) == want and aligned(none) == []
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "SALT_ROWS", 3)
    assert aligned(docs) == want


def test_units_are_safe_to_align_alone():
    parts = ["a", ".", ",", "...", ".b", "E.", " ", "  ", "\n", "\t", "▁", "é", "\xa0", "\x85", "don't", "'s", "12", "<s>", "<|endoftext|>", "…", "日本", "\x00", " ", "x,y", " the", "​", "é", "🙂"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert all("".join(alignment.units(t)) == " " + t for t in texts if t)
    both = alignment.aligner(*PATHS)
    got = [";".join(both.groups[u] for u in own) for found in both.texts(texts) for own in found]
    assert got == [w[7] for w in plain.alignment(enumerate(texts))]


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 100, 40_000):
        keys = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        made = perfect_hash.PerfectHash.from_parts(*perfect_hash.PerfectHash.of(keys).parts())
        assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
        assert (made.index(keys + np.uint64(1 << 41)) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        perfect_hash.PerfectHash.of(np.array([3, 3], np.uint64))


def phrases(df, *how):
    return pairs(tuple(r) for r in collocations.collocations(df, *how).collect())


def small(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(4)


def test_collocations_by_chance(spark, monkeypatch):
    """Few words, so that phrases overlap, lie in others and tie; every range and sketch is cut small."""
    rng = random.Random(11)
    words = ["a", "A", "b", "c\x00d", "the", "of", "ü", "Ü", "x\x1c", "\x01", "zz", "."]
    rows = [(rng.choice(["en", "de", None, "und"]), None if k % 17 == 0 else "".join(
        rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", "\n", ", ", ";"]) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    df, want = small(spark, rows), pairs(plain.collocations(rows, 4))
    assert len(want) > 100 and phrases(df, 4) == want
    assert phrases(df, 4, 3) == pairs(plain.collocations(rows, 4, 3)) and phrases(df, 300) == []
    assert phrases(df, 4, 5, 7) == pairs(plain.collocations(rows, 4, 5, 7))
    for name, value in (("RANGE_ROWS", 50), ("HELD_WORDS", 200), ("SUMMED", 2), ("CHUNK_BYTES", 16)):
        monkeypatch.setattr(collocations, name, value)
    assert phrases(df, 4) == want
    assert phrases(df, 4, 5, 2000, 7) == want  # a sketch that says little


def test_collocations_edges(docs, none):  # noqa: F811
    rows = [(r[2], r[1]) for r in table()]
    assert phrases(docs, 2) == pairs(plain.collocations(rows, 2)) != []
    assert phrases(docs, 300) == pairs(plain.collocations(rows, 300))  # counts above 255
    assert phrases(none) == []


def test_scores_beyond_64_bits(spark):
    df = small(spark, [("en", "a b " * 30_000)] * 3)
    row = {r.phrase: r for r in collocations.collocations(df).collect()}
    assert row["a b a b a"].score == 1000 * row["a b a b a"].a * 180_000 // (row["a b a b a"].l * row["a b a b a"].r)


def test_quicksort_abandons_what_is_rare():
    rng = np.random.default_rng(2)
    rows = np.unique(rng.integers(0, 6, (5000, 4)).astype(np.int32), axis=0)
    weight = rng.integers(1, 4, len(rows))
    got = {tuple(rows[r, :k].tolist()): n for r, k, n in collocations.frequent_parts(rows, weight, 40)}
    want = {}
    for row, n in zip(rows.tolist(), weight.tolist()):
        for k in range(2, 5):
            if 0 in row[1:k]:
                break
            want[tuple(row[:k])] = want.get(tuple(row[:k]), 0) + n
    assert got == {key: n for key, n in want.items() if n >= 40}


def groups(df):
    return pairs((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.marks(df).collect())


def test_exact_dedup(docs, none, monkeypatch):  # noqa: F811
    want = pairs(plain.exact_groups([r[:2] for r in table()]))
    assert groups(docs) == want and groups(none) == []
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and out.first()["key"] == "c"
    texts = [" ".join((r.text or "").split()) if (r.text or "").strip() else (r.text or "")[:1] and " " for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({w[1:3] for w in want if w[1] is not None}) + len({w for w in want if w[1] is None})
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "SALT_ROWS", 2)
    assert groups(docs) == want
    monkeypatch.setattr(exact_dedup, "BITMAP_BITS", 7)  # nearly every key shares a bit with another
    monkeypatch.setattr(exact_dedup, "PREFIX_CHARS", 1)
    assert groups(docs) == want


def test_exact_dedup_reads_in_steps(spark):
    """Texts that differ in length or in their prefix are never hashed whole."""
    rows = [(1, "one"), (2, "twenty"), (3, "a  b"), (4, "a\tb"), (5, "abc"), (6, "x" * 200 + "y"), (7, "x" * 200 + "z")]
    marked = {r.doc_id: r for r in exact_dedup.marks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, r in sorted(marked.items()) if r.digest is not None] == [3, 4, 6, 7]
    assert [i for i, r in sorted(marked.items()) if not r.kept] == [4]


def test_exact_dedup_runs_in_the_jvm(docs):  # noqa: F811
    for df in (exact_dedup.marks(docs), exact_dedup.exact_dedup(docs)):
        assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
