"""The registered text queries over whole tables, against DuckDB or the plain versions."""

import duckdb
import oracle
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
import plain
from spikeframe.llm import queries, search

SF = f"{oracle.DATA}/sf0.01"
SMALL = f"{oracle.DATA}/sf0.001"
STATEMENTS = queries.oracle_sql()


def texts(folder):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())


def rows_of(spark, name, folder):
    return queries.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connect("0.01"), STATEMENTS[name]) is None


def test_pii(spark):
    docs = texts(SF)
    rows = rows_of(spark, "op2_pii", SF)
    assert len(rows) == len(docs)
    for r in rows:
        base = plain.base_spans(docs[r.doc_id])
        joined = [f"{k}:{i}:{j}" for k, i, j in base]
        assert r.base_sha256 == plain.sha256(",".join(joined)) and set(joined) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in plain.PATTERNS]


def test_token_counts(spark):
    docs, model = texts(SF), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = rows_of(spark, "op3_token_counts", SF)
    assert len(rows) == len(docs)
    for r in rows:
        n = len(model.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_mixing_comes_near_its_targets(spark):
    rows = rows_of(spark, "op4_mixing", SF)
    assert rows == rows_of(spark, "op4_mixing", SF) or sorted(rows) == sorted(rows_of(spark, "op4_mixing", SF))
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), rel=0.1)


def test_search(spark):
    docs = texts(SMALL)
    want = plain.bm25(list(docs.items()), [(i, t) for i, t in docs.items() if i % 20 == 0])
    got = {}
    for r in sorted(rows_of(spark, "op5_topk_search", SMALL), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((round(r.score, 7), r.doc_id))
    assert got == want


def test_search_over_many_shards(spark, monkeypatch):
    for name, value in (("SHARD_DOCS", 17), ("SHARD_GROUP", 3), ("QUERY_BLOCK", 2), ("BLOCK_BITS", 2)):
        monkeypatch.setattr(search, name, value)
    docs = texts(SMALL)
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain.bm25(list(docs.items()), [(i, t) for i, t in docs.items() if i % 20 == 0], 5)
    got = {}
    for r in sorted(search.search(df, df.where("doc_id % 20 = 0"), 5).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((round(r.score, 7), r.doc_id))
    assert got == want


def test_cotraining_on_unseen_labels(spark):
    """Half of the labels are kept back; the classifier must get nearly all of them right."""
    from spikeframe.llm import cotrain

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    rows = cotrain.score(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in rows) / len(rows)
    clean = [r.kept for r in rows if r.quality == 1]
    assert right > 0.95 and sum(clean) / len(clean) > 0.98


def test_cotraining_scores_by_hand(spark):
    """Logits, calibration and combination of every document, from the fitted numbers."""
    import math

    from spikeframe.llm import cotrain

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.train(docs, labels)
    viewed = cotrain._views(cotrain._renamed(docs))
    got = {r.doc_id: r for r in model.score(viewed).collect()}
    for r in viewed.collect():
        logits = []
        for view, fitted in model.views.items():
            slope, offset = model.calibration[view]
            logits.append(slope * (float(fitted.coefficients.dot(r[view])) + fitted.intercept) + offset)
        chance = lambda x: 1 / (1 + math.exp(-x))
        want = [chance(logits[0]), chance(logits[1]), chance(sum(logits) - model.prior)]
        assert [got[r.doc_id][c] for c in ("text_score", "meta_score", "score")] == pytest.approx(want)


def test_packing(spark):
    docs = texts(SF)
    assert plain.check_packing(rows_of(spark, "op8_packing", SF), list(docs.items())) < 0.01


def test_simhash(spark):
    docs = texts(SF)
    ids = sorted(docs)
    fps = [plain.fingerprint(docs[i]) for i in ids]
    want = {i: (f"{fp:016x}", ids[c]) for i, fp, c in zip(ids, fps, plain.components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, "op9_simhash", SF)} == want


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version over what the stage before has kept."""
    from spikeframe.llm.common import kept

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    run = lambda name, df: kept(stages[name](spark, df, SMALL), name)
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    good = run("quality_rules", docs)
    assert good.columns == docs.columns
    assert pairs(good) == [(i, t) for i, t in pairs(docs) if plain.quality(t)[-1]]
    lines = run("line_dedup", good)
    before = pairs(good)
    assert pairs(lines) == [(i, t) for (i, _), (_, _, t) in zip(before, plain.line_dedup([t for _, t in before]))]
    assert all(r.n_chars == len(r.text) for r in lines.collect()) and lines.columns == docs.columns
    single = run("simhash_near_dedup", lines)
    before = pairs(lines)
    assert pairs(single) == [p for k, (p, c) in enumerate(zip(before, plain.components([plain.fingerprint(t) for _, t in before]))) if k == c]
    mixed = run("mixing", single)
    sizes = {}
    for r in single.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.words(r.text))
    rate, times = plain.targets(sizes), {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in single.collect():
        assert abs(times.get(r.doc_id, 0) - rate[r.source] / sizes[r.source]) < 1
    assert mixed.columns == docs.columns
    plain.check_packing(run("packing", mixed).collect(), pairs(mixed))


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r.offset for r in rows if r.sequence_id == rows[0].sequence_id} >= {0}
