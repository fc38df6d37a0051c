"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import plain
from spikeframe.llm import common, cotrain, line_dedup, mixing, packing, pii, quality_rules, search, simhash, token_counts, warc

CLASHES = ["row", "key", "h1", "d1", "words", "lines", "fp", "value", "block", "label", "copies", "size", "target", "position", "_key", "documents", "kind", "shard", "_salt"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
SHARED = "a line that all have"
LONG = " ".join(f"w{k % 9973}" for k in range(60_000)) + "\n" + SHARED + "\n" + "x" * 200_000


def table():
    texts = [None, "", " \t\n \n", "one two", "Ünï côdé ÄÖ\nähnlich \x1c\x85 ▁ <s> <|endoftext|>", LONG, "same text\n" + SHARED, "same text\n" + SHARED]
    texts += [f"{SHARED.upper()} \n\nnumber {k} mail a{k}@b.org or +1 (017) 555-77{k:02} or 4111 1111 1111 1111 at 10.0.0.{k}" for k in range(12)]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if k == 3 else len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here", None, None, None), (None, None, None, None, None), (None, "no id here", "de", "s1", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in table()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def pairs(rows):
    return sorted(rows, key=repr)


def test_line_dedup(docs, none):
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"] and out.first()["key"] == "c"
    rows = table()
    want = [(r[0], *w) for r, w in zip(rows, plain.line_dedup([r[1] for r in rows]))]
    assert pairs((r.doc_id, r._n_lines, r._n_dropped, r.text) for r in out.collect()) == pairs(want)
    assert sum(w[2] for w in want) >= 15
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_counts_have_names_of_their_own(spark, docs):
    import corpus_pipeline

    clash = docs.withColumns({"_n_lines": F.lit(1), "_N_DROPPED": F.lit(2)})
    with pytest.raises(ValueError, match="_n_dropped"):
        line_dedup.line_dedup(clash)
    assert line_dedup.line_dedup(clash, counts=("n1", "n2")).columns == [*clash.columns, "n1", "n2"]
    out = corpus_pipeline.lines(spark, clash, "")
    assert out.columns == clash.columns and {(r._n_lines, r._N_DROPPED) for r in out.collect()} == {(1, 2)}


def test_pii_takes_numbers_of_any_length(spark):
    texts = ["0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "9", "9" * 5000 + ".1.1.1", "1.1.1.256"]
    want = [[("ip", 0, len(texts[0]))], [("ip", 0, len(texts[1]))], [], []]
    assert [pii.base_spans(t) for t in texts] == want
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[tuple(s) for s in r.base_spans] for r in sorted(rows)] == want


def test_line_dedup_without_broadcast(docs, monkeypatch):
    want = pairs(line_dedup.line_dedup(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert pairs(line_dedup.line_dedup(docs).collect()) == want
    monkeypatch.setattr(common, "SALT_ROWS", 3)
    assert pairs(line_dedup.line_dedup(docs).collect()) == want


def test_pii(spark, docs, none):
    rows = table()
    want = [(r[0], plain.base_spans(r[1])) for r in rows]
    assert pairs((r.doc_id, [tuple(s) for s in r.base_spans]) for r in pii.find_pii(docs).collect()) == pairs(want)
    assert pii.find_pii(none).count() == 0


def test_pii_patterns_by_chance():
    parts = ["a", ".", "@", "a.b", "x@y.z", "1", "300", "+", "(", ")", "-", " ", "4111111111111111", "0", "é", "\n", "+1 (017) 555-7713", "10.0.0.1", "@a.b@c.d"]
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain.base_spans(text), text


def test_pii_search_is_linear():
    for text in ("a" * 400_000, "1" * 400_000, "a.b" * 100_000, "+" * 200_000):
        assert pii.base_spans(text) == []


def test_pii_adds_written_out_forms(spark):
    """Held-out accuracy: rewritten addresses and phone numbers are found, plain numbers are left alone."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(df)
    found = pii.examples(common.sample_texts(df.where("doc_id >= 6000"), 3000))
    score = model.score(np.array(found["x"].tolist()))
    chosen = np.array([s > model.thresholds[pii.KINDS.index(k)] for s, k in zip(score, found["kind"])])
    good = found["label"].to_numpy() == 1
    assert good[chosen].mean() > 0.95 and chosen[good].mean() > 0.7
    added = model.added("write to jo.smith (at) mail3.example.com today", [])
    assert [s[0] for s in added] == ["email"]
    assert model.added("in 2019 we saw 12345 of them, 3.14 at most", []) == []


def test_pii_proposes_each_number_of_a_line():
    for text, want in (
        ("555-123-4567 555-987-6543", ["555-123-4567", "555-987-6543"]), ("Call 555-123-4567. 3 people", ["555-123-4567"]),
        ("2021 555-123-4567", ["555-123-4567"]), ("(017) 555-7713, 1. (018) 555-7714", ["(017) 555-7713", "(018) 555-7714"]),
        ("+1 (017) 555-7713 +1 (018) 555-7714", ["+1 (017) 555-7713", "+1 (018) 555-7714"])):
        assert set(want) <= {text[i:j] for k, i, j in pii.candidates(text) if k == "phone"}, text
    text = "4111.1111.1111.1111 12 4111  1111  1111  1111"
    assert {"4111.1111.1111.1111", "4111  1111  1111  1111"} <= {text[i:j] for k, i, j in pii.candidates(text) if k == "card"}
    for text in ("jo [AT] x.org", "jo AT x DOT org", "jo dot b at x dot org", "jo{at}x{dot}org", "jo @ x.org", "jo@x (dot) org", "jo(At)x.org"):
        whole = f"ask {text}. Then go"
        assert text in {whole[i:j] for k, i, j in pii.candidates(whole) if k == "email"}, text
    assert len(pii.candidates("1 " * 20_000)) < 18 * 20_000


def test_pii_adds_cards_and_phones_beside_other_numbers(spark):
    """Values of sf0.1 that the base patterns take together with a neighbour, and drop; what is added is right."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs)
    texts = {
        "Éçan 7536784127813050 4845168114407329 èaique": ["7536784127813050", "4845168114407329"],
        "erntou +1 (269) 555-3296 4524132264652876 and": ["+1 (269) 555-3296", "4524132264652876"],
        "egraso 4451718024887799 27.65.93.188 arr": ["4451718024887799"],
        "call 38.253.197.126 4880761348116108 so": ["4880761348116108"],
    }
    for text, want in texts.items():
        assert sorted(text[i:j] for _, i, j in model.added(text, pii.base_spans(text))) == sorted(want), text
    rows = pii.find_pii(docs, model).where("size(spans) > size(base_spans)").join(docs, "doc_id").collect()
    added = [(s.kind, r.text[s.start:s.end]) for r in rows for s in r.spans if s not in r.base_spans]
    digits = lambda x: "".join(c for c in x if c.isdigit())
    right = [(k, x) for k, x in added if (k == "card" and len(digits(x)) == 16 and pii.luhn(digits(x))) or (k == "phone" and x[:2] == "+1")]
    assert {"7536784127813050", "4845168114407329", "4550997810720808"} <= {x for k, x in added if k == "card"}
    assert len(right) >= 0.9 * len(added)


def test_pii_adds_each_number_of_a_line(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for text, want in (
        ("ring 555-123-4567 555-987-6543 now", ["555-123-4567", "555-987-6543"]),
        ("ring 555-123-4567. 3 people", ["555-123-4567"]), ("in 2021 555-123-4567 was", ["555-123-4567"])):
        assert sorted(text[i:j] for _, i, j in model.added(text, pii.base_spans(text))) == sorted(want), text


def test_pii_sample_is_of_the_whole_table(spark):
    """A head without personal data, rows in another order and in other files: the same training texts, of every kind."""
    rows = [(k, f"plain words {k % 700} of a head {k}") for k in range(3000)]
    rows += [(3000 + k, f"mail a{k}@b.org or +1 (017) 555-{k:04} at 10.0.0.{k} " + "word " * 30_000 * (k == 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = pii.training_texts(df.repartition(5), 500)
    assert texts == pii.training_texts(df.orderBy("text").coalesce(2), 500)
    assert len(texts) <= 500 and max(map(len, texts)) <= pii.PIECE
    kinds = [s[0] for t in texts for s in pii.base_spans(t)]
    assert min(kinds.count(k) for k in ("email", "phone", "ip")) == 40
    copies = spark.createDataFrame([(1, "the same text")] * 3000 + rows[:50], "doc_id long, text string")
    assert len(pii.training_texts(copies, 100)) >= 20


def test_pii_examples_could_all_be_added():
    """Precision is counted over spans that can be added: none of the examples is a base span, cards have positive ones."""
    text = "card 4111 1111 1111 1111 mail a@b.org ip 10.0.0.1 phone +1 (017) 555-7713"
    assert pii._addable(text, pii.base_spans(text)) == []
    found = pii.examples([text] * 40)
    good = found[found["label"] == 1]
    assert set(good["kind"]) == {"email", "card", "phone"}


def test_redact():
    assert pii.redact("ab cd ef", [("ip", 0, 2), ("card", 1, 5), ("email", 6, 8)]) == "[ip] [email]"


def test_token_counts(docs, none):
    path = public_tokenizers.path(token_counts.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in table()]
    rows = token_counts.token_counts(docs, path).collect()
    assert pairs((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == pairs(want)
    assert token_counts.token_counts(none, path).count() == 0


STRANGE = ["a", "B", "É", "ß", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<|EndOfText|>", ",", "Ab", "<0x0A>",
           "ﬁ", "１", "é", "́", "Σ", "İ", "K", "😀", "中", ".", "'s", "1", "\x00", "​", "the", "ing", "﻿"]


def test_tokenizers_piece_by_piece(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    model = token_counts.open_model(public_tokenizers.path(token_counts.MODEL))
    want = [len(ids) for ids in model.encode(texts)]
    for cached in (token_counts.CACHED, 50):
        monkeypatch.setattr(token_counts, "CACHED", cached)
        assert list(token_counts.Lengths(model, {}).count(texts)) == want
    path = public_tokenizers.path(packing.MODEL)
    for cached in (packing.CACHED, 50):
        monkeypatch.setattr(packing, "CACHED", cached)
        ids = packing.WordIds(path).of([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() + [1] for x in ids] == [plain.token_ids(t) for t in texts]


def test_word_chunks():
    text = (" ".join(STRANGE) * 50).encode()
    assert [w for c in common.word_chunks(text, 64) for w in c] == text.split()


def test_mixing(docs, none):
    sizes = {}
    for r in table():
        sizes[r[3]] = sizes.get(r[3], 0) + len(plain.words(r[1]))
    want = plain.targets(sizes)
    rows = mixing.copies(docs).collect()
    assert len(rows) == len(table())
    for r in rows:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
        assert r["size"] == len(plain.words(r.row.text)) and 0 <= r.copies <= 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0
    assert {r.copies for r in mixing.copies(docs.where("text is null or text = ''")).collect()} == {0}


def test_mixing_without_broadcast(docs, monkeypatch):
    want = pairs(mixing.copies(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "SALT_ROWS", 3)
    assert pairs(mixing.copies(docs).collect()) == want


def test_search(docs, none):
    rows = table()
    queries = docs.where("doc_id in (0, 1, 3, 4, 5, 7, 9)")
    want = plain.bm25([r[:2] for r in rows], [r[:2] for r in rows if r[0] in (0, 1, 3, 4, 5, 7, 9)], 4)
    got = {}
    for r in sorted(search.search(docs, queries, 4).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((round(r.score, 7), r.doc_id))
    assert got == want
    assert search.search(none, queries).count() == 0 and search.search(docs, none).count() == 0


def test_search_reads_long_lists_by_their_bounds(monkeypatch):
    """Queries of a block share the bounds of long lists, whose postings are not read; every size of blocks and bounds gives the same."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    often = 1 / np.arange(1, 3001)
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 120), p=often / often.sum()))) for k in range(600)]
    docs += [(600 + k, docs[7][1]) for k in range(30)] + [(630, "alone here"), (None, "w0 w1 w2")]
    asked = docs[::20] + [(630, "alone here"), (631, "nowhere")]
    want = plain.bm25(docs, asked)
    bags = [search.terms_of(text.encode()) for _, text in docs]
    halves = [search.build_shard([i for i, _ in docs[k::2]], bags[k::2]) for k in (0, 1)]
    mean = sum(n for *_, n in bags) / len(bags)
    hashes, n = np.unique(np.concatenate([h for h, _, _ in bags]), return_counts=True)
    idf = np.log(1 + (len(bags) - n + 0.5) / (n + 0.5))
    queries_ = [search.terms_of(text.encode())[0] for _, text in asked]
    places = [np.searchsorted(hashes, q[np.isin(q, hashes)]) for q in queries_]
    start = np.append(0, np.cumsum([len(p) for p in places]))
    block = {"query_id": np.array([i for i, _ in asked]), "null": np.zeros(len(asked), bool), "query_key": np.arange(len(asked)), "start": start,
             "words": np.concatenate(places).astype(np.int32), "hashes": hashes, "idf": idf}
    monkeypatch.setattr(search, "_read", lambda k: halves[int(k)])
    read, spread = [], search._spread
    monkeypatch.setattr(search, "_spread", lambda starts, lengths: read.append(int(lengths.sum())) or spread(starts, lengths))
    whole = sum(int(n[p].sum()) for p in places)
    for settings in ({}, {"BLOCK_BITS": 3}, {"CELLS": 900}, {"CELLS": 0}, {"FEW": 1}, {"FEW": 10**9}, {"PRODUCT": 1, "LONG": 10**6}, {"LONG": 1}):
        with monkeypatch.context() as changed:
            for name, value in settings.items():
                changed.setattr(search, name, value)
            read.clear()
            found = search._answer(block, ["0", "1"], mean, 10).to_pylist()
        if not settings:
            assert sum(read) < whole / 2
        got = {}
        for r in sorted(found, key=lambda r: (r["query_id"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0)):
            got.setdefault(r["query_id"], []).append((round(r["score"], 7), r["doc_id"]))
        assert {q: own[:10] for q, own in got.items()} == want, settings


def test_search_bounds_queries_of_like_words_together(monkeypatch):
    """Queries of one vocabulary get no product with the frequent words of another, and results stay those of plain BM25."""
    rng = np.random.default_rng(4)
    often = 1 / np.arange(1, 801)
    docs = [(k, " ".join(f"{'ab'[k % 2]}{w}" for w in rng.choice(800, rng.integers(20, 90), p=often / often.sum()))) for k in range(600)]
    asked = docs[:240]
    bags = [search.terms_of(text.encode()) for _, text in docs]
    mean = sum(n for *_, n in bags) / len(bags)
    hashes, n = np.unique(np.concatenate([h for h, _, _ in bags]), return_counts=True)
    places = [np.searchsorted(hashes, search.terms_of(text.encode())[0]) for _, text in asked]
    block = {"query_id": np.array([i for i, _ in asked]), "null": np.zeros(len(asked), bool), "query_key": np.arange(len(asked)),
             "start": np.append(0, np.cumsum([len(p) for p in places])), "words": np.concatenate(places).astype(np.int32),
             "hashes": hashes, "idf": np.log(1 + (len(bags) - n + 0.5) / (n + 0.5))}
    monkeypatch.setattr(search, "_read", lambda _: search.build_shard([i for i, _ in docs], bags))
    monkeypatch.setattr(search, "PRODUCT", 130)
    rows, lists = [], search.Shard._lists
    monkeypatch.setattr(search.Shard, "_lists", lambda self, part: [out := lists(self, part), rows.append((len(out[2]), len(self.maxima)))][0])
    found = search._answer(block, ["0"], mean, 10).to_pylist()
    assert len(rows) == 2 and all(0 < own <= whole * 0.6 for own, whole in rows)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], -r["score"], r["doc_id"])):
        got.setdefault(r["query_id"], []).append((round(r["score"], 7), r["doc_id"]))
    assert got == plain.bm25(docs, asked)


def test_search_units():
    """Long rows of shards for each block of queries, and units enough for the cores."""
    for queries_, shards, cores in ((12821, 32, 6), (150_000, 375, 6), (50, 8, 6), (0, 0, 6), (1, 1, 64), (750_000, 1900, 200)):
        blocks, groups = search._units(queries_, 370 * queries_, shards, cores)
        assert blocks >= 1 and groups >= 1 and blocks * search.QUERY_BLOCK >= queries_ and groups * search.SHARD_GROUP >= shards
        assert groups <= max(1, shards) and blocks <= max(1, queries_)
        if queries_ > 10_000:
            assert blocks * groups >= 2 * cores and groups <= max(3, -(-shards // search.SHARD_GROUP))


def test_cotraining(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(3, 20)] + [(None, 1, 0), (5, None, 0), (4, 1, 0), (99, 7, 0)], "doc_id long, quality int, toxic int")
    rows = cotrain.score(docs, labels).collect()
    assert len(rows) == len(table()) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in rows)
    assert {(r.score, r.kept) for r in cotrain.score(docs, labels.limit(0)).collect()} == {(None, True)}
    assert cotrain.score(none, labels).count() == 0


def test_quality_rules(docs, none):
    rows = quality_rules.measure(docs).collect()
    names = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    assert pairs((r.doc_id, *(r[n] for n in names)) for r in rows) == pairs((r[0], *plain.quality(r[1])) for r in table())
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and pairs(r.doc_id for r in kept.collect()) == pairs(r[0] for r in table() if plain.quality(r[1])[-1])
    assert quality_rules.measure(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_quality_rules_in_any_order(spark):
    rng = random.Random(5)
    pool = ["f#", "g\n", "ab\nab\n", *(f"word{k}" for k in range(60))]
    texts = [" ".join(rng.choice(pool[rng.randint(0, 3):rng.randint(5, 63)]) for _ in range(rng.randint(0, 150))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: plain.quality(t)[-1] for k, t in enumerate(texts)}
    assert len(set(want.values())) == 2
    rules = list(quality_rules.BASE + quality_rules.ADDED)
    for _ in range(3):
        rng.shuffle(rules)
        got = df.select("doc_id", quality_rules.first_rejection_of_text(rules).isNull().alias("kept")).collect()
        assert {r.doc_id: r.kept for r in got} == want


def test_packing(docs, none):
    path = public_tokenizers.path(packing.MODEL)
    plain.check_packing(packing.pack(docs, path).collect(), [r[:2] for r in table()])
    assert packing.pack(none, path).count() == 0


def test_cut():
    for length in range(1, 5000):
        pieces = packing.cut(length)
        assert sum(pieces) == length and max(pieces) <= 2048 and all(p in (2048, 1024, 512, 256, 128) for p in pieces[:-1])


def test_simhash(docs, none):
    rows = [r for r in table()]
    fps = [plain.fingerprint(r[1]) for r in rows]
    component = plain.components(fps)
    least = {}
    for r, c in zip(rows, component):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(docs.select("doc_id", "text", "lang")).collect()]
    assert pairs(got) == pairs((r[0], f, least[c]) for r, f, c in zip(rows, fps, component))
    single = simhash.near_dedup(docs)
    assert single.columns == docs.columns and single.count() == len(set(component))
    assert simhash.simhash_groups(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(80)) for c in "ab"]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[1])], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.near_dedup(df).collect()) == [(1, texts[0]), (1, texts[1])]


def test_long_chains_and_many_blocks(spark, monkeypatch):
    """Chains of fingerprints that each differ in two bits from the next, over many small blocks."""
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 16)
    monkeypatch.setattr(simhash, "MOST_BLOCK", 16)
    rng = random.Random(2)
    values = []
    for _ in range(6):
        value = rng.getrandbits(64)
        for _ in range(50):
            values.append(value)
            value ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    values = sorted(set(values))
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long").repartition(3)
    edges = simhash.links(df, len(values))
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    groups = {}
    for s, c in zip(signed, plain.components(values)):
        groups.setdefault(c, set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(labels.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("heavy", [False, True])
def test_components_of_stars_chains_and_loops(spark, monkeypatch, heavy):
    """A hub of 300 links, a chain, a ring, loops and repeated links; with `heavy`, hubs are salted and nothing is broadcast."""
    if heavy:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "SALT_ROWS", 7)
    star, chain = [(k, 1000) for k in range(300)], [(2000 + k, 2001 + k) for k in range(60)]
    ring = [(-k, -1 - k % 9) for k in range(1, 10)]
    links = star + chain + ring + [(5000, 5000), (2001, 2000), (3000, 3001), (3000, 3001)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    rows = simhash.components(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.label, set()).add(r.node)
    assert len(rows) == len({r.node for r in rows}) and all(label in nodes for label, nodes in got.items())
    want = [set(range(300)) | {1000}, set(range(2000, 2061)), set(range(-9, 0)), {3000, 3001}]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert simhash.components(df.limit(0)).count() == 0


def test_trie_pairs():
    rng = np.random.default_rng(1)
    near = lambda x, y: {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if int(a ^ b).bit_count() <= 2}
    for bits in (7, 64):
        values = rng.integers(0, 1 << bits, 90, dtype=np.uint64)
        a = np.unique(np.concatenate([values, values ^ np.uint64(3), values ^ np.uint64(1 << 6)]))
        got = [tuple(sorted(p)) for p in simhash.trie_pairs(a).tolist()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in near(a, a) if i < j}
        got = [tuple(p) for p in simhash.trie_pairs(a[::2], a[1::2]).tolist()]
        assert len(got) == len(set(got)) and set(got) == near(a[::2], a[1::2])


def pages(spark):
    big, other = "<p>é" + "x" * 1200, "y" * 5000
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
            (7, "u", ""), (3, "http://a/3\r\nX: y", big), (None, "n", big), (None, "n", other), (None, "m", other), (-9, "z", "\r\n\r\n" * 400)]
    return rows, spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def test_warc(spark):
    rows, df = pages(spark)
    at = common.shared_folder(spark, "warc")
    manifest = warc.write_warc(df, at, file_bytes=600)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 3
    back = warc.read_warc(spark, at, payload=True).collect()
    largest = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            largest[html] = max(i, largest.get(html, i))
    want = []
    for i, _, html in rows:
        data, top = (html or "").encode(), largest.get(html)
        revisit = top is not None and i != top
        want.append((i, len(data), "revisit" if revisit else "response", top if revisit else None, None if revisit else data))
    assert pairs((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back) == pairs(want)


def test_warc_is_deterministic(spark):
    _, df = pages(spark)
    written = []
    for parts in (1, 5):
        at = common.shared_folder(spark, "warc")
        written.append(pairs(warc.write_warc(df.repartition(parts), at).collect()))
    assert written[0] == written[1]


def test_warc_rolls_with_its_own_constants(spark):
    """63 pages of a MiB that compress to about half: a shard holds more than one file, each but the last full."""
    from pyspark.sql import functions as F

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda k: F.sha2(F.concat_ws("-", "id", k), 512)), "")
    df = spark.range(63).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(text, F.reverse(text)).alias("html"))
    at = common.shared_folder(spark, "warc")
    files = sorted(tuple(r) for r in warc.write_warc(df, at).select("file", "shard", "bytes", "records").collect())
    assert len(files) > 1 and {f[1] for f in files} == {0} and sum(f[3] for f in files) == 63
    assert all(f[2] >= warc.FILE_BYTES for f in files[:-1])
    assert sorted(r.page_id for r in warc.read_warc(spark, at).collect()) == list(range(63))


def test_warc_spreads_rows_without_id(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha1(F.col("id").cast("string")), F.lit(9)).alias("html"))
    at = common.shared_folder(spark, "warc")
    manifest = warc.write_warc(df, at).collect()
    assert len(manifest) == warc.LEAST_SHARDS and max(r.records for r in manifest) < 2 * 4000 / warc.LEAST_SHARDS
    assert warc.read_warc(spark, at).where("page_id is null").count() == 1334


def test_warc_empty_and_damaged(spark):
    _, df = pages(spark)
    at = common.shared_folder(spark, "warc")
    assert warc.write_warc(df.limit(0), at).count() == 0 and warc.read_warc(spark, at).count() == 0
    record = warc.page_record(1, "u", b"abc", "d", 0, None)
    warc.parse(record)
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"abc", b"abd"))
