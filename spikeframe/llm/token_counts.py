"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens that no piece of the vocabulary crosses, so the count of a text is the
sum over its pre-tokens. Lengths of frequent pre-tokens are broadcast as a table of bounded size; the
rest are encoded once per worker and remembered in a cache of bounded size. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import groups, sample_texts

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
SAMPLE_ROWS = 1000  # rows in which frequent pre-tokens are looked for; they set the speed only
FREQUENT = 20_000  # entries of the broadcast table
CACHED = 400_000  # entries of a worker's cache
CACHED_CHARS = 48  # longer pre-tokens are not remembered
LONG_TEXT = 1 << 20  # characters from which pre-tokens are not listed at once

# Runs of spaces go with what follows; a line end is a pre-token of its own.
_PRE_TOKEN = re.compile(" *[^ \n]+| +|\n")
_MARK = "▁"  # how the vocabulary writes a space


def open_model(path: str):
    """The tokenizer, if its vocabulary allows the cut into pre-tokens."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    if any(_MARK in p.lstrip(_MARK) or ("\n" in p and len(p) > 1) for p in pieces):
        raise ValueError("pieces of this vocabulary cross words; their lengths cannot be added up")
    return model


def pre_tokens(text: str) -> Iterator[str]:
    """Pre-tokens of a text that is not empty; the tokenizer puts a space in front of it."""
    spaced = " " + text.replace(_MARK, " ")
    if len(spaced) <= LONG_TEXT:
        return iter(_PRE_TOKEN.findall(spaced))
    return (m.group() for m in _PRE_TOKEN.finditer(spaced))


class Lengths(dict):
    """Number of tokens of a pre-token: the frequent ones, then a cache, then the tokenizer."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent = model, frequent
        self.before = len(model.encode("\n"))

    def encode(self, tokens: list[str]) -> list[int]:
        # after a line end nothing is put in front of the pre-token
        return [len(ids) - self.before for ids in self.model.encode(["\n" + t for t in tokens], num_threads=1)]

    def __missing__(self, token: str) -> int:
        return self.encode([token])[0]

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self and len(t) <= CACHED_CHARS]
        if len(self) + len(new) > CACHED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
            new = [t for t in tokens if t not in self and len(t) <= CACHED_CHARS][:CACHED]
        if new:
            self.update(zip(new, self.encode(new)))

    def count(self, texts: list[str]) -> Iterator[int]:
        """The number of tokens of each text; texts are taken together up to a bounded size."""
        for group in groups(texts, LONG_TEXT):
            if len(group) == 1 and len(group[0]) > LONG_TEXT:
                yield sum(map(self.__getitem__, pre_tokens(group[0])))
                continue
            split = [list(pre_tokens(text)) if text else [] for text in group]
            self.learn(set().union(*split))
            for tokens in split:
                yield sum(map(self.__getitem__, tokens))


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The lengths of the most frequent pre-tokens of a bounded sample of rows."""
    seen: Counter = Counter()
    for text in sample_texts(docs, SAMPLE_ROWS):
        seen.update(t for t in pre_tokens(text) if len(t) <= CACHED_CHARS)
    lengths = Lengths(open_model(path), {})
    lengths.learn({token for token, _ in seen.most_common(FREQUENT)})
    return dict(lengths)


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    `path` is the tokenizer's file, at the same place on all executors. Needs doc_id and text; a null
    text is empty and has no token. Rows are counted each by itself, repeated or not; an empty table
    gives an empty table.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(open_model(path), frequent.value)
        for batch in batches:
            n = list(lengths.count(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
