"""Quality rules as a short-circuit cascade.

A rule is an expression over the text that says whether it rejects. Each rule's cost (seconds) and
selectivity are estimated on a sample, and the rules are put in order of rejections per second. The
order changes what is computed for a document, never whether it is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import SPACES, sample_texts, words_of

SAMPLE_ROWS = 1000  # rows on which costs and selectivities are estimated; they set the order only
SYMBOLS = "#*$%&|<>"  # fixed value
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_MEAN_CHARS, MAX_MEAN_CHARS = 2, 16
MAX_SYMBOL_PERCENT = 10  # symbols per word
MAX_DUP_LINE_PERCENT = 50  # lines with a word that repeat an earlier one


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: a lambda over an array of one element binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols() -> Column:
    return F.regexp_count(_text(), F.lit(f"[{SYMBOLS}]")).cast("long")


def _worded_lines() -> Column:
    return F.filter(F.split(_text(), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Sorting (hash, position) brings equal windows together; the positions of repeated windows, in
    order, cover 3 words each, less what they overlap with the one before.
    """
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(starts, window)

    def covered(pairs: Column) -> Column:
        near = lambda i: F.coalesce(F.get(pairs, i)["h"], F.lit(None))
        repeated = F.transform(pairs, lambda pair, i: F.when(
            F.coalesce(pair["h"] == near(i - 1), F.lit(False)) | F.coalesce(pair["h"] == near(i + 1), F.lit(False)), pair["p"]))
        places = F.sort_array(F.filter(repeated, lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            places, start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"])

    def sorted_pairs(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
        _let(sorted_pairs(h), covered)))


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda words: F.size(words).cast("long"),
    "word_chars": word_chars,
    "n_symbols": lambda words: n_symbols(),
    "n_lines": lambda words: F.size(_worded_lines()).cast("long"),
    "n_dup_lines": lambda words: _let(_worded_lines(), n_dup_lines),
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Callable[[str], Column]], Column]  # of the way to get a feature; true for a rejected text, never null


# The base rules and what the cascade adds. Every text has a verdict: null counts as empty.
BASE = (
    Rule("few_words", lambda f: f("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words")),
)
ADDED = (
    Rule("symbols", lambda f: 100 * f("n_symbols") > MAX_SYMBOL_PERCENT * f("n_words")),
    Rule("short_words", lambda f: f("word_chars") < MIN_MEAN_CHARS * f("n_words")),
    Rule("long_words", lambda f: f("word_chars") > MAX_MEAN_CHARS * f("n_words")),
    Rule("repeated_lines", lambda f: 100 * f("n_dup_lines") > MAX_DUP_LINE_PERCENT * f("n_lines")),
)


def ordered(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a bounded sample, best first; an empty sample keeps the order given."""
    texts = sample_texts(docs, sample_rows)
    if not texts:
        return list(rules)
    sample = docs.sparkSession.createDataFrame([(t,) for t in texts], "text string")
    gain = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.agg(F.count(first_rejection_of_text([rule]))).first()[0]
        gain[rule.name] = rejected / (time.perf_counter() - began)
    return sorted(rules, key=lambda r: -gain[r.name])


def first_rejection(rules: list[Rule], feature: Callable[[str], Column]) -> Column:
    """Name of the first rule in order that rejects, else null; later rules are not computed then."""
    chain = F
    for rule in rules:
        chain = chain.when(rule.rejects(feature), rule.name)
    return chain


def first_rejection_of_text(rules: list[Rule]) -> Column:
    """The same from the column `text`: its words are split once for all rules, other features when a rule needs them."""
    return _let(words_of(F.col("text")), lambda words: first_rejection(rules, lambda name: FEATURES[name](words)))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns.

    Needs `text`. A null or blank text has no words and is rejected by the base rules. Every row is
    judged by itself, so repeated rows have one verdict; an empty table gives an empty table.
    """
    return docs.where(first_rejection_of_text(ordered(docs, rules)).isNull())


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, n_lines, base_failed and kept (the verdict of base rules and cascade).

    Since all counts are returned, the rules take them from their columns here.
    """
    rules = ordered(docs, ADDED)
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"), _worded_lines().alias("lines"))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"),
        n_symbols().alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        n_dup_lines(F.col("lines")).alias("n_dup_lines"), n_repeat_words(F.col("words")).alias("n_repeat_words"))
    failed = first_rejection(list(BASE), F.col).isNotNull()
    verdict = F.when(failed, False).otherwise(first_rejection(rules, F.col).isNull())
    return rows.withColumn("base_failed", failed).withColumn("kept", verdict)
