"""Personal data: candidates, boosted trees and calibrated thresholds.

Base spans follow fixed patterns and always stay. Beyond them, generators propose overlapping spans
at high recall, gradient-boosted trees score each by format and context, and the spans above their
kind's threshold are added. The trees are trained on a bounded sample of texts, which a hash picks from
the whole table and which prefers texts with base spans of each kind: base spans in rewritten forms (a phone number without its +, a card with dots, an address written out) are the positive
examples, as are cards and phone numbers beside other numbers, which the base patterns drop; all other
candidates that touch no base span and damaged base spans are the negative ones. One half of the texts
trains, the other calibrates the thresholds. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeframe.llm.common import kept

KINDS = ("email", "ip", "card", "phone")  # fixed order of spans
SAMPLE_ROWS = 4000  # pieces that train and calibrate, a fifth for each kind and for texts without base spans
PIECE = 4096  # characters of a piece: a whole text, or a window of a longer one
TREES, DEPTH, STEP, SEED = 40, 4, 0.3, 7
PRECISION = 0.98  # of added spans, on the calibration half
SCORED = 4096  # candidates scored at a time
CONTEXT = 24  # characters on either side
TEXT_CANDIDATES, TEXT_SPANS, LONGEST, FORMS = 64, 8, 200, 6  # of a text in training: plain candidates, rewritten spans, characters and forms of one

# Base patterns (fixed values), in forms whose search is linear: the local part of an address is looked
# for backwards from its @, and a number begins where no digit stands before.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Generators of candidates: wider, and they overlap.
_WRITTEN_AT = re.compile(r" ?[\[({<] ?(?:at|@) ?[\])}>] ?| at | ?@ ?", re.IGNORECASE)
_WRITTEN_DOT = r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot "
_DOT_BEFORE = re.compile(f"(?:{_WRITTEN_DOT})$", re.IGNORECASE)
_DOT = re.compile(rf"\.(?=\w)|{_WRITTEN_DOT}", re.IGNORECASE)
_SPACED_DOT = re.compile(rf"{_WRITTEN_DOT}| ?\. ?", re.IGNORECASE)
_LABEL = re.compile(r"[\w-]{1,63}")
_LOCAL_CHAR = re.compile(r"[\w.%+-]")
LABELS, LOCAL_PARTS = 5, 3  # of a written address
_STRETCH = re.compile(r"[0-9][0-9 ()+.-]*")
_GROUP = re.compile(r"[0-9]+")
_CARD_DIGITS, _PHONE_DIGITS = (12, 19), (7, 15)  # digits of a candidate
_DIGITS = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_DIGITS_ONLY = frozenset("0123456789")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            end = match.end()
            yield start, end


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind in order and by start."""
    spans = [("email", i, j) for i, j in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        # compared without the zeros in front, of which there may be any number
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _local_starts(text: str, end: int) -> Iterator[int]:
    """Where the local part of a written address may begin, with the parts that a written dot joins to it."""
    for _ in range(LOCAL_PARTS):
        start = end
        while start > max(0, end - 64) and _LOCAL_CHAR.match(text[start - 1]):
            start -= 1
        if start == end:
            return
        yield start
        dot = _DOT_BEFORE.search(text[max(0, start - 9):start])
        if not dot:
            return
        end = start - len(dot.group())


def _domain_ends(text: str, start: int, dot: re.Pattern) -> Iterator[tuple[int, bool]]:
    """Where the domain of a written address may end, and whether a dot in it is written out."""
    written, label = False, _LABEL.match(text, start)
    for _ in range(LABELS - 1):
        joint = label and dot.match(text, label.end())
        label = joint and _LABEL.match(text, joint.end())
        if not label:
            return
        written = written or joint.group() != "."
        yield label.end(), written


def _numbers(text: str) -> Iterator[Span]:
    """Of each stretch of digits the spans between the limits of its groups, also from a + or a bracket before one.

    A span has the digits of a card or a phone number, so a group begins at most 17 of them in each form.
    """
    least, most = min(_CARD_DIGITS[0], _PHONE_DIGITS[0]), max(_CARD_DIGITS[1], _PHONE_DIGITS[1])
    for stretch in _STRETCH.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *stretch.span())]
        for k, (i, _) in enumerate(groups):
            if groups[-1][1] - i < least or i and (text[i - 1].isalpha() or text[i - 1] == "_"):
                continue
            before = text[max(0, i - 2):i]
            starts = [i, *([i - 1] if before[-1:] in ("+", "(") else []), *([i - 2] if before in ("(+", "+(") else [])]
            digits = 0
            for low, high in groups[k:k + most]:
                digits += high - low
                if digits > most:
                    break
                if digits < least or text[high:high + 1].isalpha() or text[high:high + 1] == "_":
                    continue
                for kind, (few, many) in (("card", _CARD_DIGITS), ("phone", _PHONE_DIGITS)):
                    if few <= digits <= many:
                        yield from ((kind, start, high) for start in starts)


def _candidates(text: str) -> Iterator[Span]:
    for m in _WRITTEN_AT.finditer(text):
        sign = m.group()
        ends = list(_domain_ends(text, m.end(), _SPACED_DOT if sign.strip(" ")[0] in "[({<" else _DOT))
        starts = list(_local_starts(text, m.start())) if ends else []
        yield from (("email", i, j) for i in starts for j, written in ends if sign != "@" or written)
    if _DIGIT.search(text):
        yield from (("ip", *m.span()) for m in _IP.finditer(text))
        yield from _numbers(text)


def candidates(text: str) -> list[Span]:
    """Overlapping spans at high recall: written addresses with each possible start and end, base ips that failed,
    and all numbers within a stretch of digits, as a card and as a phone."""
    return list(_candidates(text))


def _gap(near: str) -> int:
    """How far the next digit of the same stretch is, up to 9."""
    rest = near.lstrip(" ().+-")
    return min(len(near) - len(rest), 9) if rest[:1] in _DIGITS_ONLY else 9


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span."""
    kind, i, j = span
    body = text[i:j]
    digits = _DIGITS.sub("", body)
    groups = [len(g) for g in _GROUP.findall(body)] or [0]
    words = _LABEL.findall(body) or [""]
    before, after = text[max(0, i - CONTEXT):i], text[j:j + CONTEXT]
    return [
        KINDS.index(kind), j - i, len(digits), len(groups), max(groups), min(groups), len(digits) / (j - i),
        float(luhn(digits)) if digits else 0.0, float(max((int(g) for g in re.findall("[0-9]{1,6}", body)), default=0) <= 255),
        body.count("."), body.count("-"), body.count(" "), body.count("("), float(body[0] == "+"), float(body[0] == "0"),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
        sum(c.isdigit() for c in before) / CONTEXT, sum(c.isdigit() for c in after) / CONTEXT,
        sum(c.isalpha() for c in before) / CONTEXT, float(":" in before[-3:]), len(set(body)) / (j - i),
        groups[0], groups[-1], groups[-2] if len(groups) > 1 else 0, _gap(before[::-1]), _gap(after), float(before[-1:] in ("+", "(")),
        float(after[:1] in (")", ".", "-")), len({c for c in body if c in " .-()"}),
        float("@" in body), sum(body.count(c) for c in "[({<"), len(words), len(words[0]), len(words[-1]),
        float(words[-1].islower() and words[-1].isalpha()), float(kind == "email" and any(c in ".0123456789_+" for c in body.split(" ")[0])),
    ]


@dataclass(frozen=True)
class Model:
    """Boosted trees as arrays (a node's children are 2n+1 and 2n+2) and a threshold for each kind."""

    feature: np.ndarray  # trees x nodes, -1 at a leaf
    split: np.ndarray
    value: np.ndarray
    thresholds: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        for _ in range(DEPTH):
            feature = self.feature[tree, node]
            right = np.take_along_axis(x, np.maximum(feature, 0), axis=1) > self.split[tree, node]
            node = np.where(feature < 0, node, 2 * node + 1 + right)
        return self.value[tree, node].sum(axis=1)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates above their threshold that touch no base span; of those that overlap, the best."""
        near = sorted(base, key=lambda s: s[1])
        starts, ends = [s[1] for s in near], np.maximum.accumulate([s[2] for s in near]) if near else []
        limits = dict(zip(KINDS, self.thresholds))
        found = (s for s in _candidates(text) if limits[s[0]] < np.inf and _clear(starts, ends, s[1], s[2]))
        best = []
        while some := list(islice(found, SCORED)):  # bounded, however many numbers a text lists
            scores = self.score(np.array([features(text, s) for s in some]))
            best += [(-score, s[1] - s[2], s) for score, s in zip(scores, some) if score > limits[s[0]]]
        taken: list[Span] = []
        free = _Free(starts, ends)
        for *_, s in sorted(best):  # of equal scores the longest
            if free.add(s[1], s[2]):
                taken.append(s)
        return taken


def _clear(starts, ends, start: int, end: int) -> bool:
    """Whether a range touches none of the sorted ranges."""
    k = bisect_left(starts, end)
    return not k or ends[k - 1] <= start


class _Free:
    """Ranges that are taken already; add() takes one if it is free."""

    def __init__(self, starts, ends):
        self.base_starts, self.base_ends = starts, ends
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        if not _clear(self.base_starts, self.base_ends, start, end) or not _clear(self.starts, self.ends, start, end):
            return False
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def _written_email(body: str, turn: int) -> tuple[str, bool]:
    local, _, domain = body.partition("@")
    local, first = local[-64:], domain.split(".")[0]
    forms = [
        (f"{local} (at) {domain}", True), (f"{local} [at] {domain.replace('.', ' [dot] ')}", True),
        (f"{local} (at) {domain.replace('.', ' (dot) ')}", True), (f"{local}(AT){domain}", True),
        (f"{local} at {domain.replace('.', ' dot ')}", True), (f"{local} AT {domain.replace('.', ' DOT ')}", True),
        (f"{local} @ {domain}", True), (f"{local}@{domain.replace('.', ' (dot) ')}", True),
        (f"{local.replace('.', ' dot ')} at {domain.replace('.', ' dot ')}", True), (f"{local} at {domain}", True),
        (f"{local}{{at}}{domain.replace('.', '{dot}')}", True), (f"look at {domain}", False), (f"is at {first} dot", False),
    ]
    return forms[turn % len(forms)]


def _written_phone(body: str, turn: int) -> tuple[str, bool]:
    own = _GROUP.findall(body)
    short = own[1:] if len(own) > 2 and sum(map(len, own[1:])) >= 8 else own  # without the country
    forms = [
        (body.lstrip("+"), True), ("-".join(short), True), ("".join(own), False),  # bare digits say nothing
        (f"({short[0]}) " + "-".join(short[1:]) if len(short) > 1 else body.lstrip("+"), True), (".".join(short), True),
        (" ".join(short), True), ("-".join(own), True), (body, True), (" ".join(own), True),
    ]
    return forms[turn % len(forms)]


def _number(body: str, turn: int) -> str:
    """Other digits in the form of `body`."""
    return _DIGIT.sub(lambda m: str((int(m.group()) * 7 + m.start() * (turn % 9 + 1) + turn) % 10), body)


def _checked(digits: str) -> str:
    """The digits with the last one changed so that they pass Luhn."""
    return next(x for k in "0123456789" if luhn(x := digits[:-1] + k))


def _beside(kind: str, body: str, turn: int) -> list[tuple[str, bool | str]]:
    """A card or a phone number in its own form beside another number, which the base pattern takes for one number
    with it and then drops; the kind stands for a piece that is personal data of another kind."""
    if kind == "card":
        digits, joint = _DIGITS.sub("", body), ("", "", " ", "-")[turn // 3 % 4]
        form = lambda x: joint.join(x[k:k + 4] for k in range(0, len(x), 4)) if joint else x
        card, other, phone = form(digits), form(_checked(_number(digits, turn))), _number("+1 (269) 555-3296", turn)
    else:
        card, other, phone = _checked(_number("4524132264652876", turn)), _checked(_number("4853168114407329", turn)), body
    wrong = card[:-1] + str((int(card[-1]) + 1 + turn % 8) % 10)
    ip = ".".join(str(turn * k % 256) for k in (37, 91, 53, 113))
    few, year, space = str(turn * 7 % 60 + 1), str(1950 + turn * 13 % 100), (" ", False)
    one, two, called = (card, "card"), (other, "card"), (phone, "phone")
    around = [
        [one, space, two], [called, space, one], [one, space, (ip, False)], [(ip, False), space, one], [called, space, (ip, False)],
        [(wrong, False), space, one], [one, space, (wrong, False)], [called, space, one, space, (ip, False)],
        [called, space, (wrong, False)], [(year, False), space, one], [one, space, (few, False)], [called, space, (year, False)],
        [one, space, two, space, one], [(wrong, False), space, (wrong[::-1], luhn(_DIGITS.sub("", wrong[::-1])) and "card")],
    ]
    if kind == "phone":  # the neighbours of a card alone are left to the cards
        around = [pieces for pieces in around if called in pieces]
    return around[turn // 12 % len(around)]


def _rewritten(span: Span, body: str, turn: int) -> list[tuple[str, bool | str]]:
    """Pieces that stand for a span: it in another form, and numbers next to it; each with whether it is personal data
    of the span's kind, or of which kind."""
    kind = span[0]
    if kind in ("card", "phone") and turn % 2:
        return _beside(kind, body, turn)
    turn //= 2 if kind in ("card", "phone") else 1
    if kind == "email":
        return [_written_email(body, turn)]
    if kind == "ip":
        return [(body.rpartition(".")[0] + ".999", False)]
    if kind == "phone":
        one, good = _written_phone(body, turn)
        digits = _DIGITS.sub("", body)
        other = _written_phone(body[:-4] + f"{(int(digits[-4:]) * 7 + turn) % 10000:04}", turn)
    else:
        digits = _DIGITS.sub("", body)
        joint = (".", "  ", " - ")[turn % 3]
        one, good = joint.join(digits[k:k + 4] for k in range(0, len(digits), 4)), True
        if turn % 4 == 3:
            one, good = digits[:-1] + str((int(digits[-1]) + 1 + turn % 8) % 10), False  # a wrong check digit
        other = (one[::-1], False) if luhn(_DIGITS.sub("", one[::-1])) is False else (str(turn % 100), False)
    year, few, space = str(1950 + turn * 13 % 100), str(turn * 7 % 60 + 1), (" ", False)
    return [
        [(one, good)], [(year, False), space, (one, good)], [(one, good)], [(year, False), space, (one, good)], [(one, good), (". ", False), (few, False)],
        [(one, good), space, other], [(f"{few}) ", False), (one, good)], [(one, good), (" ", False), (year, False)],
        [other, (", ", False), (one, good), space, other], [(f"{few}. ", False), (one, good)],
    ][turn // 9 % 10]


def _addable(text: str, base: list[Span]) -> list[Span]:
    """The candidates that touch no base span."""
    near = sorted(base, key=lambda s: s[1])
    starts, ends = [s[1] for s in near], np.maximum.accumulate([s[2] for s in near]) if near else []
    return [s for s in _candidates(text) if _clear(starts, ends, s[1], s[2])]


def examples(texts: list[str], first: int = 0) -> pd.DataFrame:
    """Candidates of the texts and of rewritten texts that could be added: text number (from `first`), kind, features x, label.

    Those that touch a base span are left out, so that precision is that of added spans. An ip has no good
    rewritten form, so none is ever added.
    """
    rows = []
    for number, text in enumerate(texts, first):
        base = base_spans(text)
        found = _addable(text, base)
        for s in found[:: -(-len(found) // TEXT_CANDIDATES) or 1]:
            rows.append((number, s[0], features(text, s), 0.0))
        for turn, span in enumerate([s for s in base if s[2] - s[1] <= LONGEST][:TEXT_SPANS]):
            kind, i, j = span
            before, after = text[max(0, i - 200):i], text[j:j + 200]
            for form in range(FORMS):
                pieces = _rewritten(span, text[i:j], number * 5 + turn * 11 + form * 29)
                at, right = len(before), set()
                for piece, good in pieces:
                    if good:
                        right.add((kind if good is True else good, at, at + len(piece)))
                    at += len(piece)
                changed = before + "".join(piece for piece, _ in pieces) + after
                for s in _addable(changed, base_spans(changed)):
                    if s[1] < at and len(before) < s[2]:
                        rows.append((number, s[0], features(changed, s), float(s in right)))
    return pd.DataFrame(rows, columns=["text", "kind", "x", "label"])


def _spans_by_kind(text: str) -> dict[str, list[Span]]:
    by = {kind: [] for kind in KINDS}
    for s in base_spans(text):
        by[s[0]].append(s)
    return by


def _pieces(text: str, u: float, shares: dict[str, float]) -> Iterator[tuple[str, str]]:
    """(kind, piece) of a text for the kinds whose share it falls in; a kind of "" stands for no base spans."""
    by = _spans_by_kind(text)
    by = {kind: spans for kind, spans in by.items() if spans} or {"": []}
    for kind, spans in by.items():
        if u < shares[kind]:
            pick = int(u * 2**53)
            at = (spans[pick % len(spans)][1] - PIECE // 2) if spans else pick % max(1, len(text) - PIECE + 1)
            at = max(0, min(at, len(text) - PIECE))
            yield kind, text[at:at + PIECE]


def training_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """At most `rows` texts of all partitions, in an order that a hash of doc_id and text sets, so that files do not matter.

    Each kind of base span, and texts without any, fill up to a fifth, by a share of the hash that follows from
    the counts of the whole table; a rare kind is taken whole. A text above PIECE characters gives a window of so
    many around one of its spans, so at most rows * PIECE characters train.
    """
    each, names = -(-rows // (len(KINDS) + 1)), [*KINDS, ""]
    hashed = docs.select((F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))).alias("u"),
                         F.coalesce(F.col("text"), F.lit("")).alias("text"))
    columns = [f"n{k}" for k in range(len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [0] * len(names)
            for text in batch.column(0).to_pylist():
                found = [kind for kind, spans in _spans_by_kind(text).items() if spans] or [""]
                for kind in found:
                    totals[names.index(kind)] += 1
            yield pa.RecordBatch.from_pydict({c: [n] for c, n in zip(columns, totals)})

    counted = hashed.select("text").mapInArrow(count, ", ".join(f"{c} long" for c in columns))
    totals = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns]).first()
    shares = {kind: min(1.0, 1.5 * each / n) if n else 1.0 for kind, n in zip(names, totals)}
    while True:
        def take(batches: Iterator[pa.RecordBatch], shares=shares) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(u, *p) for u, text in zip(*(c.to_pylist() for c in batch.columns)) for p in _pieces(text, u, shares)]
                yield pa.RecordBatch.from_pydict({"u": [r[0] for r in out], "kind": [r[1] for r in out], "piece": [r[2] for r in out]},
                                                 pa.schema([("u", pa.float64()), ("kind", pa.string()), ("piece", pa.string())]))

        most = max(share for share, n in zip(shares.values(), totals) if n) if any(totals) else 0.0
        found = hashed.where(F.col("u") < most).mapInArrow(take, "u double, kind string, piece string")
        found = sorted(map(tuple, found.groupBy("kind", "piece").agg(F.min("u").alias("u")).select("u", "piece", "kind").collect()))
        by = {kind: [(u, piece) for u, piece, k in found if k == kind][:each] for kind in names}
        few = {kind for kind, n in zip(names, totals) if n and len(by[kind]) < each and shares[kind] < 1}
        if not few:  # else many of the counted texts are copies
            break
        shares = {kind: min(1.0, 8 * share) if kind in few else share for kind, share in shares.items()}
    return list(dict.fromkeys(piece for _, piece in sorted(set().union(*by.values()))))[:rows]


def _example_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """`examples` of each text, made and written by tasks: text, place (order within the text), kind, x, label."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = examples([text], number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["text"], pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found["kind"], pa.string()),
                     pa.array(found["x"], pa.list_(pa.float64())), pa.array(found["label"], pa.float64())],
                    ["text", "place", "kind", "x", "label"])

    table = spark.createDataFrame(list(enumerate(texts)), "text long, piece string").repartition(max(1, -(-len(texts) // 128)))
    return kept(table.mapInArrow(make, "text long, place long, kind string, x array<double>, label double"), "pii-examples")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit trees and thresholds on the pieces of `training_texts`; without both labels nothing is ever added.

    The trees are fitted in one task, in a fixed order, so that reruns agree; the sample bounds it. Of the
    calibration half kind, features and label come to the driver.
    """
    nothing = Model(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1)), (np.inf,) * len(KINDS))
    found = _example_table(docs.sparkSession, training_texts(docs, rows))
    fit, held = found.where("text % 2 = 0"), found.where("text % 2 = 1")
    if fit.select("label").distinct().count() < 2:
        return nothing
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    table = fit.coalesce(1).sortWithinPartitions("text", "place").select(array_to_vector("x").alias("features"), "label")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxBins=64).fit(table)
    size = 2 ** (DEPTH + 1) - 1
    feature, split, value = (np.full((TREES, size), v) for v in (-1, 0.0, 0.0))
    for t, (tree, weight) in enumerate(zip(trees.trees, trees.treeWeights)):
        todo = [(tree._call_java("rootNode"), 0)]
        while todo:
            node, k = todo.pop()
            value[t, k] = weight * node.prediction()
            if node.numDescendants():
                feature[t, k], split[t, k] = node.split().featureIndex(), node.split().threshold()
                todo += [(node.leftChild(), 2 * k + 1), (node.rightChild(), 2 * k + 2)]
    model = Model(feature, split, value, (np.inf,) * len(KINDS))
    return Model(feature, split, value, _calibrated(model, held.select("kind", "x", "label").toPandas()))


def _calibrated(model: Model, held: pd.DataFrame) -> tuple[float, ...]:
    """For each kind the lowest score above which at least PRECISION of the held-out candidates are right."""
    out = []
    for kind in KINDS:
        own = held[held["kind"] == kind]
        if not own["label"].sum() >= 5:
            out.append(np.inf)
            continue
        score = model.score(np.array(own["x"].tolist()))
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(own["label"].to_numpy()[order]) / np.arange(1, len(order) + 1)
        last = np.append(score[order][:-1] > score[order][1:], True)  # ties stand or fall together
        good = np.flatnonzero((right >= PRECISION) & last)
        out.append(float(np.nextafter(score[order][good[-1]], -np.inf)) if len(good) else np.inf)
    return tuple(out)


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, spans and base_spans as arrays of (kind, start, end) in code points, by kind and start.

    Needs doc_id and text; a null text is empty and has no spans. Rows are judged one by one, repeated
    or not; an empty table gives an empty table. Whole texts are searched.
    """
    model = model or train(docs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    fields = [("base_spans", pa.list_(span)), ("spans", pa.list_(span))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_dicts = lambda spans: [{"kind": k, "start": i, "end": j} for k, i, j in spans]
        for batch in batches:
            base, every = [], []
            for text in batch.column(1).to_pylist():
                known = base_spans(text)
                base.append(as_dicts(known))
                every.append(as_dicts(sorted(known + model.added(text, known), key=lambda s: (KINDS.index(s[0]), *s[1:]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, (_, t) in zip((base, every), fields)]], ["doc_id", "base_spans", "spans"])

    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base_spans {spans}, spans {spans}")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"[{kind}]"]
        at = max(at, j)
    return "".join(out) + text[at:]


def spans_text(column: str):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
