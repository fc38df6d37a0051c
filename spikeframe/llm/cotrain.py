"""A quality classifier by co-training on two views of a document.

One classifier sees the text (hashed words, symbols, digits, repetition), one the metadata of the page
(language, source, length, and how it is laid out). In each round each gives its confident labels of an unlabelled pool to the other. At the end
each view is calibrated on labelled rows that no round has seen, and the two are combined as
independent evidence. The fit uses bounded samples; every document is scored, in one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeframe.llm.common import kept, words_of

LABELLED_ROWS = 6000  # about so many labelled rows, picked by a hash of the id; a third calibrates
POOL_ROWS = 6000  # about so many unlabelled rows
ROUNDS = 3
CONFIDENT = 0.95
PENALTY, STANDARDISED = 0.001, ("meta_view",)  # rare words must not weigh more for being rare, so the text view keeps its scale
KEEP_FROM = 0.5
WORD_BUCKETS, META_BUCKETS = 1 << 12, 1 << 8
TEXT_COUNTS = ("symbols", "shouts", "digits", "repeated")
META_COUNTS = ("log_length", "log_words", "word_chars", "lines", "capitals", "stops")


def _views(rows: DataFrame) -> DataFrame:
    """Add the feature vectors text_view and meta_view. Null text is empty, null metadata a value of its own."""
    text, length = F.coalesce("text", F.lit("")), F.coalesce("n_chars", F.lit(0)).cast("double")
    rows = rows.withColumn("words", words_of(F.col("text")))
    per_word = lambda c: c / F.greatest(F.size("words"), F.lit(1))
    count = lambda pattern: per_word(F.regexp_count(text, F.lit(pattern)))
    level = lambda share: F.log1p(20 * share)
    rows = rows.select(
        *[c for c in rows.columns if c not in ("text", "lang", "source", "n_chars")],
        # what the text says: shares of its words, on a scale where a few count
        level(count(r"[#*$%&|<>=_{}]")).alias("symbols"), level(count("!")).alias("shouts"), level(count("[0-9]")).alias("digits"),
        level(1 - per_word(F.size(F.array_distinct("words")))).alias("repeated"),
        # how long the page is and how it is laid out
        F.log1p(F.greatest(length, F.lit(0.0))).alias("log_length"), F.log1p(F.size("words")).alias("log_words"),
        per_word(F.char_length(F.array_join("words", ""))).alias("word_chars"), level(count("\n")).alias("lines"),
        level(count("[A-Z]")).alias("capitals"), level(count("[.,;:?]")).alias("stops"),
        F.array(F.concat(F.lit("lang="), F.coalesce("lang", F.lit(""))), F.concat(F.lit("source="), F.coalesce("source", F.lit("")))).alias("meta"))
    for words, buckets, counts, view in (
            ("words", WORD_BUCKETS, TEXT_COUNTS, "text_view"), ("meta", META_BUCKETS, META_COUNTS, "meta_view")):
        rows = HashingTF(numFeatures=buckets, binary=True, inputCol=words, outputCol=f"{view}_tf").transform(rows)
        rows = VectorAssembler(inputCols=[*counts, f"{view}_tf"], outputCol=view).transform(rows).drop(f"{view}_tf")
    return rows.drop("words", "meta", *TEXT_COUNTS, *META_COUNTS)


def _renamed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def _picked(column: Column, rows: int, total: int, salt: str) -> Column:
    """True for about `rows` of `total` rows, by a hash."""
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(max(1, total // max(1, rows)))) == 0


@dataclass(frozen=True)
class Model:
    """The two classifiers, slope and offset of each one's calibration, and the log-odds of the labels."""

    views: dict[str, object]
    calibration: dict[str, tuple[float, float]]
    prior: float

    def score(self, viewed: DataFrame) -> DataFrame:
        logits = {}
        for view, model in self.views.items():
            viewed = _scored(viewed, model, view)
            slope, offset = self.calibration[view]
            logits[view] = slope * F.col(f"{view}_logit") + offset
        chance = lambda logit: 1 / (1 + F.exp(-logit))
        text, meta = logits["text_view"], logits["meta_view"]
        return viewed.select(
            "doc_id", chance(text).alias("text_score"), chance(meta).alias("meta_score"),
            chance(text + meta - self.prior).alias("score"))


def _scored(rows: DataFrame, model, view: str) -> DataFrame:
    out = model.setFeaturesCol(view).setRawPredictionCol(f"{view}_raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    return out.withColumn(f"{view}_logit", F.get(vector_to_array(f"{view}_raw"), F.lit(1))).drop(f"{view}_raw")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Co-train on bounded samples. `labels` has doc_id and quality (0 or 1); None without both labels.

    Rows of `labels` without an id or with another label are left out; of several labels of a document the largest counts.
    A third of the labelled rows is held back to calibrate both views. Where that third, or the rest, has
    one label only, all labelled rows are fitted and calibrate too: scores are then surer than they should be.
    """
    known = kept(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").cast("double").alias("label")), "labels")
    total, good = known.agg(F.count("*"), F.sum("label")).first()
    if not total or good in (0, total):
        return None
    number = docs.select("doc_id").count()
    chosen = known.where(_picked(F.col("doc_id"), LABELLED_ROWS, total, "labelled"))
    rows = _renamed(docs)
    fit = rows.join(F.broadcast(chosen), "doc_id")  # bounded by LABELLED_ROWS, up to chance
    pool = rows.where(_picked(F.col("doc_id"), POOL_ROWS, number, "pool")).join(known.select("doc_id"), "doc_id", "left_anti")
    sample = fit.unionByName(pool.withColumn("label", F.lit(None).cast("double")))
    part = F.when(F.col("label").isNull(), "pool").when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, "held").otherwise("fit")
    sample = kept(_views(sample.withColumn("part", part)).repartition(4, "doc_id"), "cotraining")
    fit, pool, held = (sample.where(F.col("part") == p) for p in ("fit", "pool", "held"))
    if fit.select("label").distinct().count() < 2 or held.select("label").distinct().count() < 2:
        fit = held = sample.where("label is not null")  # too few rows to hold some out
        if fit.select("label").distinct().count() < 2:
            return None

    other = {"text_view": "meta_view", "meta_view": "text_view"}
    given = dict.fromkeys(other)  # view -> pool rows with the labels that the other view is sure of
    views = {}
    for _ in range(ROUNDS):
        for view in other:
            rows = fit if given[view] is None else fit.unionByName(given[view])
            views[view] = LogisticRegression(
                featuresCol=view, regParam=PENALTY, standardization=view in STANDARDISED, maxIter=40).fit(rows.select(view, "label"))
        sure = F.lit(CONFIDENT / (1 - CONFIDENT))
        for view, model in views.items():
            logit = F.col(f"{view}_logit")
            label = F.when(logit >= F.log(sure), 1.0).when(logit <= -F.log(sure), 0.0)
            given[other[view]] = _scored(pool, model, view).withColumn("label", label).where("label is not null").select(pool.columns)

    calibration = {}
    for view, model in views.items():
        line = VectorAssembler(inputCols=[f"{view}_logit"], outputCol="logit").transform(_scored(held, model, view))
        platt = LogisticRegression(featuresCol="logit", maxIter=50, regParam=1e-3, standardization=False).fit(line.select("logit", "label"))
        calibration[view] = float(platt.coefficients[0]), float(platt.intercept)
    share = held.agg(F.avg("label")).first()[0]
    from math import log

    return Model(views, calibration, log(share / (1 - share)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, text_score, meta_score, score and kept (score of at least KEEP_FROM).

    Needs doc_id, text, lang, source, n_chars; nulls are values of their own, and repeated rows get one
    score. Where `labels` lack one of the two labels nothing can be learned: scores are null and all
    rows are kept. An empty table gives an empty table.
    """
    model = train(docs, labels)
    if model is None:
        unknown = F.lit(None).cast("double")
        return docs.select("doc_id", unknown.alias("text_score"), unknown.alias("meta_score"), unknown.alias("score"), F.lit(True).alias("kept"))
    return model.score(_views(_renamed(docs))).withColumn("kept", F.col("score") >= KEEP_FROM)
