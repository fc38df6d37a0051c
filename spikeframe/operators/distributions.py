"""Distribution of channel rates by genotype and the Kolmogorov-Smirnov test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ratio
from ..functions.pvalues import kolmogorov_p_value
from ..layout import Slicing



def channel_rates(table: DataFrame) -> DataFrame:
    """Rows per second of every channel, from a spike table or a burst table."""
    return (
        table.where(F.col("genotype") != "NA")
        .groupBy("fileName", "genotype", "channel_id", "maxRecording")
        .agg(F.count("*").alias("n"))
        .select("fileName", "genotype", "channel_id", ratio("n", "maxRecording").alias("Hz"))
    )


def _known_rates(rates: DataFrame) -> DataFrame:
    # Rates are spread over decades, so slices of them are cut on the logarithm.
    return rates.where(F.col("Hz") > 0).withColumn("_log", F.log2("Hz"))


def ecdf(rates: DataFrame) -> DataFrame:
    """Fraction of channels with at most this rate, per genotype and distinct rate."""
    values = _known_rates(rates).groupBy("genotype", "Hz", "_log").agg(F.count("*").alias("n"))
    groups = Slicing.measure(values, ["genotype"], "_log", "rate_slice")
    total = values.groupBy("genotype").agg(F.sum("n").alias("_total"))
    counted = groups.running_sum(groups.split(values, "_log"), "_upto", F.col("n"), "Hz")
    return groups.lookup(counted, total).select(
        "genotype", "Hz", "n", (F.col("_upto") / F.col("_total")).alias("ecdf"))


def ks_test(rates: DataFrame, genotypes: tuple[str, str] = ("WT", "KO"), method: str = "asymptotic") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test between two genotypes: n, m, D, p_value, method.

    The caller chooses the p-value, whatever the size: "asymptotic" is the
    large-sample limit, "exact" goes through all orders of the pooled sample whose
    gap stays below D. That is a walk from value to value, so one task does it; it reads
    the sorted values as a stream, holds the band of orders below D, about
    2 * D * n * m / (n + m) numbers, and takes 2 * D * n * m steps.
    """
    if method not in ("exact", "asymptotic"):
        raise ValueError(f"unknown method: {method}")
    first, second = genotypes
    counts = [F.count(F.when(F.col("genotype") == g, 1)).alias(c) for g, c in ((first, "_a"), (second, "_b"))]
    values = (
        _known_rates(rates).where(F.col("genotype").isin(first, second))
        .withColumn("pair", F.lit(f"{first} - {second}"))
        .groupBy("pair", "Hz", "_log").agg(*counts)
    )
    pairs = Slicing.measure(values, ["pair"], "_log", "rate_slice")
    counted = pairs.split(values, "_log")
    counted = pairs.running_sum(counted, "_a_upto", F.col("_a"), "Hz")
    counted = pairs.running_sum(counted, "_b_upto", F.col("_b"), "Hz")
    total = values.groupBy("pair").agg(F.sum("_a").alias("n"), F.sum("_b").alias("m"))
    gap = F.abs(F.try_divide(F.col("_a_upto"), F.col("n")) - F.try_divide(F.col("_b_upto"), F.col("m")))
    result = pairs.lookup(counted, total).groupBy("pair", "n", "m").agg(F.max(gap).alias("D"))
    result = result.withColumn("method", F.lit(method))
    if method == "asymptotic":
        return result.withColumn("p_value", kolmogorov_p_value(F.col("D"), F.col("n"), F.col("m")))
    known = result.where((F.col("n") > 0) & (F.col("m") > 0)).select("pair", "n", "m", "D")
    steps = pairs.lookup(values, known).select("pair", "Hz", (F.col("_a") + F.col("_b")).alias("ties"), "n", "m", "D")
    p = steps.repartition(1).sortWithinPartitions("Hz").mapInPandas(_exact_p(), "pair string, p_value double")
    return result.join(p, "pair", "left")


def _exact_p():
    # Defined in here, so that it travels to the executors by value.
    def exact_p(batches):
        """P(D >= d) over all orders of the pooled sample, ties kept together.

        Walks through the distinct values. `mass[k]` is the share of the ways to have met
        low + k of the first sample so far that stayed below d throughout. Ways that can
        no longer be below d at the end of a value are cut off on either side, so only the
        band |i / n - j / m| < d is ever held, and what ties add to it.
        """
        import numpy as np
        import pandas as pd

        mass, low, met, pair = np.ones(1), 0, 0, None
        for batch in batches:
            for pair, ties, n, m, d in zip(*(batch[c].tolist() for c in ("pair", "ties", "n", "m", "D"))):
                # Whole steps of 1 / (n * m), so that rounding cannot move the limit.
                limit = round(d * n * m)
                for _ in range(int(ties)):
                    left = n + m - met
                    i = np.arange(low, low + len(mass))
                    grown = np.zeros(len(mass) + 1)
                    grown[:-1] = mass * (np.maximum(m - met + i, 0) / left)
                    grown[1:] += mass * ((n - i) / left)
                    met += 1
                    first, last = max(low, met - m), min(low + len(mass), met, n)
                    mass, low = grown[first - low:last - low + 1], first
                # i * (n + m) lies strictly between met * n - limit and met * n + limit
                first = max(low, (met * n - limit) // (n + m) + 1)
                last = min(low + len(mass) - 1, -((-met * n - limit) // (n + m)) - 1)
                mass, low = mass[first - low:max(last - low + 1, first - low)], first
                if not len(mass):
                    break
        if pair is not None:
            p = 1.0 if limit <= 0 else 1.0 - float(mass.sum())
            yield pd.DataFrame({"pair": [pair], "p_value": [min(max(p, 0.0), 1.0)]})

    return exact_p
