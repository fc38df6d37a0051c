"""Aggregates and predicates with the missing-value rules of the data model.

A missing value makes a plain mean or standard deviation missing; NULL stands
for every undefined number, so neither NaN nor infinity enters a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r_mean(x: Column | str) -> Column:
    """Mean that is NULL as soon as one value is."""
    x = _col(x)
    return F.when(F.count(x) == F.count("*"), F.avg(x))


def r_sd(x: Column | str) -> Column:
    """Sample standard deviation that is NULL as soon as one value is."""
    x = _col(x)
    return F.when(F.count(x) == F.count("*"), F.stddev_samp(x))


def r_se(x: Column | str) -> Column:
    """Standard error of the mean; missing values count towards n."""
    return r_sd(x) / F.sqrt(F.count("*"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def capped(x: Column | str, limit: float) -> Column:
    """The smaller of x and the limit; a missing x stays missing."""
    x = _col(x)
    return F.when(x > F.lit(limit), F.lit(limit)).otherwise(x)


def in_interval(x: Column | str, low: float, high: float) -> Column:
    """True strictly between the two ends."""
    x = _col(x)
    return (x > F.lit(low)) & (x < F.lit(high))


def channel_list(x: Column | str) -> Column:
    """Comma list of channel ids as array<int>; entries that are no number drop out."""
    ids = F.transform(F.split(_col(x), ","), lambda e: F.trim(e).try_cast("int"))
    return F.filter(ids, lambda e: e.isNotNull())


def complete_zero(summary: DataFrame, features: DataFrame, names: list[str], on: str = "fileName") -> DataFrame:
    """Add features to the summary; recordings absent from them get 0.

    A NULL feature of a recording that is present stays NULL.
    """
    marked = features.select(on, *names, F.lit(True).alias("_present"))
    return summary.join(marked, on, "left").select(
        *summary.columns,
        *[F.when(F.col("_present").isNull(), F.lit(0)).otherwise(F.col(n)).alias(n) for n in names],
    )


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
