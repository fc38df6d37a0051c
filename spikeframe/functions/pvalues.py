"""Distribution functions of the two-sample tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _student_p():
    # Defined in here, so that it travels to the executors by value.
    def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
        def log_beta(a, b):
            return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

        def fraction(a, b, x):
            """Continued fraction of the incomplete beta function, by Lentz's method."""
            tiny = 1e-300
            f, c, d = 1.0, 1.0, 0.0
            for i in range(500):
                m = i // 2
                if i == 0:
                    term = 1.0
                elif i % 2 == 0:
                    term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                else:
                    term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                d = 1.0 + term * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + term / c
                c = c if abs(c) > tiny else tiny
                f *= c * d
                if abs(1.0 - c * d) < 1e-15:
                    break
            return f - 1.0

        def incomplete_beta(a, b, x):
            if x <= 0.0:
                return 0.0
            if x >= 1.0:
                return 1.0
            front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b))
            if x < (a + 1) / (a + b + 2):
                return front * fraction(a, b, x) / a
            return 1.0 - front * fraction(b, a, 1 - x) / b

        def one(t, df):
            if not (np.isfinite(t) and np.isfinite(df) and df > 0):
                return None
            return incomplete_beta(df / 2, 0.5, df / (df + t * t))

        return pd.Series([one(a, b) for a, b in zip(t.astype(float), df.astype(float))], dtype="float64")

    return F.pandas_udf(student_p, "double")


def student_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic. Meant for tables of test results."""
    p = _student_p()(t, df)
    return F.when(t.isNotNull() & df.isNotNull(), p)


def kolmogorov_p_value(d: Column, n: Column, m: Column) -> Column:
    """Limit of the two-sample Kolmogorov-Smirnov p-value for large samples."""
    z = d * F.sqrt(F.try_divide(n.cast("double") * m, n + m))

    def series(terms: int, term) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + term(k.cast("double")))

    # Both series have the same limit; each converges fast on its side of 1.
    far = F.lit(2.0) * series(100, lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z))
    odd = series(20, lambda k: F.exp(-((2 * k - 1) * (2 * k - 1)) * F.lit(9.869604401089358) / (8.0 * z * z)))
    near = 1.0 - F.lit(2.5066282746310002) / z * odd
    p = F.when(z <= 0, 1.0).when(z < 1, near).otherwise(far)
    # greatest and least leave a missing value out.
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
