"""Comparison of genotypes over the per-recording features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import r_mean, r_se
from ..functions.pvalues import student_p_value


MOST_GROUPS = 1000  # genotypes that become columns


def feature_long(summary: DataFrame) -> DataFrame:
    """One row per recording and numeric column, with the column's position."""
    names = [f.name for f in summary.schema.fields if isinstance(f.dataType, T.NumericType)]
    values = summary.select("fileName", "genotype", *[F.col(n).cast("double").alias(n) for n in names])
    long = values.unpivot(["fileName", "genotype"], names, "variable", "value")
    position = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return long.withColumn("position", F.element_at(position, F.col("variable")))


def _without_constant_length(stats: DataFrame) -> DataFrame:
    """Drop maxRecording where it is the same in all recordings.

    Works on the aggregated rows: one per variable and group.
    """
    over = Window.partitionBy("variable")
    constant = (F.min("_lo").over(over) == F.max("_hi").over(over)) & (F.sum("_missing").over(over) == 0)
    flagged = stats.withColumn("_drop", (F.col("variable") == "maxRecording") & F.coalesce(constant, F.lit(False)))
    return flagged.where(~F.col("_drop")).drop("_drop", "_lo", "_hi", "_missing")


def _range():
    return [
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("_missing"),
    ]


def group_means(summary: DataFrame) -> DataFrame:
    """Mean and standard error of every numeric feature by genotype."""
    stats = feature_long(summary).groupBy("variable", "position", "genotype").agg(
        F.count("*").alias("n"), r_mean("value").alias("mean"), r_se("value").alias("sem"), *_range())
    return _without_constant_length(stats)


def group_error_bounds(summary: DataFrame) -> DataFrame:
    """Group means with the interval of one standard error around them."""
    return group_means(summary).withColumns({
        "ymin": F.col("mean") - F.col("sem"),
        "ymax": F.col("mean") + F.col("sem"),
    })


def _is_wt() -> Column:
    return F.coalesce(F.lower("genotype").contains("wt"), F.lit(False))


def welch_t(summary: DataFrame) -> DataFrame:
    """Per variable: means and errors of both sides, Welch's |t| and its degrees of freedom.

    WT is every genotype that contains "wt" in any case, GM all others. The test
    leaves missing values out although the means do not.
    """
    wt = _is_wt()
    long = feature_long(summary)
    columns = []
    for side, on_side in (("WT", wt), ("GM", ~wt)):
        value = F.when(on_side, F.col("value"))
        n = F.count(F.when(on_side, 1))
        whole = F.count(value) == n
        columns += [
            F.when(whole, F.avg(value)).alias(f"{side}_mean"),
            F.when(whole, F.stddev_samp(value) / F.sqrt(n)).alias(f"{side}_sem"),
            F.count(value).alias(f"{side}_n"),
            F.avg(value).alias(f"{side}_avg"),
            F.var_samp(value).alias(f"{side}_var"),
        ]
    stats = _without_constant_length(long.groupBy("variable", "position").agg(*columns, *_range()))
    return stats.withColumns(_welch()).select(
        "variable", "position", "WT_mean", "WT_sem", "GM_mean", "GM_sem", "t", "df")


def _welch() -> dict[str, Column]:
    """Welch's |t| and its degrees of freedom, from the n, avg and var of WT and GM."""
    a = F.col("WT_var") / F.col("WT_n")
    b = F.col("GM_var") / F.col("GM_n")
    error = F.sqrt(a + b)
    # Constant data have no t statistic.
    scale = F.greatest(F.abs("WT_avg"), F.abs("GM_avg"))
    spread = (F.col("WT_n") > 1) & (F.col("GM_n") > 1) & (error >= 10 * F.lit(2.220446049250313e-16) * scale) & (error > 0)
    t = F.abs(F.try_divide(F.col("WT_avg") - F.col("GM_avg"), error))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("WT_n") - 1) + F.try_divide(b * b, F.col("GM_n") - 1))
    return {"t": F.when(spread, t), "df": F.when(spread, df)}


def bi_summary(summary: DataFrame) -> DataFrame:
    """Summary table of two sides: one row per variable, in column order."""
    stats = welch_t(summary)
    # One row per variable, so the p-values are a handful of Python calls.
    return stats.withColumn("p", student_p_value(F.col("t"), F.col("df"))).orderBy("position").select(
        F.col("variable").alias("Variable"), "WT_mean", "WT_sem", "GM_mean", "GM_sem",
        F.round("t", 2).alias("T_stat"), F.round("p", 4).alias("P_value"))


def multi_summary(summary: DataFrame, genotypes: list[str | None] | None = None) -> DataFrame:
    """Mean, standard error and n of every variable for any number of genotypes.

    By default the genotypes of the data, in order; recordings without one come last, as "NA", or
    as "missing" where a genotype has the name "NA". A list may add and order genotypes, but one that leaves out a genotype of the data is refused.
    """
    stats = group_means(summary)
    # One row per genotype: they become columns, so there must not be many.
    present = [r.genotype for r in summary.select("genotype").distinct().limit(MOST_GROUPS + 1).collect()]
    if len(present) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} genotypes do not fit into columns; group_means and vs_wt have rows")
    if genotypes is None:
        genotypes = sorted(present, key=lambda g: (g is None, g or ""))
    elif left := set(present) - set(genotypes):
        raise ValueError(f"genotypes not in the list: {sorted(map(str, left))}")
    columns = []
    for g in genotypes:
        here = F.col("genotype").eqNullSafe(F.lit(g))
        name = g if g is not None else "missing" if "NA" in genotypes else "NA"
        columns += [F.max(F.when(here, F.col(c))).alias(f"{name}_{c}") for c in ("mean", "sem", "n")]
    return stats.groupBy("variable", "position").agg(*columns)


def vs_wt(summary: DataFrame) -> DataFrame:
    """Every other genotype against WT: one row per variable and genotype.

    WT is every genotype that contains "wt" in any case; recordings without a genotype
    are a group of their own. `t` and `df` are Welch's, `p` is two-sided, and `p_adjusted`
    corrects for the number of genotypes tested per variable: step by step from the
    smallest p, each times the number of tests left, never below the one before (Holm).
    A test without a p-value does not count. Constant lengths drop out as in `welch_t`.
    """
    group = F.when(_is_wt(), "WT").otherwise(F.col("genotype"))
    long = feature_long(summary).withColumns({"_wt": _is_wt(), "genotype": group})
    stats = _without_constant_length(long.groupBy("variable", "position", "_wt", "genotype").agg(
        r_mean("value").alias("GM_mean"), r_se("value").alias("GM_sem"), F.count("value").alias("GM_n"),
        F.avg("value").alias("GM_avg"), F.var_samp("value").alias("GM_var"), *_range()))
    # The row of WT goes to the rows of the others: a handful of rows per variable.
    variable = Window.partitionBy("variable")
    sides = {f"WT_{c}": F.max(F.when(F.col("_wt"), F.col(f"GM_{c}"))).over(variable) for c in ("mean", "sem", "n", "avg", "var")}
    tests = stats.withColumns(sides).where(~F.col("_wt")).withColumns(_welch())
    tests = tests.withColumn("p", student_p_value(F.col("t"), F.col("df")))
    ordered = variable.orderBy(F.col("p").asc_nulls_last(), F.col("genotype").asc_nulls_last())
    left = F.count("p").over(variable) - F.row_number().over(ordered) + 1
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = tests.withColumn("_step", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.col("p") * left)))
    adjusted = F.when(F.col("p").isNotNull(), F.max("_step").over(upto))
    return steps.withColumn("p_adjusted", adjusted).select(
        "variable", "position", "genotype", "WT_n", "WT_mean", "WT_sem", "GM_n", "GM_mean", "GM_sem", "t", "df", "p", "p_adjusted")
