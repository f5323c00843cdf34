"""Tests of the relation between two columns. Each returns one row, or none when the test does not apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.tails import chi2_p_value, f_p_value, t_p_value

SIGNIFICANCE = 0.05


def _judged(df: DataFrame) -> DataFrame:
    """Round p after judging it."""
    return df.withColumn("significant", F.col("p_value") < SIGNIFICANCE).withColumn("p_value", C.round_to("p_value", 4))


def number_vs_number(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pearson_r, n, p_value, significant) on at least five complete rows."""
    x = df.select(C.number(df, a).alias("a"), C.number(df, b).alias("b")).dropna()
    r = F.col("r")
    t = F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (1 - r * r))).otherwise(F.lit(float("inf")))
    tested = x.agg(F.corr("a", "b").alias("r"), F.count("*").alias("n")).filter("n >= 5")
    return _judged(tested.select(C.round_to("r", 4).alias("pearson_r"), "n",
                                 t_p_value(t, (F.col("n") - 2).cast("double")).alias("p_value")))


def group_moments(df: DataFrame, number: str, category: str, least: int) -> DataFrame:
    """(n, mean, within) per category with at least `least` numbers; `within` is the sum of squares."""
    x = df.select(C.number(df, number).alias("x"), C.col(category).alias("g")).dropna()
    return (
        x.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"),
                           (F.var_pop("x") * F.count("*")).alias("within"))
        .filter(F.col("n") >= least)
    )


def f_statistic(groups: DataFrame) -> DataFrame:
    """(f, k, n) of one-way analysis of variance from group moments."""
    grand = groups.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    sums = groups.withColumn("between", F.col("n") * F.pow(F.col("mean") - grand, 2)).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("between").alias("between"), F.sum("within").alias("within"))
    return sums.filter("k >= 2").select(
        F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("f"), "k", "n")


def number_vs_category(df: DataFrame, number: str, category: str) -> DataFrame:
    """(f_statistic, n_groups, p_value, significant) over the groups with at least three numbers."""
    tested = f_statistic(group_moments(df, number, category, 3))
    p = f_p_value(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    return _judged(tested.select(C.round_to("f", 4).alias("f_statistic"), F.col("k").alias("n_groups"), p.alias("p_value")))


def category_vs_category(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof, cramers_v, p_value, significant), with Yates' correction for 2 x 2 tables.

    Empty cells are never formed: a cell without rows adds its expected count, and all expected counts
    add up to the number of rows.
    """
    cells = df.select(C.col(a).alias("a"), C.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("row"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("col"))
    n = cells.agg(F.sum("o")).scalar()
    row_marks = rows.agg(F.struct(F.count("*").alias("levels"), F.sum(1 / F.col("row")).alias("inverse"))).scalar()
    col_marks = cols.agg(F.struct(F.count("*").alias("levels"), F.sum(1 / F.col("col")).alias("inverse"))).scalar()
    e = F.col("row") * F.col("col") / F.col("n")
    gap = F.col("o") - e
    sums = cells.join(rows, "a").join(cols, "b").withColumn("n", n).agg(
        F.sum(gap * gap / e - e).alias("s"), F.max(F.abs(gap)).alias("gap"), F.max("n").alias("n"))
    flat = sums.select("s", "gap", "n", row_marks.alias("r"), col_marks.alias("c"))
    corrected = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    dof = (F.col("r.levels") - 1) * (F.col("c.levels") - 1)
    chi2 = F.when(dof == 1, corrected * corrected * F.col("n") * F.col("r.inverse") * F.col("c.inverse")).otherwise(
        F.col("s") + F.col("n"))
    smaller = F.least("r.levels", "c.levels")
    tested = flat.filter(smaller >= 2).select(chi2.alias("x"), dof.alias("dof"), smaller.alias("k"), "n")
    return _judged(
        tested.select(C.round_to("x", 4).alias("chi2"), "dof",
                      C.round_to(F.sqrt(F.col("x") / (F.col("n") * (F.col("k") - 1))), 4).alias("cramers_v"),
                      chi2_p_value(F.col("x"), F.col("dof").cast("double")).alias("p_value")))
