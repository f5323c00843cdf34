"""Numeric and categorical summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.quantiles import exact_percentiles


def distribution_shape(skew: Column, kurt: Column) -> Column:
    return (
        F.when((F.abs(skew) < 0.5) & (F.abs(kurt) < 1), "normal")
        .when(skew > 1, "right_skewed")
        .when(skew < -1, "left_skewed")
        .when((F.abs(skew) < 0.5) & (kurt > 3), "leptokurtic")
        .when((F.abs(skew) < 0.5) & (kurt < -1), "uniform")
        .otherwise("unknown")
    )


def modes(counts: DataFrame) -> DataFrame:
    """(column, mode): the most frequent value, the smallest on ties."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return counts.groupBy("column").agg(best.alias("best")).select("column", F.col("best.value").alias("mode"))


def numeric_summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Moments, extremes, mode and quartiles of each column with at least two numbers."""
    names = names if names is not None else C.numeric_columns(df)
    quartiles = exact_percentiles(df, {n: C.number(df, n) for n in names}, [0.25, 0.5, 0.75])
    rows = []
    for n in names:
        x = C.number(df, n)
        q1, q2, q3 = [F.lit(q).cast("double") for q in quartiles[n]]
        rows.append(
            F.struct(
                F.lit(n).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), q2.alias("median"),
                F.min(x).alias("min"), F.max(x).alias("max"), F.var_samp(x).alias("variance"),
                F.stddev_samp(x).alias("std"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
                q1.alias("q1"), q3.alias("q3"),
            )
        )
    r = lambda name: C.round_to(name, 4).alias(name)
    return (
        C.tidy(df, rows)
        .filter("count >= 2")
        .join(modes(C.number_counts(df, names)), "column")
        .select(
            "column", "count", r("mean"), r("median"), r("mode"), r("min"), r("max"),
            C.round_to(F.col("max") - F.col("min"), 4).alias("range"), r("variance"), r("std"), r("skewness"),
            r("kurtosis"), r("q1"), r("q3"), C.round_to(F.col("q3") - F.col("q1"), 4).alias("iqr"),
            F.when(F.col("mean") != 0, C.round_to(F.col("std") / F.col("mean"), 4)).alias("cv"),
            distribution_shape(F.col("skewness"), F.col("kurtosis")).alias("distribution_shape"),
        )
    )


def skewness(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, skewness) of each column with at least two numbers: what advice needs of the numeric summary, without its
    percentiles and modes."""
    names = names if names is not None else C.numeric_columns(df)
    rows = [F.struct(F.lit(n).alias("column"), F.count(C.number(df, n)).alias("count"), F.skewness(C.number(df, n)).alias("skewness")) for n in names]
    return C.tidy(df, rows).filter("count >= 2").select("column", C.round_to("skewness", 4).alias("skewness"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, by count and then by value, with their place."""
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def rare_values(counts: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(column, value, n) of the values below the given share of their column."""
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(totals, "column").filter(F.col("n") / F.col("total") < threshold).drop("total")


def imbalance_label(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), "N/A").when(ratio < 1.5, "balanced").when(ratio < 3, "mild imbalance")
        .when(ratio < 10, "moderate imbalance").otherwise("severe imbalance")
    )


def categorical_summary(counts: DataFrame) -> DataFrame:
    """One row per column of a (column, value, n) table: classes, dominance and imbalance."""
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    per = counts.groupBy("column").agg(
        F.count("*").alias("unique_count"), F.sum("n").alias("total"), F.max("n").alias("most"),
        F.min("n").alias("least"), top.alias("top"))
    rare = rare_values(counts).groupBy("column").agg(F.count("*").alias("rare_count"))
    dominant = F.col("most") / F.col("total")
    ratio = F.when(F.col("unique_count") > 1, F.col("most") / F.col("least"))
    return per.join(rare, "column", "left").select(
        "column", "unique_count", F.coalesce("rare_count", F.lit(0)).alias("rare_count"),
        F.when(dominant > 0.8, F.col("top.value")).alias("dominant_category"),
        C.round_to(dominant, 4).alias("dominant_pct"),
        C.round_to(ratio, 2).alias("class_imbalance_ratio"),
        imbalance_label(ratio).alias("imbalance_label"),
    )
