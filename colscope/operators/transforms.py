"""Derived columns: bins, lengths, logs, frequencies, codes and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.running import running_totals


def add_age_group(df: DataFrame, name: str) -> DataFrame:
    """(0, 12] child, (12, 17] teen, (17, 64] adult, (64, 200] senior, otherwise null."""
    x = C.number(df, name)
    group = (
        F.when((x > 0) & (x <= 12), "child").when((x > 12) & (x <= 17), "teen")
        .when((x > 17) & (x <= 64), "adult").when((x > 64) & (x <= 200), "senior")
    )
    return df.withColumn(f"{name}_group", group)


def add_text_length(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(f"{name}_length", F.coalesce(F.length(C.col(name)), F.lit(0)))


def add_log(df: DataFrame, name: str) -> DataFrame:
    x = C.number(df, name)
    return df.withColumn(f"{name}_log", F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))))


def add_frequency(df: DataFrame, name: str) -> DataFrame:
    """Count of the row's own value; 0 for null. The counts are joined, the plan decides how."""
    counts = df.filter(C.col(name).isNotNull()).groupBy(C.col(name).alias("_value")).agg(F.count("*").alias("_n"))
    joined = df.join(counts, C.col(name) == F.col("_value"), "left")
    return joined.withColumn(f"{name}_freq", F.coalesce("_n", F.lit(0))).drop("_value", "_n")


def label_codes(df: DataFrame, name: str) -> DataFrame:
    """(value, code): codes from 0 in alphabetical order of the text form."""
    values = df.select(C.as_text(df, name).alias("value")).dropna().distinct().withColumn("one", F.lit(1))
    return running_totals(values, "value", {"code": "one"}).select("value", F.col("code").cast("long").alias("code"))


def add_label_code(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    codes = label_codes(df, name).select(F.col("value").alias("_value"), F.col("code").alias(out or f"{name}_code"))
    return df.join(codes, C.as_text(df, name) == F.col("_value"), "left").drop("_value")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(value, weight): rows / (classes x rows of the class)."""
    counts = df.filter(C.col(target).isNotNull()).groupBy(C.col(target).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.select("value", (total / (classes * F.col("n"))).alias("weight"))
