"""Semantic column types, decided from the data and not from the storage type alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C

# The two-word sets that make a column boolean.
BOOLEAN_PAIRS = [("true", "false"), ("yes", "no"), ("y", "n"), ("t", "f"), ("male", "female"), ("m", "f")]


SHORT = 64


def _short_word(c: Column) -> Column:
    """Stripped and in lower case; of a long text its start and a mark, which sorts as the whole would beside short words."""
    start = C.strip(F.substring(c, 1, SHORT))
    return F.when((F.length(c) > SHORT) & (start != ""), F.concat(F.lower(start), F.lit("…"))).otherwise(F.lower(C.strip(c)))


def column_facts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Everything one scan can tell about each column; one row per column."""
    rows = []
    for i, name in enumerate(df.columns):
        if names is not None and name not in names:
            continue
        t = C.type_of(df, name)
        kind = C.kind_of(t)
        c = C.col(name)
        present = c.isNotNull() & ~F.isnan(c) if C.is_float(t) else c.isNotNull()
        x = C.number(df, name)
        word = _short_word(c) if kind == "string" else None
        if kind == "boolean":
            word = c.cast("string")
        null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
        numeric = kind in ("integer", "float", "boolean")
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(t.simpleString()).alias("dtype_raw"),
                F.lit(kind).alias("kind"),
                F.count("*").alias("n_rows"),
                F.count_if(present).alias("non_null_count"),
                (F.avg(F.length(c)) if kind == "string" else null_d).alias("avg_length"),
                (F.count_if(x.isNotNull()) if kind == "string" else F.lit(0).cast("long")).alias("number_like"),
                (C.date_like(c) if kind == "string" else F.lit(0).cast("long")).alias("date_like"),
                (F.min(word) if word is not None else null_s).alias("low_word"),
                (F.max(word) if word is not None else null_s).alias("high_word"),
                (F.min(x) if numeric else null_d).alias("low"),
                (F.max(x) if numeric else null_d).alias("high"),
                (F.skewness(x) if numeric else null_d).alias("skewness"),
            )
        )
    return C.tidy(df, rows)


def class_of() -> Column:
    """The class of a row holding the column facts and `unique_count`; the first match wins."""
    kind, unique, filled = F.col("kind"), F.col("unique_count"), F.col("non_null_count")
    share = unique / filled
    pair = C.any_of(
        [(F.col("low_word") == min(p)) & (F.col("high_word") == max(p)) for p in BOOLEAN_PAIRS]
    )
    zero_one = kind.isin("integer", "float") & (F.col("low") == 0) & (F.col("high") == 1)
    string = kind == "string"
    number_share = F.col("number_like") / filled
    return (
        F.when(filled == 0, "categorical")
        .when((unique == 2) & (F.coalesce(pair, F.lit(False)) | zero_one), "boolean")
        .when((share > 0.95) & (kind.isin("integer") | string), "identifier")
        .when(kind == "datetime", "datetime")
        .when(string & (F.col("date_like") / filled > 0.8), "datetime")
        .when(kind.isin("integer", "float", "boolean"), "numerical")
        .when(string & (F.col("avg_length") > 50), "text")
        .when(string & (number_share > 0.05) & (number_share < 0.95), "mixed")
        .when(string & (share < 0.5), "categorical")
        .when(string, "identifier")
        .otherwise("categorical")
    )


def classified(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Column facts with `unique_count` and `dtype_class`."""
    facts = column_facts(df, names)
    unique = C.distinct_counts(df, [n for n in df.columns if names is None or n in names])
    return (
        facts.join(unique, "column", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
        .withColumn("dtype_class", class_of())
    )


def column_types(df: DataFrame) -> DataFrame:
    """(column, dtype_class)."""
    return classified(df).select("column", "dtype_class")


def varying_columns(df: DataFrame) -> DataFrame:
    """(column, std) of the number columns that are not constant."""
    rows = [F.struct(F.lit(n).alias("column"), F.stddev_samp(C.number(df, n)).alias("std")) for n in C.numeric_columns(df)]
    return C.tidy(df, rows).filter("std > 0")
