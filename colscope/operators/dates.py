"""Date columns: detection, ranges, counts per month and weekday, and date parts.

A text column is read in one order of month and day, the one that suits more of its values; what doesn't fit is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C

PARSED_SHARE = 0.8
SEASON_DAYS = 365


def date_columns(df: DataFrame) -> DataFrame:
    """(column, date_share): native dates, and text of which more than 80% of all rows parse."""
    rows = []
    for f in df.schema:
        if C.is_datetime(f.dataType):
            share = F.lit(1.0)
        elif C.is_text(f.dataType):
            share = C.date_like(C.col(f.name)) / F.count("*")
        else:
            continue
        rows.append(F.struct(F.lit(f.name).alias("column"), F.max(share).alias("date_share")
                             if C.is_datetime(f.dataType) else share.alias("date_share")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, date_share double")
    return C.tidy(df, rows).filter(F.col("date_share") > PARSED_SHARE)


def date_column_names(df: DataFrame) -> list[str]:
    if not C.string_columns(df):
        return [f.name for f in df.schema if C.is_datetime(f.dataType)]
    found = {r["column"] for r in date_columns(df).collect()}  # at most one row per column
    return [n for n in df.columns if n in found]


def date_summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, min_date, max_date, range_days, has_time_component, has_seasonality, trend_direction)."""
    names = names if names is not None else date_column_names(df)
    rows, turned = [], C.day_first(df, names)
    for n in names:
        ts = C.moment_in_time(df, n, n in turned)
        rows.append(F.struct(F.lit(n).alias("column"), F.count(ts).alias("n"), F.min(ts).alias("low"),
                             F.max(ts).alias("high"), F.bool_or(F.hour(ts) != 0).alias("timed")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, min_date string, max_date string, range_days bigint, "
                                                   "has_time_component boolean, has_seasonality boolean, trend_direction string")
    days = F.extract(F.lit("DAY"), F.col("high") - F.col("low")).cast("long")
    return C.tidy(df, rows).filter("n >= 2").select(
        "column",
        F.date_format("low", "yyyy-MM-dd").alias("min_date"),
        F.date_format("high", "yyyy-MM-dd").alias("max_date"),
        days.alias("range_days"),
        F.col("timed").alias("has_time_component"),
        (days >= SEASON_DAYS).alias("has_seasonality"),
        F.lit("unknown").alias("trend_direction"),
    )


def _counts(df: DataFrame, names: list[str], key: str, part) -> DataFrame:
    turned = C.day_first(df, names)
    entries = [F.struct(F.lit(n).alias("column"), part(C.moment_in_time(df, n, n in turned)).alias(key)) for n in names]
    rows = df.select(F.inline(F.array(*entries))).filter(F.col(key).isNotNull())
    return rows.groupBy("column", key).agg(F.count("*").alias("n"))


def monthly_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, month, n) by calendar month, months present only."""
    return _counts(df, names or date_column_names(df), "month", lambda ts: F.date_format(ts, "yyyy-MM"))


def weekday_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, weekday, n) with Monday = 0."""
    return _counts(df, names or date_column_names(df), "weekday", F.weekday)


def add_date_parts(df: DataFrame, name: str) -> DataFrame:
    """Add year, month, day, weekday, quarter and is_weekend, and the hour when any is not zero."""
    ts = C.moment_in_time(df, name, name in C.day_first(df, [name]))
    timed = df.agg(F.bool_or(F.hour(ts) != 0).alias("timed")).first()["timed"]
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts),
             "quarter": F.quarter(ts), "is_weekend": F.weekday(ts) >= 5}
    if timed:
        parts["hour"] = F.hour(ts)
    return df.withColumns({f"{name}_{k}": v for k, v in parts.items()})
