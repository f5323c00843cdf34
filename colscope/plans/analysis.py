"""The whole profile of a table, and the cleaning that follows from it."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.staging import staged
from colscope.operators import compare, correlation, dates, outliers, profile, quality, score, stats, text
from colscope.sources.tables import table_meta, write

PRIMARY_CLASSES = ("categorical", "text")


@dataclass
class Profile:
    """Tidy tables about one table. `target` is the column assessed as the prediction target, if any."""

    target: str | None
    meta: DataFrame
    columns: DataFrame
    missing: DataFrame
    duplicates: DataFrame
    duplicate_columns: DataFrame
    consistency: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    categorical_balance: DataFrame
    top_values: DataFrame
    outliers: DataFrame
    correlations: DataFrame
    high_pairs: DataFrame
    dates: DataFrame
    text: dict[str, DataFrame]
    problem: DataFrame
    readiness: DataFrame
    preprocessing: DataFrame
    feature_suggestions: DataFrame
    health: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """Every table by name."""
        out = {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}
        return out | {f"text_{k}": v for k, v in self.text.items()}

    def write(self, folder: str, fmt: str = "json") -> None:
        for name, df in self.tables().items():
            write(df, os.path.join(folder, name), fmt)


def analyse(df: DataFrame, target: str | None = None, methods: tuple[str, ...] = ("pearson", "spearman", "kendall"),
            forest: bool = True) -> Profile:
    """Profile every row of a table. `target="auto"` picks the target first and then assesses it.

    The column profile is written once, as all later tables read it; the rest stays lazy where it can.
    """
    df = C.nan_to_null(df)
    columns = staged(profile.profile_columns(df))
    if target == "auto":
        target = profile.detect_target(columns).first()["target"]
    classes = {r["column"]: r["dtype_class"] for r in columns.orderBy("position").collect()}

    def of(*wanted: str) -> list[str]:
        return [n for n in df.columns if classes[n] in wanted]

    numeric = staged(stats.numeric_summary(df, [n for n in of("numerical", "boolean") if C.kind_of(C.type_of(df, n)) != "string"]
                                           )) if of("numerical", "boolean") else _empty_numeric(df)
    named = of(*PRIMARY_CLASSES)
    counts = staged(C.value_counts(df, named)) if named else df.sparkSession.createDataFrame([], "column string, value string, n long")
    balanced = of("categorical", "boolean")
    balance = C.value_counts(df, balanced) if balanced else counts.limit(0)
    numerical = of("numerical")
    table = outliers.outlier_table(df, numerical)
    if forest and numerical:
        table = table.join(outliers.isolation_forest(df, numerical), "column", "left")
    table = staged(table)
    matrix = staged(correlation.correlations(df, methods))
    pairs = correlation.high_pairs(matrix)
    duplicates = staged(quality.duplicate_rows(df))
    categorical = staged(stats.categorical_summary(counts))
    texts = of("text")
    return Profile(
        target=target,
        meta=table_meta(df),
        columns=columns,
        missing=quality.missing_values(df),
        duplicates=duplicates,
        duplicate_columns=quality.duplicate_columns(df),
        consistency=quality.consistency(df),
        numeric=numeric,
        categorical=categorical,
        categorical_balance=stats.categorical_summary(balance),
        top_values=stats.top_values(counts, 10),
        outliers=table,
        correlations=matrix,
        high_pairs=pairs,
        dates=dates.date_summary(df),
        text=text.text_analysis(df, texts) if texts else {},
        problem=score.problem_type(columns, target),
        readiness=score.readiness(columns, target),
        preprocessing=score.preprocessing(columns, numeric, table),
        feature_suggestions=score.feature_suggestions(columns, numeric),
        health=score.health_score(columns, table, duplicates, pairs, categorical, target),
    )


def _empty_numeric(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string, skewness double")


@dataclass
class Comparison:
    """Tidy tables about the differences of two tables."""

    schema: DataFrame
    size: DataFrame
    shifts: DataFrame
    nulls: DataFrame
    overlap: DataFrame
    summary: DataFrame


def compare_tables(a: DataFrame, b: DataFrame) -> Comparison:
    schema = compare.schema_diff(a, b)
    names = [n for n in compare.common_columns(a, b) if n in C.numeric_columns(a) and n in C.numeric_columns(b)]
    empty = "column string, mean_a double, mean_b double, std_a double, std_b double, ks_statistic double, ks_pvalue double, shift_detected boolean"
    shifts = staged(compare.distribution_shifts(a, b, names)) if names else a.sparkSession.createDataFrame([], empty)
    shared = compare.common_columns(a, b)
    nulls = staged(compare.null_drift(a, b)) if shared else a.sparkSession.createDataFrame(
        [], "column string, null_pct_a double, null_pct_b double, change double")
    overlap = compare.row_overlap(a, b) if shared else a.sparkSession.createDataFrame(
        [(0, 0.0)], "common_rows long, overlap_pct double")
    return Comparison(schema, compare.size_diff(a, b), shifts, nulls, overlap, compare.change_counts(schema, shifts, nulls))


def classes_of(columns: DataFrame) -> dict[str, str]:
    """{column: class} of a column profile."""
    return {r["column"]: r["dtype_class"] for r in columns.select("column", "dtype_class").collect()}
