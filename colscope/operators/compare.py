"""Differences between two tables: schema, size, nulls, distributions and shared rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.running import running_totals
from colscope.functions.tails import KS_EXACT_ROWS, ks_p_value

OVERLAP_COLUMNS = 5


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Shared column names in the order of the first table."""
    return [n for n in a.columns if n in b.columns]


def schema_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema],
                                           "column string, dtype string")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, dtype_a, dtype_b, status): only_in_a, only_in_b, dtype_change or same."""
    left = schema_frame(a).withColumnRenamed("dtype", "dtype_a")
    right = schema_frame(b).withColumnRenamed("dtype", "dtype_b")
    status = (
        F.when(F.col("dtype_b").isNull(), "only_in_a").when(F.col("dtype_a").isNull(), "only_in_b")
        .when(F.col("dtype_a") != F.col("dtype_b"), "dtype_change").otherwise("same")
    )
    return left.join(right, "column", "full").withColumn("status", status)


def column_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, kind): names in both tables and in one only."""
    x, y = schema_frame(a).select("column"), schema_frame(b).select("column")
    return (
        x.intersect(y).withColumn("kind", F.lit("common"))
        .unionByName(x.exceptAll(y).withColumn("kind", F.lit("only_in_a")))
        .unionByName(y.exceptAll(x).withColumn("kind", F.lit("only_in_b")))
    )


def distribution_shifts(a: DataFrame, b: DataFrame, names: list[str] | None = None, exact_rows: int = KS_EXACT_ROWS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of each shared number column with three values on both sides. p is exact up to
    `exact_rows` values on either side, beyond it follows the limit law."""
    shared = common_columns(a, b)
    both = [n for n in shared if n in C.numeric_columns(a) and n in C.numeric_columns(b)]
    names = names if names is not None else both
    tagged = C.number_counts(a, names).select("column", "value", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"))
    tagged = tagged.unionByName(
        C.number_counts(b, names).select("column", "value", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))
    merged = tagged.groupBy("column", "value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    steps = running_totals(merged, "value", {"a": "na", "b": "nb"}, ["column"])
    gap = F.abs((F.col("a") + F.col("na")) / F.col("a_all") - (F.col("b") + F.col("nb")) / F.col("b_all"))
    d = steps.filter("a_all >= 3 AND b_all >= 3").groupBy("column").agg(
        F.max(gap).alias("d"), F.first("a_all").alias("n_a"), F.first("b_all").alias("n_b"))

    def moments(df: DataFrame, side: str) -> DataFrame:
        return C.tidy(df, [F.struct(F.lit(n).alias("column"), F.avg(C.number(df, n)).alias(f"mean_{side}"),
                                    F.stddev_samp(C.number(df, n)).alias(f"std_{side}")) for n in names])

    p = ks_p_value(F.col("d"), F.col("n_a").cast("double"), F.col("n_b").cast("double"), exact_rows)
    return (
        d.join(moments(a, "a"), "column").join(moments(b, "b"), "column").withColumn("p", p)
        .select("column", *[C.round_to(m, 4).alias(m) for m in ("mean_a", "mean_b", "std_a", "std_b")],
                C.round_to("d", 4).alias("ks_statistic"), C.round_to("p", 4).alias("ks_pvalue"),
                (F.col("p") < 0.05).alias("shift_detected"))
    )


def null_drift(a: DataFrame, b: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(column, null_pct_a, null_pct_b, change) of the shared columns whose null rate moved."""
    names = common_columns(a, b)

    def rates(df: DataFrame, side: str) -> DataFrame:
        df = C.nan_to_null(df.select(*[C.col(n) for n in names]))
        return C.tidy(df, [F.struct(F.lit(n).alias("column"),
                                    (F.count_if(C.col(n).isNull()) / F.count("*")).alias(side)) for n in names])

    change = F.col("b") - F.col("a")
    return (
        rates(a, "a").join(rates(b, "b"), "column").filter(F.abs(change) > threshold)
        .select("column", C.round_to("a", 4).alias("null_pct_a"), C.round_to("b", 4).alias("null_pct_b"),
                C.round_to(change, 4).alias("change"))
    )


def row_overlap(a: DataFrame, b: DataFrame, max_columns: int = OVERLAP_COLUMNS) -> DataFrame:
    """(common_rows, overlap_pct): pairs agreeing on the first shared columns; nulls agree with nulls.

    Rows are counted per key on both sides first, so the pairs themselves are never formed.
    """
    names = common_columns(a, b)[:max_columns]
    keys = [f"k{i}" for i in range(len(names))]

    def counted(df: DataFrame, n: str) -> DataFrame:
        return df.select(*C.row_key(df, names)).toDF(*keys).groupBy(*keys).agg(F.count("*").alias(n))

    left, right = counted(C.nan_to_null(a), "na"), counted(C.nan_to_null(b), "nb").toDF(*[f"r{k}" for k in keys], "nb")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys])
    joined = left.join(right, same, "left")
    pairs, rows = F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)), F.coalesce(F.sum("na"), F.lit(0))
    return joined.agg(pairs.alias("common_rows"), C.round_to(pairs / F.greatest(rows, F.lit(1)) * 100, 2).alias("overlap_pct"))


def size_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    rows_a, rows_b = a.agg(F.count("*")).scalar(), b.agg(F.count("*")).scalar()
    one = a.sparkSession.range(1).select(rows_a.alias("rows_a"), rows_b.alias("rows_b"))
    return one.select("rows_a", "rows_b", (F.col("rows_b") - F.col("rows_a")).alias("row_diff"),
                      F.lit(len(a.columns)).cast("long").alias("cols_a"), F.lit(len(b.columns)).cast("long").alias("cols_b"))


def change_counts(schema: DataFrame, shifts: DataFrame, nulls: DataFrame) -> DataFrame:
    """(n_schema_changes, n_distribution_shifts, n_null_changes) from the three tables above."""
    return schema.agg(F.count_if(F.col("status") != "same").alias("n_schema_changes")).select(
        "n_schema_changes",
        shifts.agg(F.count_if("shift_detected")).scalar().alias("n_distribution_shifts"),
        nulls.agg(F.count("*")).scalar().alias("n_null_changes"),
    )
