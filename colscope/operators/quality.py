"""Missing values, duplicates and inconsistent text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import columns as C

# Symbols that mark a contaminated number, and those removed before reading it.
SYMBOLS = r"[\$%#@€£¥]"
REMOVED_SYMBOLS = r"[\$%,€£¥]"


def severity(pct: Column) -> Column:
    return F.when(pct < 0.05, "low").when(pct < 0.30, "medium").when(pct < 0.80, "high").otherwise("critical")


def missing_values(df: DataFrame) -> DataFrame:
    """(column, position, count, pct, severity) of the columns with nulls."""
    df = C.nan_to_null(df)
    rows = [
        F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"),
                 F.count_if(C.col(n).isNull()).alias("count"), F.count("*").alias("n_rows"))
        for i, n in enumerate(df.columns)
    ]
    pct = F.col("count") / F.col("n_rows")
    return C.tidy(df, rows).filter("count > 0").select(
        "column", "position", "count", C.round_to(pct, 4).alias("pct"), severity(pct).alias("severity"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(count, pct) of the rows beyond the first of each group of equal rows."""
    groups = C.nan_to_null(df).groupBy(*C.row_key(df)).agg(F.count("*").alias("n"))
    extra, rows = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.sum("n")
    return groups.agg(extra.alias("count"), F.when(rows > 0, C.round_to(extra / rows, 4)).otherwise(0.0).alias("pct"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(col_a, col_b) pairs of one type whose values agree on every row, nulls included.

    Columns are first grouped by null count and a checksum, so only likely pairs are compared.
    """
    df = C.nan_to_null(df)
    names = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    marks = df.agg(
        *[F.struct(F.count(C.col(n)), F.bit_xor(F.xxhash64(C.col(n)))).alias(f"m{i}") for i, n in enumerate(names)]
    ).first()
    pairs = [
        (a, b) for i, a in enumerate(names) for j, b in enumerate(names)
        if i < j and marks[i] == marks[j] and C.type_of(df, a) == C.type_of(df, b)
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string")
    rows = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.bool_and(C.col(a).eqNullSafe(C.col(b))).alias("equal"))
        for a, b in pairs
    ]
    return C.tidy(df, rows).filter("equal").drop("equal")


def _spellings(df: DataFrame) -> DataFrame:
    """Distinct (column, key, plain): each spelling's key and the key of its lower-cased, stripped form."""
    entries = [F.struct(F.lit(n).alias("column"), C.text_key(C.col(n)).alias("key"), C.text_key(F.lower(C.strip(C.col(n)))).alias("plain"))
               for n in C.string_columns(df)]
    return df.select(F.inline(F.array(*entries))).filter("key IS NOT NULL").distinct()


def case_inconsistency(df: DataFrame) -> DataFrame:
    """(column, count): spellings that differ only by case or outer white space."""
    groups = _spellings(df).groupBy("column", "plain").agg(F.count("*").alias("n"))
    return groups.groupBy("column").agg(F.sum(F.col("n") - 1).alias("count")).filter("count > 0")


def case_examples(df: DataFrame, groups: int = 5, spellings: int = 3) -> DataFrame:
    """(column, plain, spelling): a few groups per column, a few spellings per group, in value order."""
    entries = [F.struct(F.lit(n).alias("column"), C.col(n).cast("string").alias("spelling")) for n in C.string_columns(df)]
    rows = df.select(F.inline(F.array(*entries))).dropna().distinct().withColumn("plain", F.lower(C.strip(F.col("spelling"))))
    several = rows.groupBy("column", "plain").agg(F.count("*").alias("n")).filter("n > 1")
    first = W.partitionBy("column").orderBy("plain")
    chosen = several.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= groups).select("column", "plain")
    inside = W.partitionBy("column", "plain").orderBy("spelling")
    return (
        rows.join(chosen, ["column", "plain"])
        .withColumn("i", F.row_number().over(inside))
        .filter(F.col("i") <= spellings)
        .select("column", "plain", "spelling")
    )


def text_consistency(df: DataFrame) -> DataFrame:
    """(column, issue_type, count) for symbol contamination and mixed types."""
    rows = []
    for name in C.string_columns(df):
        c = C.col(name)
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("n"),
                F.count_if(c.rlike(SYMBOLS)).alias("symbols"),
                F.count_if(C.as_number(F.regexp_replace(c, REMOVED_SYMBOLS, "")).isNotNull()).alias("cleaned"),
                F.count_if(C.as_number(c).isNotNull()).alias("numeric"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, issue_type string, count bigint")
    text = F.col("n") - F.col("numeric")
    minority = F.least(F.col("numeric"), text)
    symbol_issue = F.when((F.col("symbols") > 0) & (F.col("cleaned") > 0.5 * F.col("symbols")), F.col("symbols"))
    mixed_issue = F.when(
        (F.col("n") >= 5) & (F.col("numeric") > 5) & (text > 5) & (minority / F.col("n") > 0.05), minority)
    issues = F.array(
        F.struct(F.lit("symbol_contamination").alias("issue_type"), symbol_issue.alias("count")),
        F.struct(F.lit("mixed_types").alias("issue_type"), mixed_issue.alias("count")),
    )
    return C.tidy(df, rows).select("column", F.inline(issues)).filter("count IS NOT NULL")


def symbol_examples(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, value): the first k distinct values, in value order, that hold a symbol."""
    parts = None
    for name in C.string_columns(df):
        part = df.select(F.lit(name).alias("column"), C.col(name).alias("value")).filter(F.col("value").rlike(SYMBOLS))
        parts = part if parts is None else parts.unionAll(part)
    order = W.partitionBy("column").orderBy("value")
    return parts.distinct().withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).drop("i")


def consistency(df: DataFrame) -> DataFrame:
    """(column, issue_type, count): all three kinds of inconsistent text."""
    rest = text_consistency(df)
    if not C.string_columns(df):
        return rest
    case = case_inconsistency(df).select("column", F.lit("case_inconsistency").alias("issue_type"), "count")
    return case.unionByName(rest)
