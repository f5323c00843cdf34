"""Column profile, target candidates and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.operators.typing import classified

# Words in a column name that hint at a prediction target.
TARGET_WORDS = ["target", "label", "output", "class", "result", "outcome", "predict", "flag", "status", "y", "churn",
                "default", "fraud", "survived", "price", "value"]
TARGET_THRESHOLD = 0.3


def target_score(last: int) -> Column:
    """Chance that a classified column is the target, between 0 and 1."""
    cls = F.col("dtype_class")
    name = F.lower("column")

    def points(condition: Column, score: float) -> Column:
        return F.when(condition, score).otherwise(0.0)

    score = (
        points(C.any_of([F.contains(name, F.lit(w)) for w in TARGET_WORDS]), 0.3)
        + points(cls == "boolean", 0.2)
        + points((cls == "categorical") & (F.col("unique_count") <= 10), 0.2)
        + points((cls == "numerical") & (F.abs("skewness") <= 2), 0.15)
        + points(F.col("position") == last, 0.15)
        - points(cls == "identifier", 0.5)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, class, counts, shares and target score."""
    score = target_score(len(df.columns) - 1)
    rows = classified(df)
    nulls = F.col("n_rows") - F.col("non_null_count")
    return rows.select(
        "column",
        "position",
        "dtype_raw",
        "dtype_class",
        "n_rows",
        "non_null_count",
        nulls.alias("null_count"),
        C.round_to(share(nulls, F.col("n_rows")), 4).alias("null_pct"),
        "unique_count",
        C.round_to(share(F.col("unique_count"), F.col("non_null_count")), 4).alias("unique_pct"),
        C.round_to(score, 3).alias("target_candidate_score"),
        (score >= TARGET_THRESHOLD).alias("is_target_candidate"),
    )


def top_target_candidates(profile: DataFrame, n: int = 3) -> DataFrame:
    return (
        profile.orderBy(F.desc("target_candidate_score"), "position")
        .limit(n)
        .select("column", F.col("target_candidate_score").alias("score"), F.col("dtype_class").alias("dtype"),
                "unique_count", "null_pct")
    )


def detect_target(profile: DataFrame) -> DataFrame:
    """(target, confidence): the best column, or null when none is convincing."""
    best = F.max_by(F.struct("column", "target_candidate_score"), F.struct("target_candidate_score", -F.col("position")))
    return profile.agg(best.alias("best")).select(
        F.when(F.col("best.target_candidate_score") >= TARGET_THRESHOLD, F.col("best.column")).alias("target"),
        F.col("best.target_candidate_score").alias("confidence"),
    )


def class_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("dtype_class").agg(F.count("*").alias("n"))
