"""Repeatable splits, folds and samples, by a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions import columns as C

BUCKETS = 4_096  # numbers don't depend on it


def key_hash(df: DataFrame, key: str | None, seed: int = 42) -> Column:
    """A repeatable pseudo-random whole number per row: from an integer key, else from all values of the row."""
    if key is not None and C.is_integer(C.type_of(df, key)):
        # A multiplicative hash modulo 2^32.
        small = F.pmod(C.col(key).cast("long"), F.lit(2147483647).cast("long"))
        return F.pmod(small * F.lit(2654435761) + F.lit(seed * 40503).cast("long"), F.lit(4294967296))
    names = [key] if key is not None else df.columns
    return F.pmod(F.xxhash64(F.lit(seed), *[C.as_text(df, n) for n in names]), F.lit(4294967296))


def numbered(df: DataFrame, key: str | None = None, strata: str | None = None, seed: int = 42,
             out: str = "number") -> DataFrame:
    """Number the rows 0, 1, 2, ... within each stratum in hash order.

    A stratum may hold most of the table, so it is cut into buckets by hash; rows are numbered within a
    bucket and the sizes of the earlier buckets are added.
    """
    tie = C.col(key) if key is not None else F.xxhash64(F.lit(seed + 1), *[C.as_text(df, n) for n in df.columns])
    s = C.col(strata) if strata is not None else F.lit(0)
    rows = df.withColumns({"_hash": key_hash(df, key, seed), "_stratum": s.cast("string")})
    rows = rows.withColumn("_bucket", F.floor(F.col("_hash") / F.lit(4294967296 // BUCKETS)))
    earlier = W.partitionBy("_stratum").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))
        .select(F.col("_stratum").alias("_s"), F.col("_bucket").alias("_b"),
                F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("_stratum", "_bucket").orderBy("_hash", tie)
    return (
        rows.withColumn("_i", F.row_number().over(inside) - 1)
        .join(offsets, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(out, F.col("_before") + F.col("_i"))
        .drop("_hash", "_stratum", "_bucket", "_before", "_i", "_s", "_b")
    )


def with_folds(df: DataFrame, k: int = 5, key: str | None = None, strata: str | None = None, seed: int = 42,
               out: str = "fold") -> DataFrame:
    """Fold 0..k-1 for each row; folds of a stratum differ by at most one row."""
    return numbered(df, key, strata, seed, out).withColumn(out, (F.col(out) % k).cast("int"))


def with_split(df: DataFrame, test_share: float = 0.2, key: str | None = None, strata: str | None = None,
               seed: int = 42, out: str = "is_test") -> DataFrame:
    """Mark the test rows: per stratum, every time the running share of test rows passes a whole number."""
    share = F.lit(float(test_share))
    marked = numbered(df, key, strata, seed, "_number")
    picked = F.floor((F.col("_number") + 1) * share) > F.floor(F.col("_number") * share)
    return marked.withColumn(out, picked).drop("_number")


def sample_rows(df: DataFrame, n: int, key: str | None = None, seed: int = 42) -> DataFrame:
    """n rows chosen by hash; the whole table when it is no larger."""
    ordered = df.withColumn("_hash", key_hash(df, key, seed))
    return ordered.orderBy("_hash", *([C.col(key)] if key is not None else [])).limit(n).drop("_hash")
