"""Registered queries: a Spark function over the tables, and the SQL stating the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions import columns as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round the float columns, each to its own number of digits where given."""
    return df.select(*[
        C.round_to(C.col(f.name), special.get(f.name, digits)).alias(f.name) if C.is_float(f.dataType) else C.col(f.name)
        for f in df.schema])


def r(expression: str, digits: int = 4) -> str:
    """SQL rounding, halves to even, plain zero for tiny negatives."""
    return f"(round_even(({expression})::double, {digits}) + 0.0)"
