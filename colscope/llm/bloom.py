"""Bloom filters of bounded size, built by grouped counts and tested in Arrow batches.

Two bit places stand for a 64-bit hash. A filter has 16 bits a row, at most `MOST_BITS` (128 MB), which bounds what is
collected and broadcast. A fuller filter flags more rows; since what it flags is then checked exactly, results don't
depend on its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30


def bits_for(rows: int) -> int:
    bits = LEAST_BITS
    while bits < rows * BITS_PER_ROW and bits < MOST_BITS:
        bits *= 2
    return bits


def _places(bits: int) -> Column:
    """The bit places of the column `hash`, each once."""
    h = F.col("hash")
    return F.array_distinct(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))


def _filled(places: DataFrame, bits: int) -> np.ndarray:
    """The 64-bit words of the filter in which the given places are set."""
    word = F.shiftright("place", 6).alias("word")
    value = F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("value")
    table = places.groupBy(word).agg(value).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[table["word"].to_numpy()] = table["value"].to_numpy().view(np.uint64)
    return words


def repeated(hashes: DataFrame, rows: int) -> np.ndarray:
    """First pass: the places that two rows of `hashes` or more share."""
    bits = bits_for(rows)
    places = hashes.select(F.explode(_places(bits)).alias("place")).groupBy("place").count()
    return _filled(places.filter("count > 1").select("place"), bits)


def present(hashes: DataFrame, rows: int) -> np.ndarray:
    """The places that any row of `hashes` has."""
    bits = bits_for(rows)
    return _filled(hashes.select(F.explode(_places(bits)).alias("place")), bits)


def contains(spark: SparkSession, hash_column: Column, words: np.ndarray) -> Column:
    """Second pass: whether all places of a hash are set."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        filled, h = shared.value, hashes.to_numpy().view(np.uint64)
        mask = np.uint64(len(filled) * 64 - 1)

        def is_set(place: np.ndarray) -> np.ndarray:
            return (filled[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        return pd.Series(is_set(h & mask) & is_set((h >> np.uint64(32)) & mask))

    return test(hash_column)
