"""Synthetic minority rows between neighbours of one class."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.operators.neighbours import k_nearest
from colscope.operators.sampling import numbered

SEED = 42


def oversample(train: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """(y, features, synthetic): the rows, plus made rows until every class has as many as the largest.

    A made row lies a random way from a row of the class to one of its k nearest in the class. Every
    row of a class starts the same number of made rows, or one more.
    """
    train = staged(train.select("id", "y", "features"))
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    largest = max(counts.values(), default=0)
    out = train.select("y", "features", F.lit(False).alias("synthetic"))
    for y, n in counts.items():
        missing = largest - n
        if missing == 0 or n < 2:
            continue
        mine = train.filter(F.col("y") == y).select("id", vector_to_array("features").alias("v"))
        near = staged(k_nearest(mine, mine, min(k, n - 1), exclude_self=True))
        places = min(k, n - 1)
        starts = numbered(mine, "id", seed=seed).withColumn(
            "copies", F.lit(missing // n) + F.when(F.col("number") < missing % n, 1).otherwise(0))
        made = starts.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", "copy"), F.lit(1 << 30)) / float(1 << 30)
        made = made.select("id", "v", (F.floor(draw("place") * places) + 1).cast("int").alias("place"), draw("way").alias("u"))
        ends = mine.select(F.col("id").alias("neighbour"), F.col("v").alias("w"))
        mixed = made.join(near.select("id", "place", "neighbour"), ["id", "place"]).join(ends, "neighbour")
        between = F.zip_with("v", "w", lambda a, b: a + F.col("u") * (b - a))
        out = out.unionByName(mixed.select(F.lit(y).cast(train.schema["y"].dataType).alias("y"),
                                           array_to_vector(between).alias("features"), F.lit(True).alias("synthetic")))
    return out
