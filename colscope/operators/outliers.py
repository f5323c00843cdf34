"""Outliers by quartile fences, by z-score, and by a one-dimensional isolation forest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.quantiles import exact_percentiles
from colscope.functions.staging import staged

MIN_VALUES = 4
FOREST_MIN_VALUES = 500
FOREST_TREES = 100
FOREST_SAMPLE = 256


def fences(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (lower, upper)}: quartiles widened by 1.5 times their distance."""
    q = exact_percentiles(df, {n: C.number(df, n) for n in names}, [0.25, 0.75])
    return {n: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for n, (a, b) in q.items() if a is not None}


def outlier_table(df: DataFrame, names: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """(column, iqr_outliers, zscore_outliers, outlier_pct, lower, upper)."""
    names = names if names is not None else C.numeric_columns(df)
    bounds = fences(df, names)
    names = [n for n in names if n in bounds]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, iqr_outliers bigint, zscore_outliers bigint, "
                                                   "outlier_pct double, lower double, upper double")
    spread = df.agg(*[F.struct(F.avg(C.number(df, n)), F.stddev_pop(C.number(df, n))).alias(f"s{i}")
                      for i, n in enumerate(names)]).first()
    rows = []
    for i, n in enumerate(names):
        x, (lower, upper), (mean, std) = C.number(df, n), bounds[n], spread[i]
        far = F.abs((x - mean) / std) > z if std else F.lit(False)
        rows.append(
            F.struct(F.lit(n).alias("column"), F.count(x).alias("n"),
                     F.count_if((x < lower) | (x > upper)).alias("iqr"), F.count_if(far).alias("far"),
                     F.lit(lower).alias("lower"), F.lit(upper).alias("upper")))
    enough = F.col("n") >= MIN_VALUES
    return C.tidy(df, rows).select(
        "column",
        F.when(enough, F.col("iqr")).otherwise(0).alias("iqr_outliers"),
        F.when(enough, F.col("far")).otherwise(0).alias("zscore_outliers"),
        F.when(enough, C.round_to(F.col("iqr") / F.col("n"), 4)).otherwise(0.0).alias("outlier_pct"),
        F.when(enough, C.round_to("lower", 4)).alias("lower"),
        F.when(enough, C.round_to("upper", 4)).alias("upper"),
    )


def outlier_examples(df: DataFrame, names: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, place, value): the k smallest distinct values outside the fences."""
    names = names if names is not None else C.numeric_columns(df)
    parts = None
    for n, (lower, upper) in fences(df, names).items():
        x = C.number(df, n)
        part = df.filter((x < lower) | (x > upper)).select(F.lit(n).alias("column"), x.alias("value")).distinct()
        parts = part if parts is None else parts.unionAll(part)
    order = W.partitionBy("column").orderBy("value")
    return parts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    out = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple[float, float]]:
    """One tree over one dimension, as the depth reached from each left edge on."""
    steps = []
    stack = [(-math.inf, np.sort(values), 0)]
    while stack:
        edge, v, depth = stack.pop()
        if depth >= height or v.size <= 1 or v[0] == v[-1]:
            steps.append((edge, depth + float(_average_path(v.size))))
            continue
        cut = rng.uniform(v[0], v[-1])
        i = int(np.searchsorted(v, cut, side="left"))
        stack.append((edge, v[:i], depth + 1))
        stack.append((cut, v[i:], depth + 1))
    return steps


def isolation_forest(df: DataFrame, names: list[str] | None = None, contamination: float = 0.05,
                     seed: int = 42) -> DataFrame:
    """(column, isolation_forest_outliers): rows scoring beyond the contamination quantile, per column.

    In one dimension a tree is a step function of the value, so the forest is one step function with
    at most trees x sample steps per column; that table alone is sent to the tasks.
    """
    names = names if names is not None else C.numeric_columns(df)
    counts = staged(C.number_counts(df, names))
    sizes = counts.groupBy("column").agg(F.sum("n").alias("n")).collect()
    sizes = {r["column"]: r["n"] for r in sizes if r["n"] >= FOREST_MIN_VALUES}
    if not sizes:
        return df.sparkSession.createDataFrame([], "column string, isolation_forest_outliers bigint")

    # About two samples' worth of rows per tree; each tree then keeps its first FOREST_SAMPLE by key. A value gives its
    # share of all draws, dealt to the trees in turn; hashes decide, so the forest is the same on any cluster.
    def draw(salt: str, *more: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "column", "value", *more), F.lit(1 << 30))

    known = counts.filter(F.col("column").isin(list(sizes)))
    rate = F.create_map(*[F.lit(x) for name, size in sizes.items() for x in (name, min(1.0, 2.0 * FOREST_SAMPLE / size))])
    wanted = F.col("n") * rate[F.col("column")] * FOREST_TREES
    dealt = known.withColumn("copies", F.floor(wanted + draw("share") / float(1 << 30))).filter("copies > 0")
    dealt = dealt.select("column", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    parts = dealt.select("column", "value", F.pmod(draw("tree") + F.col("copy"), F.lit(FOREST_TREES)).cast("int").alias("tree"),
                         draw("key", "copy").alias("key"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "value"]).head(FOREST_SAMPLE)
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        height = math.ceil(math.log2(max(len(pdf), 2)))
        steps = pd.DataFrame(_grow(pdf["value"].to_numpy(), rng, height), columns=["edge", "depth"])
        norm = float(_average_path(len(pdf))) or 1.0
        return steps.assign(column=pdf["column"].iloc[0], tree=pdf["tree"].iloc[0], depth=steps["depth"] / norm)

    grown = parts.groupBy("column", "tree").applyInPandas(build, "column string, tree int, edge double, depth double")
    steps = grown.toPandas()  # trees x sample steps per column, whatever the size of the table
    lookup = {}
    for name, per_column in steps.groupby("column"):
        edges = np.unique(per_column["edge"])
        total = np.zeros(len(edges))
        for _, tree in per_column.groupby("tree"):
            tree = tree.sort_values("edge")
            at = np.searchsorted(tree["edge"].to_numpy(), edges, side="right") - 1
            total += tree["depth"].to_numpy()[at]
        lookup[name] = (edges, np.round(2.0 ** (-total / per_column["tree"].nunique()), 12))
    shared = df.sparkSession.sparkContext.broadcast(lookup)

    @F.pandas_udf("double")
    def score(column: pd.Series, value: pd.Series) -> pd.Series:
        out = np.zeros(len(value))
        for name in column.unique():
            edges, scores = shared.value[name]
            mine = (column == name).to_numpy()
            out[mine] = scores[np.searchsorted(edges, value[mine], side="right") - 1]
        return pd.Series(out)

    scored = known.withColumn("score", score("column", "value"))
    per_score = scored.groupBy("column", "score").agg(F.sum("n").alias("n"))
    # A column has at most as many scores as the forest has steps. The cut is the score at the
    # contamination quantile from the anomalous end; rows strictly beyond it are outliers.
    beyond = W.partitionBy("column").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy("column")
    ranked = per_score.withColumn("before", F.coalesce(F.sum("n").over(beyond), F.lit(0))).withColumn(
        "total", F.sum("n").over(everything))
    place = F.floor((F.col("total") - 1) * contamination)
    cut = ranked.filter((F.col("before") <= place) & (F.col("before") + F.col("n") > place))
    return cut.select("column", F.col("before").alias("isolation_forest_outliers"))
