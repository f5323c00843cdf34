"""The numbers behind the charts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.normal import inverse_normal
from colscope.functions.quantiles import exact_percentiles
from colscope.functions.running import running_totals
from colscope.operators.sampling import sample_rows

GRID = 200
KERNELS = 2_000  # values whose kernels are added at once
GROUPS = 8
ROWS_PER_STEP = 10_000


def _values(df: DataFrame, name: str) -> DataFrame:
    return df.select(C.number(df, name).alias("x")).dropna()


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n, density) over equal bins from the least to the greatest value."""
    x = _values(df, name)
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint, density double")
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)).cast("int")
    counts = x.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    total = x.agg(F.count("*")).scalar()
    edge = low + F.col("bin") * width
    return counts.select("bin", edge.alias("low"), (edge + width).alias("high"), "n",
                         (F.col("n") / (total * width)).alias("density"))


def _densities(rows: DataFrame, points: int) -> DataFrame:
    """(group, point, x, density) of rows of (group, value) for a few groups: Gaussian kernels of bandwidth std * n^(-1/5) on
    an even grid. Each task adds up one grid a group; only these grids are shuffled."""
    facts = rows.groupBy("group").agg(F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
                                      F.stddev_samp("value").alias("std")).filter("std > 0")
    of = {r["group"]: (r["low"], (r["high"] - r["low"]) / (points - 1), r["std"] * r["rows"] ** -0.2, r["rows"]) for r in facts.collect()}

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            groups, values = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
            for code, group in enumerate(groups.dictionary.to_pylist()):
                if group not in of:
                    continue
                low, step, width, _ = of[group]
                grid = low + np.arange(points) * step
                found, n = np.unique(values[groups.indices.to_numpy() == code], return_counts=True)
                own = total.setdefault(group, np.zeros(points))
                for i in range(0, len(found), KERNELS):
                    z = (grid - found[i : i + KERNELS, None]) / width
                    own += n[i : i + KERNELS] @ np.exp(-z * z / 2)
        yield pa.RecordBatch.from_pydict({"group": pa.array(list(total), pa.string()),
                                          "sums": pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))})

    if not of:
        return rows.sparkSession.createDataFrame([], "group string, point int, x double, density double")
    grids = rows.mapInArrow(sums, "group string, sums array<double>").select("group", F.posexplode("sums").alias("point", "s"))
    known = F.create_map(*[x for g, (low, step, width, n) in of.items() for x in (
        F.lit(g), F.array(F.lit(low), F.lit(step), F.lit(n * width * math.sqrt(2 * math.pi))))])
    fact = known[F.col("group")]
    return grids.groupBy("group", "point").agg(F.sum("s").alias("s")).select(
        "group", "point", (fact[0] + F.col("point") * fact[1]).alias("x"), (F.col("s") / fact[2]).alias("density"))


def kernel_density(df: DataFrame, name: str, points: int = GRID) -> DataFrame:
    """(point, x, density): Gaussian kernels of bandwidth std * n^(-1/5) on an even grid."""
    rows = _values(df, name).select(F.lit("all").alias("group"), F.col("x").alias("value"))
    return _densities(rows, points).drop("group")


def _boxes(df: DataFrame, values: dict[str, Column], label: str) -> DataFrame:
    quartiles = exact_percentiles(df, values, [0.25, 0.5, 0.75])
    rows = []
    for name, x in values.items():
        q1, q2, q3 = quartiles[name]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = F.when((x >= low) & (x <= high), x)
        rows.append(
            F.struct(F.lit(name).alias(label), F.count(x).alias("n"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"),
                     F.lit(q3).alias("q3"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
                     F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
                     (F.count(x) - F.count(inside)).alias("n_outliers")))
    return C.tidy(df, rows)


def box_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """One box per column: quartiles, mean, sd, whiskers inside the fences, and the number of outliers."""
    return _boxes(df, {n: C.number(df, n) for n in names}, "column")


def box_stats_by_group(df: DataFrame, name: str, group: str, k: int = GROUPS) -> DataFrame:
    """One box per group, for the k largest groups."""
    counts = df.filter(C.col(group).isNotNull()).groupBy(C.as_text(df, group).alias("g")).agg(F.count("*").alias("n"))
    groups = [r["g"] for r in counts.orderBy(F.desc("n"), "g").limit(k).collect()]
    x = C.number(df, name)
    return _boxes(df, {g: F.when(C.as_text(df, group) == g, x) for g in groups}, "group")


def violin(df: DataFrame, name: str, group: str | None = None, k: int = GROUPS, points: int = GRID) -> DataFrame:
    """(group, point, x, density): one kernel density per group, for the k largest groups."""
    if group is None:
        return kernel_density(df, name, points).withColumn("group", F.lit("all"))
    counts = df.filter(C.col(group).isNotNull()).groupBy(C.as_text(df, group).alias("group")).agg(F.count("*").alias("n"))
    chosen = counts.orderBy(F.desc("n"), "group").limit(k).select("group")
    rows = df.select(C.as_text(df, group).alias("group"), C.number(df, name).alias("value")).dropna()
    return _densities(rows.join(F.broadcast(chosen), "group"), points)  # at most k names


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r, n) of the least-squares line over complete rows."""
    rows = df.select(C.number(df, x).alias("x"), C.number(df, y).alias("y")).dropna()
    return rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                    F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def time_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete (x, y) rows in order of x."""
    return df.select(C.col(x), C.col(y)).dropna().orderBy(C.col(x), C.col(y))


def pair_plot(df: DataFrame, names: list[str], color: str | None = None, n: int | None = None,
              key: str | None = None) -> DataFrame:
    """Complete rows of the columns; n of them when n is given."""
    wanted = [*names, *([color] if color else [])]
    rows = df.dropna(subset=wanted)
    if n is not None:
        rows = sample_rows(rows, n, key)
    return rows.select(*[C.col(c) for c in wanted])


def missing_pattern(df: DataFrame, n: int = 200, key: str | None = None) -> DataFrame:
    """0/1 per cell of n sampled rows, 1 where the value is missing."""
    rows = sample_rows(C.nan_to_null(df), n, key)
    return rows.select(*[C.col(c).isNull().cast("int").alias(c) for c in rows.columns])


def normal_quantiles(df: DataFrame, name: str) -> DataFrame:
    """(position, value, quantile): every value in order beside its expected normal order statistic.

    Values are counted, numbered through running totals, and laid out again row by row in steps of
    fixed size, so that a frequent value spreads over many tasks.
    """
    counts = running_totals(C.number_counts(df, [name]).select("value", "n"), "value", {"before": "n"})
    steps = counts.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ROWS_PER_STEP))))
    first = F.col("before") + F.col("step") * ROWS_PER_STEP + 1
    last = F.least(first + (ROWS_PER_STEP - 1), F.col("before") + F.col("n"))
    rows = (
        steps.select("value", F.col("before_all").alias("total"), first.alias("first"), last.alias("last"))
        .repartition("value", "first")
        .select("value", "total", F.explode(F.sequence("first", "last")).alias("position"))
    )
    n, i = F.col("total").cast("double"), F.col("position")
    end = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    return rows.select("position", "value", inverse_normal(p).alias("quantile"))


def normal_line(points: DataFrame) -> DataFrame:
    """(slope, intercept, r) of the values on their normal quantiles."""
    return points.agg(F.regr_slope("value", "quantile").alias("slope"),
                      F.regr_intercept("value", "quantile").alias("intercept"), F.corr("value", "quantile").alias("r"))
