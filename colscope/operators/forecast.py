"""Prepare and forecast many time series at once.

A series is rows (series, date, value). Lags come from joins on the position in the series, so a long
series spreads over tasks like many short ones. Coefficients are solved from sums per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.running import running_totals
from colscope.functions.staging import staged

MIN_POINTS = 10
Z95 = 1.959963984540054


def series_points(df: DataFrame, date: str, value: str, series: str | None = None) -> DataFrame:
    """(series, date, value): mean value per date, rows without date or number left out."""
    s = C.as_text(df, series) if series else F.lit("all")
    moment = C.moment_in_time(df, date, date in C.day_first(df, [date]))
    rows = df.select(s.alias("series"), moment.alias("date"), C.number(df, value).alias("value")).dropna()
    return rows.groupBy("series", "date").agg(F.avg("value").alias("value"))


def numbered_points(points: DataFrame) -> DataFrame:
    """Add `t`, the position from 0, and `points`, the length of the series."""
    at = F.unix_micros(F.col("date").cast("timestamp"))
    rows = points.withColumns({"_at": at, "_one": F.lit(1)})
    out = running_totals(rows, "_at", {"t": "_one"}, ["series"])
    return out.select("series", "date", "value", "t", F.col("t_all").alias("points"))


def with_lags(rows: DataFrame, name: str, count: int) -> DataFrame:
    """Add `<name>_1`.. `<name>_<count>`, the values that many positions earlier in the series."""
    if count == 0:
        return rows
    lagged = rows.select("series", name, F.col("t").alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("_k"))
    wide = lagged.groupBy("series", (F.col("_t") + F.col("_k")).alias("t")).agg(
        *[F.max(F.when(F.col("_k") == k, F.col(name))).alias(f"{name}_{k}") for k in range(1, count + 1)])
    return rows.join(wide, ["series", "t"], "left")


def differences(points: DataFrame, order: int = 1) -> DataFrame:
    """Replace the value by its difference of the given order; the first rows drop out."""
    rows = points
    for _ in range(order):
        rows = with_lags(rows, "value", 1).withColumn("value", F.col("value") - F.col("value_1")).drop("value_1").dropna()
    return rows


def step_length(numbered: DataFrame) -> DataFrame:
    """(series, seconds): the median gap between neighbouring dates."""
    at = numbered.select("series", "t", F.unix_micros(F.col("date").cast("timestamp")).cast("double").alias("at"))
    gaps = with_lags(at, "at", 1).dropna().select("series", ((F.col("at") - F.col("at_1")) / 1e6).alias("gap"))
    counts = gaps.groupBy("series", "gap").agg(F.count("*").alias("n"))
    placed = running_totals(counts, "gap", {"before": "n"}, ["series"])
    low, high = F.floor((F.col("before_all") - 1) / 2), F.floor(F.col("before_all") / 2)

    def holds(k):
        return F.when((F.col("before") <= k) & (F.col("before") + F.col("n") > k), F.col("gap"))

    return placed.groupBy("series").agg(((F.max(holds(low)) + F.max(holds(high))) / 2).alias("seconds"))


def calendars(numbered: DataFrame) -> DataFrame:
    """(series, last, seconds, calendar, months): the calendar that all dates of a series follow: `firsts` or `ends` of
    months that lie `months` apart, `business` days, or `gap`, the median one."""
    midnight = F.date_trunc("day", "date") == F.col("date")
    day = F.datediff("date", F.lit("1970-01-01"))
    facts = numbered.select("series", "t", "date", (12 * F.year("date") + F.month("date")).alias("m"), day.alias("d"),
                            (midnight & (F.dayofmonth("date") == 1)).alias("first"), (midnight & (F.last_day("date") == F.to_date("date"))).alias("end"),
                            (midnight & (F.weekday("date") < 5)).alias("work"))
    steps = with_lags(with_lags(facts, "m", 1), "d", 1)
    months, days = F.col("m") - F.col("m_1"), F.col("d") - F.col("d_1")
    next_day = (days == 1) | ((days == 3) & (F.weekday("date") == 0))
    per = steps.groupBy("series").agg(
        F.max("date").alias("last"), F.bool_and("first").alias("firsts"), F.bool_and("end").alias("ends"), F.bool_and("work").alias("works"),
        F.min(months).alias("least"), F.max(months).alias("most"), F.bool_and(F.coalesce(next_day, F.lit(True))).alias("daily"), F.max(days).alias("longest"))
    even = (F.col("least") == F.col("most")) & (F.col("least") > 0)
    kind = (F.when(F.col("firsts") & even, "firsts").when(F.col("ends") & even, "ends")
            .when(F.col("works") & F.col("daily") & (F.col("longest") == 3), "business").otherwise("gap"))
    return per.join(step_length(numbered), "series").select("series", "last", "seconds", kind.alias("calendar"), F.col("least").alias("months"))


def future_dates(numbered: DataFrame, horizon: int = 30) -> DataFrame:
    """(series, step, date) after the last date, by the calendar of the series."""
    rows = calendars(numbered).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    later = F.add_months("last", (F.col("step") * F.col("months")).cast("int"))
    worked = F.weekday("last") + F.col("step")
    work = F.date_add("last", (7 * F.floor(worked / 5) + worked % 5 - F.weekday("last")).cast("int"))
    plain = F.timestamp_micros(F.unix_micros(F.col("last").cast("timestamp")) + (F.col("step") * F.col("seconds") * 1e6).cast("long"))
    kind = F.col("calendar")
    date = (F.when(kind == "firsts", later.cast("timestamp_ntz")).when(kind == "ends", F.last_day(later).cast("timestamp_ntz"))
            .when(kind == "business", work.cast("timestamp_ntz")).otherwise(plain.cast("timestamp_ntz")))
    return rows.select("series", "step", date.alias("date"))


def _least_squares(rows: DataFrame, y: str, xs: list[str], intercept: bool) -> DataFrame:
    """(series, beta array, n, rss): regression per series from its sums of products, solved series by series."""
    terms = ([F.lit(1.0)] if intercept else []) + [F.col(x) for x in xs]
    size = len(terms)
    complete = rows.dropna(subset=[y, *xs])
    sums = complete.groupBy("series").agg(
        F.array(*[F.sum(terms[i] * terms[j]) for i in range(size) for j in range(size)]).alias("xx"),
        F.array(*[F.sum(t * F.col(y)) for t in terms]).alias("xy"),
        F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))

    def solve(batches):
        for pdf in batches:
            beta, rss = [], []
            for xx, xy, yy in zip(pdf["xx"], pdf["xy"], pdf["yy"]):
                a, b = np.array(xx).reshape(size, size), np.array(xy)
                w = np.linalg.lstsq(a, b, rcond=None)[0] if size else np.zeros(0)
                beta.append(w.tolist())
                rss.append(max(float(yy - 2 * w @ b + w @ a @ w), 0.0))
            yield pd.DataFrame({"series": pdf["series"], "beta": beta, "n": pdf["n"], "rss": rss})

    return sums.mapInPandas(solve, "series string, beta array<double>, n long, rss double")


def _fitted(xs: list[str], intercept: bool):
    terms = ([F.lit(1.0)] if intercept else []) + [F.col(x) for x in xs]
    return sum((F.get("beta", F.lit(i)) * t for i, t in enumerate(terms)), F.lit(0.0))


def fit_arima(numbered: DataFrame, order: tuple[int, int, int] = (1, 1, 1)) -> tuple[DataFrame, DataFrame]:
    """Coefficients per series and the differenced rows with their residuals, in two regressions.

    A long autoregression estimates the shocks; the series is then regressed on its own lags and the
    lagged shocks. As usual there is a constant only without differencing.
    """
    p, d, q = order
    intercept = d == 0
    diffed = staged(differences(numbered, d))
    long_lags = max(p, q) + 4 if q else 0
    rows = with_lags(diffed, "value", max(p, long_lags))
    ar = [f"value_{k}" for k in range(1, p + 1)]
    if q:
        long_ar = [f"value_{k}" for k in range(1, long_lags + 1)]
        first = _least_squares(rows, "value", long_ar, intercept)
        shocks = rows.join(first.select("series", "beta"), "series").withColumn(
            "shock", F.col("value") - _fitted(long_ar, intercept)).drop("beta")
        rows = with_lags(staged(shocks), "shock", q)
    xs = ar + [f"shock_{k}" for k in range(1, q + 1)]
    rows = staged(rows)
    model = staged(_least_squares(rows, "value", xs, intercept))
    return model, rows.join(model.select("series", "beta"), "series").withColumn(
        "residual", F.col("value") - _fitted(xs, intercept)).drop("beta")


def forecast(numbered: DataFrame, order: tuple[int, int, int] = (1, 1, 1), horizon: int = 30) -> DataFrame:
    """(series, step, date, forecast, lower, upper, aic, error): the 95% band comes from the accumulated shocks. A series
    that is too short, by itself or for the order, has one row that says so in `error`."""
    p, d, q = order
    every = staged(numbered)
    numbered = staged(every.filter(F.col("points") >= MIN_POINTS))
    model, rows = fit_arima(numbered, order)
    keep = max(p, q, 1)
    tail = rows.groupBy("series").agg(F.max_by(F.struct(
        "value", "residual", *[f"value_{k}" for k in range(1, p)], *[f"shock_{k}" for k in range(1, q)]), "t").alias("tail"))
    ends = numbered.filter(F.col("t") >= F.col("points") - max(d, 1)).groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("t", "value"))).alias("ends"))  # at most d points per series
    inputs = model.join(tail, "series").join(ends, "series").select(
        "series", "beta", "n", "rss",
        F.array("tail.value", *[f"tail.value_{k}" for k in range(1, p)]).alias("values"),
        F.array("tail.residual", *[f"tail.shock_{k}" for k in range(1, q)]).alias("shocks"),
        F.transform("ends", lambda e: e["value"]).alias("levels"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                beta = list(r.beta)
                c = beta.pop(0) if d == 0 else 0.0
                phi, theta = beta[:p], beta[p : p + q]
                ys = [x if x is not None else 0.0 for x in r.values]
                es = [x if x is not None else 0.0 for x in r.shocks]
                path = []
                for _ in range(horizon):
                    y = c + sum(a * v for a, v in zip(phi, ys)) + sum(a * v for a, v in zip(theta, es))
                    path.append(y)
                    ys, es = [y, *ys][:keep], [0.0, *es][:keep]
                # Weights of past shocks in the differenced series, then summed once per difference.
                psi = [1.0]
                for j in range(1, horizon):
                    psi.append((theta[j - 1] if j <= q else 0.0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(p, j))))
                levels = np.array(r.levels, dtype="float64")
                lasts = [np.diff(levels, i)[-1] for i in range(d)]
                path, psi = np.array(path), np.array(psi)
                for start in reversed(lasts):
                    path, psi = start + np.cumsum(path), np.cumsum(psi)
                variance = r.rss / r.n
                spread = Z95 * np.sqrt(variance * np.cumsum(psi * psi))
                aic = r.n * (math.log(2 * math.pi * max(variance, 1e-300)) + 1) + 2 * (p + q + 1 + (d == 0))
                out.append(pd.DataFrame({"series": r.series, "step": np.arange(1, horizon + 1), "forecast": path,
                                         "lower": path - spread, "upper": path + spread, "aic": round(aic, 2)}))
            if out:
                yield pd.concat(out)

    made = inputs.mapInPandas(run, "series string, step int, forecast double, lower double, upper double, aic double")
    done = staged(made.join(future_dates(numbered, horizon), ["series", "step"]).withColumn("error", F.lit(None).cast("string")))
    lost = every.select("series", "points").distinct().join(done.select("series").distinct(), "series", "left_anti")
    error = F.when(F.col("points") < MIN_POINTS, F.lit(f"fewer than {MIN_POINTS} points")).otherwise("too few points for this order")
    return done.unionByName(lost.select("series", error.alias("error")), allowMissingColumns=True)
