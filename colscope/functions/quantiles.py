"""Exact linear-interpolated percentiles of many columns at any size, in two scans.

The first scan makes a mergeable quantile sketch of every column and takes from it a bracket around each percentile. The
second scan sorts each value into the regions that a column's brackets cut the numbers into, and counts regions, and
inside brackets single values. So every column has its counts below each bracket and the few distinct values within, and
running totals over these give the order statistics. A bracket that misses, of small chance, is made wider and scanned anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.running import running_totals
from colscope.functions.staging import discard, staged

SKETCH = 4_096  # numbers that a level of a sketch keeps
MARGIN = 0.005  # of the ranks on either side; the sketch is within 0.0015 nearly always
FEW = 1_000  # values of a column that are all looked at


def exact_percentiles(df: DataFrame, values: dict[str, Column], probs: list[float]) -> dict[str, list[float | None]]:
    """{name: one value per probability} for the given double expressions; None when empty.

    The result is as large as names x probabilities, never as large as the data.
    """
    names = list(values)
    if not names or not probs:
        return {n: [] for n in names}
    number = lambda c: F.when(~F.isnan(c), c)
    rows = df.select(*[number(values[n].cast("double")).alias(f"v{i}") for i, n in enumerate(names)])
    brackets, sizes = _brackets(rows, len(names), probs, MARGIN)
    wanted = {(i, k) for i in brackets for q in probs for k in _places(sizes[i], q)}
    found: dict[tuple[int, int], float] = {}
    margin = MARGIN
    while wanted:
        found |= _order_statistics(rows, brackets, wanted)
        wanted -= found.keys()
        if wanted:
            margin *= 8
            brackets, _ = _brackets(rows, len(names), probs, margin)
            brackets = {i: b for i, b in brackets.items() if any(i == w[0] for w in wanted)}
    out: dict[str, list[float | None]] = {}
    for i, n in enumerate(names):
        out[n] = []
        for q in probs:
            if not sizes[i]:
                out[n].append(None)
                continue
            h = (sizes[i] - 1) * q
            low, high = (found[(i, k)] for k in _places(sizes[i], q))
            out[n].append(low + (high - low) * (h - math.floor(h)))
    return out


def _places(size: int, q: float) -> tuple[int, int]:
    """The two order statistics, from 0, that a percentile lies between."""
    at = math.floor((size - 1) * q)
    return at, min(at + 1, size - 1)


def _brackets(rows: DataFrame, columns: int, probs: list[float], margin: float) -> tuple[dict[int, list[tuple[float, float]]], dict[int, int]]:
    """Disjoint brackets in ascending order for each column with values, and the columns' numbers of values."""
    ends = F.array(*[F.lit(max(0.0, min(1.0, q + side))) for q in probs for side in (-margin, margin)])
    one = [F.struct(F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("low"), F.max(f"v{i}").alias("high"), F.when(
        F.count(f"v{i}") > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(f"v{i}", F.lit(SKETCH)), ends)).alias("cuts")).alias(f"s{i}")
        for i in range(columns)]
    facts = rows.agg(*one).first()
    out = {}
    for i in range(columns):
        n, low, high, cuts = facts[f"s{i}"]
        if not n:
            continue
        spans = [(low, high)] if n <= FEW or margin >= 0.5 else sorted(
            (low if q <= margin else a, high if q >= 1 - margin else b) for q, a, b in zip(probs, cuts[::2], cuts[1::2], strict=True))
        joined = [spans[0]]
        for a, b in spans[1:]:
            if a <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(b, joined[-1][1])
            else:
                joined.append((a, b))
        out[i] = joined
    return out, {i: facts[f"s{i}"]["n"] for i in range(columns)}


def _order_statistics(rows: DataFrame, brackets: dict[int, list[tuple[float, float]]], wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The k-th smallest value (from 0) of each (column, k) that lies in a bracket. Region 2j is below the j-th bracket of a
    column, region 2j + 1 inside."""
    def entry(i: int) -> Column:
        v, region, inside = F.col(f"v{i}"), F.lit(2 * len(brackets[i])), F.lit(None).cast("double")
        for j, (low, high) in reversed(list(enumerate(brackets[i]))):
            region = F.when(v < low, 2 * j).when(v <= high, 2 * j + 1).otherwise(region)
            inside = F.when((v >= low) & (v <= high), v).otherwise(inside)
        return F.struct(F.lit(i).alias("column"), F.when(v.isNotNull(), region).alias("region"), inside.alias("value"))

    each = rows.select(F.inline(F.array(*[entry(i) for i in brackets]))).filter("region is not null")
    counts = staged(each.groupBy("column", "region", "value").agg(F.count("*").alias("n")))
    totals = {(r["column"], r["region"]): r["n"] for r in counts.groupBy("column", "region").agg(F.sum("n").alias("n")).collect()}
    inside = []  # (column, region, place in it, k): two for each percentile
    for i, k in wanted:
        below = 0
        for region in range(2 * len(brackets.get(i, ())) + 1):
            size = totals.get((i, region), 0)
            if below <= k < below + size and region % 2:
                inside.append((i, region, k - below, k))
            below += size
    if not inside:
        return {}
    placed = running_totals(counts.filter("value is not null"), "value", {"before": "n"}, ["column", "region"])
    asked = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip("irpk", w)]) for w in inside])).alias("w")
    hits = placed.select("column", "region", "value", "before", "n", asked).filter(
        "column = w.i and region = w.r and before <= w.p and w.p < before + n").select("w.i", "w.k", "value").collect()
    discard(counts)
    return {(r["i"], r["k"]): r["value"] for r in hits}
