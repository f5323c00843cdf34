import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colscope.functions import quantiles, running, tails
from colscope.functions.normal import inverse_normal
from colscope.operators import compare, correlation, evaluate, relationships, transforms


def test_tails_against_tables():
    # Critical values of the usual printed tables.
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(3.4928, 2, 20) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(18.30704, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(2 * 5.0, 2) == pytest.approx(math.exp(-5), rel=1e-12)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)


def ks_brute(d, n1, n2):
    """Share of all orders of n1 and n2 values with a gap of at least d."""
    hits = total = 0
    for chosen in itertools.combinations(range(n1 + n2), n1):
        chosen, a, b, worst = set(chosen), 0, 0, 0.0
        for i in range(n1 + n2):
            a, b = (a + 1, b) if i in chosen else (a, b + 1)
            worst = max(worst, abs(a / n1 - b / n2))
        hits += worst >= d - 1e-12
        total += 1
    return hits / total


@pytest.mark.parametrize("n1,n2,d", [(4, 5, 0.6), (5, 5, 0.4), (3, 7, 1.0), (6, 4, 0.25)])
def test_ks_exact(n1, n2, d):
    assert tails.ks_two_sided(d, n1, n2) == pytest.approx(ks_brute(d, n1, n2), abs=1e-12)


def test_ks_limit_meets_exact():
    assert tails.ks_two_sided(0.02, 10_001, 10_001) == pytest.approx(tails.ks_two_sided(0.02, 9_999, 9_999), abs=2e-3)


def test_inverse_normal(spark):
    rows = spark.range(1, 2000).select((F.col("id") / 2000).alias("p")).select("p", inverse_normal(F.col("p")).alias("z")).collect()
    tiny = spark.range(1).select(F.lit(1e-12).alias("p")).select("p", inverse_normal(F.col("p")).alias("z")).collect()
    assert max(abs(NormalDist().inv_cdf(r.p) - r.z) for r in rows + tiny) < 1e-12


def skewed(spark):
    """A third of the rows share one value; some are null."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 50 != 1, F.exp(F.randn(1) * 3)).alias("x"),
        F.floor(F.rand(2) * 40).cast("double").alias("y"), (F.col("id") % 7).cast("double").alias("z"))


@pytest.mark.parametrize("few,sketch", [(1_000, 4_096), (0, 4_096), (0, 8)])
def test_percentiles(spark, monkeypatch, few, sketch):
    """Values all looked at, bracketed by a good sketch, and by one so small that brackets miss."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=3000), "y": rng.integers(0, 3, 3000).astype(float), "z": np.where(rng.random(3000) < 0.5, np.nan, rng.random(3000) * 1e6),
                        "one": np.where(np.arange(3000) == 7, 5.0, np.nan), "none": np.full(3000, np.nan), "far": np.where(np.arange(3000) < 2, np.inf, rng.random(3000))})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = quantiles.exact_percentiles(df, {n: F.col(n) for n in pdf}, probs)
    assert found["none"] == [None] * len(probs)
    for n in ("x", "y", "z", "one"):
        assert found[n] == pytest.approx(np.nanpercentile(pdf[n], [100 * q for q in probs]).tolist(), rel=1e-12)
    assert found["far"][:5] == pytest.approx(np.percentile(pdf["far"], [100 * q for q in probs[:5]]).tolist(), rel=1e-12)
    assert quantiles.exact_percentiles(df.limit(0), {"x": F.col("x")}, [0.5]) == {"x": [None]}


def test_percentiles_take_two_scans(spark, tmp_path, monkeypatch):
    """Whatever the number of columns, and however many rows share a value."""
    spark.range(20_000).select(*[F.when(F.rand(i) < 0.5, 7.0).otherwise(F.rand(100 + i)).alias(f"c{i}") for i in range(12)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = []
    agg, made = type(df).agg, quantiles.staged
    monkeypatch.setattr(type(df), "agg", lambda self, *a: (scans.append(1) if str(tmp_path) in str(self.inputFiles()) else None, agg(self, *a))[1])
    monkeypatch.setattr(quantiles, "staged", lambda d, **k: (scans.append(1) if str(tmp_path) in str(d.inputFiles()) else None, made(d, **k))[1])
    found = quantiles.exact_percentiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.75])
    assert len(scans) == 2 and all(v[1] == 7.0 and v[0] < 1 for v in found.values())


@pytest.mark.parametrize("rows", [0, None])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_both_ways(spark, rows, descending):
    counts = skewed(spark).select("x", "y").dropna().groupBy("y", "x").agg(F.count("*").alias("n"))
    got = running.running_totals(counts, "x", {"before": "n"}, ["y"], descending, one_window_rows=rows).collect()
    table = counts.collect()
    for r in got[::37]:
        earlier = [q.n for q in table if q.y == r.y and (q.x > r.x if descending else q.x < r.x)]
        assert r.before == sum(earlier) and r.before_all == sum(q.n for q in table if q.y == r.y)
    assert len(got) == len(table)


def test_text_order_in_blocks(spark):
    words = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("w"), F.lit(1).alias("one"))
    got = running.running_totals(words, "w", {"code": "one"}, one_window_rows=0).orderBy("w").collect()
    assert [r.code for r in got] == list(range(500))


def kendall_brute(x, y):
    net = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        net += np.sign(a - c) * np.sign(b - d)
        tx += a == c
        ty += b == d
    pairs = len(x) * (len(x) - 1) / 2
    return net / math.sqrt((pairs - tx) * (pairs - ty))


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_kendall(spark, rows, monkeypatch):
    monkeypatch.setattr(running, "ONE_WINDOW_ROWS", rows)
    df = skewed(spark).limit(300).cache()
    pdf = df.toPandas()
    for r in correlation.kendall(df).collect():
        complete = pdf[[r.col_a, r.col_b]].dropna()
        assert r.r == pytest.approx(kendall_brute(complete[r.col_a].to_numpy(), complete[r.col_b].to_numpy()), abs=1e-12)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_spearman(spark, rows, monkeypatch):
    monkeypatch.setattr(running, "ONE_WINDOW_ROWS", rows)
    df = skewed(spark).cache()
    pdf = df.toPandas()
    for r in correlation.spearman(df).collect():
        complete = pdf[[r.col_a, r.col_b]].dropna().rank()
        assert r.r == pytest.approx(complete[r.col_a].corr(complete[r.col_b]), abs=1e-9)


def test_high_pairs_and_few_columns(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 2 + 1).alias("b"), F.rand(1).alias("c"), F.lit(1).alias("flat"))
    matrix = correlation.correlations(df, ("pearson",))
    assert matrix.count() == 3
    assert [tuple(r) for r in correlation.high_pairs(matrix).collect()] == [("a", "b", 1.0, "drop one")]
    assert correlation.correlations(df.select("a", "b")).count() == 0


def test_tests_of_two_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "a"), (3.0, 4.0, "a"), (4.0, 3.0, "b"), (5.0, 6.0, "b"), (6.0, 5.0, "b")],
                               "x double, y double, g string")
    r = relationships.number_vs_number(df, "x", "y").first()
    t = r.pearson_r * math.sqrt(4 / (1 - 0.82857142857**2))
    assert r.pearson_r == 0.8286 and r.p_value == pytest.approx(tails.t_two_sided(t, 4), abs=1e-3) and r.significant
    f = relationships.number_vs_category(df, "x", "g").first()
    assert f.f_statistic == 13.5 and f.p_value == pytest.approx(tails.f_upper(13.5, 1, 4), abs=1e-4)
    assert relationships.number_vs_category(df.limit(3), "x", "g").count() == 0
    assert relationships.number_vs_number(df.limit(4), "x", "y").count() == 0


def test_yates(spark):
    cells = [("a", "u", 10), ("a", "v", 20), ("b", "u", 30), ("b", "v", 5)]
    df = spark.createDataFrame([(p, q) for p, q, n in cells for _ in range(n)], "p string, q string")
    row = relationships.category_vs_category(df, "p", "q").first()
    n, gap = 65, abs(10 - 30 * 40 / 65) - 0.5
    chi = sum(gap**2 / (r * c / n) for r in (30, 35) for c in (40, 25))
    assert row.chi2 == pytest.approx(chi, abs=1e-4) and row.dof == 1 and row.significant
    empty = spark.createDataFrame([("a", "u")] * 8 + [("b", "v")] * 8, "p string, q string")
    gap = 4 - 0.5
    assert relationships.category_vs_category(empty, "p", "q").first().chi2 == pytest.approx(4 * gap**2 / 4, abs=1e-4)


def test_overlap_and_shifts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (None, "y")], "k int, s string")
    assert tuple(compare.row_overlap(a, b).first()) == (4, 133.33)
    same = spark.range(100).select(F.col("id").cast("double").alias("v"))
    row = compare.distribution_shifts(same, same.withColumn("v", F.col("v") + 50)).first()
    assert row.ks_statistic == 0.5 and row.shift_detected


def test_metrics_by_hand(spark):
    pred = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 1, 0.9)], "y int, pred int, score double")
    row = evaluate.classification_metrics(pred).first()
    assert row.accuracy == 0.75 and row.recall_weighted == 0.75
    assert row.precision_weighted == pytest.approx((1.0 * 2 + 2 / 3 * 2) / 4)
    assert row.mcc == pytest.approx(2 / math.sqrt(2 * 2 * 3 * 1))
    assert evaluate.roc_auc(pred).first().roc_auc == pytest.approx(3.5 / 4)
    folds = spark.createDataFrame([("a", 0, 0.8), ("a", 1, 0.9), ("a", 2, 0.85), ("b", 0, 0.7), ("b", 1, 0.72), ("b", 2, 0.71),
                                   ("c", 0, 0.8), ("c", 1, 0.9), ("c", 2, 0.85)], "model string, fold int, score double")
    got = {(r.model_a, r.model_b): r.p_better for r in evaluate.pairwise_comparison(folds).collect()}
    assert got["a", "c"] == 0.5 and got["a", "b"] > 0.95 and got["b", "a"] == pytest.approx(1 - got["a", "b"], abs=1e-3)


def test_transforms(spark):
    df = spark.createDataFrame([(0.0, None), (12.0, "a"), (12.5, "a"), (64.0, "b"), (65.0, "a"), (None, "c")], "age double, s string")
    assert [r.age_group for r in transforms.add_age_group(df, "age").collect()] == [None, "child", "teen", "adult", "senior", None]
    assert sorted(r.s_freq for r in transforms.add_frequency(df, "s").collect()) == [0, 1, 1, 3, 3, 3]
    assert [r.s_length for r in transforms.add_text_length(df, "s").collect()][0] == 0
    logs = [r.age_log for r in transforms.add_log(df, "age").collect()]
    assert logs[0] == 0.0 and logs[-1] is None
