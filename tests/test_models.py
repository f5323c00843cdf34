import inspect

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as driver
from colscope.functions import lookups, staging
from colscope.functions.staging import staged
from colscope.operators import cluster, features, forecast, learners, neighbours, rank, sampling, smote
from colscope.plans import modelling

CLF = {"x1": "numerical", "x2": "numerical", "cat": "categorical", "target": "boolean", "k": "identifier"}
REG = {"x1": "numerical", "x2": "numerical", "target": "numerical", "k": "identifier"}
SMALL = {"n_estimators": 5, "max_depth": 4}


@pytest.fixture(scope="module")
def clf(spark):
    rng = np.random.default_rng(0)
    x1, x2, cat = rng.normal(size=200), rng.normal(size=200), rng.choice(list("abc"), 200)
    y = (x1 + x2 + 1.5 * (cat == "a") > 0).astype(int)
    return spark.createDataFrame([(i, float(x1[i]), float(x2[i]), str(cat[i]), int(y[i])) for i in range(200)],
                                 "k long, x1 double, x2 double, cat string, target int").cache()


@pytest.fixture(scope="module")
def reg(spark):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = 3 * x1 - 2 * x2 + rng.normal(scale=0.1, size=200)
    return spark.createDataFrame([(i, float(x1[i]), float(x2[i]), float(y[i])) for i in range(200)],
                                 "k long, x1 double, x2 double, target double").cache()


def test_registry():
    for problem in ("classification", "regression"):
        for name in learners.list_learners(problem):
            assert isinstance(learners.defaults(problem, name), dict)
    with pytest.raises(ValueError):
        learners.defaults("regression", "nope")
    assert learners.hidden_layers("100, 50") == [100, 50] and learners.hidden_layers("") == [100]


def test_train_classifier(clf):
    run = modelling.train(clf, "target", "classification", "logistic_regression", CLF, options={"cv_folds": 3}, key="k")
    assert run.ok, run.error
    assert run.metrics["accuracy"] > 0.6 and run.metrics["roc_auc"] > 0.6 and -1 <= run.metrics["mcc"] <= 1
    assert run.cv.count() == 3 and run.labels == ["0", "1"] and run.n_train + run.n_test == 200
    assert {n for n, _ in run.importance} == {"x1", "x2", "cat_a", "cat_b", "cat_c"}
    assert len(run.pipe.nomogram()) == 5


@pytest.mark.parametrize("imbalance", ["smote", "class_weight"])
def test_imbalance(clf, imbalance):
    run = modelling.train(clf, "target", "classification", "decision_tree", CLF, {"max_depth": 4}, {"imbalance": imbalance}, key="k")
    assert run.ok and run.metrics["accuracy"] > 0.6


def test_train_regressor(reg):
    run = modelling.train(reg, "target", "regression", "linear_regression", REG, key="k")
    assert run.ok and run.metrics["r2"] > 0.8


def test_errors_are_results(clf):
    assert not modelling.train(clf, "nope", "classification", "constant", CLF).ok
    assert not modelling.train(clf.limit(5), "target", "classification", "constant", CLF).ok
    assert "usable feature" in modelling.train(clf.select("k", "target"), "target", "classification", "constant", CLF).error


@pytest.mark.parametrize("name", [n for n in learners.list_learners("classification") if n not in ("linear_svm", "neural_network")])
def test_every_classifier(clf, name):
    p = modelling.prepare(clf, "target", "classification", CLF, key="k")
    params = {k: v for k, v in SMALL.items() if k in learners.DEFAULTS["classification"][name]}
    pred = modelling.fit_pipe(p, p.rows, name, params).predict(p.rows).cache()
    assert pred.count() == 200
    row = modelling.metrics(pred, p).first()
    assert row.accuracy > (0.6 if name != "constant" else 0.5)
    assert pred.select(F.max(F.abs(F.get("prob", F.lit(0)) + F.get("prob", F.lit(1)) - 1))).first()[0] < 1e-9


@pytest.mark.parametrize("name", learners.list_learners("regression"))
def test_every_regressor(reg, name):
    p = modelling.prepare(reg, "target", "regression", REG, key="k")
    params = {k: v for k, v in SMALL.items() if k in learners.DEFAULTS["regression"][name]}
    row = modelling.metrics(modelling.fit_pipe(p, p.rows, name, params).predict(p.rows), p).first()
    assert row.r2 > (0.6 if name != "constant" else -0.01)


def test_leaderboard(reg):
    board = modelling.leaderboard(reg, "target", "regression", REG, ["constant", "linear_regression", "unknown"], key="k").collect()
    assert [r.model for r in board] == ["linear_regression", "constant", "unknown"]
    assert board[0].r2 > board[1].r2 and not board[2].ok and board[2].error


def test_test_and_score(clf):
    s = modelling.test_and_score(clf, "target", "classification", {"naive_bayes": None, "constant": None}, CLF, {"k": 3}, key="k")
    assert s.predictions.count() == 400 and s.folds.count() == 6
    assert {r.model: r.accuracy for r in s.metrics.collect()}["naive_bayes"] > 0.6
    assert s.comparison.count() == 2
    table = modelling.predictions_table(s.prepared, s.fitted)
    assert table.count() == 2 * 200 * 2
    assert modelling.wide_predictions(table, list(s.fitted)).columns == ["id", "actual", "naive_bayes", "constant"]


def test_sampling_schemes(reg):
    for scheme, rows in (({"method": "random_sampling", "repeats": 2}, 120), ({"method": "test_on_train"}, 200), ({"method": "leave_one_out"}, 200)):
        s = modelling.test_and_score(reg, "target", "regression", {"linear_regression": None}, REG, scheme, refit=False, key="k")
        assert s.predictions.count() == rows and s.metrics.first().r2 > 0.8
    with pytest.raises(ValueError):
        modelling.test_and_score(reg, "target", "regression", {"decision_tree": None}, REG, {"method": "leave_one_out"}, key="k")


def test_leave_one_out_equals_refits(reg):
    small = reg.limit(30).cache()
    p = modelling.prepare(small, "target", "regression", REG, key="k")
    got = {r.id: r.pred for r in modelling.leave_one_out(p, "linear_regression").collect()}
    rows = small.toPandas()
    x, y = np.column_stack([np.ones(30), rows.x1, rows.x2]), rows.target.to_numpy()
    for i in range(30):
        keep = np.arange(30) != i
        beta = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        assert got[rows.k[i]] == pytest.approx(float(x[i] @ beta), abs=1e-9)
    constant = {r.id: r.pred for r in modelling.leave_one_out(p, "constant").collect()}
    assert constant[rows.k[0]] == pytest.approx(y[1:].mean())


def test_tune(clf):
    best = modelling.tune(clf, "target", "classification", "logistic_regression", CLF, n_iter=2, cv=2, key="k").collect()
    assert len(best) == 2 and best[0].score >= best[1].score
    with pytest.raises(ValueError):
        modelling.tune(clf, "target", "classification", "naive_bayes", CLF)


def test_pipeline_saved_and_loaded(clf, tmp_path):
    p = modelling.prepare(clf, "target", "classification", CLF, key="k")
    pipe = modelling.fit_pipe(p, p.rows, "logistic_regression")
    pipe.save(str(tmp_path / "m"))
    again = modelling.load(clf.sparkSession, str(tmp_path / "m"))
    assert again.labels == p.labels and again.target == "target"
    mine = {r.id: r.pred for r in pipe.predict(p.rows).collect()}
    for rows in (clf, clf.drop("target")):
        assert mine == {r.id: r.pred for r in again.predict(rows, key="k").collect() if r.id in mine}
    assert again.predict(clf.drop("target")).filter("y is not null").count() == 0


QUICK = {"ada_boost": {"n_estimators": 3}, "linear_svm": {"max_iter": 5}}


@pytest.mark.parametrize("name", ["constant", "naive_bayes", "ada_boost", "nearest_neighbours", "linear_svm"])  # one of each kind
def test_learners_saved_and_loaded(clf, tmp_path, name):
    p = modelling.prepare(clf, "target", "classification", CLF, key="k")
    pipe = modelling.fit_pipe(p, p.rows, name, QUICK.get(name), "class_weight")
    pipe.save(str(tmp_path / "m"))
    again = modelling.load(clf.sparkSession, str(tmp_path / "m"))
    one, two = ({r.id: (r.pred, list(r.prob)) for r in x.predict(p.rows).collect()} for x in (pipe, again))
    assert one == two


def test_unknown_levels(clf):
    plain = features.choose_columns(clf.columns, CLF, target="target")
    coded = features.choose_columns(clf.columns, CLF, choices={"cat": {"encoding": "ordinal"}}, target="target")
    assert plain["one_hot"] == ["cat"] and coded["ordinal"] == ["cat"]
    odd = clf.limit(1).withColumn("cat", F.lit("zz"))
    for groups, expected in ((plain, [0.0, 0.0, 0.0]), (coded, [-1.0])):
        pre = features.fit_preprocessor(clf, groups)
        assert features.apply_preprocessor(pre, odd).first().features.toArray().tolist()[2:] == expected


def test_standard_scaling_by_population(clf):
    pre = features.fit_preprocessor(clf, {"standard": ["x1"], "robust": [], "minmax": [], "one_hot": [], "ordinal": []})
    v = features.apply_preprocessor(pre, clf).select(F.get(vector_to_array("features"), F.lit(0)).alias("v"))
    mean, std = v.agg(F.avg("v"), F.stddev_pop("v")).first()
    assert mean == pytest.approx(0, abs=1e-12) and std == pytest.approx(1, abs=1e-12)


def test_folds_and_splits(clf):
    folds = sampling.with_folds(clf, 4, "k", "target").groupBy("target", "fold").count().collect()
    for t in (0, 1):
        sizes = [r["count"] for r in folds if r.target == t]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    split = sampling.with_split(clf, 0.2, "k", "target").cache()
    assert abs(split.filter("is_test").count() - 40) <= 1
    again = sampling.with_split(clf.repartition(5), 0.2, "k", "target")
    assert {r.k for r in split.filter("is_test").collect()} == {r.k for r in again.filter("is_test").collect()}
    assert sampling.numbered(clf.drop("k").union(clf.drop("k")), strata="target").groupBy("target", "number").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("method", ["information", "anova", "chi2", "tree", "forest"])
def test_rank(spark, clf, method):
    profile = spark.createDataFrame([(n, i, c, 0.01) for i, (n, c) in enumerate(CLF.items())],
                                    "column string, position int, dtype_class string, unique_pct double")
    ranked = rank.rank_features(clf, profile, "target", "classification", method).collect()
    assert {r.feature for r in ranked} == {"x1", "x2", "cat"}
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)


def frame(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, v array<double>")


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_k_nearest_by_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(3)
    points = np.round(np.vstack([rng.normal(size=(120, 3)), np.zeros((60, 3))]), 2)  # a third of the rows are one point
    x = frame(spark, points)
    got = {(r.id, r.place): (r.neighbour, r.distance) for r in neighbours.k_nearest(x, x, 4, True, block_rows).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(180):
        order = np.argsort(d[i], kind="stable")[:4]
        assert [got[i, j + 1][0] for j in range(4)] == order.tolist()


def dbscan_brute(points, eps, least):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    core = (d <= eps).sum(1) >= least
    label, count = np.full(len(points), -1), 0
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], count
            while stack:
                for k in np.flatnonzero((d[stack.pop()] <= eps) & core):
                    if label[k] < 0:
                        label[k] = count
                        stack.append(k)
            count += 1
    for i in np.flatnonzero(~core):
        near = np.flatnonzero((d[i] <= eps) & core)
        if len(near):
            label[i] = label[near].min()
    return label.tolist()


@pytest.mark.parametrize("eps,least", [(0.4, 5), (0.05, 3)])
def test_dbscan_by_brute_force(spark, eps, least, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(4)
    line = np.column_stack([np.linspace(0, 6, 60), np.zeros(60)])
    points = np.vstack([rng.normal(size=(80, 2)) + [0, 4], line, np.zeros((30, 2))])
    df = frame(spark, points).select("id", array_to_vector("v").alias("features"))
    got = [r.cluster for r in cluster.dbscan(df, eps, least).orderBy("id").collect()]
    assert got == dbscan_brute(points, eps, least)


def test_dbscan_all_noise(spark):
    df = frame(spark, np.arange(10).reshape(10, 1) * 100).select("id", array_to_vector("v").alias("features"))
    assert {r.cluster for r in cluster.dbscan(df, 0.5, 5).collect()} == {-1}


def test_clusters(reg):
    made = modelling.find_clusters(reg.drop("target"), REG, "k_means", {"n_clusters": 3, "n_init": 1}, key="k", with_elbow=False)
    assert made.sizes.first().n_clusters == 3 and made.rows.count() == 200
    assert -1 <= made.silhouette.agg(F.avg("silhouette")).first()[0] <= 1
    assert made.coordinates.select("pca").first().pca.size == 2


def test_smote_makes_equal_classes_between_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0.0, rng.normal(size=2).tolist()) for i in range(60)] + [(60 + i, 1.0, (rng.random(2) + 10).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, y double, v array<double>").select("id", "y", array_to_vector("v").alias("features"))
    out = smote.oversample(df).cache()
    assert {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()} == {0.0: 60, 1.0: 60}
    made = np.array([r.features.toArray() for r in out.filter("synthetic").collect()])
    assert (made >= 10).all() and (made <= 11).all()


def test_series(spark):
    rng = np.random.default_rng(6)
    x = [0.0]
    for e in rng.normal(size=3000):
        x.append(0.7 * x[-1] + e)
    rows = [("s", f"2020-01-01 00:00:00", i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(s, i, float(v)) for s, _, i, v in rows], "s string, i int, v double").withColumn(
        "d", F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(i)"))
    points = forecast.numbered_points(forecast.series_points(df, "d", "v", "s"))
    model, _ = forecast.fit_arima(points, (1, 0, 0))
    beta = model.first().beta
    assert beta[1] == pytest.approx(0.7, abs=0.05)
    made = forecast.forecast(points, (1, 0, 0), 3).orderBy("step").collect()
    assert made[0].forecast == pytest.approx(beta[0] + beta[1] * x[-1], abs=1e-9)
    assert made[0].upper - made[0].forecast == pytest.approx(1.96, abs=0.1)
    assert str(made[1].date) == "2028-03-21 00:00:00"
    walk = forecast.forecast(points, (0, 1, 0), 3).orderBy("step").collect()
    assert [w.forecast for w in walk] == pytest.approx([x[-1]] * 3)
    assert walk[2].upper - walk[2].forecast == pytest.approx((walk[0].upper - walk[0].forecast) * 3**0.5)
    moving, _ = forecast.fit_arima(points, (0, 0, 1))
    assert moving.first().beta[1] > 0.4
    short = forecast.forecast(forecast.numbered_points(forecast.series_points(df.limit(9), "d", "v", "s"))).collect()
    assert [(r.series, r.forecast, r.error) for r in short] == [("s", None, "fewer than 10 points")]
    ten = forecast.forecast(forecast.numbered_points(forecast.series_points(df.limit(10), "d", "v", "s")), (5, 1, 5)).collect()
    assert [(r.series, r.error) for r in ten] == [("s", "too few points for this order")]


def test_month_starts(spark):
    df = spark.range(24).select(F.add_months(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.col("id").cast("double").alias("v"))
    points = forecast.numbered_points(forecast.series_points(df, "d", "v"))
    assert [str(r.date)[:10] for r in forecast.future_dates(points, 3).orderBy("step").collect()] == ["2024-01-01", "2024-02-01", "2024-03-01"]


@pytest.mark.parametrize("classes", [2, 3])
def test_svm_with_weights(spark, classes):
    from pyspark.ml.linalg import Vectors

    from colscope.operators import learners

    rows = [(float(i % classes), Vectors.dense([i % classes + (i * 7 % 10) / 50, (i % classes == 1) * 2.0]), 1.0 + i % 2) for i in range(120)]
    train = spark.createDataFrame(rows, ["y", "features", "w"]).coalesce(1).cache()
    for weight in ("w",):
        model = learners._svm(train, {"C": 10.0}, classes, weight)
        assert model is not None


@pytest.mark.parametrize(("name", "module", "operator", "given"), [
    ("elbow_curve", cluster, "elbow", {"df"}), ("k_means_clusters", cluster, "k_means", {"df"}),
    ("feature_importance", modelling, "fit_pipe", {"p", "train", "name"}),
    ("leaderboard", modelling, "leaderboard", {"df", "target", "problem", "classes", "kwargs"})])
def test_queries_call_operators_with_defaults(spark, monkeypatch, name, module, operator, given):
    class Called(Exception):
        pass

    def seen(*args, **kwargs):
        raise Called(set(inspect.signature(real).bind(*args, **kwargs).arguments))

    real = getattr(module, operator)
    monkeypatch.setattr(module, operator, seen)
    with pytest.raises(Called) as call:
        driver.queries()[name](spark, driver.SMOKE_DIR)
    assert call.value.args[0] == given


def test_codes_without_the_driver(clf, monkeypatch):
    """Sparse vectors and the shuffled dictionary give what dense vectors and the broadcast one give; frequent, unknown and
    null levels included."""
    groups = {"standard": ["x1"], "robust": [], "minmax": [], "one_hot": ["cat", "k"], "ordinal": ["word"]}
    rows = clf.withColumn("word", F.when(F.col("k") % 3 > 0, F.when(F.col("k") % 2 == 0, "often").otherwise(F.concat(F.lit("w."), "k"))))
    odd = rows.unionByName(rows.limit(2).withColumns({"word": F.lit("new"), "cat": F.lit(None).cast("string"), "k": F.lit(-5).cast("long")}))
    pre = features.fit_preprocessor(rows, groups)
    values = lambda p: sorted((r.k, r.word, tuple(r.features.toArray().tolist())) for r in features.apply_preprocessor(p, odd).select(
        "k", F.coalesce("word", F.lit("")).alias("word"), "features").collect())
    whole = values(pre)
    monkeypatch.setattr(features, "DENSE", 0)
    monkeypatch.setattr(features, "FEW_LEVELS", 0)
    monkeypatch.setattr(lookups, "HOT", 4)
    made = features.apply_preprocessor(pre, odd)
    assert type(made.first().features).__name__ == "SparseVector" and values(pre) == whole
    assert len(whole[0][2]) == pre.size == 1 + 3 + 200 + 1 and pre.names([0, 1, pre.size - 1]) == ["x1", "cat_a", "word"]
    words = sorted({r.word for r in rows.collect() if r.word})
    assert {r[1]: r[2][-1] for r in whole if r[1]} == {**{w: float(i) for i, w in enumerate(words)}, "new": -1.0}


def test_positions(spark):
    from colscope.functions.running import positions

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.concat(F.lit("v"), F.col("id") % 50).alias("v"), "id")
    found = positions(rows, ["g"], ["v", "id"]).collect()
    for g in range(3):
        own = sorted((r.v, r.id) for r in found if r.g == g)
        assert sorted((r.place, r.v, r.id) for r in found if r.g == g) == [(i, *x) for i, x in enumerate(own)]


def test_weighted_draws(spark):
    """As many draws as rows, in proportion to the weights, the same however the rows are dealt out; and by a reference that
    walks the running weights in memory."""
    rows = spark.range(2_000).select("id", F.when(F.col("id") == 7, 500.0).when(F.col("id") % 2 == 0, 0.0).otherwise(1.0).alias("_w"))
    one = {r.id: r.n for r in learners.drawn_counts(rows, 3).collect()}
    assert one == {r.id: r.n for r in learners.drawn_counts(rows.repartition(13, "_w", "id"), 3).collect()}
    assert sum(one.values()) == 2_000 and all(i % 2 for i in one)
    weights = np.array([500.0 if i == 7 else float(i % 2) for i in range(2_000)])
    hashes = [r.h for r in spark.range(2_000).select(F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11).alias("h")).collect()]
    ends = np.cumsum(weights)
    reference = np.bincount(np.searchsorted(ends / ends[-1], np.array(hashes) / 2**53, side="right"), minlength=2_000)
    assert {i: float(n) for i, n in enumerate(reference) if n} == one
    assert abs(one[7] / 2_000 - 500 / weights.sum()) < 0.05
    assert one != {r.id: r.n for r in learners.drawn_counts(rows, 4).collect()}


@pytest.mark.parametrize("hot", [2, 1_000])
def test_looked_up(spark, monkeypatch, hot):
    """Frequent keys by broadcast, the others by shuffle, null and unknown keys without a value."""
    monkeypatch.setattr(lookups, "HOT", hot)
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 2 == 0, 5.0).when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("k"))
    table = rows.dropna().filter("k <> 9").groupBy(F.col("k").alias("value")).agg(F.count("*").alias("n")).withColumn("found", F.col("value") * 2)
    out = lookups.looked_up(rows, table, {"value": F.col("k")}, "found", "f")
    assert out.columns == ["id", "k", "f"]
    assert all(r.f == (None if r.k in (None, 9.0) else 2 * r.k) for r in out.collect()) and out.count() == 1_000


def test_rank_correlation_jobs_do_not_grow_with_columns(spark):
    """As many jobs for ten columns with nulls as for three."""
    from colscope.operators import correlation

    rows = spark.range(300).select(*[F.when(F.rand(i) < 0.8, F.floor(F.rand(50 + i) * 9).cast("double")).alias(f"c{i}") for i in range(10)]).cache()
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (3, 10):
        spark.sparkContext.setJobGroup(f"ranks {n}", "ranks")
        found = correlation.spearman(rows, [f"c{i}" for i in range(n)]).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"ranks {n}")))
        assert len(found) == n * (n - 1) // 2 and all(r.r is not None for r in found)
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 3


@pytest.mark.parametrize("freq,calendar", [("MS", "firsts"), ("ME", "ends"), ("QS", "firsts"), ("QE", "ends"), ("YS", "firsts"), ("B", "business"), ("D", "gap"), ("h", "gap"), ("2D", "gap"),
                                           ("W-SUN", "gap")])
def test_future_dates_follow_the_calendar(spark, freq, calendar):
    """What a library that infers frequencies gives."""
    import pandas as pd

    dates = pd.date_range("2023-01-02", periods=14, freq=freq)
    rows = spark.createDataFrame([(d.to_pydatetime(), float(i)) for i, d in enumerate(dates)], "d timestamp_ntz, v double")
    numbered = forecast.numbered_points(forecast.series_points(rows, "d", "v"))
    assert forecast.calendars(numbered).first().calendar == calendar
    found = [r.date for r in forecast.future_dates(numbered, 9).orderBy("step").collect()]
    assert found == [d.to_pydatetime() for d in pd.date_range(dates[-1], periods=10, freq=freq)[1:]]


def test_importances_of_rounds_without_a_split_add_up():
    from types import SimpleNamespace

    from pyspark.ml.linalg import Vectors

    rounds = [SimpleNamespace(featureImportances=Vectors.dense(v)) for v in ([0.0, 1.0], [0.0, 0.0], [1.0, 0.0])]
    assert learners.Ensemble("classification", 2, rounds, [3.0, 2.0, 1.0]).importances() == [0.25, 0.75]
    assert learners.Ensemble("classification", 2, rounds[1:2], [2.0]).importances() == [0.0, 0.0]


def test_neighbours_visit_few_cells_and_copy_few_rows(spark, monkeypatch):
    """In a plane a row's five nearest lie in few other cells; where cells spare nothing, rows are copied for few blocks."""
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(8)
    x = frame(spark, rng.random((2_000, 2)))
    cells = neighbours.Cells(x)
    near = {r.id: r.distance for r in neighbours.k_nearest(x, x, 5, True).filter("place = 5").collect()}
    asked = cells.placed(x).join(spark.createDataFrame(list(near.items()), "id long, bound double"), "id")
    others = asked.select(F.size(cells.candidates(wanted=6)("v", "cell", "bound")).alias("n"))
    assert len(cells.size) > 40 and others.agg(F.avg("n")).first()[0] < 6
    held, seeking = neighbours._wide(x, 2_000, x.select(F.col("id").alias("qid"), F.col("v").alias("qv")), 2_000, 2, 16)
    assert max(held.count(), seeking.count()) <= 2_000 * 6


def test_distance_sums_with_copies(spark):
    """Sums by brute force, with copies of a row in its own label and in others, far from the origin."""
    rng = np.random.default_rng(9)
    points = np.vstack([np.round(rng.random((60, 3)), 1), np.full((40, 3), 0.5)]) + 1_000
    label = np.arange(100) % 3
    x = frame(spark, points).withColumn("label", F.col("id") % 3)
    got = {(r.id, r.label): r.total for r in neighbours.distance_sums(x, x).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert len(got) == 300
    assert all(got[i, c] == pytest.approx(d[i, label == c].sum(), rel=1e-9) for i in range(100) for c in range(3))


def test_folds_and_vectors_once_for_all_learners(reg, monkeypatch):
    """Learners and cells of a grid share the folds, and the preprocessor of each."""
    calls = {"with_folds": 0, "fit_preprocessor": 0}

    def counted(module, name):
        real = getattr(module, name)

        def run(*args, **kwargs):
            calls[name] += 1
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, run)

    counted(modelling.sampling, "with_folds")
    counted(modelling.features, "fit_preprocessor")
    made = modelling.test_and_score(reg, "target", "regression", {"constant": None, "linear_regression": None}, REG, {"k": 3}, refit=False, key="k")
    assert calls == {"with_folds": 1, "fit_preprocessor": 3} and made.metrics.count() == 2
    assert modelling.tune(reg, "target", "regression", "ridge", REG, cv=3, key="k").count() == 4
    assert calls == {"with_folds": 2, "fit_preprocessor": 6}


def test_parts_are_bounded(spark, monkeypatch):
    """What a task of a fit holds doesn't grow with the table."""
    monkeypatch.setattr(modelling, "PART_DOUBLES", 1_000)
    rows = spark.range(4_000).select("id", F.lit(0.0).alias("y"), array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"))
    spread = modelling.spread_out(rows)
    most = max(spread.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
    assert spread.count() == 4_000 and most * 4 <= 2_000


@pytest.mark.parametrize("problem", ["regression", "classification"])
def test_a_tree_on_weighted_distinct_rows_is_the_tree_on_all(spark, monkeypatch, problem):
    y = F.col("a") * 3 + F.col("b") * F.col("b") + F.col("id") % 3 if problem == "regression" else ((F.col("a") + F.col("b") + F.col("id") % 2) > 5).cast("double")
    rows = spark.range(3_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    rows = rows.select("id", y.alias("y"), array_to_vector(F.array("a", "b")).alias("features"))
    few, _ = learners.alike(rows, 3_000, None, problem)
    assert few.count() <= 70 and few.agg(F.sum("_n")).first()[0] == 3_000
    grouped = learners.fit(problem, "decision_tree", rows, classes=2)
    monkeypatch.setattr(learners, "ALIKE", 10_000)
    whole = learners.fit(problem, "decision_tree", rows, classes=2)
    assert whole.model.numNodes == grouped.model.numNodes
    assert grouped.importances() == pytest.approx(whole.importances())
    both = grouped.predict(rows).select("id", F.col("pred").alias("g")).join(whole.predict(rows).select("id", "pred"), "id")
    assert both.filter(F.abs(F.col("g") - F.col("pred")) > 1e-9).isEmpty()


@pytest.mark.parametrize("problem", ["regression", "classification"])
def test_forest_in_portions(spark, monkeypatch, tmp_path, problem):
    rows = spark.range(400).select("id", F.when(F.col("id") % 20 > 9, 1.0).otherwise(0.0).alias("y"),
                                   array_to_vector(F.array((F.col("id") % 20).cast("double"), (F.col("id") % 3).cast("double"))).alias("features"))
    monkeypatch.setattr(learners, "DRAWN", 400 * 3)
    model = learners.fit(problem, "random_forest", rows, {"n_estimators": 7, "max_depth": 4}, 2)
    assert model.weights == [3.0, 2.0, 2.0] and [m.getNumTrees for m in model.models] == [3, 2, 2]
    assert sum(model.importances()) == pytest.approx(1) and model.importances()[0] > 0.9
    learners.save(model, str(tmp_path / "m"))
    for m in (model, learners.load(spark, str(tmp_path / "m"))):
        out = m.predict(rows)
        assert out.filter(F.abs(F.col("pred") - F.col("y")) > 0.5).isEmpty() and ("prob" in out.columns) == (problem == "classification")


@pytest.mark.parametrize("few", [True, False])
def test_network_by_passes_over_blocks(spark, monkeypatch, few):
    """Weights are laid out as Spark's, the gradient is that of the cost, and the fit is no worse than by Spark's own trainer."""
    rows = spark.range(1, 801).select("id", (F.xxhash64("id") % 100 / 50.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 100 / 50.0).alias("b"))
    train = staged(rows.withColumn("y", F.when(F.col("a") * F.col("b") > 0, 1.0).when(F.col("a") > 1, 2.0).otherwise(0.0)).select(
        "id", "y", array_to_vector(F.array("a", "b")).alias("features")).repartition(3, "id"))
    layers = [2, 7, 5, 3]
    plain = MultilayerPerceptronClassifier(layers=layers, maxIter=40, seed=learners.SEED, **learners.COLUMNS).fit(train)
    blocks = learners.packed(train, 64)
    assert blocks.count() >= 800 // 64 and blocks.agg(F.sum(F.length("y"))).first()[0] == 800 * 8
    w = plain.weights.toArray()
    cost, slope = learners.network_cost(blocks, layers, w, few)
    chance = plain.transform(train).select(F.avg(-F.log(F.get(vector_to_array("probability"), F.col("y").cast("int")))).alias("c"))
    assert cost == pytest.approx(chance.first()[0], rel=1e-4)
    for i in (0, 9, 25, len(w) - 1):
        step = np.zeros(len(w))
        step[i] = 1e-2
        ahead, back = (learners.network_cost(blocks, layers, w + s, few)[0] for s in (step, -step))
        assert (ahead - back) / 2e-2 == pytest.approx(slope[i], abs=2e-4)
    passes = []
    one = learners.network_cost
    monkeypatch.setattr(learners, "network_cost", lambda blocks, layers, w, f: passes.append(1) or one(blocks, layers, w, few))
    made = learners.fit("classification", "neural_network", train, {"hidden_layer_sizes": "7,5", "max_iter": 40}, 3)
    assert 10 < len(passes) < 80
    assert one(blocks, layers, made.model.weights.toArray())[0] < 1.2 * cost + 0.02
    assert made.predict(train).filter("pred is not null").count() == 800


def test_sums_of_all_runs_at_once():
    """Runs of k-means share the products of matrices; each gets what it would get by itself."""
    rng = np.random.default_rng(3)
    x, runs = rng.normal(size=(2 * cluster.SLICE + 7, 5)), [rng.normal(size=(k, 5)) for k in (2, 3, 3, 6)]
    edges = np.cumsum([0, *map(len, runs)])
    cost, size, total = cluster._sums(x, np.vstack(runs), edges)
    for r, centres in enumerate(runs):
        square = ((x[:, None] - centres) ** 2).sum(axis=2)
        near = square.argmin(axis=1)
        assert cost[r] == pytest.approx(square.min(axis=1).sum())
        for k in range(len(centres)):
            assert size[edges[r] + k] == (near == k).sum()
            assert total[edges[r] + k] == pytest.approx(x[near == k].sum(axis=0))


def test_sums_of_few_and_many_tasks(spark):
    """Sums of the tasks are the same whether the driver or a shuffle adds them up."""
    frame = spark.range(0, 300, 1, 5).select(F.array(*[(F.xxhash64("id", F.lit(i)) % 100 / 9.0) for i in range(3)]).alias("v"))
    centres = {0: np.eye(3)[:2], 4: np.eye(3) * 2}
    few, many = (cluster._moved(frame, centres, f) for f in (True, False))
    assert few.keys() == many.keys() == centres.keys()
    for r in centres:
        assert few[r][0].sum() == 300 and len(few[r][1]) == len(centres[r])
        for a, b in zip(few[r], many[r]):
            assert np.allclose(a, b)


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_boosting_learns_from_one_row_for_equal_ones(spark, problem):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 12, 2000), rng.integers(0, 20, 2000) / 4
    y = (a + 3 * b + rng.normal(size=2000) * 2).round(1) if problem == "regression" else rng.integers(0, 2, 2000) | (a > 8)
    rows = spark.createDataFrame([(i, float(y[i]), [float(a[i]), float(b[i])]) for i in range(2000)], "id long, y double, v array<double>")
    train = staged(rows.select("id", "y", array_to_vector("v").alias("features")))
    params = {"n_estimators": 6, "learning_rate": 0.1, "max_depth": 4}
    learned, weight, bounds = learners.cells(train, 2000, None, problem)
    assert learned.count() <= 2 * 12 * 20 and learned.agg(F.sum(weight)).first()[0] == 2000
    assert bounds == [[i + 0.5 for i in range(11)], [i / 4 + 0.125 for i in range(19)]]
    model = learners.fit(problem, "boosted_trees", train, params, 2)
    plain = learners.estimator(problem, "boosted_trees", params, 2000, 2, 2, 1.0).fit(train)
    got = {r.id: r.pred for r in model.predict(train).collect()}
    want = {r.id: r.pred for r in plain.transform(train).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert np.allclose(model.importances(), plain.featureImportances.toArray())


def test_boosting_tells_quantiles_and_rare_values_apart(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=3000)
    rows = [(i, float(x[i] > 0.5), [float(x[i]), 1.0 if i < 3 else 0.0, 7.0]) for i in range(3000)]
    train = staged(spark.createDataFrame(rows, "id long, y double, v array<double>").select("id", "y", array_to_vector("v").alias("features")))
    bounds = learners.interval_bounds(train)
    assert len(bounds[0]) == learners.BINS - 1 and bounds[0] == sorted(bounds[0]) and bounds[1:] == [[0.5], []]
    model = learners.fit("classification", "boosted_leaves", train, {"n_estimators": 3}, 2)
    learners.save(model, str(tmp_path / "m"))
    again = learners.load(spark, str(tmp_path / "m"))
    assert again.bounds == bounds
    pred = lambda m: [r.pred for r in m.predict(train).orderBy("id").collect()]
    assert pred(model) == pred(again) and np.mean(np.array(pred(model)) == (x > 0.5)) > 0.97
    assert set(model.predict(train).columns) == {"id", "y", "features", "pred", "prob"}


def test_network_blocks_are_narrow_and_come_in_few(spark, monkeypatch):
    """A pass reads single precision in batches of few blocks, whatever the session says; its sums are those of plain formulas."""
    monkeypatch.setattr(learners, "BATCH_BLOCKS", 4)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, v array<double>").coalesce(1)
    blocks = learners.packed(rows.select("y", array_to_vector("v").alias("features")), 10)
    assert blocks.agg(F.sum(F.length("x"))).first()[0] == 300 * 3 * 4

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [batch.num_rows]}) for batch in batches)

    assert max(r.n for r in blocks.mapInArrow(sizes, "n long").collect()) <= 4
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "4"
    w = rng.normal(size=3 * 5 + 5 + 5 * 2 + 2)
    hidden = 1 / (1 + np.exp(-(x @ w[:15].reshape(3, 5) + w[15:20])))
    z = hidden @ w[20:30].reshape(5, 2) + w[30:]
    chance = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    off = chance - np.eye(2)[y]
    back = off @ w[20:30].reshape(5, 2).T * hidden * (1 - hidden)
    want = np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (hidden.T @ off).ravel(), off.sum(axis=0)]) / 300
    cost, slope = learners.network_cost(blocks, [3, 5, 2], w, True)
    assert cost == pytest.approx(-np.log(chance[np.arange(300), y]).mean(), rel=1e-5) and np.allclose(slope, want, atol=1e-5)


@pytest.mark.parametrize("problem", ["regression", "classification"])
def test_forest_learns_from_sums_of_draws(spark, monkeypatch, tmp_path, problem):
    """Every tree draws from all rows by Poisson's law, and the forest is like Spark's own."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 8, 6000), rng.integers(0, 6, 6000) / 2
    y = a + 2.0 * b + rng.normal(size=6000) if problem == "regression" else np.where(np.arange(6000) < 2, 2, (a + 2 * b + rng.normal(size=6000) > 7).astype(int))
    made = spark.createDataFrame([(i, float(y[i]), [float(a[i]), float(b[i])]) for i in range(6000)], "id long, y double, v array<double>")
    train = staged(made.select("id", "y", array_to_vector("v").alias("features")).repartition(3, "id"))
    monkeypatch.setattr(learners, "CHUNK_ROWS", 500)
    bounds = learners.interval_bounds(train)
    drawn = learners.drawn_cells(train, bounds, problem, range(5, 45)).toPandas()
    assert set(drawn.tree) == set(range(5, 45)) and drawn.groupby("tree").n.sum().std() > 20
    size = drawn.groupby([drawn.v.map(tuple), "tree"]).n.sum().unstack(fill_value=0)
    true = np.array([((a == v[0]) & (b * 2 == v[1])).sum() for v in size.index])
    assert np.allclose(size.mean(axis=1), true, rtol=0.15) and 0.8 < (size.var(axis=1) / true).mean() < 1.2
    if problem == "regression":
        means = drawn.assign(s=drawn.n * drawn.y).groupby(drawn.v.map(tuple))[["s", "n"]].sum()
        assert np.allclose(means.s / means.n, [y[(a == v[0]) & (b * 2 == v[1])].mean() for v in means.index], atol=0.1)
    monkeypatch.setattr(learners, "DRAWN_CELLS", 0)
    monkeypatch.setattr(learners, "DRAWN_SUMS", 1_000)  # several portions of trees
    model = learners.fit(problem, "random_forest", train, {"n_estimators": 24}, 3)
    monkeypatch.setattr(learners, "DRAWN_CELLS", 10**9)
    plain = learners.fit(problem, "random_forest", train, {"n_estimators": 24}, 3)
    assert len(model.models) == 24 and model.bounds == bounds
    assert np.allclose(model.importances(), plain.importances(), atol=0.08) and sum(model.importances()) == pytest.approx(1)
    learners.save(model, str(tmp_path / "m"))
    value = "pred" if problem == "regression" else "p"
    chance = [] if problem == "regression" else [F.get("prob", F.lit(1)).alias("p")]
    got, again, want = (m.predict(train).select("id", "pred", *chance).orderBy("id").toPandas() for m in (model, learners.load(spark, str(tmp_path / "m")), plain))
    assert got.equals(again) and np.sqrt(((got[value] - want[value]) ** 2).mean()) < (0.25 if problem == "regression" else 0.06)
    assert set(model.predict(train).columns) >= {"id", "y", "features", "pred"}


def test_forest_of_many_combinations_learns_from_rows(spark, monkeypatch):
    monkeypatch.setattr(learners, "DRAWN_CELLS", 0)
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("y"), array_to_vector(F.array((F.col("id") % 20).cast("double"), F.rand(1))).alias("features"))
    assert isinstance(learners.fit("classification", "random_forest", staged(rows), {"n_estimators": 3, "max_depth": 4}, 2), learners.Fitted)


def test_reweighted_stumps_learn_from_intervals(spark, monkeypatch, tmp_path):
    """Where there are no more values than intervals, stumps on combinations are those on all rows."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 9, 2000), rng.integers(0, 7, 2000) / 2
    y = np.clip(a // 3 + (b > 2) - rng.integers(0, 2, 2000), 0, 2)
    made = spark.createDataFrame([(i, float(y[i]), [float(a[i]), float(b[i])]) for i in range(2000)], "id long, y double, v array<double>")
    train = staged(made.select("id", "y", array_to_vector("v").alias("features")))
    learned = []
    one = learners.cells
    monkeypatch.setattr(learners, "cells", lambda *args: learned.append(one(*args)) or learned[-1])
    plain = learners.fit("classification", "ada_boost", train, {"n_estimators": 5}, 3)
    monkeypatch.setattr(learners, "MANY_ROWS", 1_000)
    model = learners.fit("classification", "ada_boost", train, {"n_estimators": 5}, 3)
    assert len(learned) == 1 and learned[0][0].count() <= 9 * 7 * 3
    assert np.allclose(model.weights, plain.weights) and np.allclose(model.importances(), plain.importances())
    learners.save(model, str(tmp_path / "m"))
    of = lambda m: m.predict(train).select("id", "pred", F.get("prob", F.lit(1)).alias("p")).orderBy("id").toPandas()
    assert np.allclose(of(model), of(plain)) and of(learners.load(spark, str(tmp_path / "m"))).equals(of(model))


@pytest.mark.parametrize("problem", ["regression", "classification"])
def test_forest_scores_each_combination_once(spark, monkeypatch, problem):
    """The plan of a prediction doesn't hold one tree inside another, and says what the trees one after the other say."""
    rows = spark.range(3_000).select("id", (F.col("id") % 7 > 3).cast("double").alias("y"), array_to_vector(F.array((F.col("id") % 7).cast("double"), F.lit(1.0))).alias("features"))
    monkeypatch.setattr(learners, "DRAWN_CELLS", 0)
    model = learners.fit(problem, "random_forest", staged(rows), {"n_estimators": 6}, 2)
    made, values = model.predict(rows), ["pred"] if problem == "regression" else ["pred", "prob"]
    assert "_p0" not in str(made._jdf.queryExecution().analyzed())
    got = made.select("id", *values).orderBy("id").collect()
    want = model._scored(learners._by_interval(rows, model.bounds)).select("id", *values).orderBy("id").collect()
    assert len(got) == 3_000 and all(np.allclose(np.hstack(list(g)), np.hstack(list(w))) for g, w in zip(got, want))


def test_vectors_are_written_only_for_many_passes(spark, reg, monkeypatch):
    """One pass doesn't need them written; what is written is read file by file without a shuffle, and goes with the last fit."""
    written, one = [], modelling.spread_out
    monkeypatch.setattr(modelling, "spread_out", lambda *args: written.append(one(*args)) or written[-1])
    p = modelling.prepare(reg, "target", "regression", REG, key="k")
    modelling.cross_predictions(p, {"linear_regression": None, "ridge": None, "constant": None}, 3)
    assert not written
    before = staging.tables()
    modelling.cross_predictions(p, {"gradient_boosting": {"n_estimators": 1}, "random_forest": SMALL}, 3)
    assert len(written) == 3 and "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(modelling, "PART_DOUBLES", 100)
    assert modelling.spread_out(spark.range(0, 400, 1, 8).select("id", F.lit(1.0).alias("y"), array_to_vector(F.array(F.lit(0.0))).alias("features"))).rdd.getNumPartitions() == 16
    assert all(id(frame) not in staging._written for frame in written[:3]) and before > 0
