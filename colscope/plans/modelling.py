"""Train, compare, tune and apply models on a table.

A table becomes a written frame of its rows with `__id` and `__y`. Each train part fits its own
preprocessor, so nothing leaks from the rows scored. All predictions of a run are one long frame
(model, fold, id, y, pred, prob), and every metric is a grouped aggregate over it.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import product
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.staging import discard, file_a_part, staged
from colscope.operators import cluster, evaluate, features, learners, sampling
from colscope.operators.smote import oversample
from colscope.operators.transforms import label_codes

MIN_ROWS = 20
SEED = 42
#: What a user's table or choice can cause; a lost executor or a full disk isn't among it, and ends the run.
USER_ERRORS = (ValueError, AnalysisException, IllegalArgumentException)


def at_once(jobs: Iterable[Callable]) -> list:
    """Results of independent fits, run at the same time, in order. A fit is many small jobs, which leave the cluster idle."""
    with ThreadPoolExecutor(learners.AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


PART_DOUBLES = 2**20  # numbers of vectors in a part, of which a learner holds several times as much


def spread_out(rows: DataFrame, slots: int | None = None) -> DataFrame:
    """A written table in as many parts at least as there are cores, as fits go over it again and again, and in more where a
    part would grow with the table: what a task holds doesn't. A part is a file of bounded size, read by itself, so no pass
    shuffles the table. `slots`: numbers of a vector, looked up unless given."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if slots is None:
        slots = rows.agg(F.max(F.coalesce(F.size(F.unwrap_udt("features")["values"]), F.lit(1)))).first()[0]
    spread = rows.repartition(cores, "id") if rows.rdd.getNumPartitions() < cores else rows
    each = max(1, PART_DOUBLES // ((slots or 1) + 2))
    return staged(spread, file_a_part(spark), maxRecordsPerFile=str(each))


@dataclass
class Prepared:
    rows: DataFrame  # the table's columns, `__id`, `__y`
    problem: str
    groups: dict[str, list[str]]
    labels: list[str]  # class names in code order, empty for regression
    target: str = ""

    @property
    def classes(self) -> int:
        return len(self.labels)


def prepare(df: DataFrame, target: str, problem: str, classes: dict[str, str], advice: dict[str, dict] | None = None,
            choices: dict[str, dict] | None = None, key: str | None = None) -> Prepared:
    """Rows with a usable target; classes are coded alphabetically, other targets read as numbers."""
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    row_id = C.col(key).cast("long") if key else F.monotonically_increasing_id()
    work = C.nan_to_null(df).filter(C.col(target).isNotNull()).withColumn("__id", row_id)
    labels: list[str] = []
    if problem == "classification":
        codes = label_codes(work, target)
        labels = [r["value"] for r in codes.orderBy("code").collect()]  # one per class
        lookup = codes.select(F.col("value").alias("__v"), F.col("code").cast("double").alias("__y"))
        work = work.join(lookup, C.as_text(work, target) == F.col("__v")).drop("__v")
    else:
        work = work.withColumn("__y", C.number(work, target)).filter("__y IS NOT NULL")
    rows = staged(work)
    if rows.count() < MIN_ROWS:
        raise ValueError(f"not enough rows with a usable target, at least {MIN_ROWS} are needed")
    groups = features.choose_columns([n for n in df.columns if n != key], classes, advice, choices, target)
    if not any(groups.values()):
        raise ValueError("no usable feature columns")
    return Prepared(rows, problem, groups, labels, target)


def vectors(pre: features.Preprocessor, rows: DataFrame) -> DataFrame:
    """(id, y, features)."""
    return features.apply_preprocessor(pre, rows).select(F.col("__id").alias("id"), F.col("__y").alias("y"), "features")


@dataclass
class Pipe:
    """A fitted preprocessor and learner, with the target it was fitted for and its class names in code order."""

    pre: features.Preprocessor
    model: object
    problem: str = ""
    target: str = ""
    labels: list[str] = field(default_factory=list)

    def predict(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        """(id, y, pred, prob) of prepared rows, or of plain rows with or without the target: `id` is then the column
        `key`, or a number given to each row; `y` is null where the target is absent or a class not seen before."""
        if not {"__id", "__y"} <= set(rows.columns):
            rows = self._numbered(rows, key)
        return self.model.predict(vectors(self.pre, rows)).drop("features")

    def _numbered(self, rows: DataFrame, key: str | None) -> DataFrame:
        if self.target not in rows.columns:
            y = F.lit(None).cast("double")
        elif self.problem == "regression":
            y = C.number(rows, self.target)
        else:
            names = F.array(*[F.lit(n) for n in self.labels]).cast("array<string>")
            place = F.array_position(names, C.as_text(rows, self.target))
            y = F.when(place > 0, (place - 1).cast("double"))
        out = C.nan_to_null(rows).withColumn("__y", y)
        # A number drawn while a row is read changes when the row is read again, so it is written first.
        return out.withColumn("__id", C.col(key).cast("long")) if key else staged(out.withColumn("__id", F.monotonically_increasing_id()))

    def importance(self, top: int = 25) -> list[tuple[str, float]]:
        return self._largest(self.model.importances(), top)

    def _largest(self, values: list[float], top: int) -> list[tuple[str, float]]:
        slots = sorted(range(len(values)), key=lambda i: abs(values[i]), reverse=True)[:top]
        return list(zip(self.pre.names(slots), [values[i] for i in slots]))

    def nomogram(self, top: int = 15) -> list[tuple[str, float]]:
        """Signed coefficients of a linear model, the first row for several classes."""
        rows = self.model.coefficients() if hasattr(self.model, "coefficients") else []
        return self._largest(rows[0], top) if rows else []

    def save(self, path: str) -> None:
        """Write the preprocessor, the learner of any kind, and what is needed to name its answers."""
        features.save(self.pre, f"{path}/preprocessor")
        facts = {"problem": self.problem, "target": self.target, "labels": self.labels}
        SparkSession.active().createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").json(f"{path}/facts")
        learners.save(self.model, f"{path}/learner")


def load(spark: SparkSession, path: str) -> Pipe:
    """What `Pipe.save` wrote."""
    facts = json.loads(spark.read.json(f"{path}/facts").first()["facts"])
    return Pipe(features.load(spark, f"{path}/preprocessor"), learners.load(spark, f"{path}/learner"), **facts)


class Part:
    """Rows to fit on and rows to score. Learners that take the rows as they are share the preprocessor and the vectors, which
    are written only for those that go over them again and again."""

    def __init__(self, fold: int, train: DataFrame, test: DataFrame):
        self.fold, self.train, self.test = fold, train, test
        self._lock, self._fitted, self._written = Lock(), None, None

    def fitted(self, p: Prepared) -> features.Preprocessor:
        with self._lock:
            if self._fitted is None:
                self._fitted = features.fit_preprocessor(self.train, p.groups)
            return self._fitted

    def made(self, p: Prepared) -> tuple[features.Preprocessor, DataFrame]:
        pre = self.fitted(p)
        with self._lock:
            if self._written is None:
                self._written = spread_out(vectors(pre, self.train), slots(pre))
            return pre, self._written

    def done(self) -> None:
        """The vectors go; they are made again where needed."""
        with self._lock:
            if self._written is not None:
                discard(self._written)
                self._written = None


def slots(pre: features.Preprocessor) -> int:
    """Numbers that a vector holds."""
    return pre.size if pre.size <= features.DENSE else len(pre.scales) + len(pre.hot) + len(pre.ordered)


def fit_pipe(p: Prepared, train: DataFrame, name: str, params: dict | None = None, imbalance: str = "none", part: Part | None = None) -> Pipe:
    if imbalance == "none" or (imbalance == "class_weight" and name not in WEIGHTED):
        part = part or Part(0, train, train)
        pre = part.fitted(p)
        model = learners.fit(p.problem, name, vectors(pre, train), params, p.classes, spread=lambda: part.made(p)[1])
        return Pipe(pre, model, p.problem, p.target, p.labels)
    pre = features.fit_preprocessor(train, p.groups)
    frame = vectors(pre, train)
    weight = None
    if imbalance == "smote" and p.problem == "classification":
        frame = oversample(frame).withColumn("id", F.monotonically_increasing_id())
    elif imbalance == "class_weight" and p.problem == "classification" and name in WEIGHTED:
        counts = frame.groupBy("y").agg(F.count("*").alias("_n"))
        total, k = counts.agg(F.sum("_n")).scalar(), counts.agg(F.count("*")).scalar()
        frame = frame.join(counts.select("y", (total / (k * F.col("_n"))).alias("weight")), "y")
        weight = "weight"
    frame = spread_out(frame)
    return Pipe(pre, learners.fit(p.problem, name, frame, params, p.classes, weight), p.problem, p.target, p.labels)


# Fixed value: learners that take class weights.
WEIGHTED = {"logistic_regression", "random_forest", "decision_tree", "linear_svm", "boosted_leaves"}


def metrics(pred: DataFrame, p: Prepared, by: list[str] | None = None) -> DataFrame:
    """All metrics of the problem, one row per model."""
    by = by or []
    if p.problem == "regression":
        return evaluate.regression_metrics(pred, by)
    base = evaluate.classification_metrics(pred, by)
    if p.classes == 2:
        auc = evaluate.roc_auc(pred.withColumn("score", F.get("prob", F.lit(1))), by)
    else:
        auc = evaluate.roc_auc_multiclass(pred, p.classes, by)
    loss = evaluate.log_loss(pred, by)
    if by:
        return base.join(auc, by, "left").join(loss, by, "left")
    return base.select("*", auc.select("roc_auc").scalar().alias("roc_auc"), loss.select("logloss").scalar().alias("logloss"))


@dataclass
class Run:
    """Outcome of a training run; `error` says why when it is not ok."""

    ok: bool
    error: str | None = None
    name: str = ""
    metrics: dict = field(default_factory=dict)
    predictions: DataFrame | None = None
    confusion: DataFrame | None = None
    importance: list[tuple[str, float]] = field(default_factory=list)
    cv: DataFrame | None = None
    labels: list[str] = field(default_factory=list)
    pipe: Pipe | None = None
    train_time: float = 0.0
    n_train: int = 0
    n_test: int = 0


def _strata(p: Prepared, wanted: bool = True) -> str | None:
    """Stratify by class when every class has two rows."""
    if p.problem != "classification" or not wanted:
        return None
    least = p.rows.groupBy("__y").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    return "__y" if least >= 2 else None


def train(df: DataFrame, target: str, problem: str, name: str, classes: dict[str, str], params: dict | None = None,
          options: dict | None = None, advice: dict | None = None, choices: dict | None = None, key: str | None = None) -> Run:
    """Fit on a train part and score the rest.

    Options: test_size 0.2, stratify True, cv_folds 0, imbalance none, smote or class_weight, seed 42.
    """
    opt = {"test_size": 0.2, "stratify": True, "cv_folds": 0, "imbalance": "none", "seed": SEED, **(options or {})}
    try:
        p = prepare(df, target, problem, classes, advice, choices, key)
        parts = staged(sampling.with_split(p.rows, opt["test_size"], "__id", _strata(p, opt["stratify"]), opt["seed"], "__test"))
        return _train(p, parts, name, params, opt)
    except USER_ERRORS as error:
        return Run(False, str(error), name)


def _train(p: Prepared, parts: DataFrame, name: str, params: dict | None, opt: dict) -> Run:
    start = time.time()
    pipe = fit_pipe(p, parts.filter(~F.col("__test")), name, params, opt["imbalance"])
    spent = time.time() - start
    pred = staged(pipe.predict(parts.filter("__test")))
    sizes = parts.agg(F.count_if(~F.col("__test")), F.count_if("__test")).first()
    cv = None
    if opt["cv_folds"] and opt["cv_folds"] >= 2:
        cv = evaluate.fold_scores(cross_predictions(p, {name: params}, opt["cv_folds"], imbalance=opt["imbalance"]), p.problem)
    return Run(True, None, name, metrics(pred, p).first().asDict(), pred,
               evaluate.confusion(pred) if p.problem == "classification" else None, pipe.importance(), cv, p.labels, pipe,
               round(spent, 3), sizes[0], sizes[1])


def fold_parts(p: Prepared, k: int = 5, seed: int = SEED) -> list[Part]:
    rows = staged(sampling.with_folds(p.rows, k, "__id", _strata(p), seed, "__fold"))
    return [Part(f, rows.filter(F.col("__fold") != f), rows.filter(F.col("__fold") == f)) for f in range(k)]


def split_parts(p: Prepared, repeats: int = 3, test_share: float = 0.3, stratified: bool = True, seed: int = SEED) -> list[Part]:
    """Repeated random splits."""
    strata = _strata(p, stratified)
    splits = [staged(sampling.with_split(p.rows, test_share, "__id", strata, seed + r, "__test")) for r in range(repeats)]
    return [Part(r, split.filter(~F.col("__test")), split.filter("__test")) for r, split in enumerate(splits)]


def cross_predictions(p: Prepared, models: dict[str, dict | None], k: int = 5, seed: int = SEED,
                      imbalance: str = "none") -> DataFrame:
    """(model, fold, id, y, pred, prob): every row scored once per model by a fit on the other folds."""
    return _scored_once(p, models, fold_parts(p, k, seed), imbalance)


def repeated_predictions(p: Prepared, models: dict[str, dict | None], repeats: int = 3, test_share: float = 0.3,
                         stratified: bool = True, seed: int = SEED) -> DataFrame:
    """The same over repeated random splits; `fold` is the repeat."""
    return _scored_once(p, models, split_parts(p, repeats, test_share, stratified, seed))


def train_predictions(p: Prepared, models: dict[str, dict | None]) -> DataFrame:
    """The same on the train rows themselves."""
    return _scored_once(p, models, [Part(0, p.rows, p.rows)])


def _scored_once(p: Prepared, models, parts: list[Part], imbalance: str = "none") -> DataFrame:
    pred = _scored(p, models, parts, imbalance)
    for part in parts:
        part.done()
    return pred


def _scored(p: Prepared, models, parts: list[Part], imbalance: str = "none") -> DataFrame:
    def scored(name: str, params: dict | None, part: Part) -> DataFrame:
        pred = fit_pipe(p, part.train, name, params, imbalance, part).predict(part.test)
        return pred.select(F.lit(name).alias("model"), F.lit(part.fold).alias("fold"), "id", "y", "pred",
                           *(["prob"] if p.problem == "classification" else []))

    made = at_once([partial(scored, name, params, part) for name, params in models.items() for part in parts])
    return staged(reduce(DataFrame.unionByName, made))


# --- leave one out, in closed form ---------------------------------------------------------------------------


def leave_one_out(p: Prepared, name: str, params: dict | None = None) -> DataFrame:
    """(model, fold, id, y, pred[, prob]) where each row is scored by a fit on all others.

    The constant drops the row from the sums; linear and ridge regression use the leverage of the row;
    nearest neighbours skip the row. Scaling is learned once from all rows.
    """
    params = {**learners.defaults(p.problem, name), **(params or {})}
    pre = features.fit_preprocessor(p.rows, p.groups)
    frame = staged(vectors(pre, p.rows))
    if name == "constant":
        out = _constant_without(frame, p)
    elif name == "nearest_neighbours":
        out = learners.fit(p.problem, name, frame, params, p.classes).predict(frame, exclude_self=True).drop("features")
    elif name in ("linear_regression", "ridge"):
        out = _linear_without(frame, float(params.get("alpha", 0.0)))
    else:
        raise ValueError(f"no closed form of leave-one-out for {name}")
    return out.withColumns({"model": F.lit(name), "fold": F.lit(0)})


def _constant_without(frame: DataFrame, p: Prepared) -> DataFrame:
    rows = frame.select("id", "y")
    if p.problem == "regression":
        sums = rows.agg(F.struct(F.sum("y").alias("s"), F.count("*").alias("n"))).scalar()
        return rows.withColumn("_t", sums).withColumn("pred", (F.col("_t.s") - F.col("y")) / (F.col("_t.n") - 1)).drop("_t")
    counts = rows.agg(F.array(*[F.count_if(F.col("y") == c) for c in range(p.classes)])).scalar()
    total = rows.agg(F.count("*")).scalar()
    share = F.transform(F.col("_c"), lambda n, i: (n - F.when(i == F.col("y"), 1).otherwise(0)) / (F.col("_t") - 1))
    best = (F.array_position("prob", F.array_max("prob")) - 1).cast("double")
    return rows.withColumns({"_c": counts, "_t": total}).withColumn("prob", share).withColumn("pred", best).drop("_c", "_t")


def _linear_without(frame: DataFrame, alpha: float) -> DataFrame:
    """Residual divided by one minus the leverage. Sums of products are added up per partition."""
    rows = frame.select("id", "y", vector_to_array("features").alias("v"))

    def products(batches):
        total = None
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["v"].to_numpy()), pdf["y"].to_numpy()])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    # One number per pair of features.
    sums = rows.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    size = int(sums["i"].max()) + 1
    gram = np.zeros((size, size))
    gram[sums["i"], sums["j"]] = sums["s"]
    n = gram[0, 0]
    # Centred, so that the intercept carries no penalty.
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    inverse = np.linalg.pinv(centred[:-1, :-1] + alpha * np.eye(size - 2))
    beta = inverse @ centred[:-1, -1]

    @F.pandas_udf("double")
    def without(v: pd.Series, y: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) - mean[:-1]
        leverage = 1 / n + ((x @ inverse) * x).sum(axis=1)
        residual = y.to_numpy() - mean[-1] - x @ beta
        return y - residual / (1 - leverage)

    return rows.select("id", "y", without("v", "y").alias("pred"))


# --- many learners -------------------------------------------------------------------------------------------


def leaderboard(df: DataFrame, target: str, problem: str, classes: dict[str, str], names: list[str] | None = None,
                params: dict[str, dict] | None = None, **kwargs) -> DataFrame:
    """Every learner on one split, best first by accuracy or R²; failures last with their error."""
    names = names or learners.list_learners(problem)
    main, shown = ("accuracy", ["accuracy", "f1_weighted", "roc_auc"]) if problem == "classification" else ("r2", ["r2", "rmse", "mae"])
    options = {"test_size": 0.2, "stratify": True, "cv_folds": 0, "imbalance": "none", "seed": SEED, **kwargs.pop("options", {})}
    p = prepare(df, target, problem, classes, **kwargs)
    parts = staged(sampling.with_split(p.rows, options["test_size"], "__id", _strata(p, options["stratify"]), options["seed"], "__test"))

    def row(name: str) -> tuple:
        try:
            run = _train(p, parts, name, (params or {}).get(name), options)
            return (name, True, *[run.metrics[m] for m in shown], run.train_time, None)
        except USER_ERRORS as error:
            return (name, False, *[None for _ in shown], None, str(error))

    rows = at_once([partial(row, name) for name in names])
    schema = "model string, ok boolean, " + ", ".join(f"{m} double" for m in shown) + ", train_seconds double, error string"
    board = df.sparkSession.createDataFrame(rows, schema)
    return board.select("model", "ok", *[C.round_to(m, 4).alias(m) for m in shown], "train_seconds", "error").orderBy(
        F.desc("ok"), F.desc_nulls_last(main), "model")


@dataclass
class Scores:
    """Outcome of comparing learners under one sampling scheme."""

    predictions: DataFrame
    metrics: DataFrame
    folds: DataFrame | None
    comparison: DataFrame | None
    fitted: dict[str, Pipe]
    errors: dict[str, str]
    labels: list[str]
    prepared: Prepared


def test_and_score(df: DataFrame, target: str, problem: str, models: dict[str, dict | None], classes: dict[str, str],
                   sampling_scheme: dict | None = None, refit: bool = True, **kwargs) -> Scores:
    """Schemes: cross_validation (k), random_sampling (repeats, test_pct, stratified), leave_one_out, test_on_train."""
    if not models:
        raise ValueError("select at least one model")
    scheme = {"method": "cross_validation", **(sampling_scheme or {})}
    method = scheme["method"]
    p = prepare(df, target, problem, classes, **kwargs)
    parts, fitted, errors = [], {}, {}
    drawn: list[Part] | None = None  # once for all learners
    for name, params in models.items():
        try:
            if method == "leave_one_out":
                pred = staged(leave_one_out(p, name, params))
            elif method in ("cross_validation", "random_sampling", "test_on_train"):
                if drawn is None and method == "cross_validation":
                    drawn = fold_parts(p, int(scheme.get("k", 5)))
                elif drawn is None and method == "random_sampling":
                    drawn = split_parts(p, int(scheme.get("repeats", 3)), float(scheme.get("test_pct", 0.3)), bool(scheme.get("stratified", True)))
                elif drawn is None:
                    drawn = [Part(0, p.rows, p.rows)]
                pred = _scored(p, {name: params}, drawn)
            else:
                raise ValueError(f"unknown sampling method {method}")
            parts.append(pred)
            if refit:
                fitted[name] = fit_pipe(p, p.rows, name, params)
        except USER_ERRORS as error:
            errors[name] = str(error)
    for part in drawn or []:
        part.done()
    if not parts:
        raise ValueError("; ".join(f"{n}: {e}" for n, e in errors.items()))
    pred = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folds = evaluate.fold_scores(pred, problem) if method == "cross_validation" else None
    comparison = evaluate.pairwise_comparison(folds) if folds is not None and len(parts) >= 2 else None
    return Scores(pred, metrics(pred, p, ["model"]), folds, comparison, fitted, errors, p.labels, p)


def tune(df: DataFrame, target: str, problem: str, name: str, classes: dict[str, str], n_iter: int = 20, cv: int = 5,
         seed: int = SEED, grid: dict[str, list] | None = None, **kwargs) -> DataFrame:
    """(params, score, std) of random draws from the learner's grid, best first by mean fold score."""
    grid = grid or learners.GRIDS.get(problem, {}).get(name)
    if not grid:
        raise ValueError(f"{name} has no tunable parameters")
    p = prepare(df, target, problem, classes, **kwargs)
    cells = [dict(zip(grid, values)) for values in product(*grid.values())]
    drawn = random.Random(seed).sample(cells, min(n_iter, len(cells)))
    rows, parts = [], fold_parts(p, cv, seed)
    for params in drawn:
        summary = evaluate.fold_summary(evaluate.fold_scores(_scored(p, {name: params}, parts), problem)).first()
        rows.append(({k: str(v) for k, v in params.items()}, summary["cv_mean"], summary["cv_std"]))
    made = df.sparkSession.createDataFrame(rows, "params map<string,string>, score double, std double")
    return made.orderBy(F.desc("score"))


def predictions_table(p: Prepared, fitted: dict[str, Pipe], rows: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(id, model, actual, predicted, class, probability | error): long, over all rows or new ones.

    Classes give one row per class with its probability; numbers give one row with the error. New rows may lack the
    target; `actual` is then null.
    """
    rows = p.rows if rows is None else rows
    parts = []
    for name, pipe in fitted.items():
        pred = pipe.predict(rows, key).withColumn("model", F.lit(name))
        if p.problem == "classification":
            names = F.array(*[F.lit(n) for n in p.labels])
            each = pred.select("id", "model", F.get(names, F.col("y").cast("int")).alias("actual"),
                               F.get(names, F.col("pred").cast("int")).alias("predicted"), F.posexplode("prob").alias("_c", "_p"))
            parts.append(each.select("id", "model", "actual", "predicted", F.get(names, "_c").alias("class"),
                                     C.round_to("_p", 3).alias("probability")))
        else:
            parts.append(pred.select("id", "model", F.col("y").alias("actual"), C.round_to("pred", 4).alias("predicted"),
                                     C.round_to(F.col("y") - F.col("pred"), 4).alias("error")))
    return reduce(DataFrame.unionByName, parts)


def wide_predictions(table: DataFrame, models: list[str]) -> DataFrame:
    """One row per id with a predicted column per model."""
    rows = table.select("id", "actual", "model", "predicted").distinct()
    return rows.groupBy("id", "actual").pivot("model", models).agg(F.first("predicted"))


# --- clusters ------------------------------------------------------------------------------------------------


@dataclass
class Clusters:
    rows: DataFrame  # (id, features, cluster)
    sizes: DataFrame
    silhouette: DataFrame
    coordinates: DataFrame
    elbow: DataFrame | None


def find_clusters(df: DataFrame, classes: dict[str, str], name: str = "k_means", params: dict | None = None,
                  advice: dict | None = None, choices: dict | None = None, key: str | None = None, with_elbow: bool = True) -> Clusters:
    """Preprocess, cluster, score the separation and project to two dimensions."""
    params = {**learners.defaults("clustering", name), **(params or {})}
    row_id = C.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = staged(C.nan_to_null(df).withColumn("__id", row_id).withColumn("__y", F.lit(0.0)))
    groups = features.choose_columns([n for n in df.columns if n != key], classes, advice, choices)
    frame = staged(vectors(features.fit_preprocessor(rows, groups), rows).drop("y"))
    if name == "k_means":
        made = cluster.k_means(frame, int(params["n_clusters"]), int(params["n_init"]))
    elif name == "hierarchical":
        made = cluster.hierarchical(frame, int(params["n_clusters"]))
    else:
        made = cluster.dbscan(frame, float(params["eps"]), int(params["min_samples"]))
    made = staged(made)
    return Clusters(made, cluster.cluster_sizes(made), cluster.silhouette_squared(made), cluster.projection(made),
                    cluster.elbow(frame, int(params["n_init"])) if name == "k_means" and with_elbow else None)
