"""Learners by name, over frames of `y`, `features` and an `id`.

Every learner is fitted by `fit` and gives a model whose `predict` adds `pred`, and `prob` for classes.
Most are learners of pyspark.ml. Nearest neighbours, boosting by reweighting, the constant baseline and
calibrated margins are built here from frame operations.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.running import running_totals
from colscope.functions.staging import discard, own_session, shared_folder, staged
from colscope.operators.neighbours import k_nearest

SEED = 42
DEEPEST = 30  # the deepest tree Spark grows
STAGE_EVERY = 10  # reweighting rounds between written tables
TREE_MB = 512  # the same for one tree
FOREST_MB = 1024  # of histograms in a task, so that a level of many trees takes few passes
DRAWN = 2**28  # draws of rows for trees that a forest keeps at once
DRAWN_CELLS = 2**24  # draws from which a forest's trees learn from sums of what is drawn, where rows share few combinations of intervals
DRAWN_SUMS = 2**22  # sums for combinations and trees that a task holds at once
CHUNK_ROWS = 2**18  # rows that draws are made for at once
AT_ONCE = 8  # models fitted at the same time
ALIKE = 8  # rows a distinct vector from which these are learned from in their place
ALIKE_CELLS = 2  # the same for boosting, which goes over the rows thousands of times
BINS = 32  # intervals of a feature that Spark's trees tell apart
MANY_ROWS = 2**17  # rows beyond which reweighted stumps learn from intervals
MOST_BINNED = 256  # slots of a vector up to which rows are looked at by intervals
PART_NUMBERS = 2**20  # numbers of intervals in a part at most
CELL_NUMBERS = 2**17  # numbers of distinct vectors in a part: boosting is thousands of jobs, of few tasks where there are few
ITERATIONS = 50  # of the linear separator, unless `max_iter` says otherwise
BLOCK_NUMBERS = 2**16  # numbers of a network's widest layer for one block of rows, which stay in a core's cache
BATCH_BLOCKS = 64  # blocks that a task is given at once
SUMMED = 2**21  # numbers of all tasks' gradients that are added up on the driver

# Learners, their defaults and their search grids.
DEFAULTS: dict[str, dict[str, dict]] = {
    "classification": {
        "logistic_regression": {"C": 1.0, "max_iter": 1000},
        "random_forest": {"n_estimators": 200, "max_depth": 0, "min_samples_split": 2},
        "boosted_trees": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6},
        "boosted_leaves": {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31},
        "decision_tree": {"max_depth": 0, "min_samples_split": 2, "criterion": "gini"},
        "nearest_neighbours": {"n_neighbors": 5, "weights": "uniform"},
        "linear_svm": {"C": 1.0},
        "naive_bayes": {},
        "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
        "ada_boost": {"n_estimators": 50, "learning_rate": 1.0},
        "neural_network": {"hidden_layer_sizes": "100", "max_iter": 300},
        "constant": {},
    },
    "regression": {
        "linear_regression": {},
        "ridge": {"alpha": 1.0},
        "random_forest": {"n_estimators": 200, "max_depth": 0, "min_samples_split": 2},
        "boosted_trees": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 6},
        "decision_tree": {"max_depth": 0, "min_samples_split": 2},
        "nearest_neighbours": {"n_neighbors": 5, "weights": "uniform"},
        "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
        "ada_boost": {"n_estimators": 50, "learning_rate": 1.0},
        "constant": {},
    },
    "clustering": {
        "k_means": {"n_clusters": 4, "n_init": 10},
        "dbscan": {"eps": 0.5, "min_samples": 5},
        "hierarchical": {"n_clusters": 4},
    },
}
_FOREST = {"n_estimators": [100, 200, 300, 500], "max_depth": [0, 5, 10, 20], "min_samples_split": [2, 5, 10]}
_BOOSTED = {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2], "max_depth": [3, 5, 7, 9]}
_TREE = {"max_depth": [0, 5, 10, 20], "min_samples_split": [2, 5, 10]}
_NEIGHBOURS = {"n_neighbors": [3, 5, 7, 11, 15], "weights": ["uniform", "distance"]}
_GRADIENT = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [2, 3, 5]}
_ADA = {"n_estimators": [50, 100, 200], "learning_rate": [0.5, 1.0]}
GRIDS: dict[str, dict[str, dict[str, list]]] = {
    "classification": {
        "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [500, 1000, 2000]},
        "random_forest": _FOREST,
        "boosted_trees": _BOOSTED,
        "boosted_leaves": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1], "num_leaves": [15, 31, 63]},
        "decision_tree": _TREE,
        "nearest_neighbours": _NEIGHBOURS,
        "linear_svm": {"C": [0.1, 1.0, 10.0]},
        "gradient_boosting": _GRADIENT,
        "ada_boost": _ADA,
        "neural_network": {"hidden_layer_sizes": ["50", "100", "100,50", "100,100"]},
    },
    "regression": {
        "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
        "random_forest": _FOREST,
        "boosted_trees": _BOOSTED,
        "decision_tree": _TREE,
        "nearest_neighbours": _NEIGHBOURS,
        "gradient_boosting": _GRADIENT,
        "ada_boost": _ADA,
    },
}


def list_learners(problem: str) -> list[str]:
    return list(DEFAULTS[problem])


def defaults(problem: str, name: str) -> dict:
    if name not in DEFAULTS.get(problem, {}):
        raise ValueError(f"unknown learner {name} for {problem}")
    return dict(DEFAULTS[problem][name])


def depth(params: dict) -> int:
    """Zero or less means no limit, which is the deepest tree Spark grows."""
    d = int(params.get("max_depth", 0))
    return DEEPEST if d <= 0 else min(d, DEEPEST)


def hidden_layers(spec) -> list[int]:
    """'100,50' to [100, 50]."""
    parts = [int(x) for x in str(spec).replace(" ", "").split(",") if x.isdigit()]
    return parts or [100]


def leaf_size(params: dict) -> int:
    """A node splits only with `min_samples_split` rows, so its smaller child has at least one and Spark's
    nearest control is a least leaf of half that."""
    return max(1, int(params.get("min_samples_split", 2)) // 2)


@dataclass
class Fitted:
    """A fitted pyspark.ml model."""

    problem: str
    model: object
    classes: int = 0
    bounds: list[list[float]] | None = None  # of each slot, where the model knows values by their interval

    def predict(self, df: DataFrame) -> DataFrame:
        out = _plain(self.model.transform(_by_interval(df, self.bounds)), self.bounds)
        if self.problem == "regression":
            return out
        if "probability" in out.columns:
            return out.withColumn("prob", vector_to_array("probability")).drop("probability", "rawPrediction")
        # One-against-rest keeps margins only; each becomes a chance and the chances are scaled to one.
        chances = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(chances, F.lit(0.0), lambda a, b: a + b)
        return out.withColumn("prob", F.transform(chances, lambda p: p / total)).drop("rawPrediction")

    def importances(self) -> list[float]:
        """One number per feature: tree importances, or the mean size of the coefficients."""
        m = self.model
        if hasattr(m, "featureImportances"):
            return m.featureImportances.toArray().tolist()
        if hasattr(m, "models") and hasattr(m.models[0], "featureImportances"):
            per_class = [x.featureImportances.toArray() for x in m.models]
            return (sum(per_class) / len(per_class)).tolist()
        rows = self.coefficients()
        return [sum(abs(r[i]) for r in rows) / len(rows) for i in range(len(rows[0]))] if rows else []

    def coefficients(self) -> list[list[float]]:
        """Signed coefficients, one row for a number or two classes, else one row per class."""
        m = self.model
        if isinstance(m, mc.LogisticRegressionModel):
            return m.coefficientMatrix.toArray().tolist()
        return [m.coefficients.toArray().tolist()] if hasattr(m, "coefficients") else []


def _by_interval(df: DataFrame, bounds: list[list[float]] | None) -> DataFrame:
    """Vectors of interval numbers in place of the values, which `_plain` brings back."""
    if bounds is None:
        return df
    return df.withColumn("_plain", F.col("features")).withColumn("features", array_to_vector(interval_numbers(bounds)("features")))


def _plain(df: DataFrame, bounds: list[list[float]] | None) -> DataFrame:
    return df if bounds is None else df.withColumn("features", F.col("_plain")).drop("_plain")


@dataclass
class Constant:
    """Class shares, or the mean."""

    problem: str
    value: list[float] | float

    def predict(self, df: DataFrame) -> DataFrame:
        if self.problem == "regression":
            return df.withColumn("pred", F.lit(self.value))
        best = max(range(len(self.value)), key=lambda i: self.value[i])
        return df.withColumn("pred", F.lit(float(best))).withColumn("prob", F.array(*[F.lit(p) for p in self.value]))

    def importances(self) -> list[float]:
        return []


@dataclass
class Neighbours:
    """The train rows themselves; a query looks up its nearest."""

    problem: str
    train: DataFrame
    k: int
    weights: str
    classes: int = 0

    def predict(self, df: DataFrame, exclude_self: bool = False) -> DataFrame:
        vectors = lambda d: d.select("id", vector_to_array("features").alias("v"))
        found = k_nearest(vectors(self.train), vectors(df), self.k, exclude_self)
        y = self.train.select(F.col("id").alias("neighbour"), F.col("y").alias("_y"))
        near = found.join(y, "neighbour")
        if self.weights == "distance":
            # Rows at no distance decide alone.
            touching = F.max(F.col("distance") == 0).over(_per_id())
            w = F.when(touching, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        else:
            w = F.lit(1.0)
        near = near.withColumn("_w", w)
        if self.problem == "regression":
            votes = near.groupBy("id").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("pred"))
            return df.join(votes, "id")
        shares = near.groupBy("id").agg(
            F.array(*[F.sum(F.when(F.col("_y") == c, F.col("_w")).otherwise(0.0)) / F.sum("_w") for c in range(self.classes)])
            .alias("prob"))
        return df.join(shares, "id").withColumn("pred", _best_class())

    def importances(self) -> list[float]:
        return []


def _per_id():
    from pyspark.sql import Window

    return Window.partitionBy("id")


def _best_class() -> Column:
    """Index of the greatest entry of `prob`, the first on ties."""
    return (F.array_position("prob", F.array_max("prob")) - 1).cast("double")


@dataclass
class Calibrated:
    """Margins of a linear separator, with chances from a logistic fit on the margins."""

    margins: object
    chances: mc.LogisticRegressionModel

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.margins.transform(df)
        scored = self.chances.transform(out)
        return scored.withColumn("prob", vector_to_array("chance")).drop("chance", "rawPrediction", "guess", "raw")

    def importances(self) -> list[float]:
        models = getattr(self.margins, "models", [self.margins])
        rows = [m.coefficients.toArray() for m in models]
        return (sum(abs(r) for r in rows) / len(rows)).tolist()


@dataclass
class Ensemble:
    """Weighted trees from reweighting rounds."""

    problem: str
    classes: int
    models: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bounds: list[list[float]] | None = None  # of each slot, where the trees know values by their interval

    def predict(self, df: DataFrame) -> DataFrame:
        return _plain(self._scored(_by_interval(df, self.bounds)), self.bounds)

    def _scored(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            extra = {"rawPrediction", "probability"} & set(m.transform(df.limit(0)).columns) - set(df.columns)
            out = m.transform(out).withColumnRenamed("pred", f"_p{i}").drop(*extra)
        made = [f"_p{i}" for i in range(len(self.models))]
        if self.problem == "classification":
            # A round adds its weight to its class and takes weight / (classes - 1) from the others.
            k = self.classes
            totals = [sum((F.when(F.col(p) == c, w).otherwise(-w / (k - 1)) for p, w in zip(made, self.weights)), F.lit(0.0))
                      for c in range(k)]
            score = F.transform(F.array(*totals), lambda t: F.exp(t / (sum(self.weights) or 1.0) / max(k - 1, 1)))
            whole = F.aggregate("_s", F.lit(0.0), lambda a, b: a + b)
            return (out.withColumn("_s", score).withColumn("prob", F.transform("_s", lambda s: s / whole))
                    .withColumn("pred", _best_class()).drop("_s", *made))
        # Weighted median of the rounds.
        votes = F.array_sort(F.array(*[F.struct(F.col(p).alias("p"), F.lit(w).alias("w")) for p, w in zip(made, self.weights)]))
        half = sum(self.weights) / 2
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("value"))
        median = F.aggregate(
            votes, start,
            lambda a, v: F.struct((a["seen"] + v["w"]).alias("seen"),
                                  F.when(a["value"].isNotNull(), a["value"]).when(a["seen"] + v["w"] >= half, v["p"]).alias("value")),
            lambda a: a["value"])
        return out.withColumn("pred", median).drop(*made)

    def importances(self) -> list[float]:
        """They add up to one: a round whose tree found no split has none, so the others make up the whole."""
        parts = [m.featureImportances.toArray() * w for m, w in zip(self.models, self.weights)]
        total = sum(float(p.sum()) for p in parts) or 1.0
        return (sum(parts) / total).tolist() if parts else []


@dataclass
class Forests:
    """Portions of one forest: the mean over all trees."""

    problem: str
    classes: int
    models: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # trees of each portion
    bounds: list[list[float]] | None = None  # of each slot, where the trees know values by their interval

    def predict(self, df: DataFrame) -> DataFrame:
        return self._scored(df) if self.bounds is None else self._voted(df)

    def _voted(self, df: DataFrame) -> DataFrame:
        """Each combination of intervals is scored once by every tree, beside one another rather than in one long plan."""
        keyed = df.withColumn("_v", interval_numbers(self.bounds)("features"))
        seen = staged(keyed.select("_v").distinct())
        parts = math.ceil(seen.count() * len(self.bounds) / PART_NUMBERS)
        asked = staged(seen.repartition(max(1, parts)).select("_v", array_to_vector("_v").alias("features")))
        discard(seen)
        value = F.array("pred") if self.problem == "regression" else vector_to_array("probability")
        votes = reduce(DataFrame.unionAll, [m.transform(asked).select("_v", value.alias("p"), F.lit(float(w)).alias("w")) for m, w in zip(self.models, self.weights)])
        slots = 1 if self.problem == "regression" else self.classes
        whole = votes.groupBy("_v").agg(F.array(*[F.sum(F.get("p", F.lit(c)) * F.col("w")) / F.sum("w") for c in range(slots)]).alias("prob"))
        out = keyed.join(staged(whole), "_v").drop("_v")
        if self.problem == "regression":
            return out.withColumn("pred", F.get("prob", F.lit(0))).drop("prob")
        return out.withColumn("pred", _best_class())

    def _scored(self, df: DataFrame) -> DataFrame:
        out, whole = df, sum(self.weights)
        values = "pred" if self.problem == "regression" else "probability"
        for i, m in enumerate(self.models):
            made = m.transform(out)
            value = F.col(values) if self.problem == "regression" else vector_to_array(values)
            out = made.withColumn(f"_p{i}", value).select(*out.columns, f"_p{i}")
        names = [f"_p{i}" for i in range(len(self.models))]
        if self.problem == "regression":
            return out.withColumn("pred", sum((F.col(n) * w for n, w in zip(names, self.weights)), F.lit(0.0)) / whole).drop(*names)
        chances = [sum((F.get(n, F.lit(c)) * w for n, w in zip(names, self.weights)), F.lit(0.0)) / whole for c in range(self.classes)]
        return out.withColumn("prob", F.array(*chances)).withColumn("pred", _best_class()).drop(*names)

    def importances(self) -> list[float]:
        parts = [m.featureImportances.toArray() * w for m, w in zip(self.models, self.weights)]
        total = sum(float(p.sum()) for p in parts) or 1.0
        return (sum(parts) / total).tolist()


COLUMNS = {"featuresCol": "features", "labelCol": "y", "predictionCol": "pred"}


def _cut_lineage(spark: SparkSession) -> None:
    """Let long runs of small jobs write what they have to the shared folder now and then, so that plans stay short."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


# Fixed value: learners whose trees are grown one after the other on all rows.
BOOSTED = {"boosted_trees", "boosted_leaves", "gradient_boosting"}


def _boosted(problem: str, classes: int, rounds: int, step: float, max_depth: int, weight: str | None):
    common = {"maxIter": rounds, "stepSize": step, "maxDepth": max_depth, "seed": SEED, "checkpointInterval": 10}
    w = {"weightCol": weight} if weight else {}
    if problem == "regression":
        return mr.GBTRegressor(**COLUMNS, **common, **w)
    if classes <= 2:
        return mc.GBTClassifier(**COLUMNS, **common, **w)
    one = mc.GBTClassifier(**common)
    return mc.OneVsRest(classifier=one, rawPredictionCol="rawPrediction", parallelism=AT_ONCE, **COLUMNS, **w)


def estimator(problem: str, name: str, params: dict, rows: int, features: int, classes: int, label_std: float,
              weight: str | None = None):
    """The pyspark.ml estimator of a learner."""
    w = {"weightCol": weight} if weight else {}
    if name == "logistic_regression":
        return mc.LogisticRegression(regParam=1.0 / (float(params["C"]) * rows), elasticNetParam=0.0, standardization=False,
                                     tol=1e-8, maxIter=int(params["max_iter"]), **COLUMNS, **w)
    if name == "random_forest":
        make = mc.RandomForestClassifier if problem == "classification" else mr.RandomForestRegressor
        return make(numTrees=int(params["n_estimators"]), maxDepth=depth(params), minInstancesPerNode=leaf_size(params),
                    seed=SEED, maxMemoryInMB=FOREST_MB, cacheNodeIds=True, **COLUMNS, **w)
    if name == "decision_tree":
        impurity = {"impurity": params.get("criterion", "gini")} if problem == "classification" else {}
        make = mc.DecisionTreeClassifier if problem == "classification" else mr.DecisionTreeRegressor
        return make(maxDepth=depth(params), minInstancesPerNode=leaf_size(params), seed=SEED, maxMemoryInMB=TREE_MB, **impurity,
                    **COLUMNS, **w)
    if name == "boosted_leaves":
        levels = max(1, round(math.log2(int(params["num_leaves"]) + 1)))
        return _boosted(problem, classes, int(params["n_estimators"]), float(params["learning_rate"]), levels, weight)
    if name in ("boosted_trees", "gradient_boosting"):
        return _boosted(problem, classes, int(params["n_estimators"]), float(params["learning_rate"]), depth(params), weight)
    if name == "naive_bayes":
        return mc.NaiveBayes(modelType="gaussian", **COLUMNS, **w)
    if name == "linear_regression":
        return mr.LinearRegression(regParam=0.0, solver="normal", **COLUMNS)
    if name == "ridge":
        # Spark divides the penalty by the deviation of the label.
        return mr.LinearRegression(regParam=float(params["alpha"]) * label_std / rows, elasticNetParam=0.0,
                                   standardization=False, solver="normal", **COLUMNS)
    raise ValueError(f"unknown learner {name} for {problem}")


# Fixed value: learners that take one or two passes over the rows, or none.
FEW_PASSES = {"constant", "linear_regression", "ridge", "naive_bayes", "neural_network"}


def fit(problem: str, name: str, train: DataFrame, params: dict | None = None, classes: int = 0,
        weight: str | None = None, spread: Callable[[], DataFrame] | None = None):
    """Fit a learner on (id, y, features); y holds codes 0..classes-1 or numbers. `spread` gives the same rows written in bounded
    parts, for learners that go over them again and again."""
    params = {**defaults(problem, name), **(params or {})}
    if problem == "classification" and classes < 2 and name != "constant":
        raise ValueError("at least two classes are needed")
    grouped = name == "decision_tree" and leaf_size(params) == 1
    if spread is not None and name not in FEW_PASSES and not grouped:
        train = spread()
    if name == "nearest_neighbours":
        return Neighbours(problem, train, int(params["n_neighbors"]), params["weights"], classes)
    if name == "constant":
        return _constant(problem, train, classes)
    if name == "linear_svm":
        return _svm(train, params, classes, weight)
    if name == "ada_boost":
        return (_samme if problem == "classification" else _adaboost_r2)(train, params, classes, weight)
    _cut_lineage(train.sparkSession)
    facts = train.agg(F.count("*").alias("rows"), F.stddev_pop("y").alias("std"),
                      F.max(F.size(vector_to_array("features"))).alias("features")).first()
    if name == "neural_network":
        return _network(train, [facts["features"], *hidden_layers(params["hidden_layer_sizes"]), classes], int(params["max_iter"]))
    if grouped:
        whole = train
        train, weight = alike(whole, facts["rows"], weight, problem)
        if train is whole and spread is not None:
            train = spread()
    bounds = None
    if name in BOOSTED and facts["features"] <= MOST_BINNED:
        train, weight, bounds = cells(train, facts["rows"], weight, problem)
    made = estimator(problem, name, params, facts["rows"], facts["features"], classes, facts["std"] or 1.0, weight)
    if name == "random_forest":
        draws = facts["rows"] * made.getNumTrees()
        if draws > DRAWN_CELLS and leaf_size(params) == 1 and facts["features"] <= MOST_BINNED:
            grown = _cell_forest(problem, made, train, facts["rows"], classes, weight)
            if grown is not None:
                return grown
        if draws > DRAWN:
            return _forests(problem, made, train, facts["rows"], classes)
    return Fitted(problem, made.fit(train), classes, bounds)


def _forests(problem: str, made, train: DataFrame, rows: int, classes: int) -> Forests:
    """The trees in portions grown one after the other, as all of them keep a number for every row and tree."""
    trees = made.getNumTrees()
    sizes = [len(range(i, trees, portions)) for portions in [min(trees, -(-rows * trees // DRAWN))] for i in range(portions)]
    models = [made.copy({made.numTrees: n, made.seed: SEED + i, made.featureSubsetStrategy: _subset(problem)}).fit(train)
              for i, n in enumerate(sizes)]
    return Forests(problem, classes, models, [float(n) for n in sizes])


def _cell_forest(problem: str, made, train: DataFrame, rows: int, classes: int, weight: str | None) -> Forests | None:
    """The same forest where rows share few combinations of intervals: every tree draws from all rows as before, but learns from one
    weighted row for what it drew of a combination (and class), of a number the mean. No split parts these rows, so every
    split gains the same. None where there are too many combinations."""
    bounds = interval_bounds(train)
    most = min(rows // ALIKE, DRAWN_SUMS)
    cells = combinations(train, bounds, problem, most)
    if cells > most:
        return None
    trees, at_once = made.getNumTrees(), max(1, DRAWN_SUMS // max(1, cells))
    label = {"ml_attr": {"type": "nominal", "num_vals": classes}} if problem == "classification" else {}
    models = []
    for first in range(0, trees, at_once):
        drawn = drawn_cells(train, bounds, problem, range(first, min(trees, first + at_once)), weight)

        def grown(tree: int):
            own = drawn.filter(F.col("tree") == tree).select(F.col("y").alias("y", metadata=label), array_to_vector("v").alias("features"), "n")
            return made.copy({made.numTrees: 1, made.seed: SEED + tree, made.featureSubsetStrategy: _subset(problem), made.bootstrap: False,
                              made.weightCol: "n", made.cacheNodeIds: False}).fit(own)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            models += list(pool.map(grown, range(first, min(trees, first + at_once))))
        discard(drawn)
    return Forests(problem, classes, models, [1.0] * trees, bounds)


def _combined(bounds: list[list[float]], classed: bool) -> Callable:
    """A function of batches: (bytes of the interval numbers and of the class, y, weight) of at most CHUNK_ROWS rows and a batch."""
    most = CHUNK_ROWS

    def chunks(batches):
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = batch.column("y").to_numpy(zero_copy_only=False).astype("float64")
                key = np.column_stack([np.searchsorted(b, v[:, i]).astype("uint8") for i, b in enumerate(bounds)])
                key = np.column_stack([key, y.astype("uint32").view("uint8").reshape(-1, 4)]) if classed else key
                held.append((key, y, batch.column("w").to_numpy(zero_copy_only=False)))
                count += batch.num_rows
            if count >= most:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    return chunks


def _combinations() -> Callable:
    def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows of bytes, and for each row which of them it is."""
        wide = np.zeros((len(key), -(-key.shape[1] // 8) * 8), "uint8")
        wide[:, : key.shape[1]] = key
        whole = wide.view("uint64")[:, 0] if wide.shape[1] == 8 else wide.view(np.dtype((np.void, wide.shape[1])))[:, 0]
        _, first, place = np.unique(whole, return_index=True, return_inverse=True)
        return key[first], place

    return distinct


_distinct_bytes = _combinations()  # made so that it goes to the executors itself


def _seen(train: DataFrame, weight: str | None) -> DataFrame:
    return train.select(vector_to_array("features").alias("v"), F.col("y").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


def combinations(train: DataFrame, bounds: list[list[float]], problem: str, most: int) -> int:
    """How many combinations of intervals (and classes) rows have; where that is more than `most`, some number above it."""
    chunks, distinct = _combined(bounds, problem == "classification"), _distinct_bytes

    def found(batches):
        seen: set[bytes] = set()
        for key, _, _ in chunks(batches):
            new = {k.tobytes() for k in distinct(key)[0]} - seen
            seen |= new
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(new), pa.binary())})
            if len(seen) > most:
                return

    return _seen(train, None).mapInArrow(found, "key binary").distinct().count()


def drawn_cells(train: DataFrame, bounds: list[list[float]], problem: str, trees: range, weight: str | None = None) -> DataFrame:
    """(tree, v, y, n): of every tree, what it drew of each combination of intervals (and class), of a number the mean. A row is drawn
    as often as Spark's forests draw it, by Poisson's law of mean one for each tree: that is as many draws among the rows of a
    chunk as its law of their number gives. A task holds the sums of all combinations."""
    classed, count, slots = problem == "classification", len(trees), len(bounds)
    chunks, distinct, seed = _combined(bounds, classed), _distinct_bytes, [SEED, trees.start]

    def sums(batches):
        from pyspark import TaskContext

        rng = np.random.Generator(np.random.SFC64([*seed, TaskContext.get().partitionId()]))
        places, total = {}, np.zeros((2, count, 1024))
        for key, y, w in chunks(batches):
            found, place = distinct(key)
            at = np.array([places.setdefault(k.tobytes(), len(places)) for k in found])
            while total.shape[2] < len(places):
                total = np.concatenate([total, np.zeros_like(total)], axis=2)
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            w, wy = w[order], (w * y)[order]
            for t in range(count):
                times = np.bincount(rng.integers(0, len(y), rng.poisson(len(y)), dtype="uint32"), minlength=len(y)).astype("float64")
                total[0, t, at] += np.add.reduceat(times * w, starts)
                if not classed:
                    total[1, t, at] += np.add.reduceat(times * wy, starts)
        keys = list(places)
        for i in range(0, len(keys), 256):
            part = total[:, :, i : min(i + 256, len(keys))]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[i : i + 256], pa.binary()), "n": pa.array(list(part[0].T), pa.list_(pa.float64())),
                                              "s": pa.array(list(part[1].T), pa.list_(pa.float64()))})

    def added(batches):
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            n, s = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("n", "s"))
            for i, key in enumerate(batch.column("key").to_pylist()):
                held[key] = held[key] + np.stack([n[i], s[i]]) if key in held else np.stack([n[i], s[i]])
        if held:
            raw = np.frombuffer(b"".join(held), "uint8").reshape(len(held), -1)
            n, s = np.stack(list(held.values()), axis=1)
            v = raw[:, :slots].astype("float64")
            y = np.ascontiguousarray(raw[:, slots:]).view("uint32")[:, 0].astype("float64") if classed else None
            for t in range(count):
                some = np.flatnonzero(n[:, t] > 0)
                mean = y[some] if classed else s[some, t] / n[some, t]
                yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(some), trees[t]), pa.int32()), "v": pa.array(list(v[some]), pa.list_(pa.float64())),
                                                  "y": mean, "n": n[some, t]})

    spark = train.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = _seen(train, weight).coalesce(cores).mapInArrow(sums, "key binary, n array<double>, s array<double>")
    whole = parts.repartition(cores, "key").mapInArrow(added, "tree int, v array<double>, y double, n double")
    return staged(whole.repartition("tree").sortWithinPartitions("tree", "v", "y"), folders="tree")


def _subset(problem: str) -> str:
    """What Spark takes for several trees; for a single one it would take all features."""
    return "sqrt" if problem == "classification" else "onethird"


def alike(train: DataFrame, rows: int, weight: str | None, problem: str) -> tuple[DataFrame, str | None]:
    """Rows with equal vectors (and classes) as one weighted row, of a number the mean, where that leaves few. One tree on them
    is a tree on all rows: no split parts them, so every split gains the same."""
    each = F.col(weight).cast("double") if weight else F.lit(1.0)
    keyed = train.withColumn("_v", vector_to_array("features"))
    grouped = _grouped(keyed, each, rows // ALIKE, problem)
    if grouped is None:
        return train, weight
    spread = grouped.repartition(train.sparkSession.sparkContext.defaultParallelism, "_v").sortWithinPartitions(*_keys(problem))
    return staged(spread.select("y", array_to_vector("_v").alias("features"), "_n")), "_n"


def _keys(problem: str) -> list[str]:
    return ["_v", "y"] if problem == "classification" else ["_v"]


def _grouped(keyed: DataFrame, each: Column, most: int, problem: str) -> DataFrame | None:
    """(_v, y, _n), a row for each distinct vector (and class), unless there are more than `most`."""
    keys = _keys(problem)
    if keyed.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] > most:
        return None
    y = [] if problem == "classification" else [(F.sum(F.col("y") * each) / F.sum(each)).alias("y")]
    return keyed.groupBy(*keys).agg(F.sum(each).alias("_n"), *y)


def cells(train: DataFrame, rows: int, weight: str | None, problem: str) -> tuple[DataFrame, str, list[list[float]]]:
    """Rows as numbers of the intervals that their values are in, with the bounds of the intervals; equal ones (of equal classes)
    are one weighted row, of a number the mean, where that leaves fewer. Spark's trees see intervals of values only, so boosting
    gives such rows the same gradients in every round, and trees on the weighted rows are trees on all rows."""
    bounds = interval_bounds(train)
    each = F.col(weight).cast("double") if weight else F.lit(1.0)
    keyed = train.withColumn("_v", interval_numbers(bounds)("features"))
    grouped = _grouped(keyed, each, rows // ALIKE_CELLS, problem)
    made = staged(keyed.select("_v", "y", each.alias("_n")) if grouped is None else grouped)
    numbers, cores = made.count() * (len(bounds) + 2), train.sparkSession.sparkContext.defaultParallelism
    parts = max(min(math.ceil(numbers / CELL_NUMBERS), cores), math.ceil(numbers / PART_NUMBERS))
    spread = made.repartition(parts, "_v", "y").sortWithinPartitions("_v", "y")
    return staged(spread.select("y", array_to_vector("_v").alias("features"), "_n")), "_n", bounds


def interval_bounds(train: DataFrame) -> list[list[float]]:
    """For each slot the bounds of at most BINS intervals, in order: half-way between neighbours where there are no more values
    than that, else quantiles of all rows. A value belongs to the first interval whose bound isn't below it."""
    def values(batches):
        seen: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            seen = seen or [np.empty(0)] * v.shape[1]
            # One value more than there are intervals is enough to know that there are many.
            seen = [old if len(old) > BINS else np.unique(np.concatenate([old, v[:, i]]))[: BINS + 1] for i, old in enumerate(seen)]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(len(seen)), pa.int32()), "seen": pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))})

    rows = train.select(vector_to_array("features").alias("v"))
    few = rows.mapInArrow(values, "slot int, seen array<double>").groupBy("slot").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, BINS + 1).alias("seen"))  # BINS + 1 a task
    distinct = {r["slot"]: r["seen"] for r in few.collect()}  # a row a slot
    many = [i for i, seen in distinct.items() if len(seen) > BINS]
    bounds = {i: [(a + b) / 2 for a, b in zip(seen, seen[1:])] for i, seen in distinct.items()}
    if many:
        probs = [k / BINS for k in range(1, BINS)]
        cut = rows.agg(*[F.percentile_approx(F.get("v", F.lit(i)), probs).alias(f"s{i}") for i in many]).first()
        bounds |= {i: sorted(set(cut[f"s{i}"])) for i in many}
    return [bounds[i] for i in range(len(bounds))]


def interval_numbers(bounds: list[list[float]]) -> Callable[[str], Column]:
    """The numbers of the intervals that a vector's values belong to."""
    @F.pandas_udf("array<double>")
    def numbers(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy())
        return pd.Series(list(np.column_stack([np.searchsorted(b, x[:, i]) for i, b in enumerate(bounds)]).astype("float64")))

    return lambda name: numbers(vector_to_array(name))


def _constant(problem: str, train: DataFrame, classes: int) -> Constant:
    if problem == "regression":
        return Constant(problem, train.agg(F.avg("y")).first()[0])
    shares = train.agg(*[(F.count_if(F.col("y") == c) / F.count("*")).alias(f"c{c}") for c in range(classes)]).first()
    return Constant(problem, [shares[f"c{c}"] for c in range(classes)])


def _svm(train: DataFrame, params: dict, classes: int, weight: str | None) -> Calibrated:
    rows, rounds = train.count(), int(params.get("max_iter", ITERATIONS))
    w = {"weightCol": weight} if weight else {}
    one = mc.LinearSVC(regParam=1.0 / (float(params["C"]) * rows), maxIter=rounds, tol=1e-4)
    if classes <= 2:
        one = (one.setWeightCol(weight) if weight else one).setFeaturesCol("features").setLabelCol("y").setPredictionCol("guess")
        margins = one.fit(train)
    else:
        margins = mc.OneVsRest(classifier=one, featuresCol="features", labelCol="y", predictionCol="guess", parallelism=AT_ONCE, **w).fit(train)
    chances = mc.LogisticRegression(featuresCol="rawPrediction", labelCol="y", predictionCol="pred", probabilityCol="chance",
                                    rawPredictionCol="raw", maxIter=max(rounds, 100)).fit(margins.transform(train).select("y", "rawPrediction"))
    return Calibrated(margins, chances)


def _network(train: DataFrame, layers: list[int], rounds: int) -> Fitted:
    """Spark's perceptron with weights found by L-BFGS from Spark's own first weights, as its trainer does. Each pass is one job
    over rows packed in blocks."""
    spark_side = mc.MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=SEED, **COLUMNS)
    one = staged(train.select("y", "features").limit(1))
    first = spark_side.fit(one).weights.toArray()  # no rounds: the weights as they are drawn
    rows = packed(train, max(1, BLOCK_NUMBERS // max(layers)))
    few = rows.rdd.getNumPartitions() * len(first) <= SUMMED
    weights = minimised(lambda w: network_cost(rows, layers, w, few), first, rounds)
    discard(rows)
    fitted = spark_side.setInitialWeights(DenseVector(weights)).fit(one)
    discard(one)
    return Fitted("classification", fitted, layers[-1])


def packed(train: DataFrame, rows: int) -> DataFrame:
    """(y, x): blocks of at most so many rows, y as bytes of doubles, x of single precision with one feature after the other. They are
    read in a session of their own, whose batches hold few blocks, so that reading and the passes' sums overlap."""
    def blocks(batches):
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype("float64")
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("float32").reshape(len(y), -1)
            for i in range(0, len(y), rows):
                yield pa.RecordBatch.from_pydict({"y": [y[i : i + rows].tobytes()], "x": [x[i : i + rows].T.tobytes()]})

    frame = train.select(F.col("y").cast("double").alias("y"), vector_to_array("features").alias("v"))
    reader = own_session(train.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_BLOCKS)})
    return staged(frame.mapInArrow(blocks, "y binary, x binary"), reader, compression="uncompressed")


def network_cost(blocks: DataFrame, layers: list[int], weights: np.ndarray, few: bool = False) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a network and its gradient: one job, a row a task, which are added up by a shuffle unless they are `few`. Weights are in Spark's order: of each layer those of
    the first input to all outputs, then of the next, and the biases last."""
    def sums(batches):
        total = None
        for batch in batches:
            for y, x in zip(batch.column("y"), batch.column("x")):
                target = np.frombuffer(y.as_buffer(), "float64").astype("int64")
                part = _backward(layers, weights, np.frombuffer(x.as_buffer(), "float32").reshape(-1, len(target)), target)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"values": [total]})

    parts = blocks.mapInArrow(sums, "values array<double>")
    if few:
        values = np.sum(np.stack([part.values.to_numpy() for part in parts.toArrow()["values"]]), axis=0)
    else:
        table = parts.select(F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # a number a weight
        values = table["value"].to_numpy()[np.argsort(table["at"].to_numpy())]
    return float(values[1] / values[0]), values[2:] / values[0]


def _own_copy() -> Callable:
    """The function below, made here so that it goes to the executors itself, not by the name of a module they may not have."""
    def backward(layers: list[int], weights: np.ndarray, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Number of rows, sum of cross-entropies, and its gradient. The chances are in double precision, what lies between in
        single. A hidden node holds t = tanh(z / 2), and gives (1 + t) / 2 = 1 / (1 + exp(-z)) to the next layer; the last row
        of what a layer holds is ones, for the biases."""
        parts, at, last = [], 0, len(layers) - 2
        for width, out in zip(layers, layers[1:]):
            parts.append(weights[at : at + width * out + out].reshape(width + 1, out))
            at += width * out + out
        held = [np.ones((len(x) + 1, len(target)), "float32")]
        held[0][:-1] = x
        for i, w in enumerate(parts):
            if i:
                w = np.vstack([w[:-1] / 2, w[-1] + w[:-1].sum(axis=0) / 2])
            if i < last:
                t = np.empty((layers[i + 1] + 1, len(target)), "float32")
                np.matmul((w / 2).T.astype("float32"), held[i], out=t[:-1])
                np.tanh(t[:-1], out=t[:-1])
                t[-1] = 1
                held.append(t)
        z = (w.T.astype("float32") @ held[-1]).astype("float64")
        z -= z.max(axis=0)
        chance = np.exp(z)
        whole = chance.sum(axis=0)
        own = target, np.arange(len(target))
        cost = float((np.log(whole) - z[own]).sum())
        chance /= whole
        chance[own] -= 1
        slopes, delta = [], chance.astype("float32")
        for i in range(last, -1, -1):
            slope = held[i] @ delta.T
            if i:
                slope[:-1] = (slope[:-1] + slope[-1]) / 2
                t = held[i][:-1]
                delta = (parts[i][:-1] / 4).astype("float32") @ delta
                t *= t
                np.subtract(1, t, out=t)
                delta *= t
            slopes.append(slope.ravel())
        return np.concatenate([[len(target), cost], *slopes[::-1]])

    return backward


_backward = _own_copy()


MEMORY, LOOK_BACK, TOLERANCE = 10, 20, 1e-6  # of L-BFGS, as in Spark's trainer: corrections, values compared, and least gain
TRIES = 30  # sizes of a step


def minimised(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int) -> np.ndarray:
    """L-BFGS with steps by the Wolfe conditions. It ends after so many rounds, or when the last values gained next to nothing."""
    value, slope = cost(w)
    start, seen, steps = value, [], []
    for _ in range(rounds):
        if np.linalg.norm(slope) <= max(TOLERANCE * value, 1e-8):
            break
        way, kept = -slope, []
        for s, y in reversed(steps):
            kept.append(s @ way / (s @ y))
            way = way - kept[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            way = way + (a - y @ way / (s @ y)) * s
        low, high, size = 0.0, math.inf, 1.0 if steps else 1 / np.linalg.norm(way)
        down = slope @ way
        for _ in range(TRIES):
            new_value, new_slope = cost(w + size * way)
            if not new_value <= value + 1e-4 * size * down:
                high = size
            elif new_slope @ way < 0.9 * down:
                low = size
            else:
                break
            size = 2 * low if high == math.inf else (low + high) / 2
        else:
            if not steps:
                break
            steps = []  # begin anew along the slope
            continue
        steps = [*steps, (size * way, new_slope - slope)][-MEMORY:]
        w, value, slope = w + size * way, new_value, new_slope
        seen = [*seen, value][-LOOK_BACK:]
        if len(seen) == LOOK_BACK and max(seen) - value <= TOLERANCE * start:
            break
    return w


def _samme(train: DataFrame, params: dict, classes: int, weight: str | None) -> Ensemble:
    """Stumps on reweighted rows; a round's weight grows as its weighted error falls. Many rows are learned from by intervals as in boosting: equal ones (of equal classes) are missed or not together, so their
    weights stay in proportion and a stump on their sums is one on all rows."""
    out, facts = Ensemble("classification", classes), train.agg(F.count("*"), F.max(F.size(vector_to_array("features")))).first()
    if facts[0] > MANY_ROWS and facts[1] <= MOST_BINNED:
        train, weight, out.bounds = cells(train, facts[0], weight, "classification")
    rows = staged(train.withColumn("_w", F.col(weight) if weight else F.lit(1.0)))
    rate = float(params["learning_rate"])
    for i in range(int(params["n_estimators"])):
        tree = mc.DecisionTreeClassifier(maxDepth=1, weightCol="_w", seed=SEED, **COLUMNS).fit(rows)
        guessed = tree.transform(rows).drop("rawPrediction", "probability")
        missed = F.col("pred") != F.col("y")
        sums = guessed.agg(F.sum(F.when(missed, F.col("_w")).otherwise(0.0)).alias("bad"), F.sum("_w").alias("all")).first()
        error = sums["bad"] / sums["all"]
        if error >= 1 - 1 / classes:
            break
        out.models.append(tree)
        out.weights.append(rate * (math.log((1 - error) / max(error, 1e-12)) + math.log(classes - 1)))
        if error <= 0:
            break
        grown = F.when(missed, F.col("_w") * math.exp(out.weights[-1])).otherwise(F.col("_w"))
        rows = guessed.withColumn("_w", grown / sums["all"]).drop("pred")
        if (i + 1) % STAGE_EVERY == 0:
            rows = staged(rows)
    return out


DRAWS_A_BUCKET = 16


def drawn_counts(rows: DataFrame, seed: int) -> DataFrame:
    """(id, n): how often each row of (id, _w) is drawn in as many draws with replacement as there are rows, in proportion to
    the weights. Draws are hashes of the seed and their number; each falls into the stretch of running weight of one row, in
    order of id, so they don't depend on partitioning. Both sides meet in buckets of a few stretches and draws."""
    placed = staged(running_totals(rows.select("id", "_w"), "id", {"before": "_w"}))
    count, total = placed.agg(F.count("*"), F.max("before_all")).first()
    buckets = max(1, count // DRAWS_A_BUCKET)
    low, high = F.col("before") / total * buckets, (F.col("before") + F.col("_w")) / total * buckets
    stretches = placed.select("id", low.alias("low"), high.alias("high")).filter("high > low")
    stretches = stretches.withColumn("bucket", F.explode(F.sequence(F.floor("low"), F.floor("high"))))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") / float(1 << 53) * buckets
    draws = rows.sparkSession.range(count).select(u.alias("u")).withColumn("bucket", F.floor("u"))
    hits = draws.join(stretches, "bucket").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return hits.groupBy("id").agg(F.count("*").cast("double").alias("n"))


def _adaboost_r2(train: DataFrame, params: dict, classes: int, weight: str | None) -> Ensemble:
    """Depth-3 trees, each on rows drawn with replacement by their weights; rows with small errors lose weight."""
    out = Ensemble("regression", 0)
    rows = staged(train.withColumn("_w", F.lit(1.0)))
    rate = float(params["learning_rate"])
    for i in range(int(params["n_estimators"])):
        counts = drawn_counts(rows, SEED + i).withColumnRenamed("id", "_drawn")
        sample = staged(rows.join(counts, F.col("id") == F.col("_drawn")).select("y", "features", "n"))
        tree = mr.DecisionTreeRegressor(maxDepth=3, weightCol="n", seed=SEED, **COLUMNS).fit(sample)
        discard(sample)
        guessed = tree.transform(rows).withColumn("_e", F.abs(F.col("y") - F.col("pred")))
        sums = guessed.agg(F.max("_e").alias("most"), F.sum(F.col("_w") * F.col("_e")).alias("bad"), F.sum("_w").alias("all")).first()
        loss = sums["bad"] / sums["all"] / sums["most"] if sums["most"] else 0.0
        if loss >= 0.5:
            if not out.models:
                out.models.append(tree)
                out.weights.append(1.0)
            break
        out.models.append(tree)
        beta = loss / (1 - loss)
        out.weights.append(rate * math.log(1 / max(beta, 1e-12)))
        if loss <= 0:
            break
        kept = F.pow(F.lit(beta), (1 - F.col("_e") / sums["most"]) * rate)
        rows = guessed.withColumn("_w", F.col("_w") * kept / sums["all"]).drop("pred", "_e")
        if (i + 1) % STAGE_EVERY == 0:
            rows = staged(rows)
    return out


def _parts(model) -> tuple[dict, list, DataFrame | None]:
    """What a model consists of: plain facts, models of pyspark.ml, and rows."""
    if isinstance(model, Fitted):
        return {"problem": model.problem, "classes": model.classes, "bounds": model.bounds}, [model.model], None
    if isinstance(model, Constant):
        return {"problem": model.problem, "value": model.value}, [], None
    if isinstance(model, Neighbours):
        return {"problem": model.problem, "k": model.k, "weights": model.weights, "classes": model.classes}, [], model.train
    if isinstance(model, Calibrated):
        return {}, [model.margins, model.chances], None
    return {"problem": model.problem, "classes": model.classes, "weights": model.weights, "bounds": model.bounds}, model.models, None


def save(model, path: str) -> None:
    """Write a fitted learner of any kind."""
    facts, stages, rows = _parts(model)
    text = json.dumps({"kind": type(model).__name__, **facts})
    SparkSession.active().createDataFrame([(text,)], "facts string").write.mode("overwrite").json(f"{path}/facts")
    PipelineModel(stages).write().overwrite().save(f"{path}/stages")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str):
    """What `save` wrote."""
    facts = json.loads(spark.read.json(f"{path}/facts").first()["facts"])
    kind, stages = facts.pop("kind"), PipelineModel.load(f"{path}/stages").stages
    if kind == "Fitted":
        return Fitted(model=stages[0], **facts)
    if kind == "Constant":
        return Constant(**facts)
    if kind == "Neighbours":
        return Neighbours(train=spark.read.parquet(f"{path}/rows"), **facts)
    if kind == "Calibrated":
        return Calibrated(*stages)
    return (Forests if kind == "Forests" else Ensemble)(models=list(stages), **facts)


def tree_scores(frame: DataFrame, names: list[str], problem: str, method: str, trees: int = 100) -> DataFrame:
    """(feature, score): importances of one tree or a forest over plain columns and `y`."""
    y = frame
    classes = 0
    if problem == "classification":
        from colscope.operators.transforms import add_label_code

        y = add_label_code(frame, "y", "_code").drop("y").withColumnRenamed("_code", "y")
        classes = y.agg(F.max("y")).first()[0] + 1
    rows = y.select(F.col("y").cast("double").alias("y"), array_to_vector(F.array(*[C.col(n) for n in names])).alias("features"))
    name = "decision_tree" if method == "tree" else "random_forest"
    model = fit(problem, name, staged(rows), {"n_estimators": trees, "max_depth": 0}, classes)
    return frame.sparkSession.createDataFrame(list(zip(names, model.importances())), "feature string, score double")
