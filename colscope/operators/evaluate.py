"""Metrics and curves from a table of predictions.

Predictions are rows (model, y, pred, score or prob); every metric is a grouped aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions import columns as C

from colscope.functions.running import running_totals
from colscope.functions.tails import t_p_value

# Fixed value: probabilities are clipped this far from 0 and 1 in the log loss.
CLIP = 2.220446049250313e-16


def confusion(pred: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "pred") -> DataFrame:
    """(by, y, pred, n, share): counts and their share of the rows with that y."""
    by = by or []
    counts = pred.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("pred")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by, "y")))


def per_class(conf: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, support, predicted, hits) from a confusion table."""
    actual = conf.groupBy(*by, F.col("y").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    guessed = conf.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    return actual.join(guessed, [*by, "class"], "full").fillna(0, ["support", "hits", "predicted"])


def classification_metrics(pred: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "pred") -> DataFrame:
    """One row per model: accuracy, weighted precision, recall and F1, macro F1, macro specificity, MCC."""
    by = by or []
    classes = per_class(confusion(pred, by, y, p), by)
    n = F.sum("support").over(W.partitionBy(*by))
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    negatives = n - F.col("support")
    specificity = F.try_divide(negatives - (F.col("predicted") - F.col("hits")), negatives)
    rows = classes.select(*by, "support", "predicted", "hits", n.alias("n"), precision.alias("precision"),
                          recall.alias("recall"), f1.alias("f1"), specificity.alias("specificity"))

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    s, c = F.sum("support").cast("double"), F.sum("hits").cast("double")
    tp = F.sum(F.col("support").cast("double") * F.col("predicted"))
    tt, pp = F.sum(F.pow(F.col("support"), 2)), F.sum(F.pow(F.col("predicted"), 2))
    mcc = F.coalesce(F.try_divide(c * s - tp, F.sqrt(s * s - pp) * F.sqrt(s * s - tt)), F.lit(0.0))
    return rows.groupBy(*by).agg(
        (c / s).alias("accuracy"), weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"), weighted("f1").alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"), F.coalesce(F.avg("specificity"), F.lit(0.0)).alias("specificity"), mcc.alias("mcc"))


def thresholds(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by, score, pos, neg, tp, fp, p, n): counts at each distinct score and at or above it. y is 0 or 1."""
    by = by or []
    at = pred.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    steps = running_totals(at, "score", {"_tp": "pos", "_fp": "neg"}, by, descending=True)
    return steps.select(*by, "score", "pos", "neg", (F.col("_tp") + F.col("pos")).alias("tp"),
                        (F.col("_fp") + F.col("neg")).alias("fp"), F.col("_tp_all").alias("p"), F.col("_fp_all").alias("n"))


def roc_auc(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by, roc_auc): share of (positive, negative) pairs ranked right, ties counting half."""
    by = by or []
    t = thresholds(pred, by, y, score)
    below = F.col("n") - F.col("fp")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    return t.groupBy(*by).agg(F.try_divide(wins, F.max("p").cast("double") * F.max("n")).alias("roc_auc"))


def roc_auc_multiclass(pred: DataFrame, classes: int, by: list[str] | None = None, y: str = "y",
                       prob: str = "prob") -> DataFrame:
    """(by, roc_auc): one-against-rest areas weighted by class size. `prob` is an array indexed by y."""
    by = by or []
    each = pred.select(*by, F.col(y).alias("_y"), F.posexplode(prob).alias("class", "score"))
    each = each.select(*by, "class", (F.col("_y") == F.col("class")).cast("int").alias("y"), "score")
    areas = roc_auc(each, [*by, "class"])
    sizes = each.groupBy(*by, "class").agg(F.sum("y").alias("support"))
    return areas.join(sizes, [*by, "class"]).groupBy(*by).agg(
        (F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc"))


def log_loss(pred: DataFrame, by: list[str] | None = None, true_prob: Column | None = None) -> DataFrame:
    """(by, logloss) from the probability given to the true class."""
    p = true_prob if true_prob is not None else F.get("prob", F.col("y").cast("int"))
    clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return pred.groupBy(*(by or [])).agg(F.avg(-F.log(clipped)).alias("logloss"))


def regression_metrics(pred: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "pred") -> DataFrame:
    """One row per model: mse, rmse, mae, r2, mape, cvrmse."""
    a, e = F.col(y), F.col(y) - F.col(p)
    sums = pred.groupBy(*(by or [])).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(a).alias("_var"), F.avg(a).alias("_mean"),
        (F.avg(F.when(a != 0, F.abs(e / a))) * 100).alias("mape"))
    rmse = F.sqrt("mse")
    return sums.select(*(by or []), "mse", rmse.alias("rmse"), "mae",
                       (1 - F.try_divide("mse", "_var")).alias("r2"), "mape",
                       F.when(F.col("_mean") != 0, rmse / F.col("_mean") * 100).alias("cvrmse"))


def roc_points(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by, score, fpr, tpr) at each distinct score; the curve starts at (0, 0)."""
    t = thresholds(pred, by, y, score)
    return t.select(*(by or []), "score", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def precision_recall_points(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by, score, precision, recall) at each distinct score; the curve ends at precision 1, recall 0."""
    t = thresholds(pred, by, y, score)
    return t.select(*(by or []), "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide("tp", "p").alias("recall"))


def gains_and_lift(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by, score, fraction, gain, lift) after taking all rows at or above each distinct score.

    Rows sharing a score have no order among themselves, so the curve has one point for them.
    """
    t = thresholds(pred, by, y, score)
    fraction = (F.col("tp") + F.col("fp")) / (F.col("p") + F.col("n"))
    gain = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0))
    return t.select(*(by or []), "score", fraction.alias("fraction"), gain.alias("gain"), (gain / fraction).alias("lift"))


def calibration(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_predicted, fraction_positive) over equal right-closed bins; empty bins are absent."""
    bin_ = F.greatest(F.lit(1), F.ceil(F.col(score) * bins)).cast("long")
    return pred.groupBy(*(by or []), bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"))


def residuals(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Add the residual, actual minus predicted."""
    return pred.withColumn("residual", F.col(y) - F.col(p))


def fold_scores(pred: DataFrame, problem: str) -> DataFrame:
    """(model, fold, score): accuracy or R² within each fold."""
    keys = ["model", "fold"]
    if problem == "classification":
        return pred.groupBy(*keys).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("score"))
    return regression_metrics(pred, keys).select(*keys, F.col("r2").alias("score"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """(model, cv_mean, cv_std) with the population deviation."""
    return scores.groupBy("model").agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def pairwise_comparison(scores: DataFrame) -> DataFrame:
    """(model_a, model_b, t, p_better): chance that a scores above b, from a paired t test over folds.

    `scores` has one row per model and fold.
    """
    a = scores.select(F.col("model").alias("model_a"), "fold", F.col("score").alias("_a"))
    b = scores.select(F.col("model").alias("model_b"), "fold", F.col("score").alias("_b"))
    diff = a.join(b, "fold").filter("model_a <> model_b").withColumn("d", F.col("_a") - F.col("_b"))
    stats = diff.groupBy("model_a", "model_b").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("most"))
    spread = F.col("sd") / F.sqrt("n")
    t = F.when(F.col("sd") > 0, F.col("mean") / spread).otherwise(F.signum("mean") * F.lit(float("inf")))
    tested = stats.withColumn("t", t).withColumn("p", t_p_value(F.col("t"), (F.col("n") - 1).cast("double")))
    better = F.when(F.col("t") > 0, 1 - F.col("p") / 2).otherwise(F.col("p") / 2)
    return tested.select("model_a", "model_b", F.when(F.col("most") > 1e-8, F.col("t")).alias("t"),
                         F.when(F.col("most") <= 1e-8, 0.5).otherwise(C.round_to(better, 3)).alias("p_better"))
