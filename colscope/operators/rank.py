"""Score feature columns against a target."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions import columns as C
from colscope.functions.quantiles import exact_percentiles
from colscope.operators.transforms import add_label_code

BINS = 10


def rankable(df: DataFrame, profile: DataFrame, target: str) -> dict[str, str]:
    """{column: class} of the columns worth scoring: no identifiers, dates or near-unique categories."""
    rows = profile.filter(
        (F.col("column") != target) & ~F.col("dtype_class").isin("identifier", "datetime")
        & ((F.col("dtype_class") == "numerical") | (F.col("unique_pct") < 0.9)))
    return {r["column"]: r["dtype_class"] for r in rows.orderBy("position").select("column", "dtype_class").collect()}


def feature_frame(df: DataFrame, classes: dict[str, str], target: str, problem: str) -> DataFrame:
    """Features as doubles and the target as `y`: numbers median-filled, other classes as alphabetical codes."""
    work = df.filter(C.col(target).isNotNull())
    numeric = [n for n, c in classes.items() if c == "numerical"]
    medians = exact_percentiles(work, {n: C.number(work, n) for n in numeric}, [0.5])
    y = C.as_text(work, target) if problem == "classification" else C.number(work, target)
    base = work.select(
        y.alias("y"),
        *[F.coalesce(C.number(work, n), F.lit(medians[n][0]).cast("double")).alias(n) if n in numeric
          else F.coalesce(C.as_text(work, n), F.lit("nan")).alias(n) for n in classes],
    ).filter("y IS NOT NULL")
    for n in classes:
        if n not in numeric:
            base = add_label_code(base, n, "_code").drop(n).withColumnRenamed("_code", n)
    return base.select("y", *[C.col(n).cast("double").alias(n) for n in classes])


def class_moments(frame: DataFrame, names: list[str]) -> DataFrame:
    """(feature, y, n, mean, within, total, low, high) from one grouped aggregate."""
    rows = [
        F.struct(F.lit(n).alias("feature"), F.count(C.col(n)).alias("n"), F.avg(C.col(n)).alias("mean"),
                 (F.var_pop(C.col(n)) * F.count(C.col(n))).alias("within"), F.sum(C.col(n)).alias("total"),
                 F.min(C.col(n)).alias("low"), F.max(C.col(n)).alias("high"))
        for n in names
    ]
    return frame.groupBy("y").agg(F.array(*rows).alias("rows")).select("y", F.inline("rows"))


def anova(moments: DataFrame) -> DataFrame:
    """(feature, score): F statistic over the classes."""
    n, mean = F.col("n"), F.col("mean")
    grand = moments.groupBy("feature").agg((F.sum(n * mean) / F.sum(n)).alias("grand"))
    sums = moments.join(grand, "feature").groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("within"),
        F.sum(n * F.pow(mean - F.col("grand"), 2)).alias("between"))
    f = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return sums.select("feature", F.coalesce(f, F.lit(0.0)).alias("score"))


def chi_square(moments: DataFrame) -> DataFrame:
    """(feature, score) on values scaled to 0..1: class sums against the class share of the total."""
    whole = moments.groupBy("feature").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.sum("n").alias("rows"))
    scaled = moments.join(whole, "feature").withColumn(
        "observed", F.coalesce(F.try_divide(F.col("total") - F.col("n") * F.col("least"), F.col("most") - F.col("least")), F.lit(0.0)))
    sums = scaled.groupBy("feature").agg(F.sum("observed").alias("all"))
    expected = F.col("all") * F.col("n") / F.col("rows")
    part = F.try_divide(F.pow(F.col("observed") - expected, 2), expected)
    return scaled.join(sums, "feature").groupBy("feature").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("score"))


def binned(df: DataFrame, names: list[str], bins: int = BINS) -> DataFrame:
    """Replace continuous columns by the number of inner quantile bounds below the value."""
    cuts = exact_percentiles(df, {n: C.col(n).cast("double") for n in names}, [i / bins for i in range(1, bins)])

    def code(n: str) -> Column:
        return sum((F.when(C.col(n) > c, 1).otherwise(0) for c in cuts[n] if c is not None), F.lit(0))

    return df.withColumns({n: code(n) for n in names})


def mutual_information(frame: DataFrame, names: list[str]) -> DataFrame:
    """(feature, score): information in nats shared by each discrete feature and a discrete y."""
    entries = [F.struct(F.lit(n).alias("feature"), C.col(n).cast("double").alias("x"), F.col("y").cast("string").alias("y")) for n in names]
    joint = frame.select(F.inline(F.array(*entries))).groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    per_x = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    per_y = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    cells = joint.join(per_x, ["feature", "x"]).join(per_y, ["feature", "y"]).join(total, "feature")
    n, t = F.col("n").cast("double"), F.col("total").cast("double")
    part = n / t * F.log(n * t / (F.col("nx").cast("double") * F.col("ny")))
    return cells.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(part)).alias("score"))


def regression_f(frame: DataFrame, names: list[str]) -> DataFrame:
    """(feature, score): F statistic of the regression of y on each feature alone."""
    rows = [F.struct(F.lit(n).alias("feature"), F.corr(C.col(n), F.col("y")).alias("r"), F.count("*").alias("n")) for n in names]
    r2 = F.col("r") * F.col("r")
    return C.tidy(frame, rows).select("feature", F.coalesce(F.try_divide(r2 * (F.col("n") - 2), 1 - r2), F.lit(0.0)).alias("score"))


def rank_features(df: DataFrame, profile: DataFrame, target: str, problem: str, method: str, top: int = 30) -> DataFrame:
    """(feature, score), best first. Methods: anova, chi2, information, tree, forest; regression_f for regression."""
    classes = rankable(df, profile, target)
    if not classes:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    frame = feature_frame(df, classes, target, problem)
    names = list(classes)
    if method == "information":
        continuous = [n for n in names if classes[n] == "numerical"]
        frame = binned(frame, continuous + (["y"] if problem == "regression" else []))
        scores = mutual_information(frame, names)
    elif method in ("tree", "forest"):
        from colscope.operators.learners import tree_scores

        scores = tree_scores(frame, names, problem, method)
    elif problem == "classification":
        scores = {"anova": anova, "chi2": chi_square}[method](class_moments(frame, names))
    else:
        scores = regression_f(frame, names)
    return scores.orderBy(F.desc("score"), "feature").limit(top)
