"""Clustering of feature vectors, and how well it separates them.

Frames have `id` (long) and `features` (vector); clusterings add `cluster`, -1 for noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions.running import running_totals
from colscope.functions.staging import staged
from colscope.operators.neighbours import distance_sums, within

SEED = 42


ROUNDS = 300
SUMMED = 2**21  # numbers of all tasks' sums that are added up on the driver
SLICE = 512  # rows whose distances to all centres are held at a time
SHIFT = 1e-4  # of the mean variance, below which centres stand still


def _rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    vectors = batch.column(name)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("float64")


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0)


def _drawn(frame: DataFrame, runs: list[int], centres: dict[int, np.ndarray], seed: int) -> dict[int, np.ndarray]:
    """A row for each run, drawn in proportion to its squared distance to the run's nearest centre (any row alike without
    centres): the least of -log(u) / weight, where u comes from the row's hash, wins in each task and then overall."""
    step = {r: len(centres[r]) for r in runs}

    stacked = np.vstack([centres[r] for r in runs]) if all(step[r] for r in runs) else None
    edges = np.cumsum([0, *(step[r] for r in runs)])

    def least(batches):
        best: dict[int, tuple[float, list[float]]] = {}
        for batch in batches:
            x, h = _rows_of(batch, "v"), batch.column("h").to_numpy().view("uint64")
            square = None if stacked is None else _squares(x, stacked)
            for r, i, j in zip(runs, edges, edges[1:]):
                u = _mixed(h, seed + r * 1_000 + step[r])
                weight = np.ones(len(x)) if square is None else square[:, i:j].min(axis=1)
                with np.errstate(divide="ignore"):
                    race = np.where(weight > 0, -np.log(u) / weight, np.inf)
                at = int(race.argmin())
                if r not in best or race[at] < best[r][0]:
                    best[r] = (float(race[at]), x[at].tolist())
        if best:
            yield pa.RecordBatch.from_pydict({"run": list(best), "race": [b[0] for b in best.values()], "v": [b[1] for b in best.values()]})

    found = frame.mapInArrow(least, "run long, race double, v array<double>").groupBy("run").agg(F.min(F.struct("race", "v")).alias("best"))
    return {row["run"]: np.vstack([centres[row["run"]], [row["best"]["v"]]]) if step[row["run"]] else np.array([row["best"]["v"]])
            for row in found.collect()}  # a row a run


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a salt (the finaliser of splitmix64)."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("float64") / 2**53 + 2**-54


def _sums(x: np.ndarray, stacked: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """For runs whose centres lie one after the other between the edges: each run's summed squared distance, the size and the sum of
    vectors of each cluster. Two products for all runs, a slice of rows after the other."""
    cost, size, total = np.zeros(len(edges) - 1), np.zeros(len(stacked)), np.zeros(stacked.shape)
    twice, length = -2 * stacked.T, (stacked * stacked).sum(axis=1)
    for at in range(0, len(x), SLICE):
        rows = x[at : at + SLICE]
        d = rows @ twice
        d += length  # less the row's own square, which no choice depends on
        own, each = (rows * rows).sum(axis=1), np.arange(len(rows))
        member = np.zeros(d.shape)
        for r, (i, j) in enumerate(zip(edges, edges[1:])):
            near = i + d[:, i:j].argmin(axis=1)
            member[each, near] = 1.0
            cost[r] += np.maximum(d[each, near] + own, 0).sum()
        size += member.sum(axis=0)
        total += member.T @ rows
    return [cost, size, total]


def _moved(frame: DataFrame, centres: dict[int, np.ndarray], few: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each run the size and the sum of vectors of each cluster, and the summed squared distance: one scan for all runs, and
    a row a run and task, which are added up by a shuffle unless they are `few`."""
    runs, edges = list(centres), np.cumsum([0, *(len(c) for c in centres.values())])
    stacked = np.vstack(list(centres.values()))

    def sums(batches):
        total = None
        for batch in batches:
            part = _sums(_rows_of(batch, "v"), stacked, edges)
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            cost, size, sum_of = total
            yield pa.RecordBatch.from_pydict({"run": runs, "values": [
                [float(c), *size[i:j].tolist(), *sum_of[i:j].ravel().tolist()] for c, i, j in zip(cost, edges, edges[1:])]})

    parts = frame.mapInArrow(sums, "run long, values array<double>")
    if few:
        found: dict[int, np.ndarray] = {}
        for batch in parts.toArrow().to_batches():
            for r, v in zip(batch.column("run").to_pylist(), batch.column("values")):
                found[r] = found[r] + v.values.to_numpy() if r in found else v.values.to_numpy()
    else:
        table = parts.select("run", F.posexplode("values").alias("at", "value")).groupBy("run", "at").agg(
            F.sum("value").alias("value")).toArrow()  # a number a run, cluster and dimension
        run, at, value = (table[n].to_numpy() for n in ("run", "at", "value"))
        found = {r: value[run == r][np.argsort(at[run == r])] for r in centres if (run == r).any()}
    return {r: (v[1 : 1 + len(centres[r])], v[1 + len(centres[r]) :].reshape(len(centres[r]), -1), float(v[0])) for r, v in found.items()}


def lloyd(df: DataFrame, ks: list[int], restarts: int = 10, rounds: int = ROUNDS, seed: int = SEED) -> dict[int, tuple[np.ndarray, float]]:
    """{k: (centres, inertia)} of the best restart. All restarts for all k advance together: drawing the next centre of each is
    one scan, and so is each round. Draws depend on ids alone, not on partitioning."""
    frame = staged(df.select(vector_to_array("features").alias("v"), F.xxhash64("id").alias("h")).repartition(
        df.sparkSession.sparkContext.defaultParallelism, "h"))
    of = {n: k for n, k in enumerate(k for k in ks for _ in range(restarts))}
    centres: dict[int, np.ndarray] = {n: np.zeros((0, 0)) for n in of}
    for step in range(max(ks)):
        centres |= _drawn(frame, [n for n, k in of.items() if k > step], centres, seed)
    spread = frame.select(F.inline(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))).groupBy("i").agg(
        F.var_pop("x").alias("s")).agg(F.avg("s")).first()[0] or 0.0
    done: dict[int, tuple[np.ndarray, float]] = {}
    moving, tasks = dict(centres), frame.rdd.getNumPartitions()
    for turn in range(rounds + 1):
        found = _moved(frame, moving, tasks * sum(c.size for c in moving.values()) <= SUMMED)
        still = {}
        for n, (size, total, cost) in found.items():
            new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], moving[n])  # an empty cluster stays where it is
            if ((new - moving[n]) ** 2).sum() <= SHIFT * spread or turn == rounds:
                done[n] = moving[n], cost
            else:
                still[n] = new
        moving = still
        if not moving:
            break
    return {k: min((done[n] for n in of if of[n] == k and n in done), key=lambda c: c[1]) for k in ks}


def assigned(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add `cluster`, the place of the nearest centre, the first of equal ones."""
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_squares(np.stack(v.to_numpy()), centres).argmin(axis=1).astype("int32"))

    return df.withColumn("cluster", nearest(vector_to_array("features")))


def k_means(df: DataFrame, n_clusters: int = 4, n_init: int = 10) -> DataFrame:
    """Add `cluster` from the restart with the least inertia; with fewer distinct rows some clusters are empty."""
    if df.isEmpty():
        return df.withColumn("cluster", F.lit(0))
    return assigned(df, lloyd(df, [n_clusters], n_init)[n_clusters][0])


def hierarchical(df: DataFrame, n_clusters: int = 4) -> DataFrame:
    """Clusters split top-down by variance."""
    return BisectingKMeans(k=n_clusters, seed=SEED, predictionCol="cluster").fit(df).transform(df)


def elbow(df: DataFrame, restarts: int = 10, most: int = 10) -> DataFrame:
    """(k, inertia) for k from 2."""
    ks = list(range(2, min(most + 1, df.limit(most + 1).count())))
    costs = [(k, cost) for k, (_, cost) in lloyd(df, ks, restarts).items()] if ks else []
    return df.sparkSession.createDataFrame(costs, "k int, inertia double")


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Density clusters numbered from 0 by their least row id; -1 for noise.

    Equal vectors are one weighted point, so a vector shared by many rows costs one. Points with enough
    weight within eps are cores. Core components merge in rounds: each component hooks to the least
    label seen within eps of its points, and chains of hooks are shortened. A border point takes the
    least label of the cores around it.
    """
    rows = df.select("id", vector_to_array("features").alias("v"))
    points = staged(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("weight")))
    weighted = points.withColumn("label", F.col("id"))
    counts = within(weighted, points, eps)
    core_ids = counts.filter(F.col("weight") >= min_samples).select("id")
    cores = staged(points.join(core_ids, "id").withColumn("label", F.col("id")))

    while True:  # labels only fall, so this ends
        seen = within(cores, cores, eps).select("id", F.col("label").alias("least"))
        both = staged(cores.join(seen, "id"))
        if both.filter("least < label").isEmpty():
            break
        hooks = staged(both.groupBy("label").agg(F.min("least").alias("up")))
        while True:
            above = hooks.select(F.col("label").alias("_l"), F.col("up").alias("_u"))
            jumped = staged(hooks.join(above, F.col("up") == F.col("_l")).select("label", "up", F.col("_u").alias("top")))
            hooks = jumped.select("label", F.col("top").alias("up"))
            if jumped.filter("top < up").isEmpty():
                break
        cores = staged(both.drop("least").join(hooks, "label").drop("label").withColumnRenamed("up", "label"))

    others = points.join(cores.select("id"), "id", "left_anti")
    border = within(cores, others, eps).select("id", "label")
    labelled = staged(cores.select("id", "label").unionByName(border))
    found = labelled.select("label").distinct().withColumn("one", F.lit(1))
    numbers = running_totals(found, "label", {"cluster": "one"}).select("label", F.col("cluster").cast("int").alias("cluster"))
    per_point = points.join(labelled, "id").join(numbers, "label").select("v", "cluster")
    keyed = df.withColumn("_v", vector_to_array("features"))
    joined = keyed.join(per_point.withColumnRenamed("v", "_v"), "_v", "left")
    return joined.drop("_v").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def cluster_sizes(df: DataFrame) -> DataFrame:
    """(n_clusters, n_noise)."""
    return df.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
                  F.count_if(F.col("cluster") < 0).alias("n_noise"))


def silhouette(df: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) with Euclidean distances, noise left out.

    Exact, and quadratic by definition: every row meets every row, in blocks, as sums per cluster.
    For tables beyond that use `silhouette_squared`, whose cost is linear.
    """
    x = staged(df.filter("cluster >= 0").select("id", F.col("cluster").cast("long").alias("label"),
                                                vector_to_array("features").alias("v")))
    sizes = x.groupBy("label").agg(F.count("*").alias("n"))
    sums = distance_sums(x, x).join(sizes, "label")
    own = x.select("id", F.col("label").alias("own"))
    mean = F.when(F.col("label") == F.col("own"), F.try_divide(F.col("total"), F.col("n") - 1)).otherwise(F.col("total") / F.col("n"))
    per = sums.join(own, "id").withColumn("mean", mean).groupBy("id", "own").agg(
        F.max(F.when(F.col("label") == F.col("own"), F.col("mean"))).alias("a"),
        F.min(F.when(F.col("label") != F.col("own"), F.col("mean"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.select("id", F.col("own").cast("int").alias("cluster"), F.when(F.col("a").isNull(), 0.0).otherwise(s).alias("silhouette"))


def silhouette_squared(df: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) with squared Euclidean distances, from cluster sums in one more pass."""
    x = df.filter("cluster >= 0").select("id", "cluster", vector_to_array("features").alias("v"))
    size = x.select(F.max(F.size("v"))).first()[0] or 0
    sums = x.groupBy("cluster").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(size)]).alias("s"),
        F.sum(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("q")).orderBy("cluster").collect()
    names = np.array([r["cluster"] for r in sums])
    n = np.array([r["n"] for r in sums], dtype="float64")
    total = np.array([r["s"] for r in sums]).reshape(len(names), size)
    square = np.array([r["q"] for r in sums])

    @F.pandas_udf("double")
    def score(cluster: pd.Series, v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy())
        d = n * (m * m).sum(axis=1)[:, None] - 2 * m @ total.T + square
        own = np.searchsorted(names, cluster.to_numpy())
        at = np.arange(len(m)), own
        a = d[at] / np.maximum(n[own] - 1, 1)
        rest = d / n
        rest[at] = np.inf
        b = rest.min(axis=1)
        top = np.maximum(a, b)
        return pd.Series(np.where((n[own] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1), 0.0))

    return x.select("id", "cluster", score("cluster", "v").alias("silhouette"))


def silhouette_bars(scores: DataFrame) -> DataFrame:
    """(cluster, place, id, silhouette): bars from the best down within each cluster."""
    # A cluster may hold most rows: places come from running totals over its distinct scores.
    per_score = scores.groupBy("cluster", "silhouette").agg(F.count("*").alias("n"))
    before = running_totals(per_score, "silhouette", {"before": "n"}, ["cluster"], descending=True)
    tied = W.partitionBy("cluster", "silhouette").orderBy("id")
    return scores.join(before.select("cluster", "silhouette", "before"), ["cluster", "silhouette"]).select(
        "cluster", (F.col("before") + F.row_number().over(tied)).alias("place"), "id", "silhouette")


def projection(df: DataFrame, k: int = 2) -> DataFrame:
    """Add `pca`, the coordinates along the k directions of greatest variance."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_centred").fit(df).transform(df)
    return PCA(k=k, inputCol="_centred", outputCol="pca").fit(centred).transform(centred).drop("_centred")
