"""Exact neighbours of vectors without comparing every pair of rows in one place.

Train rows are assigned to the nearest of some pivots, whose number grows with the rows. A query row is answered from its
own cell first; it then visits only the other cells that can hold something nearer than what it found. Where that spares
little, as with many dimensions, both sides are cut into a few wide blocks instead, so that rows are copied for each block
and not for each cell. Blocks are of bounded size on both sides, so one crowded cell spreads over many tasks, and a block
returns one small result per query row, never its pairs.

Within a block, squared distances come from a matrix product, which is fast but rounds; it only rules pairs out, with a
margin above its rounding. What stays is measured coordinate by coordinate.

Frames have columns `id` (long or string) and `v` (array<double>).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions.staging import staged

ROWS_PER_PIVOT = 2048
BLOCK_ROWS = 4096
BLOCK_DOUBLES = 2**21  # in one side of a wide block
TILE = 2**19  # pairs compared at once
CELL_LIMIT = 2**22  # doubles held at once while comparing
SPARED = 0.75  # cells are visited one by one only if at least a quarter of all visits is spared
ROUNDING = 1e-13  # more than what a matrix product is off, for each unit of the squared lengths


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype("float64") if len(series) else np.zeros((0, 0))


def _lengths(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (a[i], b[j]), coordinate by coordinate, within bounded memory."""
    out = np.empty(len(i))
    step = max(1, CELL_LIMIT // max(1, a.shape[1]) // 8)
    for at in range(0, len(i), step):
        gap = a[i[at : at + step]] - b[j[at : at + step]]
        out[at : at + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first of equal rows, and for each row which of them it is."""
    if not len(a):
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    keys = np.ascontiguousarray(a + 0.0).view(np.dtype((np.void, a.dtype.itemsize * a.shape[1])))[:, 0]
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return first, place


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, squared distances, how far these may be off for each row of a), in bounded pieces; all of b for a
    piece of a before the next. Both are moved to the middle of b first, which keeps the rounding small."""
    if not len(a) or not len(b):
        return
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    la, lb = _lengths(a), _lengths(b)
    wide = min(len(b), 2048)
    tall = max(1, TILE // wide)
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(0, len(a), tall):
            for j in range(0, len(b), wide):
                rows, cols = slice(i, min(i + tall, len(a))), slice(j, min(j + wide, len(b)))
                d = a[rows] @ b[cols].T
                d *= -2
                d += lb[cols]
                d += la[rows, None]
                yield rows, cols, d, ROUNDING * (la[rows] + lb[cols].max())


def _nearest(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, t: np.ndarray, t_ids: np.ndarray, k: int,
             exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, neighbour id, distance) of the k nearest rows of t, in order of id, no farther than `bound`."""
    # Of equal rows only the first ones can be among the nearest.
    _, same = _distinct(t)
    by_vector = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.diff(same[by_vector], prepend=-1))
    among = np.arange(len(t)) - np.repeat(starts, np.diff(starts, append=len(t)))
    keep = np.sort(by_vector[among < k + exclude_self])
    t, t_ids = t[keep], t_ids[keep]
    limit = bound * bound * (1 + 1e-12)
    wanted = k + exclude_self
    rows_found, ids_found, far_found = [], [], []
    held: list[np.ndarray] = [np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)]
    for rows, cols, d, off in _tiles(q, t):
        if cols.start == 0:
            held = [np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)]
        if d.shape[1] >= wanted and not np.isfinite(limit[rows]).all():
            least = np.partition(d, wanted - 1, axis=1)[:, wanted - 1] + 2 * off
            limit[rows] = np.fmin(limit[rows], least)
        i, j = np.nonzero(d <= (limit[rows] + off)[:, None])
        i, j = i + rows.start, j + cols.start
        if exclude_self:
            other = q_ids[i] != t_ids[j]
            i, j = i[other], j[other]
        far = _apart(q, t, i, j)
        fine = np.isfinite(far) & (far <= bound[i] * (1 + 1e-12))
        i, j, far = (np.concatenate(x) for x in zip(held, (i[fine], j[fine], far[fine])))
        order = np.lexsort((j, far, i))
        i, j, far = i[order], j[order], far[order]
        new = np.diff(i, prepend=-1) != 0
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        last = place == k - 1
        limit[i[last]] = np.fmin(limit[i[last]], far[last] ** 2 * (1 + 1e-12))
        held = [x[place < k] for x in (i, j, far)]
        if cols.stop == len(t):
            rows_found.append(held[0])
            ids_found.append(t_ids[held[1]])
            far_found.append(held[2])
    if not rows_found:
        return np.zeros(0, dtype="int64"), t_ids[:0], np.zeros(0)
    return np.concatenate(rows_found), np.concatenate(ids_found), np.concatenate(far_found)


def pivots_for(rows: int) -> int:
    """A pivot for each `ROWS_PER_PIVOT` rows; of many rows, as many as their square root, so that finding a row's pivot and
    searching its cell cost alike and both grow with the root of the rows."""
    return 1 + min(rows // ROWS_PER_PIVOT, math.isqrt(rows))


class Cells:
    """The train rows by nearest pivot, with the size and radius of each cell."""

    def __init__(self, train: DataFrame, pivots: int | None = None, seed: int = 42):
        self.count = train.count()
        pivots = pivots or pivots_for(self.count)
        chosen = train.select("v").orderBy(F.xxhash64(F.lit(seed), F.col("v").cast("string"))).limit(pivots).collect()
        points = np.unique(np.array([r["v"] for r in chosen], dtype="float64"), axis=0) if chosen else np.zeros((0, 1))
        self.points = train.sparkSession.sparkContext.broadcast(points)  # `pivots` vectors
        self.rows = staged(self.placed(train))
        facts = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
        self.size = np.zeros(len(points), dtype="int64")
        self.radius = np.full(len(points), -np.inf)
        for r in facts:
            self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["radius"]

    def placed(self, rows: DataFrame) -> DataFrame:
        """Add the cell of each row and its distance to the pivot."""
        shared = self.points

        @F.pandas_udf("cell int, gap double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            a, b = _matrix(v), shared.value
            least, cell = np.full(len(a), np.inf), np.zeros(len(a), dtype="int64")
            for rows, cols, d, _ in _tiles(a, b):
                best = d.argmin(axis=1)
                value = d[np.arange(len(d)), best]
                better = value < least[rows]
                least[rows] = np.where(better, value, least[rows])
                cell[rows] = np.where(better, best + cols.start, cell[rows])
            gap = _apart(a, b, np.arange(len(a)), cell) if len(b) else least
            return pd.DataFrame({"cell": cell.astype("int32"), "gap": gap})

        return rows.withColumn("_c", nearest("v")).select("*", "_c.cell", "_c.gap").drop("_c")

    def candidates(self, wanted: int | None = None, eps: float | None = None):
        """A function of (v, own cell, bound): the other cells that can hold a row within `bound`, or all cells with one
        within `eps`. Rows of a cell are nearest to its pivot, so they lie beyond the plane half way from the own pivot."""
        shared, size, radius = self.points, self.size, self.radius

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series, own: pd.Series, bound: pd.Series) -> pd.Series:
            a, points, used, out = _matrix(v), shared.value, size > 0, []
            if not len(points):
                return pd.Series([np.zeros(0, dtype="int32")] * len(a))
            step = max(1, CELL_LIMIT // 4 // max(1, len(points)))
            lengths = _lengths(points)
            for at in range(0, len(a), step):
                q, home, far = a[at : at + step], own.to_numpy()[at : at + step], bound.to_numpy()[at : at + step].astype("float64")
                rows = np.arange(len(q))
                off = ROUNDING * 10 * (_lengths(q) + lengths.max())[:, None]
                square = np.maximum(_lengths(q)[:, None] - 2 * q @ points.T + lengths, 0)
                if wanted is not None and not np.isfinite(far).all():
                    # Cells by the farthest their rows can be; the first ones with as many rows together bound the answer.
                    farthest = np.where(used, np.sqrt(square + off) + radius, np.inf)
                    order = np.argsort(farthest, axis=1)
                    enough = np.cumsum(size[order], axis=1) >= wanted
                    last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(size) - 1)
                    far = np.fmin(far, np.take_along_axis(farthest, order, axis=1)[rows, last])
                reach = (far * (1 + 1e-9))[:, None]
                near = used & (np.sqrt(np.maximum(square - off, 0)) - radius <= reach)
                if eps is None:
                    beyond = lengths[home][:, None] - 2 * points[home] @ points.T + lengths
                    plane = 2 * reach * np.sqrt(np.maximum(beyond, 0) + off)
                    near &= (square - square[rows, home][:, None] - 4 * off <= plane) | ~np.isfinite(reach)
                    near[rows, home] = False
                out += [np.flatnonzero(r).astype("int32") for r in near]
            return pd.Series(out, dtype="object")

        return cells


KEYS = ["cell", "part", "share"]


def _pairs(held: DataFrame, asked: DataFrame, parts: list[int], shares: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (cell, part, share): a cell is cut into parts of its train rows and shares of its queries."""
    def spread(df: DataFrame, key: str, own: str, own_count, other: str, other_count) -> DataFrame:
        mine = F.pmod(F.xxhash64(key, F.lit(own)), F.get(own_count, F.col("cell"))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.get(other_count, F.col("cell")) - 1))
        return df.withColumn(own, mine).withColumn(other, every)

    parts, shares = F.lit(parts or [1]), F.lit(shares or [1])
    return spread(held, "id", "part", parts, "share", shares), spread(asked, "qid", "share", shares, "part", parts)


def _wide(held: DataFrame, rows: int, asked: DataFrame, asking: int, dims: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Every query beside every train row, in blocks as wide as memory allows while all cores have some."""
    cores = held.sparkSession.sparkContext.defaultParallelism
    most = max(block_rows, BLOCK_DOUBLES // max(1, dims))
    each = math.ceil(2 * math.sqrt(cores))
    cut = lambda n: [max(1, math.ceil(n / max(min(most, math.ceil(n / each)), min(block_rows, most))))]
    return _pairs(held.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), cut(rows), cut(asking))


def _blocks(cells: Cells, visits: DataFrame, asked: DataFrame, asking: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Train rows and queries of the cells visited; or all of both, where that spares too little."""
    per_cell = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    held = cells.rows.drop("gap")
    if sum(per_cell.values()) > (1 - SPARED) * asking * max(1, len(cells.size)) and len(cells.size) > 1:
        return _wide(held, cells.count, asked, asking, cells.points.value.shape[1], block_rows)
    parts = [max(1, math.ceil(n / block_rows)) for n in cells.size.tolist()]
    shares = [max(1, math.ceil(per_cell.get(c, 0) / block_rows)) for c in range(len(cells.size))]
    return _pairs(held, visits, parts, shares)


def k_nearest(train: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest train rows of each query, ties by neighbour id."""
    cells = Cells(train.select("id", "v"))
    t = train.schema["id"].dataType.simpleString()
    q = queries.schema["id"].dataType.simpleString()
    # New names for the query side, as a cogroup of two frames read from one table needs them.
    asked = staged(cells.placed(queries.select("id", "v")).select(F.col("id").alias("qid"), F.col("v").alias("qv"), "cell"))
    asking = asked.count()

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        left = left.sort_values("id")
        ids, bound = right["qid"].to_numpy(), right["bound"].to_numpy(dtype="float64")
        at, near, far = _nearest(_matrix(right["qv"]), ids, bound, _matrix(left["v"]), left["id"].to_numpy(), k, exclude_self)
        return pd.DataFrame({"id": ids[at], "neighbour": near, "distance": far})

    def search(held: DataFrame, asked: DataFrame) -> DataFrame:
        return held.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInPandas(best, f"id {q}, neighbour {t}, distance double")

    def places(found: DataFrame) -> DataFrame:
        order = W.partitionBy("id").orderBy("distance", "neighbour")
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    at_home = asked.withColumn("bound", F.lit(float("inf")))
    per_cell = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, math.ceil(n / block_rows)) for n in cells.size.tolist()]
    shares = [max(1, math.ceil(per_cell.get(c, 0) / block_rows)) for c in range(len(cells.size))]
    own = staged(places(search(*_pairs(cells.rows.drop("gap"), at_home, parts, shares))))
    farthest = own.filter(F.col("place") == k).select(F.col("id").alias("_id"), F.col("distance").alias("_bound"))
    bounded = staged(asked.join(farthest, F.col("qid") == F.col("_id"), "left").select(
        "qid", "qv", F.col("cell").alias("home"), F.coalesce("_bound", F.lit(float("inf"))).alias("bound")))
    others = cells.candidates(wanted=k + 1 if exclude_self else k)("qv", "home", "bound")
    visits = staged(bounded.select("qid", "home", "bound", others.alias("cells")))
    # Vectors are copied for each visit only where there are few.
    moved = bounded.join(visits.select(F.col("qid").alias("_q"), F.explode("cells").alias("cell")), F.col("qid") == F.col("_q")).select(
        "qid", "qv", "bound", "cell")
    counted = visits.agg(F.sum(F.size("cells"))).first()[0] or 0
    if counted > (1 - SPARED) * asking * max(1, len(cells.size)):
        held, seeking = _wide(cells.rows.drop("gap"), cells.count, bounded.drop("home"), asking, cells.points.value.shape[1], block_rows)
        return places(search(held, seeking))
    visited = {r["cell"]: r["n"] for r in visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shares = [max(1, math.ceil(visited.get(c, 0) / block_rows)) for c in range(len(cells.size))]
    return places(own.drop("place").unionByName(search(*_pairs(cells.rows.drop("gap"), moved, parts, shares))))


def within(train: DataFrame, queries: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, weight, label): total weight and least label of the train rows within eps of each query.

    `train` also has `weight` (double) and `label` (long). Queries without any such row are absent.
    """
    cells = Cells(train.select("id", "v", "weight", "label"))
    asked = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    near = cells.candidates(eps=eps)("qv", F.lit(0), F.lit(float(eps)))
    held, asked = _blocks(cells, asked.withColumn("cell", F.explode(near)), asked, asked.count(), block_rows)
    q = queries.schema["id"].dataType.simpleString()

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "weight": [], "label": []})
        left = left.sort_values("label")
        a, b = _matrix(right["qv"]), _matrix(left["v"])
        each, labels = left["weight"].to_numpy(), left["label"].to_numpy()
        weight, label = np.zeros(len(a)), np.full(len(a), np.iinfo("int64").max)
        found = np.zeros(len(a), dtype=bool)
        for rows, cols, d, off in _tiles(a, b):
            close = d <= eps * eps
            i, j = np.nonzero(np.abs(d - eps * eps) <= (off + ROUNDING * eps * eps)[:, None])
            close[i, j] = _apart(a, b, i + rows.start, j + cols.start) <= eps
            weight[rows] += close @ each[cols]
            some = close.any(axis=1)
            label[rows] = np.where(some, np.minimum(label[rows], labels[cols][close.argmax(axis=1)]), label[rows])
            found[rows] |= some
        out = pd.DataFrame({"id": right["qid"].to_numpy(), "weight": weight, "label": label})
        return out[found]

    found = held.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInPandas(sums, f"id {q}, weight double, label long")
    return found.groupBy("id").agg(F.sum("weight").alias("weight"), F.min("label").alias("label"))


def distance_sums(train: DataFrame, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, label, total): summed distance of each query to the train rows of each label."""
    held = train.select("id", "v", "label")
    asked = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    dims = held.select(F.max(F.size("v"))).first()[0] or 1
    held, asked = _wide(held, held.count(), asked, asked.count(), dims, block_rows)
    q = queries.schema["id"].dataType.simpleString()

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "label": [], "total": []})
        # Equal rows of a label are one row that counts as often as it occurs; equal queries have one answer.
        b, of = _matrix(left["v"]), left["label"].to_numpy()
        first, place = _distinct(np.column_stack([of, b]))
        times = np.bincount(place, minlength=len(first)).astype("float64")
        order = np.argsort(of[first], kind="stable")
        b, of, times = b[first][order], of[first][order], times[order]
        a = _matrix(right["qv"])
        one, which = _distinct(a)
        a = a[one]
        labels = np.unique(of)
        total = np.zeros((len(a), len(labels)))
        for rows, cols, d, off in _tiles(a, b):
            i, j = np.nonzero(d <= (off * 1e7)[:, None])  # so near that rounding would show
            exact = _apart(a, b, i + rows.start, j + cols.start)
            np.maximum(d, 0, out=d)
            np.sqrt(d, out=d)
            d[i, j] = exact
            d *= times[cols]
            mine = of[cols]
            starts = np.flatnonzero(np.diff(mine, prepend=mine[0] - 1))
            total[rows][:, np.searchsorted(labels, mine[starts])] += np.add.reduceat(d, starts, axis=1)
        return pd.DataFrame({"id": np.repeat(right["qid"].to_numpy(), len(labels)),
                             "label": np.tile(labels, len(right)), "total": total[which].ravel()})

    found = held.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInPandas(sums, f"id {q}, label long, total double")
    return found.groupBy("id", "label").agg(F.sum("total").alias("total"))
