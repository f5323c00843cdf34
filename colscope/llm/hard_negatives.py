"""Hard negatives of embedding vectors by a vertical scan with branch and bound (BOND).

A task turns its rows into blocks, a dimension after the other, with the least and the greatest value of each dimension. An
anchor reads the dimensions in descending order of its own magnitudes. After each step the score so far, plus the least and the
most that the dimensions still unread can add in this block, bounds the score of every candidate; a bitmap of candidates
shrinks to those that can still enter the result, and what is left at the end has been read in full.

Two scans: the first finds an anchor's positives, its best other rows of the same label; the second finds, for each
positive, the best rows of other labels whose score lies in the positive's window. A task keeps for each anchor only the
best rows that it has seen, which raise the bound for the blocks that follow, and passes on as many; they meet by anchor.
Anchors are taken in portions of bounded size that are broadcast, one scan of the blocks for each portion and step.

A component x counts as floor(256 * x). A vector shorter than another counts as if it had zeros at its end. Rows with a null
label, a null vector, or a null or non-finite component take no part. Scores are exact: in float32 or float64 where no sum
can pass their whole numbers, else in Python integers; a score beyond a long is held to its range, and a positive with such a
score finds no negatives. Ties go by id (null last), and by label for rows that share an id and score. Rows that repeat an id
are rows of their own, as anchors too. Without anchors or rows the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import quoted

SCALE = 256
BLOCK_VALUES = 1 << 18  # numbers in a block of rows
PORTION_VALUES = 1 << 21  # numbers in the anchors that are broadcast at once
STEPS = (0.5, 0.75, 0.875, 1.0)  # shares of the dimensions after which candidates are dropped
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Span:
    """A negative's score lies between these hundredths of its positive's score. Only a score of 0 or more can have any."""

    least: int = 50
    most: int = 95

    def of(self, score: int) -> tuple[int, int]:
        return -(-self.least * score // 100), self.most * score // 100


def shifted(id: Column, label: Column) -> Column:
    """The next label of ten where the id is divisible by 7."""
    return F.when(id % 7 == 0, (label + 1) % 10).otherwise(label)


def _usable(label: Column, vector: Column) -> Column:
    def odd(x: Column) -> Column:
        value = x.cast("double") * SCALE
        return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))

    return label.isNotNull() & vector.isNotNull() & ~F.exists(vector, odd)


def kind_for(largest: float, dims: int) -> np.dtype:
    """The fastest kind of number in which products of values up to `largest`, summed over `dims`, stay exact."""
    total = 2 * largest * largest * dims
    return np.dtype(np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else object)


def whole_numbers(vectors: pa.Array, dims: int, kind: np.dtype) -> np.ndarray:
    """floor(256 * x) for rows of `dims` numbers, shorter vectors filled up with zeros."""
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = values
    if kind != object:
        return out.astype(kind)
    return np.array([int(x) for x in out.ravel()], object).reshape(out.shape)


@dataclass(frozen=True)
class Block:
    """Rows, vertically: data has a line for each dimension."""

    row: np.ndarray
    id: np.ndarray
    unknown: np.ndarray  # where the id is null
    label: np.ndarray
    data: np.ndarray
    least: np.ndarray
    most: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], dims: int, kind: np.dtype) -> Iterator[Block]:
    def block(part: pa.Table) -> Block:
        data = np.ascontiguousarray(whole_numbers(part["vector"].combine_chunks(), dims, kind).T)
        ids = part["id"]
        return Block(part["row"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), part["label"].to_numpy(),
                     data, data.min(axis=1), data.max(axis=1))

    waiting: list[pa.RecordBatch] = []
    rows = max(1, BLOCK_VALUES // dims)
    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= rows:
            table = pa.Table.from_batches(waiting)
            yield block(table.slice(0, rows))
            waiting = table.slice(rows).to_batches()
    if sum(b.num_rows for b in waiting):
        yield block(pa.Table.from_batches(waiting))


def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, low: list, high: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates in the bitmap `alive` whose score lies in one of the windows low..high, and these scores. The
    others are dropped as soon as their bounds leave all windows."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = weights * block.least[order], weights * block.most[order]
    unread_least, unread_most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (np.minimum(*ends), np.maximum(*ends)))
    places: np.ndarray | None = None if alive.sum() > len(alive) // 2 else np.flatnonzero(alive)  # None: all are read
    score, read = 0, 0
    for share in STEPS:
        upto = int(np.ceil(len(order) * share))
        dims = order[read:upto]
        score = score + weights[read:upto] @ (block.data[dims] if places is None else block.data[np.ix_(dims, places)])
        read = upto
        held = np.zeros(len(score), bool)
        for a, z in zip(low, high, strict=True):
            held |= (score + unread_most[read] >= a) & (score + unread_least[read] <= z)
        if places is None:
            held &= alive
            if read < len(order) and held.sum() > len(held) // 2:
                continue  # too few dropped to pick the rest out
            places = np.flatnonzero(held)
        else:
            places = places[held]
        score = score[held]
        if read == len(order) or not len(places):
            break
    return places, score


@dataclass
class Best:
    """The best rows of one search so far: (score, unknown, id, label, row)."""

    most: int
    found: list[tuple] = field(default_factory=list)

    def add(self, score: np.ndarray, block: Block, places: np.ndarray) -> None:
        keys = [score, block.unknown[places], block.id[places], block.label[places], block.row[places]]
        if len(places) > self.most and score.dtype != object:
            first = np.lexsort([*keys[:0:-1], -score])[: self.most]
            keys = [k[first] for k in keys]
        new = zip(*[k.tolist() for k in keys], strict=True)
        self.found = sorted([*self.found, *new], key=lambda r: (-r[0], *r[1:]))[: self.most]

    def bound(self, least: int) -> int:
        """The score that a further row must reach."""
        return max(least, self.found[-1][0]) if len(self.found) >= self.most else least

    def rows(self, **known: int | None) -> list[dict]:
        return [{**known, "row": row, "id": None if unknown else id, "label": label, "score": max(LEAST, min(MOST, int(score)))}
                for score, unknown, id, label, row in self.found]


@dataclass(frozen=True)
class Portion:
    """Anchors that are sought together, and the positives (row, id, score) that each has so far."""

    row: list[int]
    id: list[int]
    label: list[int]
    values: np.ndarray
    positives: list[list[tuple[int, int | None, int]]]


NAMES = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "id", "label", "score"]
FOUND = pa.schema([(n, pa.int64()) for n in NAMES])


def _nearest(batches: Iterator[pa.RecordBatch], portion: Broadcast, most: int) -> Iterator[pa.RecordBatch]:
    """The best other rows of each anchor's label among the blocks of a task, without those of negative score."""
    p: Portion = portion.value
    best = [Best(most) for _ in p.row]
    for block in blocks(batches, p.values.shape[1], p.values.dtype):
        alike = {k: block.label == k for k in set(p.label)}
        for n, anchor in enumerate(p.values):
            alive = alike[p.label[n]] & (block.row != p.row[n])
            if alive.any():
                places, score = scan(anchor, block, alive, [best[n].bound(0)], [np.inf])
                best[n].add(score, block, places)
    out = [r for n, b in enumerate(best) for r in b.rows(anchor=p.row[n], anchor_id=p.id[n])]
    if out:
        yield pa.RecordBatch.from_pylist(out, FOUND)


def _negatives(batches: Iterator[pa.RecordBatch], portion: Broadcast, most: int, span: Span) -> Iterator[pa.RecordBatch]:
    """The best rows of other labels in the window of each positive, among the blocks of a task."""
    p: Portion = portion.value
    windows = [[span.of(score) for *_, score in own] for own in p.positives]
    best = [[Best(most) for _ in own] for own in p.positives]
    for block in blocks(batches, p.values.shape[1], p.values.dtype):
        others = {k: block.label != k for k in set(p.label)}
        for n, anchor in enumerate(p.values):
            if windows[n] and others[p.label[n]].any():
                low, high = [b.bound(w[0]) for b, w in zip(best[n], windows[n], strict=True)], [w[1] for w in windows[n]]
                places, score = scan(anchor, block, others[p.label[n]], low, high)
                for b, a, z in zip(best[n], low, high, strict=True):
                    held = (score >= a) & (score <= z)
                    b.add(score[held], block, places[held])
    out = [r for n, own in enumerate(best) for (row, id, score), b in zip(p.positives[n], own, strict=True)
           for r in b.rows(anchor=p.row[n], anchor_id=p.id[n], positive=row, positive_id=id, positive_score=score)]
    if out:
        yield pa.RecordBatch.from_pylist(out, FOUND)


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best rows of all tasks, ranked from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "label", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, span: Span = Span(), id: str = "vec_id",
          label: str = "label", vector: str = "embedding", portion_values: int = PORTION_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for the rows where `anchors` holds."""
    spark, schema = rows.sparkSession, ", ".join(f"{n} long" for n in NAMES)
    usable = rows.filter(_usable(quoted(label), quoted(vector))).select(
        quoted(id).cast("long").alias("id"), quoted(label).cast("long").alias("label"), quoted(vector).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"))
    size = usable.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = max(1, size[1] or 0)
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[0] * dims // BLOCK_VALUES))
    table = staged(usable.repartition(max(1, tasks)).select(F.monotonically_increasing_id().alias("row"), "*"))
    facts = table.agg(F.count_if("anchor"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    kind = kind_for(SCALE * (facts[1] or 0.0) + 1, dims)
    portions = 1 if facts[0] * dims <= portion_values else -(-2 * facts[0] * dims // portion_values)  # each half full on average
    found = [table.mapInArrow(lambda batches: iter(()), schema).withColumn("rank", F.lit(0))] if not facts[0] else []
    for n in range(portions if facts[0] else 0):
        own = table.filter(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(portions)) == n)).select("row", "id", "label", "vector").toArrow()
        if not own.num_rows:
            continue
        known = [own[c].to_pylist() for c in ("row", "id", "label")]
        values = whole_numbers(own["vector"].combine_chunks(), dims, kind)
        first = spark.sparkContext.broadcast(Portion(*known, values, []))
        near = staged(_ranked(table.drop("anchor").mapInArrow(partial(_nearest, portion=first, most=positives), schema), ["anchor"], positives))
        of: dict[int, list] = {}
        for r in near.select("anchor", "row", "id", "score").toArrow().to_pylist():  # at most `positives` for each anchor of the portion
            of.setdefault(r["anchor"], []).append((r["row"], r["id"], r["score"]))
        second = spark.sparkContext.broadcast(Portion(*known, values, [of.get(row, []) for row in known[0]]))
        worst = table.drop("anchor").mapInArrow(partial(_negatives, portion=second, most=negatives, span=span), schema)
        found.append(staged(_ranked(worst, ["anchor", "positive"], negatives)))
        first.unpersist()
        second.unpersist()
    return reduce(DataFrame.unionByName, found).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
