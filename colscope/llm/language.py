"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a blank; the n-grams of one to three characters that hold a letter are
hashed into `BUCKETS` places. Counts are taken per language over a bounded sample of labelled rows; the matrix of log
probabilities (languages x places, integers in units of 2**-16, so that sums don't depend on batches) is broadcast, and
whole texts are scored in numpy by sparse lookups. More than `MOST_LANGUAGES` languages are taken in blocks of that many, in
order of name, one matrix at a time; each block gives its best language and the sum of its posterior weights, and these
meet by row. So any number of languages gives the result that one matrix would.

A text that is null or has no letter is `und` with score 0; so is every text when nothing could be learned. The score is
the posterior of the predicted language; ties go to the language that sorts first. Rows repeat as they are. A null
doc_id hashes like the empty string. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.staging import staged
from colscope.llm.common import quoted, small_batches, unpacked, whole_rows

BUCKETS = 1 << 16
UNIT = 1 << 16
ROWS_PER_LANGUAGE = 5_000
MOST_LANGUAGES = 128  # in a matrix
MOST_CHARS = 1 << 18
SCALE = 1 << 20


@dataclass
class Model:
    """`table[i, b]`: log probability of place b in languages[i]; the last place stands for n-grams without a letter."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a blank."""
    lowered = (c.lower() if c.isalpha() else " " for c in map(chr, range(0x110000)))
    return np.fromiter((ord(c) if len(c) == 1 else ord(c[0]) for c in lowered), np.uint32, 0x110000)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Per bounded piece of the batch: rows, starts of their segments, and the letters with two blanks after each."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), MOST_CHARS):  # n-grams go over the cut: two characters come before it
            rows.append(row)
            parts.append(text[max(at - 2, 0) : at + MOST_CHARS] if at else "  " + text[:MOST_CHARS])
            size += len(parts[-1])
            if size >= MOST_CHARS:
                yield _joined(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        yield _joined(rows, parts)


def _joined(rows: list[int], parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows, np.concatenate([[0], np.cumsum(lengths)[:-1]]), _letters()[codes]


def _places(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The places of the n-grams that end at each character, for n = 1, 2, 3. The first two characters of a segment are
    there for the n-grams after them only."""
    known = codes != 32
    hashed = codes * np.uint32(2654435761)
    out = []
    for n in (1, 2, 3):
        if n > 1:
            hashed = hashed.copy()
            hashed[n - 1 :] += codes[: len(codes) - n + 1] * np.uint32((0, 0, 2246822519, 3266489917)[n])
            known = known.copy()
            known[n - 1 :] |= codes[: len(codes) - n + 1] != 32
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(668265263) + np.uint32(n * 374761393 & 0xFFFFFFFF)
        place = (mixed >> np.uint32(16)).astype(np.int32)
        place[~known] = BUCKETS
        for k in (0, 1):
            place[starts + k] = BUCKETS
        out.append(place)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (language, place) of a task."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for rows, starts, codes in _pieces(batch.column(1).to_pylist()):
            edges = [*starts, len(codes)]
            for places in _places(codes, starts):
                for k, row in enumerate(rows):
                    counts = total.setdefault(names[row], np.zeros(BUCKETS + 1, np.int64))
                    part = places[edges[k] : edges[k + 1]]
                    if len(part) < 2048:
                        np.add.at(counts, part, 1)
                    else:
                        counts += np.bincount(part, minlength=BUCKETS + 1)
        for name in names:
            docs[name] = docs.get(name, 0) + 1
    for name, counts in total.items():
        used = np.flatnonzero(counts[:BUCKETS])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(used) + 1), pa.string()), pa.array(np.append(used, -1), pa.int32()),
             pa.array(np.append(counts[used], docs[name]), pa.int64())], ["lang", "place", "n"])


def fit(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, id: str = "doc_id", text: str = "text", lang: str = "lang",
        most: int = MOST_LANGUAGES) -> Iterator[Model]:
    """Learn from the labelled rows: those with both values; a model for each block of languages. Of a language with more
    than `rows_per_language` rows about that many are taken, by the hash of id and text, so that the choice is the same on
    any cluster."""
    known = small_batches(rows).select(quoted(lang).alias("lang"), quoted(text).alias("text"), F.xxhash64(quoted(id), quoted(text)).alias("key"))
    known = known.filter("lang is not null and text is not null")
    counted = staged(known.groupBy("lang").agg(F.count("*").alias("count")))
    share = F.least(F.lit(SCALE), F.floor(F.lit(SCALE * rows_per_language) / F.col("count")) + 1)
    learned = counted.agg(F.sum(F.least("count", F.lit(rows_per_language)))).first()[0] or 0
    sizes = counted.withColumn("share", share).orderBy("lang").limit(most).collect()
    while sizes:
        yield _block(known, sizes, rows_per_language, learned)
        rest = counted.filter(F.col("lang") > sizes[-1]["lang"])
        sizes = rest.withColumn("share", share).orderBy("lang").limit(most).collect() if len(sizes) == most else []


def _block(known: DataFrame, sizes: list, rows_per_language: int, learned: int) -> Model:
    """The model of a block of languages. Priors are shares of all that is learned from, about, as a common factor cancels."""
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["share"])])
    drawn = known.filter(F.pmod("key", F.lit(SCALE)) < share[F.col("lang")])  # null, and so left out, for other languages
    parts = min(64, sum(min(r["count"], rows_per_language) for r in sizes) // 1000 + 1)
    table = (drawn.repartition(parts).select("lang", "text").mapInArrow(_counts, "lang string, place int, n long")
             .groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow())
    row = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    names = sorted(row.dictionary.to_pylist())
    order = np.array([names.index(x) for x in row.dictionary.to_pylist()], np.int64)
    at, place, n = order[row.indices.to_numpy()], table["place"].to_numpy(), table["n"].to_numpy()
    counts, docs = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    counts[at[place >= 0], place[place >= 0]] = n[place >= 0]
    docs[at[place < 0]] = n[place < 0]
    matrix = np.zeros((len(names), BUCKETS + 1), np.int32)
    for line, own in zip(matrix, counts, strict=True):
        line[:BUCKETS] = np.round((np.log(own + 0.5) - np.log((own + 0.5).sum())) * UNIT)
    return Model(names, np.round(np.log(docs / max(learned, 1)) * UNIT).astype(np.int64), matrix)


def _sums(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text in each language, in units, and whether the text has a letter."""
    sums = np.zeros((len(model.languages), len(texts)), np.int64)
    letters = np.zeros(len(texts), bool)
    for rows, starts, codes in _pieces([x or "" for x in texts]):
        np.logical_or.at(letters, rows, np.logical_or.reduceat(codes != 32, starts))
        for places in _places(codes, starts):
            for i, line in enumerate(model.table):
                np.add.at(sums[i], rows, np.add.reduceat(line[places], starts, dtype=np.int64))
    return sums + model.prior[:, None], letters


def _scored(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and posterior of each text."""
    sums, letters = _sums(model, texts)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = sums.argmax(axis=0)
    score = 1 / np.exp((sums - sums.max(axis=0)) / UNIT).sum(axis=0)
    names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, score, 0.0)


def _result(model: Model, text: Column, spark) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def score(texts: pa.Array) -> pa.Array:
        names, values = _scored(shared.value, texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang_pred", "score"])

    return score(text)


def _best_of_block(model: Model, text: Column, spark) -> Column:
    """struct(best, lang, weight) of a text column: the highest sum, its language, and the sum of exp over the block, as a share
    of the highest. Null for texts without a letter."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("best long, lang string, weight double")
    def score(texts: pa.Array) -> pa.Array:
        sums, letters = _sums(shared.value, texts.to_pylist())
        best, at = sums.max(axis=0), sums.argmax(axis=0)
        weight = np.exp((sums - best) / UNIT).sum(axis=0)
        names = [shared.value.languages[k] for k in at]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(names, pa.string()), pa.array(weight)], ["best", "lang", "weight"],
                                          mask=pa.array(~letters))

    return score(text)


def predict(docs: DataFrame, models: Iterable[Model], text: str = "text", kept: Column | None = None) -> DataFrame:
    """The struct `row`, of all columns of `docs` unless `kept` is another, with lang_pred and score beside it. `models` are
    blocks of one model."""
    spark, blocks = docs.sparkSession, iter(models)
    first, second = next(blocks, None) or Model([], np.zeros(0, np.int64), np.zeros((0, BUCKETS + 1), np.int32)), next(blocks, None)
    rows = small_batches(docs).select(whole_rows(docs) if kept is None else kept.alias("row"), quoted(text).alias("the text"))
    if second is None:
        out = rows.select("row", _result(first, F.col("the text"), spark).alias("language"))
        return out.select("row", "language.lang_pred", "language.score")
    rows = staged(rows.withColumn("n", F.monotonically_increasing_id()))
    parts = [staged(rows.select("n", F.lit(k).alias("block"), _best_of_block(m, F.col("the text"), spark).alias("b")).select("n", "block", "b.*"))
             for k, m in enumerate(chain([first, second], blocks))]
    every = reduce(DataFrame.unionByName, parts).filter("best is not null").groupBy("n").agg(
        F.max(F.struct("best", (-F.col("block")).alias("place"), "lang")).alias("top"), F.collect_list(F.struct("best", "weight")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda acc, b: acc + b["weight"] * F.exp((b["best"] - F.col("top.best")) / F.lit(float(UNIT))))
    return rows.join(every, "n", "left").select(
        "row", F.coalesce("top.lang", F.lit("und")).alias("lang_pred"), F.coalesce(F.lit(1.0) / total, F.lit(0.0)).alias("score"))


def held_out(id: str = "doc_id") -> Column:
    """The rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(quoted(id).cast(T.StringType()), F.lit("")).cast("binary")) % 4 == 2


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the labelled rows that are not held out."""
    kept = F.struct(quoted("doc_id").alias("doc_id"), held_out().alias("held_out"))
    return predict(docs, fit(docs.filter(~held_out())), kept=kept).select("row.doc_id", "row.held_out", "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is recognised with a posterior of `least` or more."""
    models = fit(docs.filter(~held_out()))
    return unpacked(predict(docs, models).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)))
