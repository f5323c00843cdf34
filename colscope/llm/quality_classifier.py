"""Quality by co-training: a classifier on the text and one on metadata teach each other, then are combined.

The text view sees which hashed words and word shapes (letters and digits run together) a text has, and how far its words
repeat; a word of more than `PIECE` characters, such as a text without blanks, has the shapes of all its consecutive pieces.
The metadata view sees no words: lang, source, sizes, and the layout of the page (lengths of lines and words, repeated and
empty lines, shares of digits, capitals, marks, markup and bytes beyond ASCII). Both are logistic regressions. In every
round each view labels the documents of an unlabelled pool that it is surest of, and the other view learns from them. At
the end both are calibrated on margins of labelled documents that the weights behind them didn't learn from (`FOLDS`
folds), a logistic regression on the two log odds combines them, and every document is scored.

The classifiers are fitted on bounded samples, drawn by hash of doc_id and text, one row for each pair: about `labelled`
labelled documents and `pool` others, as hashed features of `PLACES` places at most, so what reaches the driver is bounded
whatever the corpus, and however often an id repeats. Scoring
reads all rows. Without labels of both kinds nothing is learned and every score is the prior, one half without labels. A
null text counts as empty; null metadata count as a value of their own. A document with several labels takes the lowest.
Rows repeat as they are; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import quoted, small_batches

PLACES = 1 << 13
META_PLACES = 1 << 10
LABELLED, POOL = 6_000, 6_000
ROUNDS, STEPS = 3, 150
SURE, TAKEN = 0.9, 0.05
FOLDS = 4
MOST_CACHED = 1 << 17
PIECE = 64
_SHAPES = ((regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"[\p{Ll}\p{Lo}]+"), "a"), (regex.compile(r"\p{N}+"), "0"))


def _shape_place(piece: str) -> int:
    for pattern, short in _SHAPES:
        piece = pattern.sub(short, piece)
    return crc32(b"s" + piece.encode()) % PLACES


def _later_shapes(word: bytes) -> list[int]:
    """The places of the shapes of a word's pieces after the first."""
    chars = word.decode("utf-8", "replace")
    return [_shape_place(x) for x in {chars[i : i + PIECE] for i in range(PIECE, len(chars), PIECE)}]


class _Places(dict):
    """The places of a word and of the shape of its first piece, packed into one number."""

    def __missing__(self, word: bytes) -> int:
        shape = _shape_place(word.decode("utf-8", "replace")[:PIECE])
        both = crc32(b"w" + word.lower()) % PLACES * PLACES + shape
        if len(word) <= PIECE:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[word] = both
        return both


def text_places(text: str | None, cache: _Places) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.array([crc32(b"empty") % PLACES], np.int32)
    both = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    distinct = set(words)
    repeats = crc32(b"r%d" % (10 * len(distinct) // len(words))) % PLACES
    used = np.zeros(PLACES, bool)
    used[both // PLACES] = used[both % PLACES] = used[repeats] = True
    for word in distinct:
        if len(word) > PIECE:
            used[_later_shapes(word)] = True
    return np.flatnonzero(used).astype(np.int32)


_KINDS = np.zeros(256, np.int64)  # of a byte: 1 digit, 2 capital, 3 small letter, 4 markup, 5 mark, 6 beyond ASCII, 0 blank or control
for _kind, _bytes in ((1, b"0123456789"), (2, bytes(range(65, 91))), (3, bytes(range(97, 123))), (4, b"<>{}[]|#*$%&=_/\\~^@"), (5, b".,;:!?-()'\"+`")):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 6


def _grade(part: int, whole: int) -> int:
    """A share as a number from 0 to 10, finer where it is small."""
    return int(1000 * part / whole).bit_length() if whole else 0


def meta_places(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=7).tolist() if data else [0] * 7
    solid, words = sum(kinds[1:]), max(data.count(b" ") + data.count(b"\n"), 1)
    lines = text.split("\n")
    full = [x for x in lines if x]
    facts = [f"lang {lang}", f"source {source}", f"both {lang} {source}", f"size {len(text).bit_length()}",
             f"lines {len(lines).bit_length()}", f"line {(len(text) // len(lines)).bit_length()}", f"word {min(solid // words, 20)}",
             f"again {_grade(len(full) - len(set(full)), len(full))}", f"empty {_grade(len(lines) - len(full), len(lines))}",
             f"longest {max(map(len, lines)).bit_length()}", *[f"kind {k} {_grade(n, solid)}" for k, n in enumerate(kinds) if k]]
    return np.unique([crc32(x.encode("utf-8", "surrogatepass")) % META_PLACES for x in facts]).astype(np.int32)


@dataclass
class View:
    """Weights of a logistic regression on sets of places, and its calibration: log odds = a * margin + b."""

    places: int
    weights: np.ndarray = field(default=None)
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.weights is None or not rows:
            return np.full(len(rows), self.bias)
        flat, starts, scale = _flat(rows)
        return np.add.reduceat(self.weights[flat], starts) * scale + self.bias

    def fit(self, rows: list[np.ndarray], y: np.ndarray, l2: float = 1e-4) -> None:
        """Adam over all rows, so that the result doesn't depend on their order."""
        flat, starts, scale = _flat(rows)
        lengths = np.diff(np.append(starts, len(flat)))
        w, bias = np.zeros(self.places), 0.0
        m, v = np.zeros(self.places + 1), np.zeros(self.places + 1)
        for t in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], starts) * scale + bias, -30, 30)))
            r = (p - y) / len(y)
            g = np.append(np.bincount(flat, np.repeat(r * scale, lengths), self.places) + l2 * w, r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        self.weights, self.bias = w, float(bias)

    def calibrate(self, margins: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling by Newton steps, with a light prior on the slope."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            d, s = p - y, np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(d * margins).sum() + (a - 1), d.sum()])
            hess = np.array([[(s * margins**2).sum() + 1, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
            move = np.linalg.solve(hess, grad)
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-9:
                break
        self.a, self.b = float(a), float(b)

    def log_odds(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.a * self.margins(rows) + self.b, -30, 30)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.cumsum(lengths) - lengths, 1 / np.sqrt(lengths)


@dataclass
class Model:
    text: View
    meta: View
    mix: tuple[float, float, float]  # weights of the log odds of text and metadata, and a constant

    def scores(self, texts: list[np.ndarray], metas: list[np.ndarray]) -> np.ndarray:
        """score_text, score_meta and the combined score, a row each."""
        t, m = self.text.log_odds(texts), self.meta.log_odds(metas)
        return 1 / (1 + np.exp(-np.clip([t, m, self.mix[0] * t + self.mix[1] * m + self.mix[2]], -30, 30)))


def combined(t: np.ndarray, m: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of y on two columns of log odds by Newton steps, drawn towards one half of each."""
    x, w, centre = np.column_stack([t, m, np.ones(len(t))]), np.array([0.5, 0.5, 0.0]), np.array([0.5, 0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + (w - centre)
        move = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.eye(3), grad)
        w = np.array([max(w[0] - move[0], 0.0), max(w[1] - move[1], 0.0), w[2] - move[2]])  # no view counts against itself
        if np.abs(move).max() < 1e-9:
            break
    return tuple(w.tolist())


def co_train(texts: list[np.ndarray], metas: list[np.ndarray], y: np.ndarray, fold: np.ndarray, pool: tuple[list, list]) -> Model:
    """`y` of the labelled rows, `fold` the fold of each (0 to FOLDS - 1); the pool's rows in both views."""
    n = [int((y == 0).sum()), int((y == 1).sum())]
    prior = float(np.log(n[1] / n[0])) if all(n) else 0.0 if not sum(n) else 30.0 if n[1] else -30.0
    parts = [fold == f for f in range(FOLDS) if (fold == f).any()]
    if not all(n) or any(len(set(y[~part])) < 2 for part in parts):
        return Model(View(PLACES, b=prior, a=0.0), View(META_PLACES, b=prior, a=0.0), (0.5, 0.5, 0.0))
    places, labelled = (PLACES, META_PLACES), (texts, metas)
    taught: list[dict[int, int]] = [{}, {}]  # rows of the pool that each view learned from the other

    def fitted(k: int, chosen: np.ndarray) -> View:
        view = View(places[k])
        rows = [labelled[k][i] for i in np.flatnonzero(chosen)] + [pool[k][i] for i in taught[k]]
        view.fit(rows, np.append(y[chosen], list(taught[k].values())).astype(float))
        return view

    every = np.ones(len(y), bool)
    for _ in range(ROUNDS):
        for k in (0, 1):
            other, view = taught[1 - k], fitted(k, every)
            p = 1 / (1 + np.exp(-view.margins(pool[k])))
            for label, sure, share in ((1, p, n[1] / sum(n)), (0, 1 - p, n[0] / sum(n))):
                best = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= SURE and i not in other]
                for i in best[: int(np.ceil(TAKEN * len(p) * share))]:
                    other[int(i)] = label
    views, odds = [], []
    for k in (0, 1):
        unseen = np.zeros(len(y))
        for part in parts:
            unseen[part] = fitted(k, ~part).margins([labelled[k][i] for i in np.flatnonzero(part)])
        view = fitted(k, every)
        view.calibrate(unseen, y.astype(float))
        views.append(view)
        odds.append(np.clip(view.a * unseen + view.b, -30, 30))
    return Model(*views, combined(*odds, y.astype(float)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Places()
    for batch in batches:
        key, y, text, lang, source = (batch.column(i).to_pylist() for i in range(5))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(y, pa.int32()), pa.array([text_places(t, cache) for t in text], pa.list_(pa.int32())),
             pa.array([meta_places(*x) for x in zip(text, lang, source, strict=True)], pa.list_(pa.int32()))], ["key", "y", "text", "meta"])


def _columns() -> list[Column]:
    return [quoted("text").alias("text"), quoted("lang").cast("string").alias("lang"), quoted("source").cast("string").alias("source")]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    known = labels.select(quoted("doc_id").alias("doc_id"), quoted("quality").alias("y")).filter("doc_id is not null and y is not null")
    known = staged(known.groupBy("doc_id").agg(F.min("y").cast("int").alias("y")))
    ids = docs.select(quoted("doc_id").alias("doc_id"))
    n_known, n_docs, scale = ids.join(known, "doc_id", "left_semi").count(), docs.count(), 1 << 40
    key = F.xxhash64(quoted("doc_id"), quoted("text"), F.lit("draw"))

    def drawn(wanted: int, n: int) -> Column:
        return F.pmod("key", F.lit(scale)) < min(scale, scale * wanted // max(n, 1))

    rows = small_batches(docs).select(quoted("doc_id").alias("doc_id"), key.alias("key"), *_columns())
    rows = rows.filter(drawn(labelled, n_known) | drawn(pool, n_docs)).dropDuplicates(["key"])
    some = rows.filter(drawn(labelled, n_known)).join(known, "doc_id").select("key", "y", "text", "lang", "source")
    rest = rows.filter(drawn(pool, n_docs)).join(known, "doc_id", "left_anti").select("key", F.lit(None).cast("int").alias("y"), "text", "lang", "source")
    table = some.unionByName(rest).mapInArrow(_features, "key long, y int, text array<int>, meta array<int>").toArrow()
    key_of, y_of = table["key"].to_numpy(), table["y"].to_pylist()
    text_of, meta_of = table["text"].to_pylist(), table["meta"].to_pylist()
    order = sorted(range(len(y_of)), key=lambda i: (key_of[i], y_of[i] is None, y_of[i] or 0))
    ours, others = [i for i in order if y_of[i] is not None], [i for i in order if y_of[i] is None]
    as_rows = lambda of, chosen: [np.array(of[i], np.int32) for i in chosen]
    y = np.array([int(y_of[i] > 0) for i in ours], np.int32)
    fold = np.array([(int(key_of[i]) >> 42) % FOLDS for i in ours], np.int64)
    return co_train(as_rows(text_of, ours), as_rows(meta_of, ours), y, fold, (as_rows(text_of, others), as_rows(meta_of, others)))


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score_text, score_meta, score and kept of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = small_batches(docs).select(quoted("doc_id").alias("doc_id"), *_columns())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Places()
        for batch in batches:
            text, lang, source = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = shared.value.scores([text_places(t, cache) for t in text], [meta_places(*x) for x in zip(text, lang, source, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), pa.array(out[2] >= threshold)],
                                             ["doc_id", "score_text", "score_meta", "score", "kept"])

    schema = narrow.select("doc_id", *[F.lit(0.0).alias(c) for c in ("score_text", "score_meta", "score")], F.lit(True).alias("kept")).schema
    return narrow.mapInArrow(score, schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the sample and score all rows."""
    return scored(docs, fit(docs, labels))
