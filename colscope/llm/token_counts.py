"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with two roots, for pieces that begin a word (`first`) and for those inside one. Each
node has a failure link, to the node of what is left after the longest matches are split off, and the number of pieces so
popped; a word is then read once, adding up numbers, and no piece is built. The count equals that of greedy longest-match.

Words are runs of characters other than ASCII white space. A word with a part that no piece matches is one unknown token.
A null or empty text has no words. Each distinct word is counted once in a task, in a cache of bounded size. Repeated rows
come out repeated; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colscope.llm.common import quoted, small_batches

FIRST = "▁"
MOST_CACHED = 1 << 17
LONG_WORD = 64


@dataclass
class Automaton:
    """Node 0 begins a word, node 1 continues one; `step` is keyed by node * 0x110000 + code point, `fail` is -1 for none."""

    step: dict[int, int]
    fail: list[int]
    popped: list[int]

    def count(self, word: str) -> int:
        """The number of pieces; -1 if a part of the word has no piece."""
        step, fail, popped = self.step, self.fail, self.popped
        node = pieces = 0
        for c in map(ord, word):
            while (to := step.get(node * 0x110000 + c)) is None:
                if fail[node] < 0:
                    return -1
                pieces += popped[node]
                node = fail[node]
            node = to
        while node > 1:
            if fail[node] < 0:
                return -1
            pieces += popped[node]
            node = fail[node]
        return pieces


def automaton(pieces: Iterable[str], first: str = FIRST) -> Automaton:
    """From pieces; those that begin a word start with `first`."""
    step: dict[int, int] = {}
    parent, label, final = [-1, -1], [0, 0], [False, False]
    level = {0: 0, 1: 0}
    for piece in pieces:
        if not piece:
            continue
        node = 0 if piece.startswith(first) else 1
        for c in map(ord, piece):
            to = step.get(node * 0x110000 + c)
            if to is None:
                to = step[node * 0x110000 + c] = len(parent)
                parent.append(node)
                label.append(c)
                final.append(False)
                level[to] = level[node] + 1
            node = to
        final[node] = True
    fail, popped = [-1] * len(parent), [0] * len(parent)
    for node in sorted(range(2, len(parent)), key=level.__getitem__):
        if final[node]:
            fail[node], popped[node] = 1, 1
            continue
        above = parent[node]
        at, n = fail[above], popped[above]
        while at >= 0 and (to := step.get(at * 0x110000 + label[node])) is None:
            n += popped[at]
            at = fail[at]
        if at >= 0:
            fail[node], popped[node] = to, n
    return Automaton(step, fail, popped)


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class _Counts(dict):
    """Pieces by word, in UTF-8."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        n = self.machine.count(FIRST + word.decode("utf-8", "surrogatepass"))
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[word] = n
        return n


def _counted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    counts = _Counts(shared.value)
    for batch in batches:
        out = np.zeros((3, batch.num_rows), np.int64)
        for i, text in enumerate(batch.column(1)):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
            out[:, i] = len(words), np.abs(n).sum(), (n < 0).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_tokens", "n_unknown"])


def counted(docs: DataFrame, machine: Automaton, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each row. The automaton, of the vocabulary's size, is broadcast."""
    narrow = small_batches(docs).select(quoted(id).alias("doc_id"), quoted(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]])
    return narrow.mapInArrow(lambda batches: _counted(batches, shared), schema)
