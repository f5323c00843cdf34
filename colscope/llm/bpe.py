"""Byte-level BPE by a global shuffle of distinct words, and decoding by the table of token bytes.

Texts are split into pre-tokens by a pattern; each is merged by ranks on its own, without special tokens. Tasks take
documents in chunks of bounded size, number the distinct pre-tokens of a chunk, and write the numbers by position (one
row a chunk, compressed, bucketed by chunk) and the words in slices by their hash (one row a chunk and slice). Only the
words are then shuffled by slice: all copies of a word meet in one task, which encodes it once and sends its ids back to
the chunks that have it. There they are joined with the numbers, which stay in their buckets, and every document is put
together by position. A word comes at most once from a chunk, so " the" is no hot key; a task's memory is bounded by a
chunk and by `MOST_CACHED` words.

Null texts count as empty; an empty text has no ids and decodes to no bytes. A document longer than a chunk is a chunk of
its own. Repeated rows come out repeated; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.staging import bucketed
from colscope.llm.common import quoted, small_batches

CHUNK_CHARS = 1 << 23
SLICES = 256
MOST_CACHED = 1 << 17
CODEC = "zstd"
NUMBERS, PLACES = -1, -2  # in the place of a slice: rows of a chunk that are no words


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, a line each: base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, the leftmost first, until none is left that has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 200:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + (1 << 32)
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while costs and (best := min(costs)) < none:
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of merges over a linked list; merges of parts that changed are skipped."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        if start >= 0 and (middle := end[start]) < n:
            rank = ranks.get(word[start : end[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, end[middle]))

    for start in range(n - 1):
        offer(start)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < n:
            before[stop] = start
        offer(start)
        offer(before[start])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


@cache
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


# Numbers are written with one byte for the smallest and up to four for the largest, first bytes first; by class of length
# the smallest number and the first byte it starts at.
SMALLEST = np.array([0, 1 << 7, (1 << 7) + (1 << 14), (1 << 7) + (1 << 14) + (1 << 21)], np.int32)
FIRST_BYTE = np.array([0, 128, 192, 224], np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Compressed numbers below 2**29, bytes of the same place together."""
    kind = np.searchsorted(SMALLEST[1:], values.astype(np.int32), "right").astype(np.uint8)
    rest = values.astype(np.int32) - SMALLEST[kind]
    places = [(FIRST_BYTE[kind] + (rest >> (8 * kind.astype(np.int32)))).astype(np.uint8)]
    for k in (1, 2, 3):
        longer = kind >= k
        places.append((rest[longer] >> 8 * (kind[longer].astype(np.int32) - k) & 255).astype(np.uint8))
    data = np.concatenate(places).tobytes()
    return np.array([len(values), len(data)], "<u4").tobytes() + pa.compress(data, CODEC, asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n, size = np.frombuffer(packed, "<u4", 2).tolist()
    data = np.frombuffer(pa.decompress(packed[8:], size, CODEC, asbytes=True), np.uint8)
    kind = np.searchsorted(FIRST_BYTE[1:].astype(np.uint8), data[:n], "right").astype(np.uint8)
    values, at = data[:n].astype(np.int32) - FIRST_BYTE[kind], n
    for k in (1, 2, 3):
        longer = np.flatnonzero(kind >= k)
        values[longer] = values[longer] << 8 | data[at : at + len(longer)]
        at += len(longer)
    return values + SMALLEST[kind]


def _packed_words(words: list[bytes]) -> bytes:
    data = b"".join(words)
    lengths = _packed(np.fromiter(map(len, words), np.int64, len(words)))
    return np.array([len(lengths), len(data)], "<u4").tobytes() + lengths + pa.compress(data, CODEC, asbytes=True)


def _unpacked_words(packed: bytes) -> list[bytes]:
    skip, size = np.frombuffer(packed, "<u4", 2).tolist()
    data = pa.decompress(packed[8 + skip :], size, CODEC, asbytes=True)
    ends = np.cumsum(_unpacked(packed[8 : 8 + skip])).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _chunks(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, pattern: str, slices: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: a row with doc_ids, words per document and the numbers by position, a row with the slice of each
    number, and a row for each slice with its words in order of their numbers."""
    find = _compiled(pattern).findall
    schema = pa.schema([("chunk", pa.string()), ("slice", pa.int32()), ("ids", pa.list_(id_type)),
                        ("n_words", pa.list_(pa.int32())), ("data", pa.binary()), ("words", pa.bool_())])
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids: list = []
    codes: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        name, words = uuid.uuid4().hex, [w.encode("utf-8", "surrogatepass") for w in numbers]
        flat = np.concatenate(codes)
        # frequent words get small numbers, which are shorter
        often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[often] = np.arange(len(words), dtype=np.int32)
        place = np.fromiter((crc32(words[i]) for i in often.tolist()), np.int64, len(words)) % slices
        rows = [(name, NUMBERS, ids, [len(c) for c in codes], _packed(rank[flat])), (name, PLACES, None, None, _packed(place))]
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(slices + 1)).tolist()
        mine = often[order].tolist()
        rows += [(name, k, None, None, _packed_words([words[i] for i in mine[a:b]]))
                 for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] >= 0 for r in rows])], schema=schema)
        numbers.clear()
        ids.clear()
        codes.clear()

    for batch in batches:
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if ids and size + len(text) > chars:
                yield from flush()
                size = 0
            found = find(text)
            ids.append(id)
            codes.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
            size += len(text)
    if ids:
        yield from flush()


def _encoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The ids of the words of each (chunk, slice); a word that several chunks have is encoded once."""
    ranks = shared.value
    cached: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for packed in batch.column("data"):
            ids = []
            for word in _unpacked_words(packed.as_py()):
                found = cached.get(word)
                if found is None:
                    if len(cached) >= MOST_CACHED:
                        cached.clear()
                    found = cached[word] = encode_word(word, ranks)
                ids.append(found)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
            first = _packed(lengths)
            out.append(np.array([len(first)], "<u4").tobytes() + first + _packed(flat))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("slice"), pa.array(out, pa.binary())], ["chunk", "slice", "data"])


def _assembled(key, chunk: pa.Table, words: pa.Table, table) -> pa.Table:
    """The documents of a chunk with their ids, and what these decode to by the broadcast table of token bytes."""
    parts = dict(zip(words["slice"].to_pylist(), words["data"].to_pylist(), strict=True))
    lengths, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for k in sorted(parts):
        cut = 4 + int.from_bytes(parts[k][:4], "little")
        lengths.append(_unpacked(parts[k][4:cut]))
        flat.append(_unpacked(parts[k][cut:]).astype(np.int32))
    rows = {s: i for i, s in enumerate(chunk["slice"].to_pylist())}
    head = rows[NUMBERS]
    order = np.argsort(_unpacked(chunk["data"][rows[PLACES]].as_py()), kind="stable")
    size, ids = np.concatenate(lengths), np.concatenate(flat)
    first = np.cumsum(size) - size
    of = np.empty((2, len(order)), np.int32)  # by number: the place of its ids and how many
    of[:, order] = first, size
    numbers = _unpacked(chunk["data"][head].as_py())
    edges = np.cumsum([0, *chunk["n_words"][head].as_py()]).tolist()
    sequences, data, token = [], [], table.value.__getitem__
    for a, b in zip(edges, edges[1:], strict=False):
        start, n = of[:, numbers[a:b]]
        ends = np.cumsum(n)
        own = ids[np.repeat(start - ends + n, n) + np.arange(n.sum())]
        sequences.append(own.astype("<u4").tobytes())
        data.append(b"".join(map(token, own.tolist())))
    return pa.table([chunk["ids"][head].values, pa.array(sequences, pa.binary()), pa.array(data, pa.binary())],
                    names=["doc_id", "ids", "decoded"])


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id; no bytes for a number between that is no id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id: str = "doc_id", text: str = "text",
           slices: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Of each row of `docs`: doc_id, ids (binary, little-endian unsigned 32-bit integers), and decoded, the bytes that the
    ids decode to. Distinct words are spread over `slices` tasks, as many as there are shuffle partitions, `SLICES` at least."""
    from pyspark.sql.pandas.types import to_arrow_type

    slices = slices or max(SLICES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    narrow = small_batches(docs).select(quoted(id).alias("doc_id"), quoted(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType([
        T.StructField("chunk", T.StringType()), T.StructField("slice", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("n_words", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType()), T.StructField("words", T.BooleanType())])
    pieces = bucketed(narrow.mapInArrow(lambda batches: _chunks(batches, arrow, pattern, slices, chunk_chars), schema),
                      "chunk", "words", compression="zstd")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    words = (pieces.filter("words").select("chunk", "slice", "data").repartition("slice")
             .mapInArrow(lambda batches: _encoded(batches, shared), "chunk string, slice int, data binary"))
    table = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    result = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    numbers = pieces.filter("not words").select("chunk", "slice", "ids", "n_words", "data")
    return numbers.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        lambda key, chunk, words: _assembled(key, chunk, words, table), result)


def decode(spark: SparkSession, ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that a column of ids (binary as `encode` gives it) decodes to: a map-side join with the table of token
    bytes. Null ids have none; an id beyond the table is an error, as no bytes stand for it."""
    shared = spark.sparkContext.broadcast(token_bytes(ranks))

    @F.pandas_udf("binary")
    def joined(rows: pd.Series) -> pd.Series:
        token = shared.value.__getitem__
        return rows.map(lambda x: b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())))

    return joined(ids)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
