"""Near-duplicates by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

Words are runs of characters other than ASCII white space, A-Z lower-cased; the features of a text are its shingles of
consecutive words, repeats included, a shorter text being one shingle. A fingerprint bit is set when it is set in more
than half of the 64-bit hashes; a text without words, or null, has fingerprint zero and links like any other.

Two fingerprints that differ in at most `distance` bits agree on all but `distance` of any blocks that the 64 bits are
split into. For each choice of the agreeing blocks the distinct fingerprints are keyed by those bits, sorted by key, and
compared inside a key only; a key passes on at most one link a member, not its pairs. Keys with more than `CROWD` members
are keyed again by the same rule on their remaining bits, and what stays crowded is compared in pairs of chunks, so that
no task gets more than a bounded group and no link is lost. Links make components; exact copies are one fingerprint
throughout, so a group of copies of any size costs one row here.

A null doc_id counts as larger than any other. `representatives` keeps one row of each component: that with the smallest
doc_id, then the smallest hash of the text; of rows that repeat both, one.
An empty table gives an empty table. Other columns are not read, and pass through `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.staging import discard, staged
from colscope.llm import components
from colscope.llm.common import quoted, small_batches, unpacked, whole_rows, with_groups, without

SHINGLE = 4
DISTANCE = 4
CROWD = 2_048
PIECE = 1 << 14
BATCH = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*[words[k:] for k in range(min(shingle, len(words)))], strict=False)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, runs))
    n = max(len(words) - shingle + 1, 1)
    h = np.fromiter(hashes, np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = h[at : at + PIECE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                                         ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the fingerprint as a signed long) of each row."""
    narrow = small_batches(docs).select(quoted(id).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_key"), quoted(text).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(partial(_fingerprints, shingle=shingle), schema)


def _split(bits: int, blocks: int) -> list[int]:
    """Masks of `blocks` blocks of about equal size that share out the set bits of a mask."""
    places = [p for p in range(64) if bits >> p & 1]
    edges = [round(len(places) * k / blocks) for k in range(blocks + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(bits: int, distance: int, blocks: int) -> list[int]:
    """The agreeing bits for each choice of all but `distance` blocks."""
    return [sum(chosen) for chosen in combinations(_split(bits, blocks), blocks - distance)]


def blocks_for(count: int, distance: int) -> int:
    """The fewest blocks, one more than `distance` at least, whose keys hold a few random fingerprints each."""
    blocks = distance + 2
    while 64 * (blocks - distance) // blocks < np.log2(max(count, 1)) - 3 and blocks < distance + 4:
        blocks += 1
    return blocks


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value)


def _keyed(table: DataFrame, choices: list[tuple[int, int]], given: Column | None = None) -> DataFrame:
    """(part, key, fp) for each (part, mask), or for those whose part is `given` on the row."""
    keys = F.array(*[F.struct(F.lit(n).alias("part"), F.col("fp").bitwiseAND(_signed(mask)).alias("key")) for n, mask in choices])
    return table.select(F.explode(keys if given is None else F.filter(keys, lambda k: k["part"].bitwiseAND(F.lit(255)) == given)).alias("k"),
                        "fp").select("k.part", "k.key", "fp")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining the sets of a[i] and b[i]; a root is the least member."""
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def _linked(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group and fingerprint: each row that some other links to, with the least row of its set."""
    root, step = np.arange(len(fp)), 1
    left = np.flatnonzero(group[1:] == group[:-1])
    while len(left):
        near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= distance]
        near = near[root[near] != root[near + step]]
        if len(near):
            root = _unite(root, near, near + step)
        step += 1
        left = left[left + step < len(fp)]
        left = left[group[left] == group[left + step]]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a sorted partition; a group that a batch cuts waits for its rest."""
    names = ["part", "key", "chunk"]
    held = [np.zeros(0, np.int64) for _ in range(4)]

    def done(columns: list[np.ndarray]) -> pa.RecordBatch:
        changes = np.zeros(len(columns[3]), bool)
        for c in columns[:3]:
            changes[1:] |= c[1:] != c[:-1]
        a, b = _linked(np.cumsum(changes), columns[3].view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        new = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in [*names, "fp"]]
        held = [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
        if len(held[0]) >= BATCH:
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield done([c[:cut] for c in held])
                held = [c[cut:] for c in held]
    if len(held[0]):
        yield done(held)


def _compared(rows: DataFrame, distance: int) -> DataFrame:
    """Links inside (part, key, chunk)."""
    ready = rows.repartition("part", "key", "chunk").sortWithinPartitions("part", "key", "chunk", "fp")
    return ready.mapInArrow(partial(_links, distance=distance), "a long, b long")


def _sized(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most `crowd` members, and those of the others with the size n; None if there are none."""
    crowded = staged(rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd))
    if crowded.isEmpty():
        discard(crowded)
        return rows, None
    return rows.join(crowded, ["part", "key"], "left_anti"), rows.join(crowded, ["part", "key"])


def links(table: DataFrame, count: int, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Enough links (a, b) between the distinct fingerprints `fp` of `table` to connect all that differ in at most
    `distance` bits with one another."""
    every = (1 << 64) - 1
    blocks = blocks_for(count, distance)
    first = masks(every, distance, blocks)
    rows = staged(_keyed(table, list(enumerate(first))))
    plain, crowded = _sized(rows, crowd)
    found = _compared(plain.withColumn("chunk", F.lit(0).cast("long")), distance)
    if crowded is not None:
        # part is n + 256 * m from here on: the m-th choice inside the n-th
        second = [(n + 256 * m, mask | inner) for n, mask in enumerate(first)
                  for m, inner in enumerate(masks(every & ~mask, distance, distance + 2))]
        again = staged(_keyed(crowded.select("fp", F.col("part").alias("given")), second, F.col("given")))
        plain, dense = _sized(again, crowd)
        found = found.unionByName(_compared(plain.withColumn("chunk", F.lit(0).cast("long")), distance))
        if dense is not None:
            chunks = F.ceil(F.col("n") / F.lit(crowd))
            own = F.pmod(F.xxhash64("fp"), chunks)
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1),
                                lambda k: F.greatest(k, own) * chunks + F.least(k, own))
            found = found.unionByName(_compared(dense.select("part", "key", "fp", F.explode(pairs).alias("chunk")), distance))
    return found.distinct()


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """fp, component_id, the hash of the text that represents the component, and n (rows) of the distinct fingerprints."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("text_key").alias("text")))
    table = staged(prints.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")))
    count = table.count()
    reached = components.roots(links(table.select("fp"), count, distance))
    rooted = table.join(reached.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = staged(rooted.select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    groups = staged(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("size")))
    return staged(with_groups(rooted, groups, "root", "size", count).select(
        "fp", F.col("first.id").alias("component_id"), F.col("first.text").alias("component_text"), "n"))


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """A row for each row of `docs`: doc_id, text_key, fp, component_id, the smallest doc_id reachable, and component_text, the
    text_key of the row that stands for the component."""
    prints = staged(fingerprints(docs, id, text, shingle))
    joined = with_groups(prints, _classes(prints, distance), "fp", "n", prints.count())
    return joined.select("doc_id", "text_key", "fp", "component_id", "component_text")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of `docs`, all columns."""
    marked = staged(mark(docs, id, text))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_text"))
    gone = staged(marked.filter(~first).select("doc_id", "text_key").distinct())
    again = staged(marked.filter(first).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    keys = [("doc_id", quoted(id)), ("text_key", F.xxhash64(quoted(text)))]
    if again.isEmpty():
        return without(docs, gone, keys)
    alone = without(docs, staged(gone.unionByName(again)), keys)
    rows = docs.select(whole_rows(docs), *[c.alias(n) for n, c in keys])
    same = rows["doc_id"].eqNullSafe(again["doc_id"]) & (rows["text_key"] == again["text_key"])
    return alone.unionByName(unpacked(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_key"])))
