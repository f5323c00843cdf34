"""A Merkle manifest of a table: a leaf a row, a tree a language, a tree over those trees, and a witness for every leaf.

Nodes of a tree are appended in order. An open subtree keeps the nodes that were appended to it and their witnesses, the
siblings on the way up so far; as soon as two subtrees of one height stand side by side they become one, and the witnesses
in each are extended by the root of the other. Appending is aligned: places in a tree are cut into blocks of
2 ** `BLOCK_BITS`, a task streams through whole blocks in order and holds one at a time, and the root of each block is
appended at the next level, as any node, until a tree has one root. So no task sees a whole tree, and the witness of a
leaf is its own in its block, then its block's, and so on up to the root of all.

Places come from a range partitioning in order of the leaves: rows are numbered inside a partition, and the counts of the
partitions before are added. A parent is H, the SHA-256 in hex digits, of its children's digests; a last node without a
neighbour has a parent of its own. A tree with one node is that node.

Leaves stand by doc_id (null first); those with equal doc_id by their digest. A null lang is a tree of its own and the
first. Repeated rows are leaves of their own. A leaf with null doc_id is not tampered with, nor can one be whose n_chars is
null. An empty table gives an empty table. Columns other than the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.staging import staged
from colscope.llm.common import quoted

BLOCK_BITS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FEW = 10_000  # trees and range partitions whose counts are broadcast
NONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"  # which side of the path a sibling stands on
STEP = 33  # bytes of a step of a witness: side and digest
CARRIED = ("tree", "place", "node", "forged", "doc_id")


def parent(*children: bytes) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


class Appender:
    """One block of a tree: nodes are appended in order, and `close` completes the witnesses of all of them."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[list[bytes]]]] = []  # height, root, witnesses
        self.witnesses: list[list[bytes]] = []

    def append(self, node: bytes) -> None:
        own: list[bytes] = []
        self.witnesses.append(own)
        self.open.append((0, node, [own]))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        (_, right, after), (height, left, before) = self.open.pop(), self.open.pop()
        for w in before:
            w.append(RIGHT + right)
        for w in after:
            w.append(LEFT + left)
        self.open.append((height + 1, parent(left, right), before + after))

    def close(self, height: int) -> bytes:
        """The root, at this height at least: what has no neighbour is raised alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            own, root, inside = self.open.pop()
            if self.open and self.open[-1][0] == own:
                self.open.append((own, root, inside))
                self._join()
                continue
            for w in inside:
                w.append(NONE + bytes(32))
            self.open.append((own + 1, parent(root), inside))
        return self.open[0][1]


def climbed(node: bytes, witness: bytes) -> bytes:
    """The root that a node and its witness lead to."""
    for at in range(0, len(witness), STEP):
        side, sibling = witness[at : at + 1], witness[at + 1 : at + STEP]
        node = parent(node) if side == NONE else parent(sibling, node) if side == LEFT else parent(node, sibling)
    return node


def siblings(witness: bytes) -> Iterator[bytes]:
    return (witness[at + 1 : at + STEP] for at in range(0, len(witness), STEP) if witness[at : at + 1] != NONE)


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of tree and place, block by block, with their witnesses and, on its first row, the root of the block."""
    def finished(rows: list[dict], block: Appender, carried: pa.Schema) -> pa.RecordBatch:
        wide = rows[0]["total"] > 1 << bits
        root = block.close(bits if wide else 0)
        out = [{**r, "block": r["place"] >> bits, "witness": b"".join(w), "root": None, "wide": wide}
               for r, w in zip(rows, block.witnesses, strict=True)]
        out[0]["root"] = root
        added = [("block", pa.int64()), ("witness", pa.binary()), ("root", pa.binary()), ("wide", pa.bool_())]
        return pa.RecordBatch.from_pylist(out, pa.schema([*[carried.field(c) for c in CARRIED], *[pa.field(*x) for x in added]]))

    rows, block, now = [], Appender(), None
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["tree"], r["place"] >> bits)
            if rows and key != now:
                yield finished(rows, block, batch.schema)
                rows, block = [], Appender()
            now = key
            rows.append(r)
            block.append(r["node"])
    if rows:
        yield finished(rows, block, batch.schema)


def appended(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """tree, place, node, forged, doc_id, block, witness (inside the block), root (of the block, on its first row) and wide
    (whether the tree goes on above the block), from the first five and the tree's total. One level of the forest."""
    rows = nodes.select(*CARRIED, "total").repartition("tree", F.shiftright("place", bits)).sortWithinPartitions("tree", "place")
    schema = T.StructType([*[rows.schema[c] for c in CARRIED], T.StructField("block", T.LongType()), T.StructField("witness", T.BinaryType()),
                           T.StructField("root", T.BinaryType()), T.StructField("wide", T.BooleanType())])
    return staged(rows.mapInArrow(partial(_blocks, bits=bits), schema))


def grown(nodes: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Witnesses (tree, place, node, forged, doc_id, witness: up to the tree's root) and roots (tree, root) of a forest."""
    levels = [appended(nodes, bits)]
    while levels[-1].filter("wide").limit(1).count():
        roots = levels[-1].filter(F.col("wide") & F.col("root").isNotNull()).select(
            "tree", F.col("block").alias("place"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("forged"),
            F.lit(None).cast(nodes.schema["doc_id"].dataType).alias("doc_id"))
        totals = roots.groupBy(F.col("tree").alias("t")).agg(F.count("*").alias("total"))
        levels.append(appended(roots.join(totals, F.col("tree").eqNullSafe(F.col("t"))), bits))
    above = None
    for level in reversed(levels):
        if above is not None:  # a tree that ends at this level has no row above
            up = above.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), F.col("witness").alias("rest"))
            same = F.col("wide") & (F.col("block") == F.col("up_place")) & F.col("tree").eqNullSafe(F.col("up_tree"))
            level = level.join(up, same, "left").withColumn("witness", F.concat("witness", F.coalesce("rest", F.lit(b""))))
        above = level.select(*CARRIED, "witness")
    roots = [level.filter(~F.col("wide") & F.col("root").isNotNull()).select("tree", "root") for level in levels]
    return above, reduce(DataFrame.unionByName, roots)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with their place from 0 in their tree, and the tree's total, in order of the columns `order`. The rows must be
    staged, as they are read twice."""
    names = ["tree", *order]
    ordered = staged(rows.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")  # the upper bits are the number of the partition
    counts = ordered.groupBy("tree", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    ahead = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"),
                                  F.sum("n").over(tree).alias("total")))
    same = F.col("tree").eqNullSafe(F.col("t")) & (part == F.col("p"))
    starts = F.broadcast(starts) if starts.count() <= FEW else starts
    return ordered.join(starts, same).withColumn("place", F.col("at") + F.col("shift")).drop("t", "p", "shift", "at")


def _field(value: Column) -> Column:
    data = value.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(data).cast("string").cast("binary"), F.lit(b":"), data), F.lit(b"-"))


def leaf(row: dict[str, Column]) -> Column:
    """The digest of a row, from the five columns."""
    return F.unhex(F.sha2(F.concat(*[_field(row[c]) for c in COLUMNS]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, lang, node (the leaf), forged (the leaf with 1 added to n_chars where `tampered` holds, else null), witness
    (for each step up a byte for the side of the sibling, 0 none, 1 left, 2 right, and its digest), subroot and top."""
    row = {c: quoted(c) for c in COLUMNS}
    more = {**row, "n_chars": row["n_chars"].cast("decimal(38,0)") + 1}
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & row["n_chars"].isNotNull()
    leaves = staged(docs.select(row["lang"].cast("binary").alias("tree"), row["doc_id"].alias("doc_id"), leaf(row).alias("node"),
                                F.when(changed, leaf(more)).alias("forged"), F.rand(1).alias("salt")))  # splits repeated rows
    inside, subroots = grown(staged(numbered(leaves, ["doc_id", "node", "salt"])), bits)
    trees = staged(subroots.select(F.lit(b"").alias("tree"), F.col("tree").alias("doc_id"), F.col("root").alias("node"),
                                   F.lit(None).cast("binary").alias("forged")))
    outside, tops = grown(staged(numbered(trees, ["doc_id"])), bits)
    top = tops.first()
    over = staged(outside.select(F.col("doc_id").alias("name"), F.col("node").alias("subroot"), F.col("witness").alias("rest"),
                                 F.lit(top["root"] if top else b"").alias("top")))
    over = F.broadcast(over) if over.count() <= FEW else over
    return inside.join(over, F.col("tree").eqNullSafe(F.col("name"))).select(
        "doc_id", F.col("tree").cast("string").alias("lang"), "node", "forged", F.concat("witness", "rest").alias("witness"), "subroot", "top")


def _judged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            proof = hashlib.sha256(b"".join(s.hex().encode() for s in siblings(r["witness"]))).hexdigest()
            folded = climbed(r["forged"] or r["node"], r["witness"])
            out.append({"doc_id": r["doc_id"], "leaf": r["node"].hex(), "subroot": r["subroot"].hex(), "root": r["top"].hex(),
                        "proof_sha256": proof, "folded_root": folded.hex(), "verified": folded == r["top"]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("doc_id"), *schema]))


def audited(witnessed: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the digest of the siblings on the way, the root that the forged leaf, else the leaf, folds
    to, and whether it is the root; of a manifest."""
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = pa.schema([*[(n, pa.string()) for n in names], ("verified", pa.bool_())])
    schema = T.StructType([witnessed.schema["doc_id"], *[T.StructField(n, T.StringType()) for n in names], T.StructField("verified", T.BooleanType())])
    return witnessed.drop("lang").mapInArrow(partial(_judged, schema=kinds), schema)


def few_changed(id: str = "doc_id") -> Column:
    """Rows to tamper with: a seventh by the checksum of the id."""
    return F.crc32(quoted(id).cast("string").cast("binary")) % 7 == 0
