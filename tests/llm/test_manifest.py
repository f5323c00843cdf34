"""The Merkle manifest beside a version in memory, on given and on awkward rows, with blocks of several sizes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from colscope.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(row, more=0):
    out = b""
    for name in manifest.COLUMNS:
        value = row[name]
        data = b"" if value is None else str(value + more if name == "n_chars" else value).encode()
        out += b"-" if value is None else str(len(data)).encode() + b":" + data
    return hashlib.sha256(out).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((other < place, level[other]) if other < len(level) else None)
        place //= 2
    return out


def folded(node, steps):
    for step in steps:
        node = digest(node) if step is None else digest(step[1], node) if step[0] else digest(node, step[1])
    return node


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, encoded(r)), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels_of([key[-1] for key, _ in sorted(by[k], key=lambda x: x[0])]) for k in langs}
    top = levels_of([trees[k][-1][0] for k in langs])
    out = []
    for n, lang in enumerate(langs):
        for i, ((_, _, leaf), r) in enumerate(sorted(by[lang], key=lambda x: x[0])):
            steps = path(trees[lang], i) + path(top, n)
            changed = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            found = folded(encoded(r, 1) if changed else leaf, steps)
            out.append((r["doc_id"], leaf, trees[lang][-1][0], top[-1][0], digest(*[s[1] for s in steps if s]), found, found == top[-1][0]))
    return sorted(out, key=str)


def audited(df, bits=manifest.BLOCK_BITS):
    return sorted((tuple(r) for r in manifest.audited(manifest.manifest(df, manifest.few_changed(), bits)).collect()), key=str)


@pytest.mark.parametrize("bits", [manifest.BLOCK_BITS, 2])
def test_manifest(documents, bits):
    found = audited(documents, bits)
    assert found == brute(documents.collect())
    assert 0 < sum(not r[-1] for r in found) < len(found)


@pytest.mark.parametrize("bits", [1, 3])
def test_manifest_edges(edge, edge_rows, empty, bits):
    """Null and repeated ids, languages and rows, and columns with the operator's own names."""
    assert audited(edge.withColumn("tree", F.lit(1)).withColumn("witness", F.lit("x")), bits) == brute(edge_rows)
    assert audited(empty, bits) == []


def test_many_trees_and_one_leaf(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("lang"),
                                   F.when(F.col("id") % 3 > 0, F.col("id")).alias("n_chars"), F.lit("t").alias("text"))
    assert audited(rows, 2) == brute(rows.collect())
    assert audited(rows.limit(1)) == brute(rows.limit(1).collect())


def test_largest_count(spark):
    rows = spark.sql("select 7L as doc_id, 's' as source, 'en' as lang, 9223372036854775807L as n_chars, 't' as text")
    assert audited(rows) == brute(rows.collect())


@pytest.mark.parametrize("count", [1, 2, 3, 7, 8, 13])
def test_appender(count):
    nodes = [hashlib.sha256(bytes([n])).digest() for n in range(count)]
    block = manifest.Appender()
    for n in nodes:
        block.append(n)
    root = block.close(0)
    levels = levels_of([n.hex() for n in nodes])
    assert root.hex() == levels[-1][0]
    for place, witness in enumerate(block.witnesses):
        assert manifest.climbed(nodes[place], b"".join(witness)) == root
        assert [s.hex() for s in manifest.siblings(b"".join(witness))] == [s[1] for s in path(levels, place) if s]


def test_changed_leaf_is_found(documents):
    """A witness of one row doesn't fit another."""
    rows = manifest.manifest(documents.limit(40)).collect()
    for a, b in zip(rows, rows[1:]):
        assert manifest.climbed(bytes(a.node), bytes(a.witness)) == bytes(a.top)
        assert a.node == b.node or manifest.climbed(bytes(b.node), bytes(a.witness)) != bytes(a.top)
