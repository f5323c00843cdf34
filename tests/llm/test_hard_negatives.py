"""Hard negatives beside brute force, on awkward vectors, in several portions and blocks."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colscope.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, `a.b` int"


def brute(rows, every=50, positives=5, negatives=3):
    t = []
    for r in rows:
        v = r["embedding"]
        if r["label"] is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] is not None and r["vec_id"] % 7 == 0 else r["label"]
        t.append((r["vec_id"], label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (anchor, label, a) in enumerate(t):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a, v)), i is None, i or 0, k, i) for m, (i, k, v) in enumerate(t) if m != n),
                        key=lambda s: (-s[0], s[1], s[2], s[3]))
        for score, _, _, _, positive in [s for s in scored if s[3] == label][:positives]:
            found = [s for s in scored if s[3] != label and 50 * score <= 100 * s[0] <= 95 * score][:negatives]
            out += [(anchor, positive, rank, s[4], score, s[0]) for rank, s in enumerate(found, 1)]
    return Counter(out)


def mined(df, **options):
    rows = df.withColumn("label", hn.shifted(F.col("vec_id"), F.col("label")))
    return Counter(tuple(r) for r in hn.mined(rows, F.col("vec_id") % options.pop("every", 50) == 0, **options).collect())


def awkward(seed, rows, dims, scale=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        v = (np.round(rng.normal(size=dims), 1) * scale).tolist()  # ties are frequent
        v = [None, [], [None, *v[1:]], [math.nan, *v[1:]], [math.inf, *v[1:]], v[:2], [0.0] * dims][i % 40] if i % 40 < 7 else v
        out.append((None if i % 23 == 0 else i // 2 if i % 5 == 0 else i, v, None if i % 31 == 0 else int(rng.integers(0, 3)), "x", i))
    return out


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 12, 2.0 ** 20])
def test_awkward_rows(spark, scale):
    """Nulls, odd numbers, short and empty vectors, repeated ids, ties; sums in float32, float64 and Python integers."""
    df = spark.createDataFrame(awkward(3, 240, 6, scale), SCHEMA)
    wanted = brute(df.collect(), 10)
    assert wanted and mined(df, every=10) == wanted


def test_portions_and_blocks(spark, monkeypatch):
    df = spark.createDataFrame(awkward(4, 300, 8), SCHEMA)
    wanted = brute(df.collect(), 5)
    assert mined(df, every=5, portion_values=64) == wanted


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame(awkward(5, 60, 4), SCHEMA)
    assert mined(df.limit(0)) == {}
    assert mined(df.filter("vec_id % 50 <> 0")) == {}
    assert hn.mined(df, F.lit(None).cast("boolean")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_query(spark, folder):
    from colscope.llm.queries import QUERIES

    found = Counter(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, folder).collect())
    assert found == brute(spark.read.parquet(f"{folder}/embeddings.parquet").collect())


def blocks_of(rows, dims, kind):
    table = pa.table({"row": pa.array(range(len(rows)), pa.int64()), "id": pa.array(range(len(rows)), pa.int64()),
                      "label": pa.array([0] * len(rows), pa.int64()), "vector": pa.array(rows, pa.list_(pa.float64()))})
    return hn.blocks(iter(table.to_batches(max_chunksize=7)), dims, kind)


@pytest.mark.parametrize("kind", [np.float32, np.float64, object])
@pytest.mark.parametrize("rows", [1, 5, 16])
def test_scan_finds_all_in_its_windows(monkeypatch, kind, rows):
    monkeypatch.setattr(hn, "BLOCK_VALUES", rows * 9)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(50, 9)).round(2)
    whole = np.floor(256 * data)
    anchor = whole[0].astype(kind) if kind != object else np.array([int(x) for x in whole[0]], object)
    scores = (whole @ whole[0]).astype(int).tolist()
    alive_rows = set(rng.choice(50, 30, replace=False).tolist())
    seen, windows = [], [(20_000, 60_000), (100_000, 400_000)]
    for block in blocks_of(data.tolist(), 9, np.dtype(kind)):
        assert len(block.row) <= rows and (block.least <= block.most).all()
        alive = np.isin(block.row, list(alive_rows))
        places, found = hn.scan(anchor, block, alive, [w[0] for w in windows], [w[1] for w in windows])
        seen += zip(block.row[places].tolist(), [int(x) for x in found])
    wanted = [(n, scores[n]) for n in sorted(alive_rows) if any(a <= scores[n] <= z for a, z in windows)]
    assert sorted(seen) == wanted


def test_window_in_whole_numbers():
    for score in range(0, 500):
        low, high = hn.Span().of(score)
        assert [n for n in range(600) if 50 * score <= 100 * n <= 95 * score] == list(range(low, high + 1))
