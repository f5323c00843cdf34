"""Running totals over an ordered value, at any number of values.

The input holds one row per group and value, so a frequent value is one row. Up to a checked number of
rows a plain window does it. Beyond, a window over a whole order would be a single task, so the order
is cut into blocks at approximate quantiles, each block is summed on its own, and the totals of the
earlier blocks are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.functions.columns import is_text, type_of
from colscope.functions.staging import staged

BLOCKS = 128  # a power of two
ONE_WINDOW_ROWS = 2_000_000


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    by: list[str] | None = None,
    descending: bool = False,
    bounds_by: list[str] | None = None,
    blocks: int = BLOCKS,
    one_window_rows: int | None = None,
) -> DataFrame:
    """Add, for each `sums` entry {new: source}, the total of `source` over all earlier rows.

    `df` has one row per (`by`, `value`). The row itself is not included in the total. The total over
    all rows of the group is added as `<new>_all`. With `bounds_by`, a part of `by`, the groups sharing
    it are cut into blocks at the same bounds, which suits many groups over one domain.
    """
    by = by or []
    limit = ONE_WINDOW_ROWS if one_window_rows is None else one_window_rows
    df = staged(df)

    def order(c: Column) -> Column:
        return c.desc() if descending else c.asc()

    def before(c: Column, keys: list[str]) -> Column:
        window = W.partitionBy(*keys).orderBy(order(F.col(value))).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(window), F.lit(0))

    if df.count() <= limit:  # answered from the file footers
        out = df.withColumns({n: before(F.col(s), by) for n, s in sums.items()})
        return out.withColumns({f"{n}_all": F.sum(s).over(W.partitionBy(*by)) for n, s in sums.items()})

    text = is_text(type_of(df, value))
    probs = [i / blocks for i in range(1, blocks)]
    cuts = F.percentile_approx(F.col(value).cast("double"), probs, blocks * 20).alias("_bounds")
    shared = by if bounds_by is None else bounds_by
    if text and not by:
        cut = df.withColumn("_bounds", _text_bounds(df, value, blocks))
    elif shared:
        cut = df.join(df.groupBy(*shared).agg(cuts), shared)
    else:
        cut = df.withColumn("_bounds", df.agg(cuts).scalar())
    # The block number is how many bounds lie below the value, found by halving steps.
    cut = cut.withColumn("_block", F.lit(0))
    step = blocks // 2
    while step:
        v = F.col(value) if text else F.col(value).cast("double")
        below = F.get("_bounds", F.col("_block") + (step - 1)) < v
        cut = cut.withColumn("_block", F.col("_block") + F.when(below, step).otherwise(0))
        step //= 2
    cut = staged(cut.drop("_bounds"))

    earlier = W.partitionBy(*by).orderBy(order(F.col("_block"))).rowsBetween(W.unboundedPreceding, -1)
    per_block = cut.groupBy(*by, "_block").agg(*[F.sum(s).alias(f"_t_{n}") for n, s in sums.items()])
    offsets = per_block.select(
        *by, "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(W.partitionBy(*by)).alias(f"{n}_all") for n in sums],
    )
    out = cut.join(offsets, [*by, "_block"])
    out = out.withColumns({n: F.col(f"_o_{n}") + before(F.col(s), [*by, "_block"]) for n, s in sums.items()})
    return out.drop("_block", *[f"_o_{n}" for n in sums])


def _text_bounds(df: DataFrame, value: str, blocks: int) -> Column:
    """Evenly spaced values of a sorted sample of fixed size, drawn by hash."""
    sample = df.select(value).orderBy(F.xxhash64(value)).limit(blocks * 20)
    ordered = sample.agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda i: F.get("v", F.floor(i * F.size("v") / blocks).cast("int"))
    return ordered.select(F.transform(F.sequence(F.lit(1), F.lit(blocks - 1)), at)).scalar()


def average_ranks(counts: DataFrame, value: str = "value", n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Add `rank`, the mean rank of the rows sharing a value, to a (value, n) table."""
    out = running_totals(counts, value, {"_before": n}, by)
    return out.withColumn("rank", F.col("_before") + (F.col(n) + 1) / 2).drop("_before", "_before_all")


def positions(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Add each row's place from 0 among the rows that share `by`, in order of `order`, whatever the types and however many
    rows. The order comes from a range partitioning: rows are numbered inside a partition, and the counts of the
    partitions before are added. Equal rows are told apart by chance."""
    keys = [*by, *order]
    ordered = staged(staged(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")  # the upper bits are the number of the partition
    counts = ordered.groupBy(*by, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.withColumn("_part", part).join(starts, [*by, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_shift", "_at")
