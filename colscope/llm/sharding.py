"""Shards by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number u in (0, 1) from the digest of key and shard; the shard with the least -ln(u) / weight takes the
record, so shards get records in proportion to their weights, and adding a shard moves records only into it. Positions in
a shard are gapless: the records of a shard are ordered by digest, ranges of digests are counted, and the counts before a
range are added to the position inside it, so no task orders a whole shard.

A null key counts as the empty string; a null text has no bytes and the checksum of none. Rows that repeat a key share its
shard and get positions of their own, in order of size and checksum. An empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import quoted

ROWS_A_RANGE = 1_024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that takes a key. Ties, of chance 2**-52, go to the lower number."""
    def cost(n: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{n}")).cast("binary")), 1, 13)
        return -F.log((F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))

    return F.array_min(F.array(*[F.struct(cost(n, w).alias("cost"), F.lit(n).alias("shard"))
                                 for n, w in enumerate(weights) if w > 0]))["shard"]


def shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the shard under the weights `grown` (null without them)."""
    key = F.coalesce(quoted(id).cast("string"), F.lit(""))
    data = F.coalesce(quoted(text), F.lit("")).cast("binary")
    rows = staged(docs.select(
        quoted(id).alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(F.concat_ws(":", key, F.crc32(data)).cast("binary")).alias("digest")))
    digits, count = 1, rows.count()
    while 16 ** digits * len(weights) * ROWS_A_RANGE < count:
        digits += 1
    rows = rows.withColumn("range", F.substring("digest", 1, digits))
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "range").orderBy("digest", "doc_id", "size")
    placed = rows.withColumn("place", F.row_number().over(inside)).join(starts, ["shard", "range"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard")
