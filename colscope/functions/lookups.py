"""Values found by key in a table that counts its keys, however frequent some keys are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1_000


def looked_up(rows: DataFrame, table: DataFrame, keys: dict[str, Column], value: str, out: str, n: str = "n") -> DataFrame:
    """Add `out`, the `value` of the row of `table` whose columns equal `keys` (column: expression over `rows`), else null.

    `table` has one row a key, and in `n` how many rows have it. Keys of more than one row in `HOT`, fewer than that many,
    are broadcast; the others are joined by shuffle, over which the rows that have found theirs are spread.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    frequent = F.col(n) > max(1, total // HOT)
    own = {f"_key {i}": c for i, c in enumerate(keys.values())}
    names = {f"_table key {i}": F.col(c) for i, c in enumerate(keys)}

    def side(part: DataFrame) -> DataFrame:
        return part.select(*[c.alias(k) for k, c in names.items()], F.col(value).alias("_found"))

    def same() -> Column:
        out = F.lit(True)
        for a, b in zip(own, names, strict=True):
            out = out & (F.col(a) == F.col(b))
        return out

    first = rows.withColumns(own).join(F.broadcast(side(table.filter(frequent))), same(), "left")
    first = first.withColumn(out, F.col("_found")).drop(*names, "_found")
    salt = F.when(F.col(out).isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT))).cast("long")
    rest = side(table.filter(~frequent)).withColumn("_salt", F.lit(0).cast("long"))
    second = first.withColumn("_row salt", salt).join(rest, same() & (F.col("_row salt") == F.col("_salt")), "left")
    return second.withColumn(out, F.coalesce(out, "_found")).drop(*own, *names, "_found", "_salt", "_row salt")
