"""What the operators share: words, whole rows, and dropping rows by key without moving the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm import bloom

BLANKS = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"
TEXTS_A_BATCH = 500


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(df: DataFrame) -> DataFrame:
    """Have Arrow batches of this session hold fewer rows: the default of 10,000 is for numbers, and would keep tens or
    hundreds of MB of texts several times over in each task. A smaller setting is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXTS_A_BATCH:
        conf.set(name, str(TEXTS_A_BATCH))
    return df


def whole_rows(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def without(docs: DataFrame, dropped: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """`docs` without the rows whose keys are in `dropped` (one column for each name in `keys`; null equals null).

    A Bloom filter of the dropped keys, of bounded size, lets the rows that are surely kept pass where they are; only
    the rows that it flags are shuffled, to an exact anti join.
    """
    names = [name for name, _ in keys]
    hashed = F.xxhash64(*[F.col(f"key.{n}") for n in names])
    seen = bloom.present(dropped.select(F.xxhash64(*names).alias("hash")), dropped.count())
    rows = small_batches(docs).select(whole_rows(docs), F.struct(*[c.alias(n) for n, c in keys]).alias("key"))
    rows = rows.withColumn("maybe", bloom.contains(docs.sparkSession, hashed, seen))
    gone = dropped.select(F.struct(*names).alias("gone"))
    left = rows.filter("maybe").join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return unpacked(rows.filter(~F.col("maybe"))).unionByName(unpacked(left))


HOT_GROUPS = 1_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows` joined to their group (one row a key, not null) by `key`. `size` is the groups' number of rows of `total`:
    those with more than one part in HOT_GROUPS, of which there are less than HOT_GROUPS, are broadcast, so that a group of
    any size stays spread out; the rest are joined by shuffle."""
    hot = F.col(size) > max(1, total // HOT_GROUPS)
    flagged = groups.filter(hot).select(F.col(key).alias("hot_key"))
    rows_of = lambda how: rows.join(F.broadcast(flagged), F.col(key) == F.col("hot_key"), how)
    large = rows_of("left_semi").join(F.broadcast(groups.filter(hot)), key)
    return large.unionByName(rows_of("left_anti").join(groups.filter(~hot), key))
