"""Exact duplicates by two-pass Bloom filtering: only rows whose hash may repeat are shuffled.

Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row with the
most code points stays, then the smallest doc_id (null last). The first pass counts, for each place of the filter, the
rows that hit it; the second lets every row pass whose places are not all shared. The rest are grouped by SHA-256, with
partial aggregation before the shuffle, and joined back, the largest groups by broadcast.

One row of a group stays, whatever its ids: among rows with as many code points and the same doc_id, or none, the one with
the smaller hash of the original text, and of rows that repeat all of these the first. An empty table gives an empty table. Other columns are not read by `mark` and pass through `deduplicate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.staging import discard, staged
from colscope.llm import bloom
from colscope.llm.common import BLANKS, quoted, small_batches, unpacked, whole_rows, with_groups


def _text(text: str) -> Column:
    return F.coalesce(quoted(text), F.lit(""))


def _digest(text: str) -> Column:
    return F.sha2(F.regexp_replace(_text(text), BLANKS, ""), 256)


def _best() -> Column:
    return F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "own", "row"))


def _digests(docs: DataFrame, id: str, text: str) -> DataFrame:
    return staged(docs.select(quoted(id).alias("doc_id"), F.length(_text(text)).cast("long").alias("n_chars"),
                              _digest(text).alias("text_sha256"), F.xxhash64(_text(text)).alias("own"), F.monotonically_increasing_id().alias("row")))


def _filter(digests: DataFrame):
    return bloom.repeated(digests.select(F.xxhash64("text_sha256").alias("hash")), digests.count())


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs, id, text)
    shared = _filter(digests)
    rows = digests.withColumn("maybe", bloom.contains(docs.sparkSession, F.xxhash64("text_sha256"), shared))
    alone = rows.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256")
    rest = rows.filter("maybe")
    groups = staged(rest.groupBy("text_sha256").agg(_best().alias("best"), F.count("*").alias("group_size")))
    stays = F.col("row") == F.col("best.row")
    return alone.unionByName(with_groups(rest, groups, "text_sha256", "group_size", digests.count()).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns."""
    digests = _digests(docs, id, text)
    shared = _filter(digests)
    flagged = bloom.contains(docs.sparkSession, F.xxhash64("text_sha256"), shared)
    groups = digests.withColumn("maybe", flagged).filter("maybe").groupBy("text_sha256").agg(_best().alias("best"))
    best = staged(groups.select(F.col("text_sha256").alias("sha"), F.col("best.id").alias("id"), F.col("best.own").alias("hash")))
    discard(digests)
    rows = small_batches(docs).select(whole_rows(docs), quoted(id).alias("doc_id"), F.xxhash64(_text(text)).alias("own"),
                       _digest(text).alias("text_sha256")).withColumn("maybe", flagged)
    same = ((F.col("text_sha256") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")))
    stay = rows.filter("maybe").join(best, same, "left_semi").dropDuplicates(["text_sha256", "doc_id", "own"])
    return unpacked(rows.filter(~F.col("maybe"))).unionByName(unpacked(stay))
