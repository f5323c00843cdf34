"""Connected components of links between 64-bit nodes by alternating large-star and small-star rounds.

Each round replaces links by links to the least neighbour, so long chains shorten quickly; every round is written to the
shared folder. Only counts reach the driver. Nodes with very many links are joined by broadcast, as there can be only few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import with_groups


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    joined = with_groups(both, least, "a", "n", 2 * total)
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    least = staged(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = with_groups(links, least, "a", "n", total).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none."""
    twice = links.groupBy("a").count().filter("count > 1").limit(1).count()
    inner = links.select("a").join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
    return not twice and not inner


def roots(links: DataFrame) -> DataFrame:
    """(a, b) with b the least node reachable from a, for each node that isn't the least of its component. `links` has the
    long columns a and b in any order and number, a loop being no link; no links give no rows."""
    ordered = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(ordered)
    while not _are_stars(now):
        wide = staged(_large_star(now, now.count()))
        now = staged(_small_star(wide, wide.count()))
    return now
