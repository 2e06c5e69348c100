"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.session import cut_lineage

#: Links that one task of a round handles at least; small tables need no more tasks and files than that.
TASK_LINKS = 500_000


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows. ``links`` has each link once, a < b."""
    both = links.union(links.selectExpr("b AS a", "a AS b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").selectExpr("m AS a", "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return moved.selectExpr("m AS a", "b").union(moved.selectExpr("m AS a", "a AS b").where("a < b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node reaches.

    ``links`` has the non-null columns ``a`` and ``b`` of one orderable type; returns ``node`` and ``root`` for every
    node of a link between two different nodes. Rounds of large-star and small-star steps replace links by links
    to the smallest node seen until all are such: about the logarithm of the longest path. A round groups and joins
    links by node, with sums before each shuffle, and ends in a written table; nothing but two numbers of it comes
    to the driver. A node with very many links is a skewed join key, which the skew join splits.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    held, seen = cut_lineage(ordered), None
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return held.selectExpr("b AS node", "a AS root").union(held.selectExpr("a AS node", "a AS root").distinct())
        seen = state
        held = cut_lineage(_small_star(_large_star(held)).coalesce(-(-2 * state[0] // TASK_LINKS)))
