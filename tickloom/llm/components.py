"""Connected components of a graph given as a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours are tied to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tied = down.join(_least(down), "a")
    return tied.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node with a link to another node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each an aggregation by node and a join that
    adaptive execution can split where a node has very many links. The number of rounds grows with the logarithm of the
    number of nodes; each ends in a checkpoint in the shared folder. Null ends and links to oneself are left out."""
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    now = cut_lineage(now)
    seen = _state(now)
    while True:
        now = cut_lineage(_small_star(_large_star(now)).where("a <> b").distinct())
        if (state := _state(now)) == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
