"""Connected components of links between keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def with_least(links: DataFrame, total: int) -> DataFrame:
    """links with m, the least key among a and its b's. A hub's count and least key are aggregated before they are shuffled, and a hub
    with many of all links is joined by a broadcast, so its links are not gathered."""
    facts = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
    return join_counted(links, facts.withColumn("m", F.least("a", "m")), "a", total)


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the least key of its component) of every node with a link; links has columns a and b.

    In a large star each node hands its larger neighbours to the least node it sees; in a small star it hands itself and
    its smaller neighbours there. Links never grow in number, and what is left are stars around the roots. Each round is
    cut off in the checkpoint folder; nothing but counts comes to the driver. Links with a null end, and from a node to itself, say
    nothing and are left out; repeated links count once; no links give an empty result. A run that still has a path after
    most_rounds raises, as its components would be wrong.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    at = cut(links.where("a <> b").select(a, b).distinct())
    done = at.isEmpty()
    for _ in range(most_rounds):
        if done:
            break
        total = at.count()
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small = with_least(large, total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        at = cut(small.where("a <> b").distinct())
        done = is_stars(at)
    if not done:
        raise RuntimeError(f"paths are left after {most_rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def is_stars(links: DataFrame) -> bool:
    """Whether each node is either linked to one node, or what others are linked to."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    worst = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).agg(F.max(F.when((F.col("out") > 1) | (F.col("out") > F.col("least")) & (F.col("least") == 0), 1))).first()[0]
    return worst is None
