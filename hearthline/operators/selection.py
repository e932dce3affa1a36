"""Exact values by rank within groups, without bringing a group to one task.

Each round splits what may hold the rank by cuts from a mergeable sketch, counts the cells between them, and keeps the one that holds it, so
about a thousandth is left each time; a group's last values, MOST at most, are sorted as an array. Cells are counted before they are
shuffled, and the cuts are a row a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Values of a group that are sorted in one task at most.
MOST = 10_000
#: Cells of a round, and the sketch's accuracy (a rank is off by 1/ACCURACY of all at most).
CELLS, ACCURACY = 64, 10_000


def at_rank(rows: DataFrame, value: Column, by: Sequence[str], rank: Column, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """by, n, value and next: of each group the number of its values, the one at a rank from 0 and the one after it (null: none).

    rank is an expression over n. Null values are no values; groups without any are left out, null keys are a group.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    on = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}{k}")) for k in keys]
    named = lambda p: [F.col(k).alias(f"{p}{k}") for k in keys]
    alive = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.cast("double").alias("__v")).where("__v is not null")
    least_and_most = (F.count("*").alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    groups = cut(alive.groupBy(*keys).agg(*least_and_most).withColumn("n", F.col("__m")).withColumn("__rank", rank.cast("long")).withColumn("__next", F.lit(None).cast("double")))
    done = []
    while True:
        small = (F.col("__m") <= most) | (F.col("__lo") == F.col("__hi"))
        done.append(groups.where(small))
        groups = groups.where(~small)
        if groups.isEmpty():
            break
        inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
        here = alive.join(groups.select(*named("s"), "__lo", "__hi"), [*on("s"), inside]).drop("__lo", "__hi")
        cuts = here.groupBy(*keys).agg(F.percentile_approx("__v", [i / cells for i in range(1, cells)], ACCURACY).alias("__cuts"))
        cuts = cuts.select(*named("c"), "__cuts")
        cell = F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))
        exact = F.array_contains("__cuts", F.col("__v"))  # a cut itself is a cell of its own, so that repeated values don't hold a round up
        dealt = here.join(cuts, on("c")).select(*keys, "__v", (2 * cell + F.when(exact, 0).otherwise(1)).alias("__cell"))
        counted = dealt.groupBy(*keys, "__cell").agg(*least_and_most)
        order = Window.partitionBy(*keys).orderBy("__cell")  # of a group no more rows than twice the cells
        counted = counted.withColumns({"__upto": F.sum("__m").over(order), "__after": F.lead("__lo").over(order)})
        old = groups.select(*named("g"), "n", "__rank", "__next")
        holds = (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__m"))
        groups = cut(
            counted.join(old, on("g")).where(holds)
            .select(*keys, "__m", "__lo", "__hi", "n", (F.col("__rank") - F.col("__upto") + F.col("__m")).alias("__rank"), F.coalesce("__after", "__next").alias("__next"))
        )
    found = reduce(DataFrame.unionByName, done)
    last = found.where("__lo < __hi").select(*named("s"), F.col("__lo").alias("__a"), F.col("__hi").alias("__b"))
    arrays = alive.join(last, [*on("s"), F.col("__v").between(F.col("__a"), F.col("__b"))]).groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__vs"))
    joined = found.join(arrays.select(*named("a"), "__vs"), on("a"), "left")
    at = lambda i: F.when(F.col("__vs").isNull(), F.when(i < F.col("__m"), F.col("__lo"))).otherwise(F.get("__vs", i.cast("int")))
    return joined.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", at(F.col("__rank")).alias("value"), F.coalesce(at(F.col("__rank") + 1), F.col("__next")).alias("next"))


def median(rows: DataFrame, value: Column, by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """by, n, median: the middle value of each group, of an even number the mean of the two middle ones."""
    found = at_rank(rows.withColumn("__one", F.lit(1)), value, by or ["__one"], F.floor((F.col("n") - 1) / 2), most)
    return found.select(*by, "n", F.when(F.col("n") % 2 == 1, F.col("value")).otherwise((F.col("value") + F.col("next")) / 2).alias("median"))


def upper_median(rows: DataFrame, value: Column, by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """by, n, median: the middle value, of an even number the upper one."""
    found = at_rank(rows.withColumn("__one", F.lit(1)), value, by or ["__one"], F.floor(F.col("n") / 2), most)
    return found.select(*by, "n", F.col("value").alias("median"))
