"""Connected components of a link table, by alternating large and small stars.

Every step is a minimum per node and a join back on the node. The minimum combines before the
shuffle and the join's hot keys can be split at run time, so no node's neighbours are ever gathered
in one place. Each round's links are cut from their lineage by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstate.llm import common


def _state(links: DataFrame) -> tuple:
    with common.cleaned(links.sparkSession):
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
    return (
        both.join(least, F.col("a") == F.col("n"))
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = links.join(least, F.col("a") == F.col("n")).filter(F.col("b") != F.col("m"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest node that it can reach; roots are left out.

    links has columns a and b of one orderable type; order, repeats and loops don't matter. An empty
    table gives an empty one.
    """
    links = common.settled(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(links)
    while before[0]:
        links = common.settled(_small_star(_large_star(links)))
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
