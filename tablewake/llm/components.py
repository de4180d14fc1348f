"""Connected components of a graph given as links, by alternating stars.

Each round moves every node's larger neighbours to its smallest neighbour (large star), then its
smaller ones (small star), until nothing changes: a logarithmic number of rounds in practice. A
round is two aggregations with partial minima and two equi joins; its links are written to the
shared folder, so neither plans nor lost executors carry over. Nothing is brought to the driver
but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewake.sources.scratch import cut


def _mark(links: DataFrame) -> tuple:
    sums = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return tuple(sums)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has links, from links (a, b); root is the smallest node of the component.

    A root has no row of its own. Links with a null end and loops are ignored; repeated links are harmless.
    """
    links = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "a", "b")
    now = cut(links.where("a IS NOT NULL AND b IS NOT NULL AND lo < hi").select("hi", "lo").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(small.union(least.select("hi", "m")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
