"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component for each node of links (a, b: long): the component is its smallest node.

    Large stars and small stars by turns: each node's larger neighbours, then its smaller ones, are linked to the smallest node
    around. A round only regroups links, whose number never grows, and the number of rounds goes with the logarithm of the size of a
    component. Each round is written to the shared folder, so the lineage stays short. Links of a node to itself and
    repeated ones do no harm; an empty table gives no rows.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = stored(small.where("a <> b").distinct(), "links")
        is_now = state(new)
        dropped(now)
        now = new
        if is_now == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
