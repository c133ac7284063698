"""Exact quantiles by key without a buffer of the key's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orevein.session import prepare


def quantiles(rows: DataFrame, value: str, keys: list[str], wanted: dict[str, float], parts: int | None = None) -> DataFrame:
    """keys, n, and for each name in wanted its quantile of value (0 to 1, linearly interpolated) and above_<name>, the number of values that exceed it.

    Equal values of a key are counted first; the counts are range-partitioned by key and value and written down, so a key with very many values lies in many ranges and none of them
    is sorted but the few that hold a wanted rank. Nulls count nowhere, a key without values has no row, null is a key like any other. NaN is larger than all numbers.
    """
    prepare(rows.sparkSession)
    named = [f"_k{j}" for j in range(len(keys))]
    counts = rows.where(F.col(value).isNotNull()).select(*(F.col(k).alias(a) for k, a in zip(keys, named, strict=True)), F.col(value).cast("double").alias("_v")).groupBy(*named, "_v").agg(F.count("*").alias("_c"))
    ranged = (counts.repartitionByRange(parts, *named, "_v") if parts else counts.repartitionByRange(*named, "_v")).withColumn("_part", F.spark_partition_id()).checkpoint()
    whole = Window.partitionBy(*named)  # over a key's ranges, not its values
    sizes = ranged.groupBy("_part", *named).agg(F.sum("_c").alias("_s")).select(
        "*", F.sum("_s").over(whole).alias("n"), F.coalesce(F.sum("_s").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    places = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    holds = [(F.col("_before") <= end) & (end < F.col("_before") + F.col("_s")) for at in places.values() for end in (F.floor(at), F.ceil(at))]
    few = sizes.where(reduce(lambda a, b: a | b, holds)).select(F.col("_part").alias("_at"), *(F.col(a).alias(f"{a}_") for a in named), "n", "_before")
    same = [F.col("_part") == F.col("_at"), *(F.col(a).eqNullSafe(F.col(f"{a}_")) for a in named)]
    upto = F.sum("_c").over(Window.partitionBy("_part", *named).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    placed = ranged.join(few, same).select(*named, "n", "_v", "_c", upto.alias("_upto"))
    ends = []
    for j, at in enumerate(places.values()):
        for side, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            inside = (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
            ends.append(F.max(F.when(inside, F.struct(F.col("_v").alias("v"), F.col("_upto").alias("upto")))).alias(f"_{side}{j}"))
    found = placed.groupBy(*named, "n").agg(*ends)
    out = []
    for j, (name, at) in enumerate(places.items()):
        low, high = F.col(f"_l{j}"), F.col(f"_h{j}")
        mixed = (F.ceil(at) - at) * low["v"] + (at - F.floor(at)) * high["v"]
        exact = F.when(low["v"] == high["v"], low["v"]).otherwise(F.greatest(low["v"], F.least(high["v"], mixed)))
        out += [exact.alias(name), (F.col("n") - F.when(exact >= high["v"], high["upto"]).otherwise(low["upto"])).alias(f"above_{name}")]
    return found.select(*(F.col(a).alias(k) for k, a in zip(keys, named, strict=True)), "n", *out)
