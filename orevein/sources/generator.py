"""Made catalogs for tests and trials: items that several enterprises hold under their own wording, items that only look alike, and items of one enterprise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of items by kind, in per cent.
KINDS = {"MULTI_ENTERPRISE": 40, "AMBIGUOUS": 30, "STANDALONE": 30}
ENTERPRISES = "NORTH SOUTH EAST WEST CENTRAL COAST HILL DELTA".split()
NOUNS = ["BALL VALVE", "HEX BOLT", "PIPE ELBOW", "GASKET SHEET", "BEARING", "POWER CABLE", "OIL SEAL", "FLANGE"]
GRADES = ["SS304", "SS316", "A105", "WCB", "EN8", "PVC"]


def _drawn(values: list[str], seed: int, what: str) -> Column:
    """One of the values, by a hash of the item, the seed and what is drawn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("item", F.lit(seed), F.lit(what)), F.lit(len(values))) + 1).cast("int"))


def catalog(spark: SparkSession, items: int | DataFrame, seed: int = 42) -> DataFrame:
    """item, kind, enterprise, code, description, of so many items or of those in a column item: the same rows for the same seed, however many tasks make them.

    Of 100 items in a row, KINDS says how many are of which kind. An item of several enterprises has a row in two to four, worded in three ways; an ambiguous
    one has two rows that differ in size; a standalone one has one row.
    """
    place = F.pmod(F.col("item") * 37, F.lit(100))
    first, second = KINDS["MULTI_ENTERPRISE"], KINDS["MULTI_ENTERPRISE"] + KINDS["AMBIGUOUS"]
    kind = F.when(place < first, "MULTI_ENTERPRISE").when(place < second, "AMBIGUOUS").otherwise("STANDALONE")
    several = (F.pmod(F.xxhash64("item", F.lit(seed), F.lit("rows")), F.lit(3)) + 2).cast("int")
    numbers = spark.range(items).withColumnRenamed("id", "item") if isinstance(items, int) else items.select(F.col("item").cast("long"))
    base = numbers.withColumn("kind", kind)
    base = base.withColumn("noun", _drawn(NOUNS, seed, "noun")).withColumn("grade", _drawn(GRADES, seed, "grade")).withColumn("size", F.pmod(F.xxhash64("item", F.lit(seed), F.lit("size")), F.lit(48)) + 2)
    n = F.when(kind == "MULTI_ENTERPRISE", several).when(kind == "AMBIGUOUS", 2).otherwise(1)
    rows = base.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.pmod(F.xxhash64("item", F.lit(seed), F.lit("enterprise")) + F.col("k"), F.lit(len(ENTERPRISES)))
    size = F.when(F.col("kind") == "AMBIGUOUS", F.col("size") + F.col("k") * 5).otherwise(F.col("size")).cast("string")
    parts = [F.col("noun"), F.col("grade"), F.concat(size, F.lit(" MM"))]
    text = F.when(F.col("k") % 3 == 0, F.concat_ws(" ", *parts)).when(F.col("k") % 3 == 1, F.lower(F.concat_ws(", ", parts[0], parts[2], parts[1]))).otherwise(F.concat_ws(" - ", parts[1], parts[0], parts[2]))
    return rows.select("item", "kind", F.element_at(F.array(*map(F.lit, ENTERPRISES)), (at + 1).cast("int")).alias("enterprise"), F.format_string("ITM-%06d-%d", "item", "k").alias("code"), text.alias("description"))


def exported(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Every table as JSON lines below root, for another system to load; where each of them is."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in tables}
