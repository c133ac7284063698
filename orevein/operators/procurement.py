"""Stock, demand, purchases, and what enterprises could do together. Quantities of different units are never added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def total(column: str, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.sum(column), F.lit(0.0)), digits)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent, 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100 / whole, digits)).otherwise(0.0)


def stock_status(available: Column, on_hand: Column) -> Column:
    """OUT of stock, LOW below a fifth of what is held, else AVAILABLE."""
    return F.when(available <= 0, "OUT").when(available < on_hand * 0.2, "LOW").otherwise("AVAILABLE")


def inventory_summary(stock: DataFrame) -> DataFrame:
    """Sums by unit, and how many common codes two or more enterprises hold in that unit."""
    held = stock.where("available > 0").groupBy("uom", "common_code").agg(F.countDistinct("enterprise").alias("n")).groupBy("uom").agg(F.count_if(F.col("n") >= 2).alias("shared_codes"))
    sums = stock.groupBy("uom").agg(total("on_hand").alias("on_hand"), total("reserved").alias("reserved"), total("available").alias("available"), F.countDistinct("material_id").alias("materials"))
    return sums.join(held, "uom", "left").withColumn("shared_codes", F.coalesce("shared_codes", F.lit(0).cast("long"))).withColumn("available_pct", share(F.col("available"), F.col("on_hand")))


def by_enterprise(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Sums of each enterprise in its main unit (the largest first measure), with a flag if it has others too."""
    by_unit = rows.groupBy("enterprise", "uom").agg(*(total(m).alias(m) for m in measures), F.countDistinct("material_id").alias("materials"))
    order = Window.partitionBy("enterprise").orderBy(F.col(measures[0]).desc(), "uom")
    ranked = by_unit.withColumn("_k", F.row_number().over(order)).withColumn("uom_mixed", F.count("*").over(Window.partitionBy("enterprise")) > 1)
    return ranked.where("_k = 1").drop("_k")


def inventory_by_code(stock: DataFrame) -> DataFrame:
    sums = stock.groupBy("common_code", "uom").agg(
        total("on_hand").alias("on_hand"), total("available").alias("available"), F.countDistinct("enterprise").alias("enterprises"), F.countDistinct("material_id").alias("materials")
    )
    return sums.withColumn("status", stock_status(F.col("available"), F.col("on_hand")))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows in a total order, with the count of rows and of pages (1 at least)."""
    n = rows.agg(F.count("*").alias("total_rows"))
    counted = n.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("long"))
    at = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return at.withColumn("total_rows", counted.select("total_rows").scalar()).withColumn("total_pages", counted.select("total_pages").scalar())


def inventory_detail(stock: DataFrame, code: str) -> DataFrame:
    rows = stock.where(F.col("common_code") == code)
    return rows.groupBy("enterprise", F.coalesce("plant", F.lit("MAIN-PLANT")).alias("plant"), "uom").agg(total("on_hand").alias("on_hand"), total("available").alias("available"), F.max("day").alias("latest"))


def demand_by_code(need: DataFrame) -> DataFrame:
    """Sums of a code and unit with the enterprises' own sums as a list in order of their names."""
    own = need.groupBy("common_code", "uom", "enterprise").agg(total("required").alias("required"), total("forecast").alias("forecast"))
    listed = F.array_sort(F.collect_list(F.struct("enterprise", "required")))
    out = own.groupBy("common_code", "uom").agg(total("required").alias("required"), total("forecast").alias("forecast"), F.count("*").alias("enterprises"), listed.alias("l"))
    return out.withColumn("breakdown", F.array_join(F.transform("l", lambda x: F.concat(x["enterprise"], F.lit("="), F.round(x["required"]).cast("long").cast("string"))), ";")).drop("l")


def demand_detail(need: DataFrame, code: str) -> DataFrame:
    rows = need.where(F.col("common_code") == code).groupBy("enterprise", "period", "uom").agg(total("required").alias("required"), total("forecast").alias("forecast"))
    return rows.withColumn("combined", F.round(F.sum("required").over(Window.partitionBy("period", "uom")), 2))


def opportunities(stock: DataFrame, need: DataFrame, least: int = 2) -> DataFrame:
    """Codes and units that `least` enterprises or more hold, need, or both."""
    held = stock.where("available > 0").groupBy("common_code", "uom").agg(F.countDistinct("enterprise").alias("holders"), total("available").alias("available")).where(F.col("holders") >= least)
    wanted = need.groupBy("common_code", "uom").agg(F.countDistinct("enterprise").alias("requesters"), total("required").alias("required")).where(F.col("requesters") >= least)
    both = held.join(wanted, ["common_code", "uom"], "full_outer")
    kind = F.when(F.col("holders").isNotNull() & F.col("requesters").isNotNull(), "SHARED_STOCK_AND_DEMAND").when(F.col("holders").isNotNull(), "SHARED_STOCK").otherwise("SHARED_DEMAND")
    zero = {"holders": 0, "requesters": 0, "available": 0.0, "required": 0.0}
    return both.withColumn("kind", kind).na.fill(zero)


def combined_by_uom(stock: DataFrame, need: DataFrame, code: str) -> DataFrame:
    """A code's stock against its demand; the net only where both are known in the unit."""
    held = stock.where(F.col("common_code") == code).groupBy("uom").agg(total("available").alias("available"))
    wanted = need.where(F.col("common_code") == code).groupBy("uom").agg(total("required").alias("required"))
    both = held.join(wanted, "uom", "full_outer").withColumn("net", F.round(F.col("required") - F.col("available"), 2))
    said = F.when(F.col("net").isNull(), "ONE_SIDED").when(F.col("net") > 0, "PROCURE").otherwise("COVERED")
    return both.withColumn("insight", said)


def purchase_history(bought: DataFrame, code: str) -> DataFrame:
    return bought.where(F.col("common_code") == code).select("po_number", "po_date", "enterprise", "supplier", "quantity", F.round("unit_price", 8).alias("unit_price"), "uom").orderBy(F.col("po_date").desc(), "po_number")


def price_variance(bought: DataFrame) -> DataFrame:
    """Each code's spread between the enterprises' mean prices, in a unit that two or more of them buy in."""
    own = bought.where("unit_price is not null").groupBy("common_code", "uom", "enterprise").agg(F.round(F.avg("unit_price"), 4).alias("price"))
    spread = own.groupBy("common_code", "uom").agg(F.count("*").alias("enterprises"), F.min("price").alias("least"), F.max("price").alias("most"), F.min_by("enterprise", F.struct("price", "enterprise")).alias("cheapest"))
    spread = spread.where("enterprises >= 2")
    return spread.withColumn("variance_pct", share(F.col("most") - F.col("least"), F.col("least"))).withColumn("saving_a_unit", F.round(F.col("most") - F.col("least"), 2))


def tender_aggregation(need: DataFrame, least: int = 2) -> DataFrame:
    out = need.groupBy("common_code", "uom", "period").agg(F.countDistinct("enterprise").alias("enterprises"), total("required").alias("bulk"), F.round(F.max("required"), 2).alias("largest"))
    return out.where(F.col("enterprises") >= least)


def surplus_pool(stock: DataFrame, need: DataFrame) -> DataFrame:
    """For each enterprise's demand of a code: what the others have available in the same unit."""
    held = stock.groupBy("common_code", "uom", "enterprise").agg(F.sum("available").alias("own"))
    everyone = held.groupBy("common_code", "uom").agg(F.sum("own").alias("whole"))
    wanted = need.groupBy("common_code", "uom", "enterprise").agg(F.sum("required").alias("required"))
    at = wanted.join(everyone, ["common_code", "uom"]).join(held, ["common_code", "uom", "enterprise"], "left")
    others = F.round(F.col("whole") - F.coalesce("own", F.lit(0.0)), 2)
    out = at.select("common_code", "uom", "enterprise", F.round("required", 2).alias("required"), others.alias("elsewhere")).where("elsewhere > 0")
    return out.withColumn("poolable", F.least("required", "elsewhere"))


def uom_volumes(stock: DataFrame, units: list[str]) -> DataFrame:
    """An enterprise's volume in each of some units and in all others, each in a column of its own."""
    other = ~F.col("uom").isin(units)
    return stock.groupBy("enterprise").agg(*(F.round(F.sum(F.when(F.col("uom") == u, F.col("on_hand")).otherwise(0.0)), 2).alias(f"volume_{u.lower()}") for u in units), F.round(F.sum(F.when(other, F.col("on_hand")).otherwise(0.0)), 2).alias("volume_other"), F.count("*").alias("records"))


def consumption_summary(need: DataFrame) -> DataFrame:
    """Members, enterprises, main unit, total and mean, of each code; the main unit is the one with most records."""
    units = need.groupBy("common_code", "uom").agg(F.count("*").alias("n"), F.sum("required").alias("s"))
    main = units.groupBy("common_code").agg(F.max_by("uom", F.struct("n", "uom")).alias("primary_uom"), F.count("*").alias("units"))
    sums = need.groupBy("common_code").agg(F.countDistinct("material_id").alias("members"), F.countDistinct("enterprise").alias("enterprises"))
    own = units.select("common_code", F.col("uom").alias("primary_uom"), F.round("s", 2).alias("total"), F.round(F.col("s") / F.col("n"), 4).alias("mean"))
    return sums.join(main, "common_code").join(own, ["common_code", "primary_uom"])


def purchase_recency(bought: DataFrame, as_of: str, active_days: int = 365) -> DataFrame:
    """First and last purchase of each code, days since as_of, and how many suppliers it has."""
    out = bought.groupBy("common_code").agg(F.min("po_date").alias("earliest"), F.max("po_date").alias("latest"), F.countDistinct("supplier").alias("suppliers"))
    days = F.datediff(F.lit(as_of).cast("date"), F.col("latest")).cast("long")
    return out.withColumn("days_since", days).withColumn("state", F.when(days <= active_days, "ACTIVE").otherwise("INACTIVE")).withColumn("diverse", F.col("suppliers") > 1)


def high_volume(need: DataFrame, least_rows: int = 5) -> DataFrame:
    """Rows' 95th percentile, linearly interpolated, of units of a code with enough rows, and how many rows exceed it."""
    marks = quantiles(need, "required", ["common_code", "uom"], {"p95": 0.95}).where(F.col("n") >= least_rows)
    return marks.select("common_code", "uom", "n", F.round("p95", 4).alias("p95_volume"), F.col("above_p95").alias("above"))


def plant_distribution(stock: DataFrame) -> DataFrame:
    return stock.groupBy("plant", "enterprise", "uom").agg(total("on_hand").alias("volume"), F.countDistinct("material_id").alias("materials"))


def procurement_kpis(stock: DataFrame) -> DataFrame:
    """Codes of one enterprise and of several, and each unit's volume, in long form (metric, value)."""
    codes = stock.groupBy("common_code").agg(F.countDistinct("enterprise").alias("n")).agg(F.count("*").alias("codes"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("n") == 1).alias("single"))
    tall = codes.select(F.expr("stack(3, 'codes', 1D * codes, 'multi_enterprise', 1D * multi, 'standalone', 1D * single) as (metric, value)"))
    return tall.unionByName(stock.groupBy(F.concat(F.lit("volume_"), "uom").alias("metric")).agg(total("on_hand").alias("value")))


def opportunity_signals(need: DataFrame, bought: DataFrame, least: int = 2) -> DataFrame:
    """Typed signals with the metric, the threshold and the evidence that set each off."""
    shared = need.groupBy("common_code").agg(F.countDistinct("enterprise").alias("m"), F.countDistinct("material_id").alias("e")).where(F.col("m") >= least)
    shared = shared.select("common_code", F.lit("MULTI_ENTERPRISE_DEMAND").alias("type"), F.lit("enterprises").alias("metric"), F.col("m").cast("double").alias("value"), F.lit(float(least)).alias("threshold"), F.concat("e", F.lit(" materials")).alias("evidence"))
    peaks = high_volume(need).where("above > 0").select("common_code", F.lit("HIGH_VOLUME").alias("type"), F.concat(F.lit("p95_"), "uom").alias("metric"), F.col("above").cast("double").alias("value"), F.col("p95_volume").alias("threshold"), F.concat("n", F.lit(" rows")).alias("evidence"))
    makers = bought.groupBy("common_code").agg(F.countDistinct("supplier").alias("m")).where(F.col("m") >= least)
    makers = makers.select("common_code", F.lit("SUPPLIER_DIVERSITY").alias("type"), F.lit("suppliers").alias("metric"), F.col("m").cast("double").alias("value"), F.lit(float(least)).alias("threshold"), F.concat("m", F.lit(" suppliers")).alias("evidence"))
    return shared.unionByName(peaks).unionByName(makers)


def dominant_plants(stock: DataFrame) -> DataFrame:
    """How many plants hold a code, and which has most records of it; ties go to the last by name."""
    each = stock.groupBy("common_code", "plant").agg(F.count("*").alias("n"))
    return each.groupBy("common_code").agg(F.count("*").alias("plants"), F.max_by("plant", F.struct("n", "plant")).alias("dominant_plant"))


def purchase_diversity(bought: DataFrame) -> DataFrame:
    """Makers and parts of each code's purchases, and whether there is more than one maker."""
    out = bought.groupBy("common_code").agg(F.countDistinct("supplier").alias("makers"), F.countDistinct("material_id").alias("parts"))
    return out.withColumn("diverse", F.col("makers") > 1)


def demand_signals(need: DataFrame, least: int = 2, many: int = 10) -> DataFrame:
    """Codes that `least` enterprises need, with evidence as id, status and decision; `many` of them are to be bought for together."""
    out = need.groupBy("common_code").agg(F.countDistinct("enterprise").alias("enterprises")).where(F.col("enterprises") >= least)
    return out.withColumn("threshold", F.lit(least).cast("long")).withColumn("evidence", F.concat_ws("|", "common_code", F.lit("PENDING"), F.when(F.col("enterprises") >= many, "AGGREGATE").otherwise("REVIEW")))
