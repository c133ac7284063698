"""Profiles of catalogs: columns, texts, numbers, dates, codes and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def blank(c: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return c.isNull() | (F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "") == "")


def _tall(row: DataFrame, names: list[str], parts: list[str]) -> DataFrame:
    """One row of `name_part` columns as a row for each name."""
    arms = ", ".join(f"'{n}', " + ", ".join(f"`{n}_{p}`" for p in parts) for n in names)
    return row.select(F.expr(f"stack({len(names)}, {arms}) as (column_name, {', '.join(parts)})"))


def columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each column, in one pass: rows with a value, share without, share of distinct values, and a band of missingness."""
    aggregates = [e for n in names for e in (F.count(F.when(~blank(F.col(n)), 1)).alias(f"{n}_filled"), F.countDistinct(F.when(~blank(F.col(n)), F.col(n).cast("string"))).alias(f"{n}_values"), F.count("*").alias(f"{n}_whole"))]
    tall = _tall(rows.agg(*aggregates), names, ["filled", "values", "whole"])
    missing = F.when(F.col("whole") > 0, F.round((F.col("whole") - F.col("filled")) * 100 / F.col("whole"), 2)).otherwise(0.0)
    distinct = F.when(F.col("filled") > 0, F.round(F.col("values") * 100 / F.col("filled"), 2)).otherwise(0.0)
    band = F.when(missing == 0, "COMPLETE").when(missing < 5, "LOW").when(missing < 25, "MODERATE").otherwise("HIGH")
    return tall.select("column_name", "filled", missing.alias("missing_pct"), distinct.alias("distinct_pct"), band.alias("band"))


def lengths(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Characters and words of a text column."""
    n, words = F.length(column), F.size(F.split(F.trim(F.col(column)), r"\s+"))
    return rows.groupBy(*keys).agg(
        F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 2).alias("mean"), F.median(n).alias("median"), F.count_if(words == 1).alias("single_word"), F.count_if(blank(F.col(column))).alias("empty")
    )


def codes(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(
        F.count_if(c.contains("-")).alias("hyphen"), F.count_if(c.contains("/")).alias("slash"), F.count_if(c.rlike("^[0-9]+$")).alias("numeric"), F.count_if(c.rlike("^[A-Za-z0-9]+$") & ~c.rlike("^[0-9]+$")).alias("alphanumeric"), F.countDistinct(c).alias("distinct_codes")
    )


def numbers(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Numbers among the values of a column, text or not; a single one has a deviation of 0."""
    x = F.col(column).try_cast("double")
    plain = rows.groupBy(*keys).agg(
        F.count(x).alias("valid"), F.count_if(x.isNull()).alias("missing"), F.count_if(x == 0).alias("zero"), F.count_if(x < 0).alias("negative"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("deviation")
    )
    middle = quantiles(rows.select(*keys, x.alias("_x")), "_x", list(keys), {"_median": 0.5}).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.round("_median", 4).alias("median"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
    return plain.join(middle, same, "left").drop(*(f"_of_{k}" for k in keys))


def dates(rows: DataFrame, column: str) -> DataFrame:
    d = F.col(column).try_cast("date")
    return rows.agg(F.count(d).alias("valid"), F.count_if(d.isNull()).alias("missing"), F.min(d).cast("string").alias("earliest"), F.max(d).cast("string").alias("latest"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """Rows beyond the first of each kind."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))


def quality_score(rows: DataFrame, code: str, validity: float = 98.5, consistency: float = 82.0) -> DataFrame:
    """0.40 completeness + 0.30 uniqueness (0.7 of codes, 0.3 of rows) + 0.15 validity + 0.15 consistency, all in per cent."""
    names = rows.columns
    filled = sum((F.sum((~blank(F.col(n))).cast("long")) for n in names), F.lit(0))
    one = rows.agg((filled * 100 / (F.count("*") * len(names))).alias("complete"), (F.countDistinct(code) * 100 / F.count("*")).alias("unique_codes"))
    rest = duplicate_rows(rows).select(((F.col("whole") - F.col("duplicates")) * 100 / F.col("whole")).alias("unique_rows"))
    unique = 0.7 * F.col("unique_codes") + 0.3 * F.col("unique_rows")
    score = 0.40 * F.col("complete") + 0.30 * unique + 0.15 * validity + 0.15 * consistency
    return one.withColumn("unique_rows", rest.scalar()).select(F.round("complete", 2).alias("completeness"), F.round(unique, 2).alias("uniqueness"), F.round(score, 2).alias("score"))
