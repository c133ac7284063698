"""Catalog files in, stages out: reading, checking, mapping, deriving, registering and writing."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orevein.operators.records import numbered

from .workbooks import read_sheets

#: A raw catalog's columns, all text.
COLUMNS = "Enterprise Material_Code Material_Description Material_Category Material_Type Specification Material_Grade Size Length Diameter Coating Unit Manufacturer Manufacturer_Part_No Plant Material_Status Annual_Consumption Last_Purchase_Date".split()
RAW = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
#: Headers that name a required column, in order of preference.
ALIASES = {"material_code": ["material_code", "code", "item_code", "material no"], "description": ["material_description", "description", "item_description", "desc"], "uom": ["unit", "uom", "unit_of_measure"]}


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, utf8 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.expr("is_valid_utf8(content)").alias("utf8"))


def unchanged(spark: SparkSession, path: str, allowed: set[str]) -> bool:
    """Does the file still have one of the allowed hashes?"""
    return fingerprints(spark, path).first().sha256 in allowed


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """CSV catalogs, every column as text; a file that isn't UTF-8 is read as Latin-1. Extra columns stay, missing ones are left to missing()."""
    lines = spark.read.format("text").load(path).select(F.col("_metadata.file_path").alias("path"), F.expr("is_valid_utf8(cast(value as binary))").alias("utf8"))
    # a file's lines go through many tasks, and each file is judged on its own; there are as many rows here as files
    by_file = {r.path: r.utf8 for r in lines.groupBy("path").agg(F.bool_and("utf8").alias("utf8")).collect()}
    out = None
    for encoding, plain in (("UTF-8", True), ("ISO-8859-1", False)):
        paths = [f for f, utf8 in by_file.items() if utf8 == plain]
        if paths:
            rows = spark.read.option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(paths, header=True, inferSchema=False)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], RAW)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Excel catalogs as text: the first sheet of each workbook, or the named one."""
    return read_sheets(spark, path, sheet)


def missing(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that a catalog lacks, and those beyond."""
    return [c for c in COLUMNS if c not in rows.columns], [c for c in rows.columns if c not in COLUMNS]


def _plain(name: str) -> str:
    return re.sub(r"[_\s-]", "", name).lower()


def mapped_columns(rows: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """For each field, the first of its aliases that a header matches but for case, spaces, hyphens and underscores."""
    have = {_plain(c): c for c in reversed(rows.columns)}
    found = {f: next((have[_plain(a)] for a in names if _plain(a) in have), None) for f, names in aliases.items()}
    return {f: c for f, c in found.items() if c}


def duplicate_codes(rows: DataFrame, enterprise: str, code: str) -> DataFrame:
    return rows.groupBy(enterprise, code).agg(F.count("*").alias("n")).where("n > 1")


def problems(rows: DataFrame) -> list[str]:
    """What is wrong with an upload, if anything."""
    lacks, _ = missing(rows)
    if lacks:
        return [f"missing columns: {', '.join(lacks)}"]
    if rows.isEmpty():
        return ["no rows"]
    twice = duplicate_codes(rows, "Enterprise", "Material_Code").limit(5).collect()
    return [f"duplicate code {r.Material_Code} of {r.Enterprise}" for r in twice]


def deduplicated(rows: DataFrame, description: str, position: str) -> DataFrame:
    """The first row of each description, by position; blank ones go."""
    text = F.coalesce(F.col(description), F.lit(""))
    kept = rows.where(F.regexp_replace(text, r"\s+", "") != "")
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy(description).orderBy(position))).where("_k = 1").drop("_k")


def derived_inventory(rows: DataFrame) -> DataFrame:
    """rows (code, status, consumption and given on_hand as text) with on_hand, reserved, available: given, or a part of the consumption by status."""
    use = F.coalesce(F.col("consumption").try_cast("double"), F.lit(0.0))
    part = F.when(F.lower("status").contains("slow"), 0.25).when(F.lower("status").contains("obsolete"), 0.40).otherwise(0.12)
    on_hand = F.coalesce(F.col("on_hand").try_cast("double"), F.round(use * part, 1))
    out = rows.withColumn("on_hand", on_hand).withColumn("reserved", F.round(on_hand * 0.08, 1))
    return out.withColumn("available", F.greatest(F.lit(0.0), F.round(F.col("on_hand") - F.col("reserved"), 1)))


def derived_demand(rows: DataFrame, period: str) -> DataFrame:
    use = F.coalesce(F.col("consumption").try_cast("double"), F.lit(0.0))
    part = F.when(F.lower("status").contains("obsolete"), 0.0).when(F.lower("status").contains("slow"), 0.10).otherwise(0.25)
    required = F.coalesce(F.col("required").try_cast("double"), F.round(use * part, 1))
    return rows.withColumn("required", required).withColumn("forecast", F.round(required * 115 / 100, 1)).withColumn("period", F.lit(period))


def derived_purchase(rows: DataFrame, as_of: str) -> DataFrame:
    """rows (enterprise, code, po_number, supplier, quantity, consumption, unit_price, po_date as text) with defaults for what is missing."""
    tail = F.element_at(F.split("code", "-"), -1)
    return rows.select(
        "enterprise", "code", F.coalesce("po_number", F.concat_ws("-", F.lit("PO"), "enterprise", tail)).alias("po_number"), F.coalesce("supplier", F.lit("UNKNOWN SUPPLIER")).alias("supplier"),
        F.coalesce(F.col("quantity").try_cast("double"), F.col("consumption").try_cast("double"), F.lit(1.0)).alias("quantity"), F.coalesce(F.col("unit_price").try_cast("double"), F.lit(0.0)).alias("unit_price"),
        F.coalesce(F.col("po_date").try_cast("date"), F.lit(as_of).cast("date")).alias("po_date"),
    )


def recovered(rows: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """rows (code, description) with null columns filled from the source's row of the same code, else of the same description whatever the case; of several the last (by position)."""
    last = lambda key: source.withColumn("_key", key).where("_key is not null").groupBy("_key").agg(F.max_by(F.struct(*columns), "position").alias("_v"))
    by_code, by_text = last(F.col("code")), last(F.lower("description"))
    at = rows.join(by_code.select(F.col("_key").alias("_a"), F.col("_v").alias("_va")), F.col("code") == F.col("_a"), "left").join(by_text.select(F.col("_key").alias("_b"), F.col("_v").alias("_vb")), F.lower("description") == F.col("_b"), "left")
    return at.select(*(c for c in rows.columns if c not in columns), *(F.coalesce(*([F.col(c)] if c in rows.columns else []), F.col(f"_va.{c}"), F.col(f"_vb.{c}")).alias(c) for c in columns))


def scoped(datasets: dict[str, DataFrame], scope: str) -> DataFrame | None:
    """NONE: nothing (None). ALL: every dataset with its id; else the one of that id."""
    if scope == "NONE":
        return None
    chosen = datasets if scope == "ALL" else {scope: datasets[scope]}
    out = None
    for name, rows in chosen.items():
        rows = rows.withColumn("dataset_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def next_upload(existing: list[str], day: str) -> str:
    """UPLOAD-day-NNN, one beyond the day's largest."""
    taken = [int(x.rsplit("-", 1)[1]) for x in existing if x.startswith(f"UPLOAD-{day}-")]
    return f"UPLOAD-{day}-{max(taken, default=0) + 1:03d}"


def registered(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """uploads (day as yyyymmdd, position: distinct in a day) with dataset_id UPLOAD-day-NNN, of three digits or more, numbered on from the day's largest in existing (dataset_id)."""
    taken = existing.select(F.regexp_extract("dataset_id", r"^UPLOAD-(\d+)-\d+$", 1).alias("day"), F.nullif(F.regexp_extract("dataset_id", r"-(\d+)$", 1), F.lit("")).cast("long").alias("n"))
    last = taken.where("day <> ''").groupBy("day").agg(F.max("n").alias("_last"))
    placed = numbered(uploads, ["position"], "_place", by=["day"]).join(last, "day", "left")
    n = F.col("_place") + F.coalesce("_last", F.lit(0))
    return placed.withColumn("dataset_id", F.concat(F.lit("UPLOAD-"), "day", F.format_string("-%03d", n))).drop("_last", "_place")


def malformed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The lines of a CSV file with a header that don't have as many fields as columns."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_line"])
    lines = spark.read.text(path).where(F.col("value") != ",".join(columns))
    parsed = F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    return lines.select(parsed.alias("x")).where("x._line is not null").select(F.col("x._line").alias("line"))


def listed(registry: DataFrame, user: str) -> DataFrame:
    """Baselines first, then the user's uploads, newest first."""
    mine = registry.where((F.col("kind") == "BASELINE") | (F.col("user") == user))
    return mine.orderBy((F.col("kind") != "BASELINE").cast("int"), F.col("created").desc(), "dataset_id")


def write_csv(rows: DataFrame, path: str, columns: list[str], keys: list[str]) -> None:
    """One CSV file with columns in this order and rows in the order of keys: a report for people, not a stage's table."""
    rows.select(*columns).coalesce(1).sortWithinPartitions(*keys).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report(rows: DataFrame) -> str:
    """A few rows of metrics as JSON."""
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()], sort_keys=True)


def load_tables(tables: dict[str, DataFrame], schemas: dict[str, T.StructType], root: str) -> None:
    """Tables in order, each with its schema's columns: unknown ones are left out, missing ones null."""
    for name, schema in schemas.items():
        if name in tables:
            rows = tables[name]
            rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("overwrite").parquet(f"{root}/{name}")
