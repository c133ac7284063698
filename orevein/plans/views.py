"""The domain's tables as views of the star schema.

An enterprise is a nation, its sector the region. A material is a part; its common code joins its family (p_type) and the last word of
its name. Line items are stock at suppliers' enterprises, requirements of customers' enterprises, and purchases. Fact tables are only joined to small
dimensions here, and each view selects the columns that it needs, so scans read no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enterprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return both.select(F.col("n_nationkey").alias("enterprise_id"), F.col("n_name").alias("enterprise"), F.col("r_name").alias("sector"))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    noun = F.element_at(F.split("p_name", " "), -1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("material_id"),
        F.format_string("MAT-%06d", "p_partkey").alias("material_code"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("family"),
        noun.alias("noun"),
        F.col("p_brand").alias("grade"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") % 25).cast("int").alias("owner_id"),
        F.upper(F.concat_ws("-", "p_type", noun)).alias("common_code"),
    )


def _of_supplier(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", *columns)
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    at = items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
    at = at.join(enterprises(spark, sf_dir), F.col("s_nationkey") == F.col("enterprise_id"))
    return at.join(materials(spark, sf_dir).select("material_id", "common_code", "family"), F.col("l_partkey") == F.col("material_id"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id, common_code, family, enterprise, sector, plant, uom, on_hand, reserved, available, day."""
    at = _of_supplier(spark, sf_dir, "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    reserved = F.col("l_quantity") * F.col("l_discount")
    return at.select(
        "material_id", "common_code", "family", "enterprise", "sector", F.col("s_name").alias("plant"), F.col("l_returnflag").alias("uom"),
        F.col("l_quantity").alias("on_hand"), reserved.alias("reserved"), (F.col("l_quantity") - reserved).alias("available"), F.to_date("l_shipdate").alias("day"),
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id, common_code, enterprise, uom, required, forecast, period."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    at = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    at = at.join(enterprises(spark, sf_dir), F.col("c_nationkey") == F.col("enterprise_id"))
    at = at.join(materials(spark, sf_dir).select("material_id", "common_code"), F.col("l_partkey") == F.col("material_id"))
    period = F.concat_ws("-Q", F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"))
    return at.select("material_id", "common_code", "enterprise", F.col("l_returnflag").alias("uom"), F.col("l_quantity").alias("required"), (F.col("l_quantity") * 1.15).alias("forecast"), period.alias("period"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id, common_code, enterprise, supplier, quantity, unit_price, uom, po_number, po_date."""
    at = _of_supplier(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return at.select(
        "material_id", "common_code", "enterprise", F.col("s_name").alias("supplier"), F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
        F.col("l_returnflag").alias("uom"), F.format_string("PO-%d-%d", "l_orderkey", "l_linenumber").alias("po_number"), F.to_date("l_shipdate").alias("po_date"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, actor, action, confidence, match_id: decisions and their audit trail."""
    return as_reviews(table(spark, sf_dir, "events"))


def as_reviews(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), (F.col("value") / 500).alias("confidence"), F.get_json_object("props", "$.k").cast("long").alias("match_id")
    )


#: The same views for DuckDB.
SQL = """
enterprises AS (SELECT n_nationkey AS enterprise_id, n_name AS enterprise, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey),
materials AS (SELECT p_partkey AS material_id, printf('MAT-%06d', p_partkey) AS material_code, p_name AS description, p_type AS family, split_part(p_name, ' ', -1) AS noun, p_brand AS grade, p_size AS size,
  p_retailprice AS price, CAST(p_partkey % 25 AS INTEGER) AS owner_id, upper(p_type || '-' || split_part(p_name, ' ', -1)) AS common_code FROM part),
at_supplier AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN enterprises ON s_nationkey = enterprise_id JOIN materials ON l_partkey = material_id),
inventory AS (SELECT material_id, common_code, family, enterprise, sector, s_name AS plant, l_returnflag AS uom, l_quantity AS on_hand, l_quantity * l_discount AS reserved,
  l_quantity - l_quantity * l_discount AS available, CAST(l_shipdate AS DATE) AS day FROM at_supplier),
demand AS (SELECT material_id, common_code, enterprise, l_returnflag AS uom, l_quantity AS required, l_quantity * 1.15 AS forecast, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN enterprises ON c_nationkey = enterprise_id JOIN materials ON l_partkey = material_id),
purchases AS (SELECT material_id, common_code, enterprise, s_name AS supplier, l_quantity AS quantity, l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_returnflag AS uom,
  'PO-' || l_orderkey || '-' || l_linenumber AS po_number, CAST(l_shipdate AS DATE) AS po_date FROM at_supplier),
reviews AS (SELECT event_id, ts, user_id AS actor, event_type AS action, value / 500 AS confidence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS match_id FROM events)
"""


def sql(query: str) -> str:
    return f"WITH {SQL.strip()} {query}" if not query.lstrip().startswith(",") else f"WITH {SQL.strip()}{query.lstrip()}"


def uuid5_sql(name: str, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> str:
    """DuckDB's expression for functions.ids.uuid5."""
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"
