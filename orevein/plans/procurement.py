"""Queries about stock, demand and purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from orevein.operators import procurement as P

from .views import demand, inventory, purchases, sql

#: The code that detail queries look at.
CODE = "ECONOMY-RING"



def _dated(df, *columns):
    """Dates as text, which both engines print alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


QUERIES = {
    "inventory_summary": lambda s, d: P.inventory_summary(inventory(s, d)),
    "inventory_by_enterprise": lambda s, d: P.by_enterprise(inventory(s, d), ["on_hand", "available"]),
    "inventory_by_code": lambda s, d: P.inventory_by_code(inventory(s, d)),
    "inventory_page": lambda s, d: P.page(P.inventory_by_code(inventory(s, d)), [F.col("available").desc(), "common_code", "uom"], 2, 20),
    "inventory_detail": lambda s, d: _dated(P.inventory_detail(inventory(s, d), CODE), "latest"),
    "demand_summary": lambda s, d: demand(s, d).groupBy("uom").agg(P.total("required").alias("required"), P.total("forecast").alias("forecast"), F.countDistinct("material_id").alias("materials"), F.countDistinct("enterprise").alias("enterprises")),
    "demand_by_enterprise": lambda s, d: P.by_enterprise(demand(s, d), ["required", "forecast"]),
    "demand_by_code": lambda s, d: P.demand_by_code(demand(s, d)),
    "demand_detail": lambda s, d: P.demand_detail(demand(s, d), CODE),
    "sourcing_opportunities": lambda s, d: P.opportunities(inventory(s, d), demand(s, d)),
    "combined_by_uom": lambda s, d: P.combined_by_uom(inventory(s, d), demand(s, d), CODE),
    "purchase_history": lambda s, d: _dated(P.purchase_history(purchases(s, d), CODE), "po_date"),
    "price_variance": lambda s, d: P.price_variance(purchases(s, d)),
    "tender_aggregation": lambda s, d: P.tender_aggregation(demand(s, d)),
    "surplus_pool": lambda s, d: P.surplus_pool(inventory(s, d), demand(s, d)),
    "enterprise_uom_volumes": lambda s, d: P.uom_volumes(inventory(s, d), ["A", "N"]),
    "consumption_summary": lambda s, d: P.consumption_summary(demand(s, d)),
    "purchase_recency": lambda s, d: _dated(P.purchase_recency(purchases(s, d), "2002-01-01"), "earliest", "latest"),
    "high_volume_p95": lambda s, d: P.high_volume(demand(s, d)),
    "plant_distribution": lambda s, d: P.plant_distribution(inventory(s, d)),
    "procurement_kpis": lambda s, d: P.procurement_kpis(inventory(s, d)),
    "opportunity_signals": lambda s, d: P.opportunity_signals(demand(s, d), purchases(s, d)),
    "inventory_filters": lambda s, d: inventory(s, d).select(F.explode(F.array(F.struct(F.lit("uom").alias("filter"), F.col("uom").alias("value")), F.struct(F.lit("family").alias("filter"), F.col("family").alias("value")))).alias("x")).select("x.*").distinct(),
}

_BY_CODE = "SELECT common_code, uom, round(sum(on_hand), 2) AS on_hand, round(sum(available), 2) AS available, count(DISTINCT enterprise) AS enterprises, count(DISTINCT material_id) AS materials FROM inventory GROUP BY ALL"
_STATUS = "CASE WHEN available <= 0 THEN 'OUT' WHEN available < on_hand * 0.2 THEN 'LOW' ELSE 'AVAILABLE' END AS status"


def _main_unit(view: str, a: str, b: str) -> str:
    return sql(f"""SELECT enterprise, uom, {a}, {b}, materials, n > 1 AS uom_mixed FROM (SELECT *, row_number() OVER (PARTITION BY enterprise ORDER BY {a} DESC, uom) AS k, count(*) OVER (PARTITION BY enterprise) AS n
      FROM (SELECT enterprise, uom, round(sum({a}), 2) AS {a}, round(sum({b}), 2) AS {b}, count(DISTINCT material_id) AS materials FROM {view} GROUP BY ALL)) WHERE k = 1""")


_P95 = """(SELECT common_code, uom, n, p95_volume, count(*) FILTER (WHERE required > p95) AS above FROM demand JOIN (SELECT common_code, uom, count(*) AS n, quantile_cont(required, 0.95) AS p95, round(quantile_cont(required, 0.95), 4) AS p95_volume
  FROM demand GROUP BY ALL HAVING count(*) >= 5) USING (common_code, uom) GROUP BY ALL)"""

ORACLE_SQL = {
    "inventory_summary": sql("""SELECT *, CASE WHEN on_hand > 0 THEN round(available * 100 / on_hand, 1) ELSE 0.0 END AS available_pct FROM
      (SELECT uom, round(sum(on_hand), 2) AS on_hand, round(sum(reserved), 2) AS reserved, round(sum(available), 2) AS available, count(DISTINCT material_id) AS materials FROM inventory GROUP BY uom)
      JOIN (SELECT uom, count(*) FILTER (WHERE n >= 2) AS shared_codes FROM (SELECT uom, common_code, count(DISTINCT enterprise) AS n FROM inventory WHERE available > 0 GROUP BY ALL) GROUP BY uom) USING (uom)"""),
    "inventory_by_enterprise": _main_unit("inventory", "on_hand", "available"),
    "inventory_by_code": sql(f"SELECT *, {_STATUS} FROM ({_BY_CODE})"),
    "inventory_page": sql(f"SELECT *, {_STATUS}, count(*) OVER () AS total_rows, greatest(1, CAST(ceil(count(*) OVER () / 20) AS BIGINT)) AS total_pages FROM ({_BY_CODE}) ORDER BY available DESC, common_code, uom LIMIT 20 OFFSET 20"),
    "inventory_detail": sql(f"SELECT enterprise, coalesce(plant, 'MAIN-PLANT') AS plant, uom, round(sum(on_hand), 2) AS on_hand, round(sum(available), 2) AS available, CAST(max(day) AS VARCHAR) AS latest FROM inventory WHERE common_code = '{CODE}' GROUP BY ALL"),
    "demand_summary": sql("SELECT uom, round(sum(required), 2) AS required, round(sum(forecast), 2) AS forecast, count(DISTINCT material_id) AS materials, count(DISTINCT enterprise) AS enterprises FROM demand GROUP BY uom"),
    "demand_by_enterprise": _main_unit("demand", "required", "forecast"),
    "demand_by_code": sql("""SELECT common_code, uom, round(sum(required), 2) AS required, round(sum(forecast), 2) AS forecast, count(*) AS enterprises, string_agg(enterprise || '=' || CAST(round(required) AS BIGINT), ';' ORDER BY enterprise) AS breakdown
      FROM (SELECT common_code, uom, enterprise, round(sum(required), 2) AS required, round(sum(forecast), 2) AS forecast FROM demand GROUP BY ALL) GROUP BY common_code, uom"""),
    "demand_detail": sql(f"""SELECT *, round(sum(required) OVER (PARTITION BY period, uom), 2) AS combined FROM
      (SELECT enterprise, period, uom, round(sum(required), 2) AS required, round(sum(forecast), 2) AS forecast FROM demand WHERE common_code = '{CODE}' GROUP BY ALL)"""),
    "sourcing_opportunities": sql("""SELECT common_code, uom, coalesce(holders, 0) AS holders, coalesce(available, 0.0) AS available, coalesce(requesters, 0) AS requesters, coalesce(required, 0.0) AS required,
      CASE WHEN holders IS NOT NULL AND requesters IS NOT NULL THEN 'SHARED_STOCK_AND_DEMAND' WHEN holders IS NOT NULL THEN 'SHARED_STOCK' ELSE 'SHARED_DEMAND' END AS kind FROM
      (SELECT common_code, uom, count(DISTINCT enterprise) AS holders, round(sum(available), 2) AS available FROM inventory WHERE available > 0 GROUP BY ALL HAVING count(DISTINCT enterprise) >= 2)
      FULL JOIN (SELECT common_code, uom, count(DISTINCT enterprise) AS requesters, round(sum(required), 2) AS required FROM demand GROUP BY ALL HAVING count(DISTINCT enterprise) >= 2) USING (common_code, uom)"""),
    "combined_by_uom": sql(f"""SELECT *, CASE WHEN net IS NULL THEN 'ONE_SIDED' WHEN net > 0 THEN 'PROCURE' ELSE 'COVERED' END AS insight FROM (SELECT uom, available, required, round(required - available, 2) AS net FROM
      (SELECT uom, round(sum(available), 2) AS available FROM inventory WHERE common_code = '{CODE}' GROUP BY uom) FULL JOIN (SELECT uom, round(sum(required), 2) AS required FROM demand WHERE common_code = '{CODE}' GROUP BY uom) USING (uom))"""),
    "purchase_history": sql(f"SELECT po_number, CAST(po_date AS VARCHAR) AS po_date, enterprise, supplier, quantity, round(unit_price, 8) AS unit_price, uom FROM purchases WHERE common_code = '{CODE}'"),
    "price_variance": sql("""SELECT *, CASE WHEN least > 0 THEN round((most - least) * 100 / least, 1) ELSE 0.0 END AS variance_pct, round(most - least, 2) AS saving_a_unit FROM
      (SELECT common_code, uom, count(*) AS enterprises, min(price) AS least, max(price) AS most, arg_min(enterprise, (price, enterprise)) AS cheapest FROM
      (SELECT common_code, uom, enterprise, round(avg(unit_price), 4) AS price FROM purchases WHERE unit_price IS NOT NULL GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2)"""),
    "tender_aggregation": sql("SELECT common_code, uom, period, count(DISTINCT enterprise) AS enterprises, round(sum(required), 2) AS bulk, round(max(required), 2) AS largest FROM demand GROUP BY ALL HAVING count(DISTINCT enterprise) >= 2"),
    "surplus_pool": sql(""", held AS (SELECT common_code, uom, enterprise, sum(available) AS own FROM inventory GROUP BY ALL)
      SELECT *, least(required, elsewhere) AS poolable FROM (SELECT common_code, uom, enterprise, round(required, 2) AS required, round(whole - coalesce(own, 0), 2) AS elsewhere
      FROM (SELECT common_code, uom, enterprise, sum(required) AS required FROM demand GROUP BY ALL) JOIN (SELECT common_code, uom, sum(own) AS whole FROM held GROUP BY ALL) USING (common_code, uom) LEFT JOIN held USING (common_code, uom, enterprise)) WHERE elsewhere > 0"""),
    "enterprise_uom_volumes": sql("""SELECT enterprise, round(coalesce(sum(on_hand) FILTER (WHERE uom = 'A'), 0), 2) AS volume_a, round(coalesce(sum(on_hand) FILTER (WHERE uom = 'N'), 0), 2) AS volume_n,
      round(coalesce(sum(on_hand) FILTER (WHERE uom NOT IN ('A', 'N')), 0), 2) AS volume_other, count(*) AS records FROM inventory GROUP BY enterprise"""),
    "consumption_summary": sql(""", units AS (SELECT common_code, uom, count(*) AS n, sum(required) AS s FROM demand GROUP BY ALL)
      SELECT common_code, primary_uom, members, enterprises, units, round(s, 2) AS total, round(s / n, 4) AS mean FROM (SELECT common_code, count(DISTINCT material_id) AS members, count(DISTINCT enterprise) AS enterprises FROM demand GROUP BY ALL)
      JOIN (SELECT common_code, arg_max(uom, (n, uom)) AS primary_uom, count(*) AS units FROM units GROUP BY ALL) USING (common_code) JOIN (SELECT common_code, uom AS primary_uom, n, s FROM units) USING (common_code, primary_uom)"""),
    "purchase_recency": sql("""SELECT *, CASE WHEN days_since <= 365 THEN 'ACTIVE' ELSE 'INACTIVE' END AS state, suppliers > 1 AS diverse FROM (SELECT common_code, CAST(min(po_date) AS VARCHAR) AS earliest, CAST(max(po_date) AS VARCHAR) AS latest, count(DISTINCT supplier) AS suppliers,
      date_diff('day', max(po_date), DATE '2002-01-01') AS days_since FROM purchases GROUP BY ALL)"""),
    "high_volume_p95": sql(f"SELECT * FROM {_P95}"),
    "plant_distribution": sql("SELECT plant, enterprise, uom, round(sum(on_hand), 2) AS volume, count(DISTINCT material_id) AS materials FROM inventory GROUP BY ALL"),
    "procurement_kpis": sql(""", codes AS (SELECT common_code, count(DISTINCT enterprise) AS n FROM inventory GROUP BY ALL) SELECT 'codes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM codes UNION ALL
      SELECT 'multi_enterprise', CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) FROM codes UNION ALL SELECT 'standalone', CAST(count(*) FILTER (WHERE n = 1) AS DOUBLE) FROM codes
      UNION ALL SELECT 'volume_' || uom, round(sum(on_hand), 2) FROM inventory GROUP BY uom"""),
    "opportunity_signals": sql(f"""SELECT common_code, 'MULTI_ENTERPRISE_DEMAND' AS type, 'enterprises' AS metric, CAST(m AS DOUBLE) AS value, CAST(2 AS DOUBLE) AS threshold, e || ' materials' AS evidence
      FROM (SELECT common_code, count(DISTINCT enterprise) AS m, count(DISTINCT material_id) AS e FROM demand GROUP BY ALL) WHERE m >= 2
      UNION ALL SELECT common_code, 'HIGH_VOLUME', 'p95_' || uom, CAST(above AS DOUBLE), p95_volume, n || ' rows' FROM {_P95} WHERE above > 0
      UNION ALL SELECT common_code, 'SUPPLIER_DIVERSITY', 'suppliers', CAST(m AS DOUBLE), CAST(2 AS DOUBLE), m || ' suppliers' FROM (SELECT common_code, count(DISTINCT supplier) AS m FROM purchases GROUP BY ALL) WHERE m >= 2"""),
    "inventory_filters": sql("SELECT 'uom' AS filter, uom AS value FROM inventory UNION SELECT 'family', family FROM inventory"),
}
