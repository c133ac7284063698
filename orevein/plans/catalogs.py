"""Queries about catalogs' way in and out, and about what remains of records, reviews and stock."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orevein.functions import text as N
from orevein.operators import analytics as A
from orevein.operators import extraction as E
from orevein.operators import grouping as G
from orevein.operators import matching as M
from orevein.operators import procurement as P
from orevein.operators import records as R
from orevein.operators import review as V
from orevein.session import shared
from orevein.sources import catalogs as C
from orevein.sources import generator

from .analytics import _PAIRS, _pairs
from .harmonisation import _EDGES_SQL, _STEPS, _edges, _key_sql
from .records import _ENDING_SQL, _MATCHES_SQL, _OWNED_SQL, _by_ending, _ended, _matches, _owned, _sql
from .views import demand, enterprises, inventory, materials, purchases, reviews, sql, table, uuid5_sql


def _new(s, name):
    return f"{shared(s)}/{name}-{uuid.uuid4().hex}"


def _csv_round_trip(s, d):
    """Materials written as a CSV report and read as a catalog."""
    path = _new(s, "csv")
    rows = materials(s, d).select(F.col("material_code").alias("Material_Code"), F.when(F.col("size") % 5 == 0, F.concat(F.col("description"), F.lit(', "big"\nsecond line é'))).otherwise(F.col("description")).alias("Material_Description"), F.nullif("grade", F.lit("Brand#5")).alias("Material_Grade"))
    C.write_csv(rows, path, ["Material_Code", "Material_Description", "Material_Grade"], ["Material_Code"])
    return C.read_catalog(s, path).select(F.col("Material_Code").alias("code"), F.col("Material_Description").alias("description"), F.col("Material_Grade").alias("grade"))


def _latin(s, d):
    """Names with accents, one file in UTF-8 and one in Latin-1, read together."""
    path = _new(s, "encodings")
    for name, encoding, rest in (("utf", "UTF-8", 0), ("latin", "ISO-8859-1", 1)):
        rows = table(s, d, "supplier").where(F.col("s_suppkey") % 2 == rest).select(F.col("s_suppkey").cast("string").alias("code"), F.concat(F.lit("é"), "s_name").alias("name"))
        rows.coalesce(1).write.option("header", True).option("encoding", encoding).csv(f"{path}/{name}")
    return C.read_catalog(s, f"{path}/*/*.csv").select(F.col("code").cast("long").alias("code"), "name")


def _malformed(s, d):
    """Supplier lines as CSV, some with a field too many or too few."""
    path = _new(s, "malformed")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 10 == 3, F.lit("x,y,z")).otherwise(F.lit("x,y")))
    rows = table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 10 == 7, F.col("s_suppkey").cast("string")).otherwise(line).alias("value"), "s_suppkey")
    head = s.createDataFrame([("a,b,c", -1)], "value string, s_suppkey long")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    return C.malformed(s, path, ["a", "b", "c"])


def _json_export(s, d):
    at = generator.exported({"materials": materials(s, d).select("material_id", "description", "price")}, _new(s, "json"))
    return s.read.schema("material_id long, description string, price double").json(at["materials"])


def _loaded(s, d):
    """A table loaded with another schema: a column more, which is null, and one less."""
    from pyspark.sql import types as T

    root = _new(s, "loaded")
    schema = T.StructType([T.StructField("material_id", T.LongType()), T.StructField("price", T.StringType()), T.StructField("note", T.StringType())])
    C.load_tables({"materials": materials(s, d).select("material_id", "price", "grade"), "unknown": enterprises(s, d)}, {"materials": schema}, root)
    return s.read.schema(schema).parquet(f"{root}/materials").select("material_id", F.col("price").cast("double").alias("price"), "note")


def _purchase_rows(s, d):
    null = lambda k, c: F.when(F.col("p_partkey") % k > 0, c.cast("string"))
    return table(s, d, "part").select(
        (F.concat(F.lit("E"), (F.col("p_partkey") % 25).cast("string"))).alias("enterprise"), F.format_string("MAT-%06d", "p_partkey").alias("code"), null(2, F.col("p_partkey")).alias("po_number"), null(3, F.col("p_brand")).alias("supplier"),
        null(4, F.col("p_size")).alias("quantity"), null(5, F.col("p_size") * 2).alias("consumption"), null(6, F.col("p_retailprice")).alias("unit_price"), F.when(F.col("p_partkey") % 7 > 0, F.lit("2024-05-06")).otherwise("soon").alias("po_date"),
    )


def _recovered(s, d):
    """Materials that have lost grade and size, filled from a source by code, else by description."""
    own = materials(s, d)
    rows = own.select(F.col("material_code").alias("code"), F.upper("description").alias("description"), F.when(F.col("material_id") % 3 == 0, F.col("grade")).alias("grade"))
    source = own.where("material_id % 2 = 0").select(F.col("material_code").alias("code"), "description", "grade", F.col("size").cast("string").alias("size"), F.col("material_id").alias("position"))
    return C.recovered(rows, source, ["grade", "size"])


def _fields(s, d):
    text = F.concat(F.lit(" "), F.col("p_name"), F.lit("  "), F.element_at(F.array(*map(F.lit, ["Ünit", "5°", "A × B", "plain"])), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit(" "))
    unit = F.element_at(F.array(*map(F.lit, ["nos", "NOS", "pcs", "Box"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 > 0, text).alias("field"), text.alias("maker"), F.upper("p_brand").alias("part_no"), unit.alias("unit"))


def _audited(s, d):
    return N.audited(_fields(s, d), {"field": N.FIELD, "maker": N.MAKER, "part_no": N.PART_NUMBER}, ("unit",)).select("id", "field_normalized", "maker_normalized", "part_no_normalized", "unit_normalized", "changed", "n_rules", "rules")


_FIELDS_SQL = """fields AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN t END AS field, t AS maker, upper(p_brand) AS part_no, ['nos', 'NOS', 'pcs', 'Box'][p_partkey % 4 + 1] AS unit
  FROM (SELECT *, ' ' || p_name || '  ' || ['Ünit', '5°', 'A × B', 'plain'][p_partkey % 4 + 1] || ' ' AS t FROM part))"""
_TRIMMED = lambda c: _STEPS["COLLAPSE_WHITESPACE"](_STEPS["TRIM_WHITESPACE"](c))
_SYMBOLLED = lambda c: _STEPS["UNICODE_NORMALIZATION"](_TRIMMED(c))

#: What _records of harmonisation makes of parts: an answer for each of eight descriptions.
_NOUNS = ["gate valve 2 in 150# flanged WCB", "hex bolt M16X75 SS 304", "ball bearing 6205 deep groove", "weld neck flange 4 in class 300 A105", "hydraulic hose 1/2 in 1000 mm", "seamless pipe 6 in sch 40 API 5L", "elbow 90 degree 2 in", "XLPE cable 3 core 25 sq mm IS 7098"]


def _candidates_with_standards(s, d):
    """Candidates with the standardised records of both ends as JSON, {} where there is none."""
    std = _owned(s, d).where("material_id % 4 <> 1").select("material_id", F.to_json(F.struct("family", "grade")).alias("j"))
    at = _pairs(s, d).select("source_id", "candidate_id")
    for side in ("source", "candidate"):
        at = at.join(std.select(F.col("material_id").alias(f"{side}_id"), F.col("j").alias(side)), f"{side}_id", "left").withColumn(side, F.coalesce(side, F.lit("{}")))
    return at


def _queue(s, d):
    """Open matches of one page with both descriptions and enterprises, those that mention a word."""
    own = _owned(s, d)
    at = _matches(s, d).where("status in ('PENDING_REVIEW', 'ALREADY_MAPPED')")
    for side in ("source", "candidate"):
        at = at.join(own.select(F.col("material_id").alias(f"{side}_id"), F.col("description").alias(f"{side}_text"), F.col("enterprise").alias(f"{side}_enterprise")), f"{side}_id")
    found = A.search(at, "bolt", "source_text", "candidate_text", "match_id")
    return P.page(found, [F.col("confidence").desc(), "match_id"], 1, 25).select("match_id", "source_text", "candidate_text", "source_enterprise", "candidate_enterprise", "confidence", "total_rows")


def _reviewers(s, d):
    return table(s, d, "supplier").select(F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("reviewer_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("R"), (F.col("s_suppkey") + 1).cast("string"))).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("R"), F.col("s_suppkey").cast("string"))).alias("key"))


_REVIEWERS_SQL = "reviewers AS (SELECT 'R' || s_suppkey AS reviewer_id, CASE WHEN s_suppkey % 2 = 0 THEN 'R' || (s_suppkey + 1) END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'R' || s_suppkey END AS key FROM supplier)"
_VALID = "action IN ('ACCEPT', 'REJECT', 'DEFER')"
_VERDICTS = "CASE action WHEN 'click' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' WHEN 'view' THEN 'DEFER' WHEN 'purchase' THEN 'MAYBE' END"
_REASONS = "['too short', '   ', 'a reason of length', 'ten chars!'][event_id % 4 + 1]"

QUERIES = {
    "csv_round_trip": _csv_round_trip,
    "csv_encodings": _latin,
    "csv_malformed_rows": _malformed,
    "json_export": _json_export,
    "tables_loaded": _loaded,
    "derived_purchases": lambda s, d: C.derived_purchase(_purchase_rows(s, d), "2026-03-31").withColumn("po_date", F.col("po_date").cast("string")),
    "catalog_scope": lambda s, d: C.scoped({"A": materials(s, d).select("material_id", "grade"), "B": materials(s, d).where("size > 25").select("material_id", "size")}, "ALL").groupBy("dataset_id").agg(F.count("*").alias("n"), F.count("grade").alias("grades"), F.count("size").alias("sizes")),
    "catalog_registry": lambda s, d: C.listed(table(s, d, "supplier").select(F.col("s_suppkey").alias("dataset_id"), F.when(F.col("s_suppkey") % 10 == 0, "BASELINE").otherwise("UPLOAD").alias("kind"), (F.col("s_suppkey") % 3).cast("string").alias("user"), F.col("s_acctbal").alias("created")), "1"),
    "upload_registration": lambda s, d: C.registered(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.col("o_orderkey").alias("position")), table(s, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.concat(F.lit("UPLOAD-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 3, "0")).alias("dataset_id"))),
    "recovered_columns": _recovered,
    "row_audit": _audited,
    "extracted_conflicts": lambda s, d: R.conflict_types(_extracted(s, d), "conflicts"),
    "engineering_text": lambda s, d: materials(s, d).select("material_id", N.engineering_text(F.when(F.col("size") % 2 == 0, F.concat(F.lit(" "), "description")).when(F.col("size") % 3 == 0, " "), F.when(F.col("size") % 5 > 0, F.col("family")), F.when(F.col("size") % 5 > 0, F.col("grade"))).alias("text")),
    "candidates_with_standards": _candidates_with_standards,
    "conflict_marks": lambda s, d: materials(s, d).select("material_id", M.text_marks(F.concat(F.col("description"), F.lit(" m"), F.col("size").cast("string"), F.lit(" class "), (F.col("size") * 100).cast("string"))).alias("m")).select("material_id", F.col("m")[5]["same"].alias("pressure"), F.col("m")[9]["said"].alias("diameter"), F.col("m")[4]["said"].alias("fastener")),
    "material_groups": lambda s, d: G.grouped(materials(s, d).select("material_id"), "material_id", _edges(s, d)),
    "group_governance": lambda s, d: G.grouped(materials(s, d).select("material_id", "size"), "material_id", _edges(s, d)).select("material_id", G.governance(F.col("members"), F.col("size") % 11 == 0, F.col("size") % 7 == 0).alias("governance")),
    "valid_decisions": lambda s, d: reviews(s, d).select("event_id", F.expr(_VERDICTS).alias("v"), F.element_at(F.array(*map(F.lit, ("too short", "   ", "a reason of length", "ten chars!"))), (F.col("event_id") % 4 + 1).cast("int")).alias("r")).select("event_id", F.coalesce(V.valid_decision(F.col("v"), F.col("r")), F.lit(False)).alias("valid")),
    "replaced_dataset": lambda s, d: V.without_dataset(_owned(s, d), table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("dataset_id"))).groupBy("dataset_id").agg(F.count("*").alias("n")),
    "notifications_acted": lambda s, d: V.notifications_read(reviews(s, d).select("event_id", "match_id", (F.col("event_id") % 5 == 0).alias("is_acted"), F.lit(False).alias("is_read")), reviews(s, d).where("action = 'purchase' and confidence > 0.9").select("match_id")),
    "point_lookup": lambda s, d: materials(s, d).where((F.col("material_id").cast("string") == "17") | (F.col("material_code") == F.upper(F.lit("mat-000023")))).select("material_id", "material_code"),
    "queue_listing": _queue,
    "label_or_range": lambda s, d: reviews(s, d).agg(F.count_if((F.col("action") == "purchase") | (F.col("confidence") >= 0.7)).alias("high"), F.count_if((F.col("action") == "view") | ((F.col("confidence") >= 0.4) & (F.col("confidence") < 0.7))).alias("medium")),
    "analytic_funnel": lambda s, d: A.funnel({"materials": materials(s, d), "owned": _owned(s, d), "matched": _pairs(s, d), "reviewed": _matches(s, d).where("status <> 'PENDING_REVIEW'"), "accepted": _matches(s, d).where("status = 'ACCEPTED'")}),
    "confidence_index": lambda s, d: A.confidence_index(_matches(s, d)),
    "confidence_index_fallback": lambda s, d: A.confidence_index(_matches(s, d).where("status = 'REJECTED'")),
    "roster_by_any_key": lambda s, d: A.roster(_reviewers(s, d), _by_ending(s, d).join(_ended(s, d).select("ending").distinct(), "ending", "left_semi")).select("reviewer_id", "decisions", "last"),
    "inventory_search": lambda s, d: P.page(A.search(P.inventory_by_code(R.chosen(inventory(s, d), sector="ASIA,EUROPE")), "ring", "common_code").where("status = 'AVAILABLE'"), ["common_code", "uom"], 1, 10).select("common_code", "uom", "available", "status", "total_rows"),
    "dominant_plants": lambda s, d: P.dominant_plants(inventory(s, d)),
    "purchase_diversity": lambda s, d: P.purchase_diversity(purchases(s, d)),
    "signal_evidence": lambda s, d: P.demand_signals(demand(s, d)),
}


def _extracted(s, d):
    from .harmonisation import _records

    return E.extracted(_records(s, d))


_SORTED = lambda fields: "[" + ", ".join("NULL" if f is None else "'" + f + "'" for f in fields) + "][k]"
_EXTRACT = {
    "material_family": ["VALVE", "FASTENER", "BEARING", "FLANGE", "HOSE", "PIPE/FITTING", "PIPE/FITTING", "ELECTRICAL"],
    "material_type": ["GATE VALVE", "BOLT", "BALL BEARING", "WELD NECK FLANGE", "HYDRAULIC HOSE", "PIPE", "ELBOW", "CABLE"],
    "material_subtype": [None, "HEX", "DEEP GROOVE", None, None, None, None, None],
    "material": [None, "STAINLESS STEEL", None, None, None, None, None, "XLPE"],
    "material_grade": ["ASTM A216 WCB", "SS 304", None, "ASTM A105", None, None, None, None],
    "size": ["2 IN", "M16X75", None, "4 IN", "1/2 IN", "6 IN", "2 IN", "25 SQ MM"],
    "length": [None, None, None, None, "1000 MM", None, None, None],
    "pressure_class": ["150", None, None, "300", None, None, None, None],
    "schedule": [None, None, None, None, None, "40", None, None],
    "standard": [None, None, None, None, None, "API 5L", None, "IS 7098"],
    "connection_type": ["FLANGED", None, None, "WELD NECK", None, None, None, None],
    "construction": [None, None, None, None, None, "SEAMLESS", None, None],
    "bearing_number": [None, None, "6205", None, None, None, None, None],
    "rating": [None, None, None, None, None, None, "90 DEG", None],
}
_AS_DESCRIBED = ["2 in", "M16X75", None, "4 in", "1/2 in", "6 in", "2 in", "25 sq mm"]
_VALUE = {a: _SORTED(v) for a, v in _EXTRACT.items()} | {
    "size": f"CASE WHEN sized THEN '2 IN' ELSE {_SORTED(_EXTRACT['size'])} END", "pressure_class": f"CASE WHEN spec THEN '150' ELSE {_SORTED(_EXTRACT['pressure_class'])} END", "standard": f"CASE WHEN spec THEN 'API 600' ELSE {_SORTED(_EXTRACT['standard'])} END",
}
_PARTS_SQL = "x AS (SELECT p_partkey AS id, p_partkey % 8 + 1 AS k, p_size % 3 = 0 AS sized, p_size % 2 = 0 AS spec FROM part)"
_CLASHES = f"CASE WHEN sized AND {_SORTED(_AS_DESCRIBED)} IS NOT NULL THEN 'size: ''2 IN'' vs ''' || {_SORTED(_AS_DESCRIBED)} || '''' END, CASE WHEN spec AND k = 4 THEN 'pressure_class: ''150'' vs ''300''' END"
_RECOVER = "coalesce({0}, {1})"

ORACLE_SQL = {
    "extract_attribute_fold": f"WITH {_PARTS_SQL} SELECT id, 1 + " + " + ".join(f"CAST({v} IS NOT NULL AS BIGINT)" for v in _VALUE.values()) + f" AS attributes, concat_ws('; ', {_CLASHES}) AS conflicts, concat_ws(' | ', {', '.join(_VALUE.values())}) AS standardized, concat_ws('|', {', '.join(_key_sql(v) for v in _VALUE.values())}) AS canonical_key FROM x",
    "extracted_conflicts": f"WITH {_PARTS_SQL} SELECT trim(split_part(c, ':', 1)) AS attribute, count(*) AS n FROM (SELECT unnest([{_CLASHES}]) AS c FROM x) WHERE c IS NOT NULL GROUP BY 1",
    "csv_round_trip": sql("SELECT material_code AS code, CASE WHEN size % 5 = 0 THEN description || ', \"big\"' || chr(10) || 'second line é' ELSE description END AS description, nullif(grade, 'Brand#5') AS grade FROM materials"),
    "csv_encodings": "SELECT s_suppkey AS code, 'é' || s_name AS name FROM supplier",
    "csv_malformed_rows": "SELECT CASE WHEN s_suppkey % 10 = 7 THEN CAST(s_suppkey AS VARCHAR) ELSE s_suppkey || ',x,y,z' END AS line FROM supplier WHERE s_suppkey % 10 IN (3, 7)",
    "json_export": sql("SELECT material_id, description, price FROM materials"),
    "tables_loaded": sql("SELECT material_id, price, CAST(NULL AS VARCHAR) AS note FROM materials"),
    "derived_purchases": """SELECT 'E' || p_partkey % 25 AS enterprise, printf('MAT-%06d', p_partkey) AS code, CASE WHEN p_partkey % 2 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'PO-E' || p_partkey % 25 || '-' || printf('%06d', p_partkey) END AS po_number, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'UNKNOWN SUPPLIER' END AS supplier,
      CAST(CASE WHEN p_partkey % 4 > 0 THEN p_size WHEN p_partkey % 5 > 0 THEN p_size * 2 ELSE 1 END AS DOUBLE) AS quantity, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice ELSE 0.0 END AS unit_price, CASE WHEN p_partkey % 7 > 0 THEN '2024-05-06' ELSE '2026-03-31' END AS po_date FROM part""",
    "catalog_scope": sql("SELECT 'A' AS dataset_id, count(*) AS n, count(grade) AS grades, 0::BIGINT AS sizes FROM materials UNION ALL SELECT 'B', count(*), 0, count(size) FROM materials WHERE size > 25"),
    "catalog_registry": "SELECT s_suppkey AS dataset_id, CASE WHEN s_suppkey % 10 = 0 THEN 'BASELINE' ELSE 'UPLOAD' END AS kind, CAST(s_suppkey % 3 AS VARCHAR) AS \"user\", s_acctbal AS created FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 3 = 1",
    "upload_registration": """SELECT day, position, 'UPLOAD-' || day || '-' || printf('%03d', coalesce(l, 0) + row_number() OVER (PARTITION BY day ORDER BY position)) AS dataset_id FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey AS position FROM orders WHERE o_orderpriority = '1-URGENT')
      LEFT JOIN (SELECT strftime(o_orderdate, '%Y%m%d') AS day, max(o_orderkey % 40) AS l FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1) USING (day)""",
    "recovered_columns": sql(""", source AS (SELECT * FROM materials WHERE material_id % 2 = 0), texts AS (SELECT lower(description) AS t, arg_max(grade, material_id) AS g, arg_max(CAST(size AS VARCHAR), material_id) AS z FROM source GROUP BY 1)
      SELECT m.material_code AS code, upper(m.description) AS description, coalesce(CASE WHEN m.material_id % 3 = 0 THEN m.grade END, s.grade, g) AS grade, coalesce(CAST(s.size AS VARCHAR), z) AS size FROM materials m LEFT JOIN source s USING (material_code) LEFT JOIN texts ON t = lower(m.description)"""),
    "row_audit": f"""WITH {_FIELDS_SQL}, steps AS (SELECT id, unit, field, part_no, lower({_SYMBOLLED('field')}) AS f, {_SYMBOLLED('maker')} AS m, {_TRIMMED('part_no')} AS p, CASE upper(unit) WHEN 'PCS' THEN 'NOS' ELSE upper(unit) END AS u, id % 4 IN (1, 2) AS symbols, lower({_SYMBOLLED('field')}) <> {_SYMBOLLED('field')} AS lowered FROM fields)
      SELECT id, f AS field_normalized, m AS maker_normalized, p AS part_no_normalized, u AS unit_normalized, true AS changed, 2 + CAST(symbols AS BIGINT) + CAST(coalesce(lowered, false) AS BIGINT) + CAST(id % 4 = 2 AS BIGINT) AS n_rules,
      concat_ws(';', 'TRIM_WHITESPACE', 'COLLAPSE_WHITESPACE', CASE WHEN symbols THEN 'UNICODE_NORMALIZATION' END, CASE WHEN lowered THEN 'LOWERCASE_TEXT' END, CASE WHEN id % 4 = 2 THEN 'UNIT_CANONICAL' END) AS rules FROM steps""",
    "engineering_text": sql("SELECT material_id, CASE WHEN size % 2 = 0 THEN description WHEN size % 5 > 0 THEN family || ' | ' || grade ELSE 'MATERIAL' END AS text FROM materials"),
    "candidates_with_standards": _sql("""SELECT source_id, candidate_id, coalesce(a.j, '{}') AS source, coalesce(b.j, '{}') AS candidate FROM (SELECT source_id, candidate_id FROM pairs) LEFT JOIN std a ON a.material_id = source_id LEFT JOIN std b ON b.material_id = candidate_id""",
      _OWNED_SQL, "std AS (SELECT material_id, '{\"family\":\"' || family || '\",\"grade\":\"' || grade || '\"}' AS j FROM owned WHERE material_id % 4 <> 1)", pairs=True),
    "conflict_marks": sql("SELECT material_id, CASE WHEN size * 100 < 10000 THEN CAST(size * 100 AS VARCHAR) END AS pressure, CAST(size AS VARCHAR) AS diameter, CASE WHEN contains(description, 'washer') THEN 'WASHER' END AS fastener FROM materials"),
    "material_groups": sql(_EDGES_SQL + " SELECT material_id, coalesce(c, material_id) AS component, coalesce(n, 1) AS members FROM materials LEFT JOIN (SELECT noun, grade, size, min(material_id) AS c, count(*) AS n FROM materials GROUP BY ALL) USING (noun, grade, size)"),
    "group_governance": sql("SELECT material_id, CASE WHEN size % 11 = 0 THEN 'SPLIT_CONFLICT' WHEN n = 1 THEN 'STANDALONE_CANDIDATE' WHEN size % 7 = 0 THEN 'AMBIGUOUS_REVIEW_REQUIRED' ELSE 'VERIFIED_HARMONIZED' END AS governance FROM (SELECT *, count(*) OVER (PARTITION BY noun, grade, size) AS n FROM materials)"),
    "valid_decisions": sql(f"SELECT event_id, coalesce(v IN ('ACCEPT', 'REJECT', 'DEFER') AND length(trim(r)) > 0 AND (v = 'ACCEPT' OR length(trim(r)) >= 10), false) AS valid FROM (SELECT event_id, {_VERDICTS} AS v, {_REASONS} AS r FROM reviews)"),
    "replaced_dataset": _sql("SELECT dataset_id, count(*) AS n FROM owned WHERE dataset_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1", _OWNED_SQL),
    "notifications_acted": sql("SELECT event_id, match_id, event_id % 5 = 0 OR hit AS is_acted, hit AS is_read FROM (SELECT *, match_id IN (SELECT match_id FROM reviews WHERE action = 'purchase' AND confidence > 0.9) AS hit FROM reviews)"),
    "point_lookup": sql("SELECT material_id, material_code FROM materials WHERE material_id IN (17, 23)"),
    "queue_listing": _sql("""SELECT *, count(*) OVER () AS total_rows FROM (SELECT match_id, a.description AS source_text, b.description AS candidate_text, a.enterprise AS source_enterprise, b.enterprise AS candidate_enterprise, confidence FROM matches JOIN owned a ON a.material_id = source_id JOIN owned b ON b.material_id = candidate_id
      WHERE status IN ('PENDING_REVIEW', 'ALREADY_MAPPED') AND (contains(a.description, 'bolt') OR contains(b.description, 'bolt'))) ORDER BY confidence DESC, match_id LIMIT 25""", _OWNED_SQL, _MATCHES_SQL, pairs=True),
    "label_or_range": sql("SELECT count(*) FILTER (WHERE action = 'purchase' OR confidence >= 0.7) AS high, count(*) FILTER (WHERE action = 'view' OR (confidence >= 0.4 AND confidence < 0.7)) AS medium FROM reviews"),
    "analytic_funnel": _sql("SELECT place, stage, n, round(n * 100 / (SELECT count(*) FROM materials), 1) AS pct FROM (" + " UNION ALL ".join(f"SELECT {k} AS place, '{name}' AS stage, count(*) AS n FROM {view}" for k, (name, view) in enumerate([("materials", "materials"), ("owned", "owned"), ("matched", "pairs"), ("reviewed", "matches WHERE status <> 'PENDING_REVIEW'"), ("accepted", "matches WHERE status = 'ACCEPTED'")])) + ")", _OWNED_SQL, _MATCHES_SQL, pairs=True),
    "confidence_index": _sql("SELECT round(avg(confidence) * 100, 1) AS confidence_index FROM matches WHERE status = 'ACCEPTED'", _MATCHES_SQL, pairs=True),
    "confidence_index_fallback": _sql("SELECT round(avg(confidence) FILTER (WHERE confidence >= 0.8) * 100, 1) AS confidence_index FROM matches WHERE status = 'REJECTED'", _MATCHES_SQL, pairs=True),
    "roster_by_any_key": _sql("SELECT reviewer_id, count(DISTINCT decision_id) AS decisions, max(decision_id) AS last FROM reviewers LEFT JOIN decisions ON reviewer = reviewer_id OR reviewer = name OR reviewer = key GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", _MATCHES_SQL, _ENDING_SQL, _REVIEWERS_SQL, pairs=True),
    "inventory_search": sql("""SELECT common_code, uom, available, status, count(*) OVER () AS total_rows FROM (SELECT common_code, uom, available, CASE WHEN available <= 0 THEN 'OUT' WHEN available < on_hand * 0.2 THEN 'LOW' ELSE 'AVAILABLE' END AS status FROM (SELECT common_code, uom, round(sum(on_hand), 2) AS on_hand, round(sum(available), 2) AS available FROM inventory WHERE sector IN ('ASIA', 'EUROPE') GROUP BY ALL))
      WHERE contains(lower(common_code), 'ring') AND status = 'AVAILABLE' ORDER BY common_code, uom LIMIT 10"""),
    "dominant_plants": sql("SELECT common_code, count(*) AS plants, arg_max(plant, (n, plant)) AS dominant_plant FROM (SELECT common_code, plant, count(*) AS n FROM inventory GROUP BY ALL) GROUP BY 1"),
    "purchase_diversity": sql("SELECT common_code, count(DISTINCT supplier) AS makers, count(DISTINCT material_id) AS parts, count(DISTINCT supplier) > 1 AS diverse FROM purchases GROUP BY 1"),
    "signal_evidence": sql("SELECT common_code, count(DISTINCT enterprise) AS enterprises, 2::BIGINT AS threshold, common_code || '|PENDING|' || CASE WHEN count(DISTINCT enterprise) >= 10 THEN 'AGGREGATE' ELSE 'REVIEW' END AS evidence FROM demand GROUP BY 1 HAVING count(DISTINCT enterprise) >= 2"),
}
