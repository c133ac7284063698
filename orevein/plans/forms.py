"""Queries of canonical forms: values made of the parts' names, sizes, brands and numbers in the ways that catalogs write them; the twins state the rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orevein.functions import canonical as K
from orevein.operators import extraction as E
from orevein.sources.generator import catalog

from .views import table

#: Columns of a part as texts, in words that both engines understand.
_NOUN, _WHOLE, _RAW = "split_part(p_name, ' ', -1)", "CAST(p_size AS STRING)", "CAST(p_partkey AS STRING)"
_TEXTS = {
    "size": f"""CASE p_partkey % 20 WHEN 0 THEN 'm' || {_WHOLE} WHEN 1 THEN ' M' || {_WHOLE} || 'X' || {_RAW} WHEN 2 THEN 'm ' || {_WHOLE} WHEN 3 THEN 'dn' || {_WHOLE} WHEN 4 THEN {_WHOLE} || ' Inch' WHEN 5 THEN {_WHOLE} || 'in'
      WHEN 6 THEN {_WHOLE} || ' 1/2 in' WHEN 7 THEN {_WHOLE} || '-3/4  inch' WHEN 8 THEN {_WHOLE} || '/64 IN' WHEN 9 THEN {_WHOLE} || '.5mm' WHEN 10 THEN {_WHOLE} || '  MM' WHEN 11 THEN {_WHOLE} || 'Sq mm' WHEN 12 THEN {_WHOLE} || ' a'
      WHEN 13 THEN '0-' || {_WHOLE} || 'bar' WHEN 14 THEN 'iso  vg ' || {_WHOLE} WHEN 15 THEN 'ep' || {_WHOLE} WHEN 16 THEN {_WHOLE} || '-wire' WHEN 17 THEN {_RAW} WHEN 18 THEN CASE WHEN p_size > 25 THEN 'NaN' ELSE '  ' END ELSE p_name END""",
    "standard": f"""CASE p_partkey % 10 WHEN 0 THEN 'api' || {_RAW} WHEN 1 THEN 'API  ' || {_WHOLE} || 'a; asme b' || {_WHOLE} || '.5' WHEN 2 THEN 'astm a' || {_RAW} WHEN 3 THEN 'iso-' || {_WHOLE} WHEN 4 THEN 'IS' || {_RAW} || ';is ' || {_RAW}
      WHEN 5 THEN 'iec' || {_RAW} || ' ; ' || p_brand WHEN 6 THEN 'iso vg' || {_WHOLE} WHEN 7 THEN 'sae ' || {_WHOLE} || ' r2;en  ' || {_RAW} || ';api' || {_WHOLE} || 'abc' WHEN 8 THEN CASE WHEN p_size > 25 THEN ' ; ' ELSE 'null' END ELSE p_name || ';' || p_type END""",
    "grade": f"""CASE p_partkey % 12 WHEN 0 THEN CAST(300 + p_size AS STRING) WHEN 1 THEN 'a' || CAST(100 + p_size AS STRING) WHEN 2 THEN 'ASTM A ' || CAST(100 + p_size AS STRING) WHEN 3 THEN 'astm a' || CAST(200 + p_size AS STRING) || ' WCB'
      WHEN 4 THEN 'a' || CAST(200 + p_size AS STRING) || ' wpb' WHEN 5 THEN 'ss' || CAST(300 + p_size AS STRING) WHEN 6 THEN 'SS  ' || CAST(300 + p_size AS STRING) || 'L' WHEN 7 THEN 'pt' || CAST(2 * p_size AS STRING)
      WHEN 8 THEN 'astm a' || CAST(100 + p_size AS STRING) || ' gr. B' WHEN 9 THEN CASE WHEN p_size % 2 = 0 THEN 'xlpe aluminium' ELSE 'XLPE Copper' END WHEN 10 THEN CASE WHEN p_size > 25 THEN 'none' ELSE p_brand END ELSE p_name || '  ' || p_type END""",
    "alias": f"""CASE p_partkey % 10 WHEN 0 THEN {_NOUN} WHEN 1 THEN 'Hex ' || {_NOUN} WHEN 2 THEN p_name WHEN 3 THEN upper({_NOUN}) || '  ' || p_type WHEN 4 THEN CASE WHEN p_size > 25 THEN 'SS' ELSE 'stainless steel' END WHEN 5 THEN CASE WHEN p_size > 25 THEN 'Zinc-Plated' ELSE p_brand END
      WHEN 6 THEN CASE WHEN p_size > 25 THEN 'weld-neck' ELSE 'Weld Neck' END WHEN 7 THEN CASE WHEN p_size > 25 THEN 'Valves' ELSE 'pipes & fittings' END WHEN 8 THEN CASE WHEN p_size > 25 THEN 'NaN' ELSE ' none ' END ELSE p_type END""",
    "rating": f"CASE p_partkey % 6 WHEN 0 THEN {_WHOLE} || ' deg' WHEN 1 THEN {_WHOLE} || '°' WHEN 2 THEN {_WHOLE} || ' Degree' WHEN 3 THEN {_WHOLE} || ' bar' WHEN 4 THEN 'null' ELSE p_name || {_WHOLE} || 'DEGrees' END",
    "description": f"""p_name || CASE p_partkey % 9 WHEN 0 THEN ' M' || {_WHOLE} || 'X' || {_RAW} WHEN 1 THEN ' dn ' || {_WHOLE} WHEN 2 THEN ' 1-1/' || {_WHOLE} || ' IN' WHEN 3 THEN ' ' || {_WHOLE} || '/4 in' WHEN 4 THEN ' ' || {_WHOLE} || '.5 IN'
      WHEN 5 THEN ' ' || {_WHOLE} || ' SQ MM' WHEN 6 THEN ' hose ' || {_WHOLE} || 'MM' WHEN 7 THEN ' ' || {_WHOLE} || ' mm' ELSE '' END || ' ' || p_brand""",
}


def _texts(s, d, name: str):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_TEXTS[name]).alias("t"))


def _form(form, text: str, name: str):
    return lambda s, d: _texts(s, d, text).select("id", form(F.col("t")).alias("k")).select("id", F.col("k.value").alias(name), F.col("k.rule").alias("rule"))


_ALIASED = ("family", "type", "material", "coating", "connection")


def _aliases(s, d):
    at = _texts(s, d, "alias").select("id", *(K.aliased(a, F.col("t")).alias(a) for a in _ALIASED))
    return at.select("id", *(F.concat_ws("/", f"{a}.value", f"{a}.rule").alias(a) for a in _ALIASED))


def _measures(s, d):
    sizes = _texts(s, d, "size").select("id", K.dimension(F.col("t"), "length").alias("l"))
    return _texts(s, d, "rating").select("id", K.rating(F.col("t")).alias("r")).join(sizes, "id").select("id", F.col("r.value").alias("rating"), F.concat_ws("/", "l.value", "l.rule").alias("length"))


def _generated(s, d):
    """A made catalog with an item for each part."""
    made = catalog(s, table(s, d, "part").select(F.col("p_partkey").alias("item")))
    return made.groupBy("kind").agg(F.countDistinct("item").alias("items"), F.min("item").alias("first"), F.max("item").alias("last"), F.sum_distinct("item").alias("ids"))


QUERIES = {
    "standards_format": _form(K.standard, "standard", "standard"),
    "size_format": _form(K.size, "size", "size"),
    "grade_format": _form(K.grade, "grade", "grade"),
    "canonical_aliases": _aliases,
    "rating_dimension_format": _measures,
    "extract_sizes_regex": lambda s, d: _texts(s, d, "description").select("id", E.size_in(F.col("t")).alias("size")),
    "generated_catalog": _generated,
}


def _clean_sql(name: str) -> str:
    """id, the text c (null for what means none) and its small letters l."""
    return f"(SELECT id, c, lower(c) AS l FROM (SELECT p_partkey AS id, CASE WHEN lower(trim(t)) NOT IN ('', 'nan', 'none', 'null') THEN trim(t) END AS c FROM (SELECT p_partkey, {_TEXTS[name]} AS t FROM part)))"


def _cases_sql(text: str, name: str, cases: list[tuple[str, str, str]], default: str, rule: str) -> str:
    """The first case (condition, value, rule) that holds."""
    value = " ".join(f"WHEN {when} THEN {to}" for when, to, _ in cases)
    said = " ".join(f"WHEN {when} THEN '{r}'" for when, _, r in cases)
    return f"SELECT id, CASE {value} ELSE {default} END AS {name}, CASE WHEN c IS NULL THEN NULL {said} ELSE '{rule}' END AS rule FROM {_clean_sql(text)}"


_INCHES = r"upper(regexp_replace(l, '\s*(in|inch)$', ' IN'))"
_SIZE_RULES = [
    (r"regexp_full_match(l, '[0-9]+[-\s]+[0-9]+/[0-9]+\s*(in|inch)')", _INCHES, "SIZE_FORMAT_MIXED_INCH"),
    (r"regexp_full_match(l, '[0-9]+/[0-9]+\s*(in|inch)')", _INCHES, "SIZE_FORMAT_FRACTION_INCH"),
    (r"regexp_full_match(l, '[0-9.]+\s*(in|inch)')", _INCHES, "SIZE_FORMAT_INCH"),
    (r"regexp_full_match(l, '[0-9.]+\s*mm')", r"rtrim(left(upper(l), length(l) - 2)) || ' MM'", "SIZE_FORMAT_MM"),
    (r"regexp_full_match(l, '[0-9.]+\s*sq\s*mm')", r"regexp_extract(l, '^[0-9.]+') || ' SQ MM'", "SIZE_FORMAT_SQMM"),
    (r"regexp_full_match(l, '0-[0-9]+\s*bar')", r"regexp_extract(l, '^0-[0-9]+') || ' BAR'", "SIZE_FORMAT_BAR"),
    ("regexp_full_match(l, 'm[0-9]+(x[0-9]+)?')", "upper(l)", "SIZE_FORMAT_METRIC_BOLT"),
    (r"regexp_full_match(l, '[0-9]+\s*a')", "upper(l)", "SIZE_FORMAT_AMPERE"),
    ("l LIKE '%-wire' AND regexp_full_match(l, '[0-9]+-wire')", "upper(l)", "SIZE_FORMAT_WIRE"),
    ("length(l) = 4 AND TRY_CAST(l AS INTEGER) IS NOT NULL", "l", "SIZE_BEARING_NUMBER"),
    (r"regexp_full_match(l, 'iso\s*vg\s*[0-9]+|ep\s*[0-9]+')", r"upper(regexp_replace(l, '\s+', ' ', 'g'))", "SIZE_FORMAT_LUBRICANT"),
]
_GRADE_RULES = [
    ("l = '316'", "l", "GRADE_CANONICAL_316"),
    ("l = '304'", "l", "GRADE_CANONICAL_304"),
    (r"regexp_replace(l, '\s', '', 'g') = 'astma105' OR l = 'a105'", "'ASTM A105'", "GRADE_FORMAT_ASTM_A105"),
    (r"regexp_replace(l, '\s', '', 'g') = 'astma216wcb' OR l IN ('a216 wcb', 'wcb')", "'ASTM A216 WCB'", "GRADE_FORMAT_ASTM_A216_WCB"),
    (r"regexp_replace(l, '\s', '', 'g') = 'astma234wpb' OR l IN ('a234 wpb', 'wpb')", "'ASTM A234 WPB'", "GRADE_FORMAT_ASTM_A234_WPB"),
    (r"regexp_replace(l, '\s', '', 'g') IN ('astma106gr.b', 'astma106grb') OR l IN ('a106 gr.b', 'a106 gr b')", "'ASTM A106 GR.B'", "GRADE_FORMAT_ASTM_A106_GRB"),
    (r"regexp_full_match(l, 'ss\s*316l?')", "'SS ' || upper(ltrim(l[3:]))", "GRADE_FORMAT_SS316"),
    (r"regexp_full_match(l, 'ss\s*304l?')", "'SS ' || upper(ltrim(l[3:]))", "GRADE_FORMAT_SS304"),
    ("l = 'pt100'", "'PT100'", "GRADE_FORMAT_PT100"),
    ("l = 'xlpe aluminium'", "'XLPE ALUMINIUM'", "GRADE_CANONICAL_XLPE_AL"),
    ("l = 'xlpe copper'", "'XLPE COPPER'", "GRADE_CANONICAL_XLPE_CU"),
]
# By attribute, what a value in small letters stands for and the rule, of the values that the texts above can have.
_ALIAS_RULES = {
    "family": [("valves", "VALVE", "FAMILY_CANONICAL"), ("pipes & fittings", "PIPE/FITTING", "FAMILY_CANONICAL")],
    "type": [("bolt", "BOLT", "TYPE_CANONICAL"), ("hex bolt", "BOLT", "TYPE_CANONICAL"), ("nut", "NUT", "TYPE_CANONICAL"), ("hex nut", "NUT", "TYPE_CANONICAL"), ("washer", "WASHER", "TYPE_CANONICAL")],
    "material": [("ss", "STAINLESS STEEL", "MATERIAL_ALIAS_SS"), ("stainless steel", "STAINLESS STEEL", "MATERIAL_CANONICAL")],
    "coating": [("zinc-plated", "ZINC PLATED", "COATING_FORMAT")],
    "connection": [("weld-neck", "WELD NECK", "CONNECTION_FORMAT"), ("weld neck", "WELD NECK", "CONNECTION_CANONICAL")],
}


def _alias_sql(attribute: str) -> str:
    plain = r"regexp_replace(upper(c), '\s+', ' ', 'g')" if attribute == "type" else "upper(c)"
    return f"CASE WHEN c IS NULL THEN '' {' '.join(f'''WHEN l = '{v}' THEN '{to}/{rule}' ''' for v, to, rule in _ALIAS_RULES[attribute])} ELSE {plain} || '/{attribute.upper()}_UPPERCASE' END AS {attribute}"


# For each body, what makes a text one of its standards.
_BODIES_SQL = " ".join(f"WHEN regexp_matches(p, '^{body}{rest}') THEN {{'v': '{body} ' || ltrim(p[{len(body) + 1}:]), 'r': 'STANDARD_FORMAT_{body}'}}" for body, rest in {
    "API": r"\s*[0-9]+[A-Z]?$", "ASME": r"\s*B[0-9]+\.[0-9]+$", "ASTM": r"\s*[A-Z][0-9]", "IEC": r"\s*[0-9]", "ISO": r"\s*(VG\s*)?[0-9]", "IS": r"\s*[0-9]", "SAE": r"\s*[0-9]", "EN": r"\s*[0-9]"}.items())
_GROUP = "regexp_extract(t, '(?i){}', 1)"
_GROUPS = [
    (r"\b(M[0-9]+(?:X[0-9]+)?)\b", "upper({})"), (r"\b(DN\s*[0-9]+)\b", "replace(upper({}), ' ', '')"), (r"\b([0-9]+[-\s]+[0-9]+/[0-9]+\s*in)\b", "lower({})"), (r"\b([0-9]+/[0-9]+\s*in)\b", "lower({})"),
    (r"\b([0-9]+(?:\.[0-9]+)?\s*in)\b", "lower({})"), (r"\b([0-9]+(?:\.[0-9]+)?\s*sq\s*mm)\b", "lower({})"),
]
_FOUND_SQL = "coalesce(" + ", ".join(f"nullif({to.format(_GROUP.format(p))}, '')" for p, to in _GROUPS)

ORACLE_SQL = {
    "standards_format": rf"""SELECT id, nullif(array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.v))), '; '), '') AS standard, CASE WHEN len(f) = 0 OR f IS NULL THEN NULL WHEN len(f) = 1 THEN f[1].r ELSE 'STANDARD_FORMAT_MULTI' END AS rule
      FROM (SELECT id, list_transform(ps, lambda p: CASE {_BODIES_SQL} ELSE {{'v': p, 'r': 'STANDARD_FORMAT_GENERIC'}} END) AS f
        FROM (SELECT id, list_filter(list_transform(string_split(c, ';'), lambda x: regexp_replace(upper(trim(x)), '\s+', ' ', 'g')), lambda x: x <> '') AS ps FROM {_clean_sql("standard")}))""",
    "size_format": _cases_sql("size", "size", _SIZE_RULES, "upper(c)", "SIZE_UPPERCASE"),
    "grade_format": _cases_sql("grade", "grade", _GRADE_RULES, r"upper(regexp_replace(c, '\s+', ' ', 'g'))", "GRADE_UPPERCASE"),
    "canonical_aliases": f"SELECT id, {', '.join(map(_alias_sql, _ALIASED))} FROM {_clean_sql('alias')}",
    "rating_dimension_format": rf"""SELECT id, upper(regexp_replace(r.c, '([0-9]+)\s*(°|deg|degree)', '\1 DEG', 'gi')) AS rating, CASE WHEN s.c IS NULL THEN '' WHEN regexp_full_match(s.l, '[0-9]+(\.[0-9]+)?\s*mm') THEN regexp_extract(s.l, '^[0-9.]+') || ' MM/LENGTH_FORMAT_MM' ELSE upper(s.c) || '/LENGTH_UPPERCASE' END AS length
      FROM {_clean_sql("rating")} r JOIN {_clean_sql("size")} s USING (id)""",
    "extract_sizes_regex": rf"SELECT p_partkey AS id, {_FOUND_SQL}, CASE WHEN lower(t) NOT LIKE '%hose%' THEN lower(nullif({_GROUP.format(r'\b([0-9]+(?:\.[0-9]+)?\s*mm)\b')}, '')) END) AS size FROM (SELECT p_partkey, {_TEXTS['description']} AS t FROM part)",
    "generated_catalog": """SELECT kind, count(*) AS items, min(item) AS first, max(item) AS last, CAST(sum(item) AS BIGINT) AS ids
      FROM (SELECT p_partkey AS item, CASE WHEN p_partkey * 37 % 100 < 40 THEN 'MULTI_ENTERPRISE' WHEN p_partkey * 37 % 100 < 70 THEN 'AMBIGUOUS' ELSE 'STANDALONE' END AS kind FROM part) GROUP BY 1""",
}
