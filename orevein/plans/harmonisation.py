"""Queries that clean, match, validate, group and review catalog records."""

from __future__ import annotations

from pyspark.sql import functions as F

from orevein.functions import canonical as K
from orevein.functions import ids as I
from orevein.functions import similarity as S
from orevein.functions import text as N
from orevein.operators import extraction as E
from orevein.operators import grouping as G
from orevein.operators import linkage as L
from orevein.operators import matching as M
from orevein.operators import review as V
from orevein.sources import catalogs as C

from .views import enterprises, inventory, materials, reviews, sql, table, uuid5_sql

#: A part's description as a catalog would have it, with things to clean up; the same for both engines.
_RAW = ("concat(' ', p_name, '  ', case p_size % 5 when 0 then 'BRG SS' when 1 then 'HEX VAL 2 IN.' when 2 then 'dia 20 mm. PVC' when 3 then '10 × 20 – 5°' else 'CU NO 4 ' end, chr(9), 'X', p_size, ' ')")
_STRIP, _COLLAPSE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')", "regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g')"


def _raw(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_RAW).alias("description"), F.element_at(F.array(*map(F.lit, ["nos", " ea ", "Pcs", "m", "LTR ", "box"])), (F.col("p_size") % 6 + 1)).alias("unit"))


_RAW_SQL = f"raw AS (SELECT p_partkey AS id, {_RAW} AS description, ['nos', ' ea ', 'Pcs', 'm', 'LTR ', 'box'][p_size % 6 + 1] AS unit FROM part)"


def _sql_symbols(x: str) -> str:
    for a, b in N.SYMBOLS.items():
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_expand(x: str) -> str:
    for a, b in N.ABBREVIATIONS.items():  # no underscores here, so word boundaries do
        x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'gi')"
    return x


_STEPS = {
    "TRIM_WHITESPACE": lambda x: _STRIP.format(x),
    "COLLAPSE_WHITESPACE": lambda x: _COLLAPSE.format(x),
    "UNICODE_NORMALIZATION": lambda x: _sql_symbols(f"nfc_normalize({x})"),
    "SAFE_PUNCTUATION": lambda x: f"regexp_replace({x}, '\\b({'|'.join(N.UNITS.split())})\\.(\\s|$)', '\\1\\2', 'gi')",
    "LOWERCASE_TEXT": lambda x: f"lower({x})",
    "ABBREVIATION_EXPANSION": _sql_expand,
}


def _sql_normalised() -> str:
    """Steps as a chain of views, each with the text before and after."""
    views, last = [_RAW_SQL], ("raw", "description")
    for k, (rule, step) in enumerate(_STEPS.items()):
        trail = "[]::VARCHAR[]" if k == 0 else f"CASE WHEN t{k - 1} <> t{k} THEN list_append(trail, '{list(_STEPS)[k - 1]}') ELSE trail END"
        views.append(f"s{k} AS (SELECT id, {'description' if k == 0 else f't{k}'} AS t{k}, {step('description' if k == 0 else f't{k}')} AS t{k + 1}, {trail} AS trail FROM {last[0]})")
        last = (f"s{k}", f"t{k + 1}")
    n = len(_STEPS)
    views.append(f"normal AS (SELECT id, {_STRIP.format(_COLLAPSE.format(f't{n}'))} AS normalized, array_to_string(CASE WHEN t{n - 1} <> t{n} THEN list_append(trail, '{list(_STEPS)[-1]}') ELSE trail END, ';') AS rules FROM s{n - 1})")
    return "WITH " + ", ".join(views)


def _blocks(s, d):
    rows = materials(s, d).withColumn("kind", F.concat_ws(" ", "family", "noun", "grade")).withColumn("sized", F.concat_ws("/", "noun", F.col("size").cast("string"), "family"))
    return M.blocked_pairs(rows, "material_id", {"TYPE": F.col("kind"), "SIZE": F.col("sized"), "MATERIAL_GRADE": F.col("grade")})


_BLOCK_SQL = """, kinds AS (SELECT material_id AS id, unnest(['TYPE', 'SIZE', 'MATERIAL_GRADE']) AS block, unnest([upper(family || ' ' || noun || ' ' || grade), upper(noun || '/' || size || '/' || family), upper(grade)]) AS value FROM materials),
kept AS (SELECT * FROM kinds WHERE (block, value) IN (SELECT (block, value) FROM kinds GROUP BY block, value HAVING count(*) BETWEEN 2 AND 300)),
pairs AS (SELECT x.id AS a, y.id AS b, string_agg(DISTINCT x.block, ',' ORDER BY x.block) AS blocks FROM kept x JOIN kept y USING (block, value) WHERE x.id < y.id GROUP BY ALL)"""


def _features(s, d):
    """Pairs of one type and grade, with the features that a score needs; descriptions are synthetic, and some attributes null. What hangs on one record is worked out before records meet."""
    own = materials(s, d).withColumn("text", S.sorted_tokens(F.concat_ws(" ", "noun", "description", F.concat(F.lit("M"), F.col("size").cast("string"))))).withColumn("sized", F.concat(F.lit("M"), F.nullif(F.col("size") % 4, F.lit(0)).cast("string")))
    own = own.select("material_id", F.concat_ws("|", "family", "noun", "grade").alias("kind"), "text", S.places(F.col("text")).alias("at"), "sized", "owner_id", F.nullif("description", F.lit("red bolt")).alias("name"))
    pairs = M.blocked_pairs(own, "material_id", {"TYPE": F.col("kind")}).select(F.col("a").alias("a_material_id"), F.col("b").alias("b_material_id"))
    for x in "ab":
        pairs = pairs.join(own.select(*(F.col(c).alias(f"{x}_{c}") for c in ("material_id", "text", "at", "sized", "owner_id", "name"))), f"{x}_material_id")
    agree = S.agreement([(F.col("a_sized"), F.col("b_sized")), (F.col("a_name"), F.col("b_name"))])
    hard = F.coalesce(F.col("a_sized") != F.col("b_sized"), F.lit(False))
    common = F.when(F.col("a_at").isNotNull(), S.lcs_of(F.col("a_at"), F.length("a_text"), F.col("b_text"))).otherwise(S.lcs(F.col("a_text"), F.col("b_text")))
    out = pairs.withColumn("raw_sim", F.round(2.0 * common / (F.length("a_text") + F.length("b_text")), 4)).withColumn("_a", agree)
    return out.select(
        F.col("a_material_id").alias("source"), F.col("b_material_id").alias("candidate"), (F.col("a_owner_id") != F.col("b_owner_id")).alias("cross"), F.coalesce(F.col("a_name") == F.col("b_name"), F.lit(False)).alias("key_exact"), F.lit(None).cast("double").alias("embedding"),
        F.lit(None).cast("double").alias("standard_sim"), "raw_sim", F.col("_a.agreement").alias("agreement"), F.col("_a.n").alias("n"), (F.col("a_text") == F.col("b_text")).alias("raw_same"),
        F.when(hard, "HARD_INCOMPATIBLE").otherwise("NO_CONFLICT").alias("class"), F.lit(False).alias("upstream"), F.col("a_sized").alias("a_size"), F.col("b_sized").alias("b_size"), F.col("a_name").alias("a_name"), F.col("b_name").alias("b_name"),
    )


def _lcs_sql(a: str, b: str) -> str:
    inner = f"list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, CASE WHEN substr({a}, i, 1) = substr({b}, CAST(j AS BIGINT), 1) THEN p[j] + 1 ELSE greatest(p[j + 1], r[j]) END), [0]::BIGINT[])"
    return f"list_reduce(range(1, length({a}) + 1), lambda p, i: {inner}, list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)))[-1]"


def _sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


_SIM_SQL = f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part), pairs AS (SELECT x.name AS a, y.name AS b, {_sorted_sql('x.name')} AS sa, {_sorted_sql('y.name')} AS sb FROM names x JOIN names y ON split_part(x.name, ' ', -1) = split_part(y.name, ' ', -1) WHERE x.name < y.name)
SELECT a, b, round(2.0 * {_lcs_sql('sa', 'sb')} / (length(sa) + length(sb)), 4) AS similarity FROM pairs"""


def _name_pairs(s, d):
    """Names with the same last word."""
    names = table(s, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("noun", F.element_at(F.split("name", " "), -1))
    a, b = names.withColumnRenamed("name", "a"), names.withColumnRenamed("name", "b")
    return a.join(b, "noun").where("a < b").select("a", "b", F.round(S.token_sort(F.col("a"), F.col("b")), 4).alias("similarity"))


def _cosines(s, d):
    """The five nearest of its own label, by cosine, of each vector whose id is divisible by 50: these queries against all rows."""
    v = table(s, d, "embeddings")
    found = L.nearest(v.where("vec_id % 50 = 0"), v, "label", 5)
    pairs = found.select("source", "candidate", F.round("score", 4).alias("score"), F.lit(True).alias("cross"), F.lit(False).alias("key_exact"))
    return M.ranked(pairs, 5).select("source", "candidate", "score", "rank")


def _blended(s, d):
    """The features with an embedding's similarity, one of the standardised texts for some pairs, and soft differences."""
    n = F.col("source") + F.col("candidate")
    out = _features(s, d).withColumn("embedding", n % 100 / 100).withColumn("standard_sim", F.when(n % 3 > 0, (F.col("source") * 3 + F.col("candidate")) % 100 / 100))
    return out.withColumn("class", F.when((F.col("class") == "NO_CONFLICT") & (n % 5 == 0), "SOFT_ENGINEERING_DIFFERENCE").otherwise(F.col("class")))


def _scored(s, d):
    return M.score(_features(s, d))


def _records(s, d):
    """Catalog records made of parts, for extraction."""
    nouns = F.element_at(F.array(*map(F.lit, ["gate valve 2 in 150# flanged WCB", "hex bolt M16X75 SS 304", "ball bearing 6205 deep groove", "weld neck flange 4 in class 300 A105", "hydraulic hose 1/2 in 1000 mm", "seamless pipe 6 in sch 40 API 5L", "elbow 90 degree 2 in", "XLPE cable 3 core 25 sq mm IS 7098"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    cats = F.element_at(F.array(*map(F.lit, ["Valves", "Fasteners", "Bearings", "Pipes & Fittings", "Hoses", "Pipes & Fittings", "Pipes & Fittings", "Electrical"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    size = F.when(F.col("p_size") % 3 == 0, "2 IN")
    null = F.lit(None).cast("string")
    return table(s, d, "part").select("p_partkey", cats.alias("category"), null.alias("type"), nouns.alias("description"), F.when(F.col("p_size") % 2 == 0, "API 600; class 150").alias("specification"), null.alias("grade"), size.alias("size"), *(null.alias(c) for c in ("length", "diameter", "coating")), F.lit("ea").alias("unit"), null.alias("manufacturer"), null.alias("part_number"))


def _made(events):
    """Every event as a decision on the match of its number and its actor's last two digits, and what state that is in before any."""
    verdict = F.element_at(F.create_map(*map(F.lit, ["click", "ACCEPT", "view", "DEFER", "purchase", "OVERRIDE", "error", "REJECT", "signup", "DIFFERENT"])), F.col("action"))
    number = F.col("match_id") * 100 + F.col("actor") % 100
    before = F.when(number % 7 == 0, "ALREADY_MAPPED").otherwise("PENDING_REVIEW")
    return events.select(number.alias("match_id"), F.col("event_id").alias("decision_id"), F.col("ts").alias("at"), (F.col("event_id") % 3).cast("string").alias("enterprise"), verdict.alias("verdict"), before.alias("status"))


def _decided(s, d):
    every = _made(reviews(s, d))
    return V.decided(every.select("match_id", "status").distinct(), every.drop("status"))


def _matches(s, d):
    return _scored(s, d).select(F.xxhash64("source", "candidate").alias("match_id"), "source", "candidate", F.col("score").alias("confidence"), F.lit("POTENTIALLY_SAME").alias("category"), F.lit("PENDING_REVIEW").alias("status"))


QUERIES = {
    "normalize_whitespace": lambda s, d: _raw(s, d).select("id", N.collapse(N.strip(F.col("description"))).alias("text")),
    "normalize_unicode_symbols": lambda s, d: _raw(s, d).select("id", N.unicode(F.col("description")).alias("text")),
    "normalize_punctuation": lambda s, d: _raw(s, d).select("id", N.punctuation(F.col("description")).alias("text")),
    "expand_abbreviations": lambda s, d: _raw(s, d).select("id", N.expand(F.col("description")).alias("text")),
    "canonicalize_uom": lambda s, d: _raw(s, d).groupBy(N.uom(F.col("unit")).alias("uom")).agg(F.count("*").alias("n")),
    "normalize_audit_rules": lambda s, d: N.normalised(_raw(s, d), "description").select("id", "normalized", F.array_join("rules", ";").alias("rules")),
    "rule_usage": lambda s, d: N.normalised(_raw(s, d), "description").select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")),
    "canonical_keys": lambda s, d: materials(s, d).select("material_id", N.canonical_key(F.col("family"), F.concat(F.col("noun"), F.lit(" - "), F.col("grade")), F.col("size").cast("string")).alias("key")),
    "canonical_key_frequency": lambda s, d: materials(s, d).groupBy(N.canonical_key(F.col("family"), F.col("noun"), F.col("grade")).alias("key")).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") == 1).alias("single"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_shared")),
    "extract_attribute_fold": lambda s, d: E.standardised(E.extracted(_records(s, d))).select(F.col("p_partkey").alias("id"), F.size("attributes").cast("long").alias("attributes"), "conflicts", "standardized", "canonical_key"),
    "blocking_pairs": _blocks,
    "blocking_reduction": lambda s, d: M.reduction(_blocks(s, d), materials(s, d)),
    "family_token_pairs": lambda s, d: M.blocked_pairs(materials(s, d).withColumn("t", F.concat_ws(" | ", "noun", "grade", F.col("size").cast("string"))), "material_id", {"FAMILY_TOKEN[]": M.family_tokens(F.col("family"), F.col("t"))}, most=M.MOST_OF_A_TOKEN),
    "token_sort_similarity": _name_pairs,
    "attribute_agreement": lambda s, d: _features(s, d).select("source", "candidate", "agreement", "n"),
    "pair_scores": lambda s, d: _scored(s, d).select("source", "candidate", "description_sim", "penalty", "score", "confidence"),
    "pair_scores_blended": lambda s, d: M.score(_blended(s, d)).select("source", "candidate", "description_sim", "penalty", "score", "confidence"),
    "candidates_topk": lambda s, d: M.ranked(M.both_ways(_scored(s, d).select("source", "candidate", "score", "cross", "key_exact")), 3).select("source", "candidate", "score", "rank"),
    "embedding_cosine_topk": _cosines,
    "tfidf_weights": lambda s, d: S.tfidf(materials(s, d), "description", "material_id").select("material_id", F.explode("vector").alias("term", "w")).select("material_id", "term", F.round("w", 6).alias("weight")),
    "validation_status": lambda s, d: M.validated(_scored(s, d), ["size", "name"]).groupBy("validation", "conflict_class", F.array_join("reasons", ";").alias("reasons")).agg(F.count("*").alias("n")),
    "refined_confidence": lambda s, d: M.refined(M.validated(_scored(s, d), ["size", "name"])).groupBy("refined_confidence", "priority").agg(F.count("*").alias("n"), F.round(F.avg("refined"), 4).alias("refined")),
    "review_partitions": lambda s, d: M.refined(M.validated(_scored(s, d), ["size", "name"])).groupBy(M.partition_of(F.col("priority"), F.col("validation")).alias("part")).agg(F.count("*").alias("n")),
    "cross_match_category": lambda s, d: M.cross_category(_scored(s, d)).groupBy("category", "label", "status").agg(F.count("*").alias("n")),
    "conflict_class": lambda s, d: _conflicts(s, d),
    "components": lambda s, d: G.components(_edges(s, d)).groupBy("component").agg(F.count("*").alias("members"), F.max("node").alias("largest")),
    "clique_split": lambda s, d: G.cliques(_edges(s, d).withColumn("score", F.lit(1.0)), _edges(s, d).where("(a + b) % 3 = 0").select("a", "b")).groupBy("component", "clique").agg(F.count("*").alias("members")),
    "common_codes": lambda s, d: G.coded(materials(s, d).groupBy("family", "noun").agg(F.count("*").alias("members")).withColumn("content", F.concat_ws("|", "family", "noun")), "CMN", "family", "content").select("family", "noun", "members", "code"),
    "crosswalk": lambda s, d: G.crosswalk(_coded_materials(s, d), _accepted(s, d)).drop("mapping_id"),
    "crosswalk_uuid5": lambda s, d: G.crosswalk(_coded_materials(s, d), _accepted(s, d)).select("enterprise", "material_code", "mapping_id"),
    "consolidate_attributes": lambda s, d: G.consolidated(materials(s, d).withColumn("v", F.when(F.col("size") % 2 == 0, F.col("noun")).otherwise(F.col("description"))), "grade", "v"),
    "decision_state_machine": lambda s, d: _decided(s, d),
    "mapping_propagation": lambda s, d: V.propagated(inventory(s, d).select("material_id", "on_hand"), V.mapped(_acceptances(s, d))).groupBy("record").agg(F.count("*").alias("n"), F.round(F.sum("on_hand"), 2).alias("on_hand")),
    "upgrade_superseded": lambda s, d: V.upgrades(_matches(s, d).withColumn("confidence", F.lit(0.9)), V.mapped(_acceptances(s, d))).select("material", "record", "status", "old_status"),
    "ingest_dedup_descriptions": lambda s, d: C.deduplicated(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id"),
    "upload_duplicate_check": lambda s, d: C.duplicate_codes(table(s, d, "part"), "p_brand", "p_name"),
    "derived_inventory": lambda s, d: C.derived_inventory(_facts(s, d)).select("code", "on_hand", "reserved", "available"),
    "derived_demand": lambda s, d: C.derived_demand(_facts(s, d), "2026-Q1").select("code", "required", "forecast", "period"),
    "append_versions": lambda s, d: V.versions(reviews(s, d), "match_id", F.col("ts"), F.col("event_id")).select("event_id", "match_id", "version"),
    "evidence_hash": lambda s, d: materials(s, d).select("material_id", V.evidence_hash("family", "grade", "noun").alias("hash")),
    "unique_enterprise_codes": lambda s, d: V.unique_codes(table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("E"), F.col("s_nationkey").cast("string")).alias("code")), "code", "s_suppkey").select("s_suppkey", "unique_code"),
    "uuid5_codes": lambda s, d: materials(s, d).select("material_id", I.uuid5(F.col("material_code")).alias("uuid")),
}


def _facts(s, d):
    status = F.element_at(F.array(*map(F.lit, ["Active", "Slow-Moving", "Obsolete"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    null = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size").cast("string"))
    use = F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise((F.col("p_size") * 40).cast("string"))
    return table(s, d, "part").select(F.col("p_partkey").alias("code"), status.alias("status"), use.alias("consumption"), null.alias("on_hand"), null.alias("required"))


def _edges(s, d):
    """Links between materials of one noun, grade and size."""
    own = materials(s, d).withColumn("alike", F.concat_ws("|", "noun", "grade", F.col("size").cast("string")))
    return M.blocked_pairs(own, "material_id", {"ALIKE": F.col("alike")}).select("a", "b")


def _coded_materials(s, d):
    return materials(s, d).join(enterprises(s, d), F.col("owner_id") == F.col("enterprise_id")).select("enterprise", "material_code", F.concat_ws("|", "common_code", "grade").alias("record"))


def _accepted(s, d):
    """Pairs of one noun, grade and size, as accepted for the record of their first material."""
    at = _edges(s, d).join(materials(s, d).select(F.col("material_id").alias("a"), F.concat_ws("|", "common_code", "grade").alias("record")), "a")
    return at.select("record", F.concat_ws("-", F.format_string("%06d", "a"), F.format_string("%06d", "b")).alias("pair_id"))


def _acceptances(s, d):
    return _edges(s, d).select(F.concat(F.lit("R"), F.col("a").cast("string")).alias("record"), F.col("a").alias("source"), F.col("b").alias("candidate"), (F.col("a") % 10).alias("at"))


#: Records that conflict in one way or another: text, family, type, subtype, grade, material, size, length, diameter, pressure, standard, conflicts as extracted.
_CONFLICT_FIELDS = "text family type subtype grade material size length diameter pressure standard conflicts".split()
_CONFLICT_KINDS = [
    "GATE VALVE 2 IN CLASS 150 WCB|VALVE|GATE VALVE|||||||||", "GATE VALVE 2 IN CLASS 300 WCB|VALVE|GATE VALVE|||||||||", "GATE VALVE 2 IN 150# CF8M|VALVE|GATE VALVE|||||||||", "BALL VALVE 3 IN PN 16|VALVE|BALL VALVE|||||||||", "GLOBE VALVE 2 IN|VALVE||||||||||",
    "BUTTERFLY VALVE 2 INCH|VALVE||||||||||", "BALL BEARING 6205||||||6205|||||", "CHECK NUT||||||6206|||||", "HEX BOLT M16 SS304|FASTENER|BOLT||||M16|||||", "HEX BOLT M16 SS 304L|FASTENER|BOLT||||M16X75|||||", "HEX BOLT M16 SS316|FASTENER|BOLT||||M16|||||",
    "HEX BOLT M20 GRADE 8.8|FASTENER|BOLT||||M20||||IS 1363|", "STUD BOLT M20 GRADE 10.9|FASTENER|BOLT||||M20||||IS 1364|", "CABLE 3 C 25 SQ MM COPPER|ELECTRICAL||||||||||", "CABLE 3 C 25 SQMM ALUMINIUM|ELECTRICAL||||||||||", "CABLE 4C 25 SQ. MM ALUMINUM|ELECTRICAL||||||||||",
    "CABLE 3 C 35 SQ MM|ELECTRICAL||||||||||", "GASKET NITRILE|SEAL||||||||||", "GASKET EPDM|SEAL||SPIRAL WOUND||||||||", "GASKET|SEAL||FLAT||||||||", "FLANGE|FLANGE|||A105|CARBON STEEL|2 IN||||API 600|", "FLANGE|FLANGE|||ASTM A105|CARBON STEEL|2 IN||||API 600|", "FLANGE|FLANGE|||WCB|STAINLESS STEEL|3 IN|||300|API 608|",
    "FLANGE|FLANGE||||RUBBER|2 IN||||API 608|", "SENSOR|INSTRUMENT|||||4-WIRE|||||", "SENSOR|INSTRUMENT|||||500 MM|100 MM||||", "SENSOR|INSTRUMENT|||||500 MM|200 MM|10 MM|||", "SENSOR|INSTRUMENT|||||500 MM||12 MM|||grade: 'ASTM A105' vs 'A105'",
    "ELBOW|PIPE|||316||||||IS 1363|", "ELBOW|PIPE|||SS 316||||||IS 1363|", "ELBOW|PIPE|||304|||||150||", "ELBOW|PIPE||||||||||",
]


def _conflict_records(s, d):
    at = F.split(F.element_at(F.array(*map(F.lit, _CONFLICT_KINDS)), (F.col("material_id") % len(_CONFLICT_KINDS) + 1).cast("int")), r"\|")
    fields = [F.nullif(F.get(at, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(_CONFLICT_FIELDS)]
    own = materials(s, d).select("material_id", F.floor(F.col("material_id") / len(_CONFLICT_KINDS)).alias("lot"), *fields)
    return own.withColumn("marks", M.text_marks(F.col("text")))


def _conflicts(s, d):
    """Conflicts of all pairs of a lot, of which each has every kind of record once."""
    own = _conflict_records(s, d)
    a, b = (own.select("lot", *(F.col(c).alias(f"{x}_{c}") for c in own.columns if c != "lot")) for x in "ab")
    pairs = a.join(b, "lot").where("a_material_id < b_material_id").withColumn("c", M.conflict("a_", "b_"))
    return pairs.groupBy(F.col("c.class").alias("class"), F.array_join("c.reasons", "; ").alias("reasons")).agg(F.count("*").alias("n"))


def _conflict_rules() -> tuple[str, str]:
    """The rules of conflicts in SQL: columns of what the upper-cased text `up` says, and columns hard, soft, later and written of records a and b."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    marks = []
    for k, (words, whole) in enumerate(M.OPPOSED.values()):
        hit = lambda w: f"regexp_matches(up, '\\b{w}\\b')" if whole else f"contains(up, '{w}')"  # noqa: B023, E731
        marks.append("CASE " + " ".join(f"WHEN {hit(w)} THEN '{w}'" for w in words) + f" END AS s{k}")
    for k, (pattern, group) in enumerate(M.MEASURES.values(), len(M.OPPOSED)):
        marks.append(f"nullif(regexp_extract(up, {q(pattern)}, {group}), '') AS s{k}")
    same = {0: "CASE WHEN contains({0}.s0, 'ALUM') THEN 'AL' ELSE {0}.s0 END", 5: "regexp_replace({0}.s5, '[^0-9]', '', 'g')", 6: "replace({0}.s6, ' ', '')"}
    of = lambda k, x: same.get(k, f"{{0}}.s{k}").format(x)
    diff = lambda n: f"upper(a.{n}) <> upper(b.{n})"
    either = lambda n, x, y: f"((contains(upper(a.{n}), '{x}') AND contains(upper(b.{n}), '{y}')) OR (contains(upper(a.{n}), '{y}') AND contains(upper(b.{n}), '{x}')))"
    versus = lambda label, n: f"{q(label)} || ': ' || chr(39) || a.{n} || chr(39) || ' vs ' || chr(39) || b.{n} || chr(39)"
    metric, inch = (lambda x: f"nullif(regexp_extract(upper({x}.size), '^M([0-9]+)', 1), '')"), (lambda x: f"nullif(regexp_extract(upper({x}.size), '^([0-9]+(?:/[0-9]+)?)\\s*IN', 1), '')")
    threads = f"({metric('a')} IS NOT NULL AND {metric('b')} IS NOT NULL)"
    hard = [(diff("family"), versus("Material family mismatch", "family")), (diff("type"), versus("Material type mismatch", "type"))]
    for k, name in enumerate([*M.OPPOSED, *M.MEASURES]):
        apart = f"{of(k, 'a')} <> {of(k, 'b')}"
        if name == "fastener grade":
            apart += "".join(f" AND NOT (contains(a.s{k}, '{g}') AND contains(b.s{k}, '{g}'))" for g in ("304", "316"))
        hard.append((apart, f"'Incompatible {name}: ' || a.s{k} || ' vs ' || b.s{k}"))
    hard += [(either("grade", "304", "316"), versus("Incompatible stainless steel grade", "grade")), (either("grade", "A105", "WCB"), versus("Incompatible steel form (forged vs cast)", "grade")), (either("grade", "CARBON", "STAINLESS"), versus("Incompatible base metallurgy", "grade"))]
    hard += [(either("material", "CARBON STEEL", "STAINLESS STEEL"), versus("Base material incompatibility", "material")), (either("material", "RUBBER", "STEEL"), versus("Base material incompatibility", "material"))]
    size = diff("size")
    hard += [(f"{size} AND {metric('a')} <> {metric('b')}", versus("Incompatible metric bolt diameter", "size")), (f"{size} AND NOT {threads} AND {inch('a')} <> {inch('b')}", versus("Incompatible pipe/valve nominal size", "size"))]
    hard += [(f"{size} AND regexp_matches(a.size, '^[0-9]+$') AND regexp_matches(b.size, '^[0-9]+$')", versus("Incompatible bearing number", "size")), (f"{size} AND NOT {threads} AND NOT {either('size', 'WIRE', 'MM')}", versus("Incompatible engineering size", "size"))]
    hard += [(diff("pressure"), versus("Pressure class mismatch", "pressure")), (either("standard", "API 600", "API 608"), versus("Standard incompatibility (gate vs ball valve)", "standard"))]
    soft = [(f"{size} AND {metric('a')} = {metric('b')}", versus("Fastener length/specification variance", "size")), (f"{size} AND {either('size', 'WIRE', 'MM')}", versus("Sensor wiring specification vs dimension", "size")), (either("standard", "IS 1363", "IS 1364"), versus("Fastener product grade variance", "standard"))]
    then = [(diff("length"), versus("Length dimension variance", "length")), (diff("diameter"), versus("Diameter dimension variance", "diameter")), (f"{diff('subtype')} AND (contains(a.subtype, 'SPIRAL') OR contains(b.subtype, 'SPIRAL'))", versus("Construction subtype variance", "subtype"))]
    both = " OR ".join(f"(contains(a.grade, '{g}') AND contains(b.grade, '{g}'))" for g in ("A105", "WCB", "316"))
    written = [(f"{diff('grade')} AND ({both})", versus("Standard/grade prefix representation difference", "grade")), ("contains(a.conflicts, 'A105') OR contains(b.conflicts, 'ASTM A105')", "'Phase 3 preserved grade representation conflict: ASTM A105 vs A105'")]
    first = lambda cases: "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in cases) + " END"
    every = lambda cases: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, r in cases) + ")"
    return ", ".join(marks), f"{first(hard)} AS hard, nullif({every(soft)}, '') AS soft, {first(then)} AS later, nullif({every(written)}, '') AS written"


def _conflict_sql() -> str:
    marks, rules = _conflict_rules()
    fields = ", ".join(f"nullif(p[{k + 1}], '') AS {n}" for k, n in enumerate(_CONFLICT_FIELDS))
    kinds = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _CONFLICT_KINDS) + "]"
    return sql(f""", k AS (SELECT material_id, material_id // {len(_CONFLICT_KINDS)} AS lot, string_split({kinds}[material_id % {len(_CONFLICT_KINDS)} + 1], '|') AS p FROM materials), f AS (SELECT material_id, lot, {fields} FROM k),
      m AS (SELECT *, {marks} FROM (SELECT *, upper(coalesce(text, '')) AS up FROM f)), c AS (SELECT {rules} FROM m a JOIN m b USING (lot) WHERE a.material_id < b.material_id)
      SELECT CASE WHEN hard IS NOT NULL THEN 'HARD_INCOMPATIBLE' WHEN soft IS NOT NULL OR later IS NOT NULL THEN 'SOFT_ENGINEERING_DIFFERENCE' WHEN written IS NOT NULL THEN 'REPRESENTATION_DIFFERENCE' ELSE 'NO_CONFLICT' END AS class,
      coalesce(hard, soft, later, written, 'No engineering or representation conflicts detected') AS reasons, count(*) AS n FROM c GROUP BY ALL""")


def _key_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(upper({x}), '[\\s/\\-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g'), '^_+|_+$', '', 'g')"


def _tsr_sql(a: str, b: str) -> str:
    return f"(2.0 * {_lcs_sql(a, b)} / (length({a}) + length({b})))"


_FEATURE_SQL = f""", own AS (SELECT material_id, family, noun, grade, owner_id, {_sorted_sql("noun || ' ' || description || ' M' || size")} AS text, 'M' || nullif(size % 4, 0) AS sized, {_sorted_sql("upper(nullif(description, 'red bolt'))")} AS name FROM materials),
duos AS (SELECT x.material_id AS source, y.material_id AS candidate, x.owner_id <> y.owner_id AS crossed, x.text AS ta, y.text AS tb, x.sized AS za, y.sized AS zb, x.name AS na, y.name AS nb FROM own x JOIN own y USING (family, noun, grade) WHERE x.material_id < y.material_id AND (family, noun, grade) IN (SELECT (family, noun, grade) FROM own GROUP BY family, noun, grade HAVING count(*) <= 300)),
each_one AS (SELECT *, {_tsr_sql('ta', 'tb')} AS tsr, CASE WHEN za IS NULL AND zb IS NULL THEN NULL WHEN za IS NULL OR zb IS NULL THEN 0.0 WHEN za = zb THEN 1.0 ELSE {_tsr_sql('za', 'zb')} END AS z,
  CASE WHEN na IS NULL AND nb IS NULL THEN NULL WHEN na IS NULL OR nb IS NULL THEN 0.0 WHEN na = nb THEN 1.0 ELSE {_tsr_sql('na', 'nb')} END AS m FROM duos),
features AS (SELECT *, round(tsr, 4) AS raw_sim, coalesce(za <> zb, false) AS hard, coalesce(na = nb, false) AS key_exact, ta = tb AS raw_same, CAST((z IS NOT NULL)::INT + (m IS NOT NULL)::INT AS BIGINT) AS n,
  coalesce(round((CASE WHEN z < 0.5 THEN 0 ELSE coalesce(z, 0) END + CASE WHEN m < 0.5 THEN 0 ELSE coalesce(m, 0) END) / nullif((z IS NOT NULL)::INT + (m IS NOT NULL)::INT, 0), 4), 0.0) AS agreement FROM each_one),
based AS (SELECT *, CASE WHEN key_exact AND NOT hard THEN 0.25 ELSE 0.0 END::DOUBLE + 0.2::DOUBLE * raw_sim + 0.25::DOUBLE * raw_sim + 0.3::DOUBLE * agreement * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0, n / 4)) AS base, CASE WHEN hard THEN 0.65 ELSE 0.0 END::DOUBLE AS penalty FROM features),
scored AS (SELECT *, CASE WHEN hard THEN least(0.25, greatest(0.05, round(base - penalty + 1e-9, 4))) ELSE round(1e-9 + least(CASE WHEN raw_same THEN 1.0 WHEN raw_sim < 0.50 THEN 0.45 WHEN raw_sim < 0.70 THEN 0.68 WHEN raw_sim < 0.85 THEN 0.82 ELSE 0.94 END::DOUBLE, greatest(0.0, base - penalty)), 4) END AS score FROM based),
labelled AS (SELECT *, CASE WHEN hard THEN 'LOW' WHEN score >= 0.80 AND key_exact THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM scored)"""

_COS = """SELECT source, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate) AS rank FROM (SELECT x.vec_id AS source, y.vec_id AS candidate,
  round(least(1.0, greatest(0.0, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 4) AS score FROM embeddings x JOIN embeddings y USING (label) WHERE x.vec_id <> y.vec_id AND x.vec_id % 50 = 0)) WHERE rank <= 5"""
_EDGES_SQL = ", edges AS (SELECT x.material_id AS a, y.material_id AS b FROM materials x JOIN materials y USING (noun, grade, size) WHERE x.material_id < y.material_id AND (noun, grade, size) IN (SELECT (noun, grade, size) FROM materials GROUP BY noun, grade, size HAVING count(*) <= 300))"
_ACCEPTED_SQL = _EDGES_SQL + ", accepted AS (SELECT common_code || '|' || grade AS record, min(printf('%06d-%06d', a, b)) AS pair_id FROM edges JOIN materials ON a = material_id GROUP BY ALL)"
_MAPPED_SQL = _EDGES_SQL + ", mapped AS (SELECT material, arg_max(record, (day, record)) AS record FROM (SELECT 'R' || a AS record, a % 10 AS day, unnest([a, b]) AS material FROM edges) GROUP BY material)"
_FACTS_SQL = "facts AS (SELECT p_partkey AS code, ['Active', 'Slow-Moving', 'Obsolete'][p_partkey % 3 + 1] AS status, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 40 END AS consumption, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS DOUBLE) END AS given FROM part)"

#: Each decision and the state have the same fields, so that a fold can take one into the other.
_STATE = "{'status': %s, 'endorser': %s, 'errors': %s, 'n': %s, 'enterprise': %s, 'verdict': %s}"
_OPEN, _GATE = "s.status IN ('PENDING_REVIEW', 'GATE_1_APPROVED', 'ALREADY_MAPPED')", "s.status = 'GATE_1_APPROVED'"
_AGAIN = f"coalesce(x.verdict = 'ACCEPT' AND {_GATE} AND s.endorser = x.enterprise, false)"
_STEP = _STATE % (
    f"CASE WHEN NOT {_OPEN} OR {_AGAIN} OR x.verdict = 'DEFER' THEN s.status WHEN x.verdict = 'OVERRIDE' THEN 'ACCEPTED' WHEN x.verdict = 'ACCEPT' AND s.status <> 'PENDING_REVIEW' THEN 'ACCEPTED' WHEN x.verdict = 'ACCEPT' THEN 'GATE_1_APPROVED' WHEN x.verdict = 'DIFFERENT' OR {_GATE} THEN 'DIFFERENT' ELSE 'REJECTED' END",
    "CASE WHEN s.status = 'PENDING_REVIEW' AND x.verdict = 'ACCEPT' THEN x.enterprise ELSE s.endorser END", f"s.errors + CASE WHEN NOT {_OPEN} OR {_AGAIN} THEN 1 ELSE 0 END", "s.n + 1", "NULL::VARCHAR", "NULL::VARCHAR",
)
_DECIDED_SQL = f""", made AS (SELECT match_id * 100 + actor % 100 AS match_id, ts, event_id, CAST(event_id % 3 AS VARCHAR) AS enterprise, CASE action WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'DEFER' WHEN 'purchase' THEN 'OVERRIDE' WHEN 'error' THEN 'REJECT' ELSE 'DIFFERENT' END AS verdict FROM reviews),
lists AS (SELECT match_id, list({_STATE % ('NULL::VARCHAR', 'NULL::VARCHAR', '0::BIGINT', '0::BIGINT', 'enterprise', 'verdict')} ORDER BY ts, event_id) AS d FROM made GROUP BY match_id),
ends AS (SELECT match_id, list_reduce(list_prepend({_STATE % ("CASE WHEN match_id % 7 = 0 THEN 'ALREADY_MAPPED' ELSE 'PENDING_REVIEW' END", 'NULL::VARCHAR', '0::BIGINT', '0::BIGINT', 'NULL::VARCHAR', 'NULL::VARCHAR')}, d), lambda s, x: {_STEP}) AS e FROM lists)
SELECT match_id, e.status AS status, e.endorser AS endorser, e.n AS decisions, e.errors AS errors FROM ends"""
_VALIDATED_SQL = """judged AS (SELECT *, coalesce((za IS NOT NULL AND zb IS NOT NULL)::INT, 0) + coalesce((na IS NOT NULL AND nb IS NOT NULL)::INT, 0) AS filled, coalesce((za = zb)::INT, 0) + coalesce((na = nb)::INT, 0) AS agreeing, coalesce(na <> nb, false) AS soft FROM labelled),
validated AS (SELECT *, CASE WHEN hard THEN 'HARD_INCOMPATIBLE' WHEN soft THEN 'SOFT_ENGINEERING_DIFFERENCE' ELSE 'NO_CONFLICT' END AS conflict_class,
  concat_ws(';', CASE WHEN key_exact THEN 'EXACT_CANONICAL_KEY' END, CASE WHEN soft THEN 'SECONDARY_ATTR_DIFFERENCE' END, CASE WHEN hard THEN 'SIZE_MISMATCH' END, CASE WHEN filled < 2 AND NOT key_exact THEN 'SPARSE_ATTRIBUTES' END) AS reasons,
  CASE WHEN hard THEN 'ENGINEERING_INCOMPATIBLE' WHEN filled < 2 AND NOT key_exact THEN 'INSUFFICIENT_EVIDENCE' WHEN soft THEN 'REVIEW_REQUIRED' WHEN key_exact OR (score >= 0.85 AND filled = agreeing) THEN 'VALIDATED_COMPATIBLE' WHEN score >= 0.70 THEN 'PROBABLE_COMPATIBLE' ELSE 'REVIEW_REQUIRED' END AS validation FROM judged)"""
_REFINED_SQL = """refined_ones AS (SELECT *, round(CASE validation WHEN 'ENGINEERING_INCOMPATIBLE' THEN least(0.39, greatest(0.0, score - 0.50)) WHEN 'INSUFFICIENT_EVIDENCE' THEN least(0.49, greatest(0.0, score - 0.20)) WHEN 'REVIEW_REQUIRED' THEN least(0.79, greatest(0.40, score - 0.15))
  WHEN 'PROBABLE_COMPATIBLE' THEN least(0.95, greatest(0.65, score)) ELSE least(1.0, greatest(0.85, score)) END, 4) AS refined FROM validated),
prioritised AS (SELECT *, CASE WHEN validation IN ('ENGINEERING_INCOMPATIBLE', 'INSUFFICIENT_EVIDENCE') THEN 'LOW' WHEN validation = 'REVIEW_REQUIRED' THEN 'MEDIUM' WHEN validation = 'VALIDATED_COMPATIBLE' OR refined >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS refined_confidence,
  CASE WHEN validation IN ('ENGINEERING_INCOMPATIBLE', 'INSUFFICIENT_EVIDENCE') THEN 'LOW' WHEN crossed AND validation = 'REVIEW_REQUIRED' THEN 'CRITICAL' WHEN crossed THEN 'HIGH' WHEN validation IN ('REVIEW_REQUIRED', 'VALIDATED_COMPATIBLE') THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM refined_ones)"""

ORACLE_SQL = {
    "normalize_whitespace": f"WITH {_RAW_SQL} SELECT id, {_COLLAPSE.format(_STRIP.format('description'))} AS text FROM raw",
    "normalize_unicode_symbols": f"WITH {_RAW_SQL} SELECT id, {_STEPS['UNICODE_NORMALIZATION']('description')} AS text FROM raw",
    "normalize_punctuation": f"WITH {_RAW_SQL} SELECT id, {_STEPS['SAFE_PUNCTUATION']('description')} AS text FROM raw",
    "expand_abbreviations": f"WITH {_RAW_SQL} SELECT id, {_sql_expand('description')} AS text FROM raw",
    "canonicalize_uom": f"WITH {_RAW_SQL} SELECT CASE upper({_STRIP.format('unit')}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.UOM.items()) + f" ELSE upper({_STRIP.format('unit')}) END AS uom, count(*) AS n FROM raw GROUP BY 1",
    "normalize_audit_rules": f"{_sql_normalised()} SELECT * FROM normal",
    "rule_usage": f"{_sql_normalised()} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ';')) AS rule FROM normal WHERE rules <> '') GROUP BY rule",
    "canonical_keys": sql(f"SELECT material_id, {_key_sql('family')} || '|' || {_key_sql(chr(39).join(['noun || ', ' - ', ' || grade']))} || '|' || {_key_sql('CAST(size AS VARCHAR)')} AS key FROM materials"),
    "canonical_key_frequency": sql("SELECT count(*) AS keys, count(*) FILTER (WHERE n = 1) AS single, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS in_shared FROM (SELECT count(*) AS n FROM materials GROUP BY family, noun, grade)"),
    "conflict_class": _conflict_sql(),
    "uuid5_codes": sql(f"SELECT material_id, {uuid5_sql('material_code')} AS uuid FROM materials"),
    "crosswalk_uuid5": sql(f"SELECT enterprise, material_code, {uuid5_sql(chr(39) + 'LEGACY_MAP:' + chr(39) + ' || enterprise || ' + chr(39) + ':' + chr(39) + ' || material_code || ' + chr(39) + ':' + chr(39) + ' || record')} AS mapping_id FROM (SELECT enterprise, material_code, common_code || '|' || grade AS record FROM materials JOIN enterprises ON owner_id = enterprise_id)"),
    "decision_state_machine": sql(_DECIDED_SQL),
    "validation_status": sql(f"{_FEATURE_SQL}, {_VALIDATED_SQL} SELECT validation, conflict_class, reasons, count(*) AS n FROM validated GROUP BY ALL"),
    "refined_confidence": sql(f"{_FEATURE_SQL}, {_VALIDATED_SQL}, {_REFINED_SQL} SELECT refined_confidence, priority, count(*) AS n, round(avg(refined), 4) AS refined FROM prioritised GROUP BY ALL"),
    "review_partitions": sql(f"{_FEATURE_SQL}, {_VALIDATED_SQL}, {_REFINED_SQL} SELECT CASE WHEN priority IN ('CRITICAL', 'HIGH') THEN 'ACTIVE' WHEN validation IN ('ENGINEERING_INCOMPATIBLE', 'INSUFFICIENT_EVIDENCE') THEN 'DISQUALIFIED' ELSE 'SECONDARY' END AS part, count(*) AS n FROM prioritised GROUP BY ALL"),
    "upgrade_superseded": sql(f"""{_MAPPED_SQL}, kinds AS (SELECT material_id, family, noun, grade FROM materials), duos AS (SELECT x.material_id AS source, y.material_id AS candidate FROM kinds x JOIN kinds y USING (family, noun, grade) WHERE x.material_id < y.material_id AND (family, noun, grade) IN (SELECT (family, noun, grade) FROM kinds GROUP BY family, noun, grade HAVING count(*) <= 300))
      SELECT DISTINCT other AS material, record, 'ALREADY_MAPPED' AS status, 'SUPERSEDED_BY_RECORD' AS old_status FROM (SELECT source AS material, candidate AS other FROM duos UNION ALL SELECT candidate, source FROM duos) JOIN mapped USING (material) WHERE other NOT IN (SELECT material FROM mapped)"""),
    "blocking_pairs": sql(f"{_BLOCK_SQL} SELECT * FROM pairs"),
    "blocking_reduction": sql(f"{_BLOCK_SQL} SELECT n AS records, p AS pairs, round(1 - p / (n * (n - 1) / 2), 6) AS reduction FROM (SELECT count(*) AS n FROM materials), (SELECT count(*) AS p FROM pairs)"),
    "family_token_pairs": sql(""", tokens AS (SELECT DISTINCT material_id AS id, upper(family) || '~' || t AS v FROM (SELECT material_id, family, unnest([upper(noun), upper(grade), CAST(size AS VARCHAR)]) AS t FROM materials) WHERE length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')),
      kept AS (SELECT * FROM tokens WHERE v IN (SELECT v FROM tokens GROUP BY v HAVING count(*) BETWEEN 2 AND 100)) SELECT DISTINCT x.id AS a, y.id AS b, 'FAMILY_TOKEN' AS blocks FROM kept x JOIN kept y USING (v) WHERE x.id < y.id"""),
    "token_sort_similarity": _SIM_SQL,
    "attribute_agreement": sql(f"{_FEATURE_SQL} SELECT source, candidate, agreement, n FROM labelled"),
    "pair_scores": sql(f"{_FEATURE_SQL} SELECT source, candidate, raw_sim AS description_sim, penalty, score, confidence FROM labelled"),
    "pair_scores_blended": sql(f"""{_FEATURE_SQL}, blended AS (SELECT *, round(CASE WHEN (source + candidate) % 3 > 0 THEN 0.35::DOUBLE * ((source * 3 + candidate) % 100 / 100) + 0.65::DOUBLE * raw_sim ELSE raw_sim END, 4) AS described, CASE WHEN hard THEN 0.65 WHEN (source + candidate) % 5 = 0 THEN 0.15 ELSE 0.0 END::DOUBLE AS less FROM features),
      sums AS (SELECT *, CASE WHEN key_exact AND NOT hard THEN 0.25 ELSE 0.0 END::DOUBLE + 0.2::DOUBLE * ((source + candidate) % 100 / 100) + 0.25::DOUBLE * described + 0.3::DOUBLE * agreement * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0, n / 4)) AS base FROM blended),
      ends AS (SELECT *, CASE WHEN hard THEN least(0.25, greatest(0.05, round(base - less + 1e-9, 4))) ELSE round(1e-9 + least(CASE WHEN raw_same THEN 1.0 WHEN raw_sim < 0.50 THEN 0.45 WHEN raw_sim < 0.70 THEN 0.68 WHEN raw_sim < 0.85 THEN 0.82 ELSE 0.94 END::DOUBLE, greatest(0.0, base - less)), 4) END AS score FROM sums)
      SELECT source, candidate, described AS description_sim, less AS penalty, score, CASE WHEN hard THEN 'LOW' WHEN score >= 0.80 AND key_exact THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ends"""),
    "candidates_topk": sql(f"""{_FEATURE_SQL} SELECT source, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, crossed DESC, key_exact DESC, candidate) AS rank FROM
      (SELECT source, candidate, score, crossed, key_exact FROM labelled UNION ALL SELECT candidate, source, score, crossed, key_exact FROM labelled)) WHERE rank <= 3"""),
    "cross_match_category": sql(f"""{_FEATURE_SQL} SELECT CASE WHEN label = 'LOW' THEN 'DIFFERENT' ELSE 'POTENTIALLY_SAME' END AS category, label, 'PENDING_REVIEW' AS status, count(*) AS n FROM
      (SELECT CASE WHEN hard OR score < 0.55 THEN 'LOW' WHEN score >= 0.75 AND key_exact THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM labelled WHERE crossed) GROUP BY ALL"""),
    "embedding_cosine_topk": _COS,
    "tfidf_weights": sql(r""", grams AS (SELECT material_id, unnest([split_part(description, ' ', 1), split_part(description, ' ', 2), description]) AS term FROM materials), counts AS (SELECT material_id, term, count(*) AS tf FROM grams GROUP BY ALL),
      vocabulary AS (SELECT term, sum(tf) AS n, count(*) AS df FROM counts GROUP BY term ORDER BY n DESC, term LIMIT 384), weights AS (SELECT material_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM materials)) / (1 + df)) + 1) AS v FROM counts JOIN vocabulary USING (term))
      SELECT material_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY material_id)), 6) AS weight FROM weights"""),
    "components": sql(_EDGES_SQL + " SELECT min(material_id) AS component, count(*) AS members, max(material_id) AS largest FROM materials GROUP BY noun, grade, size HAVING count(*) > 1"),
    "common_codes": sql("SELECT *, 'CMN-' || left(regexp_replace(upper(family), '[^A-Z]', '', 'g'), 6) || '-' || upper(left(sha256(family || '|' || noun), 6)) || '-001' AS code FROM (SELECT family, noun, count(*) AS members FROM materials GROUP BY ALL)"),
    "crosswalk": sql(_ACCEPTED_SQL + """ SELECT enterprise, material_code, record, pair_id, CASE WHEN pair_id IS NULL THEN 'MAPPED_STANDALONE' ELSE 'MAPPED_VERIFIED' END AS status,
      CASE WHEN pair_id IS NULL THEN 'STANDALONE' ELSE 'DIRECT_ACCEPTED' END AS method, CASE WHEN pair_id IS NULL THEN 'STANDALONE_IDENTITY' ELSE 'VERIFIED_CROSS_ENTERPRISE' END AS basis, CAST(1 AS DOUBLE) AS confidence
      FROM (SELECT enterprise, material_code, common_code || '|' || grade AS record FROM materials JOIN enterprises ON owner_id = enterprise_id) LEFT JOIN accepted USING (record)"""),
    "consolidate_attributes": sql(""", v AS (SELECT grade, list_sort(list(DISTINCT CASE WHEN size % 2 = 0 THEN noun ELSE description END)) AS v FROM materials GROUP BY grade), l AS (SELECT *, list_sort(list_transform(v, lambda x: (length(x), x)))[-1][2] AS longest FROM v)
      SELECT grade, CASE WHEN len(list_filter(v, lambda x: NOT contains(longest, x))) = 0 THEN longest ELSE 'UNRESOLVED_CONFLICT: ' || array_to_string(v, ' / ') END AS value, len(list_filter(v, lambda x: NOT contains(longest, x))) > 0 AS conflict FROM l"""),
    "mapping_propagation": sql(_MAPPED_SQL + " SELECT record, count(*) AS n, round(sum(on_hand), 2) AS on_hand FROM inventory LEFT JOIN mapped ON material = material_id GROUP BY record"),
    "ingest_dedup_descriptions": "SELECT min(doc_id) AS doc_id FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY text",
    "upload_duplicate_check": "SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "derived_inventory": f"WITH {_FACTS_SQL} SELECT *, greatest(0.0, round(on_hand - reserved, 1)) AS available FROM (SELECT *, round(on_hand * 0.08, 1) AS reserved FROM (SELECT code, coalesce(given, round(CAST(consumption AS DOUBLE) * CASE status WHEN 'Active' THEN 0.12 WHEN 'Obsolete' THEN 0.40 ELSE 0.25 END, 1)) AS on_hand FROM facts))",
    "derived_demand": f"WITH {_FACTS_SQL} SELECT code, required, round(required * 115 / 100, 1) AS forecast, '2026-Q1' AS period FROM (SELECT code, coalesce(given, round(CAST(consumption AS DOUBLE) * CASE status WHEN 'Active' THEN 0.25 WHEN 'Obsolete' THEN 0.0 ELSE 0.10 END, 1)) AS required FROM facts)",
    "append_versions": sql("SELECT event_id, match_id, row_number() OVER (PARTITION BY match_id ORDER BY ts, event_id) AS version FROM reviews"),
    "evidence_hash": sql("""SELECT material_id, sha256('{"family":"' || family || '","grade":"' || grade || '","noun":"' || noun || '"}') AS hash FROM materials"""),
    "unique_enterprise_codes": "SELECT s_suppkey, code || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS unique_code FROM (SELECT s_suppkey, 'E' || s_nationkey AS code, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)",
}
