"""Rules against values worked out by hand."""

import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orevein.functions import canonical, ids, similarity, text
from orevein.operators import extraction, grouping, matching, review
from orevein.sources import catalogs


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("rule", "value", "expected"),
    [
        (text.strip, " \t a b \n", "a b"),
        (text.collapse, "a \t\n b", "a b"),
        (text.unicode, "10 × 20 – 5° café µ", "10 x 20 - 5 deg café u"),
        (text.punctuation, "2 IN. x 3 mm. MAIN.", "2 IN x 3 mm MAIN."),
        (text.expand, "SS valve CLASS brg", "stainless steel valve CLASS bearing"),
        (text.uom, " pcs", "NOS"),
        (text.uom, "box", "BOX"),
        (text.key_token, " gate valve/2-in (x)", "GATE_VALVE_2_IN_X"),
        (lambda c: canonical.standard(c)["value"], "api-600; ASTM  A105;API600;", "API 600; API-600; ASTM A105"),
        (lambda c: canonical.size(c)["value"], "2 inch", "2 IN"),
        (lambda c: canonical.size(c)["rule"], "1-1/2 in", "SIZE_FORMAT_MIXED_INCH"),
        (lambda c: canonical.size(c)["value"], "dn 50", "DN 50"),
        (lambda c: canonical.size(c)["value"], "m16", "M16"),
        (lambda c: canonical.size(c)["value"], "odd", "ODD"),
    ],
)
def test_text_rules(spark, rule, value, expected):
    assert one(spark, rule, value) == expected


def test_normalised_keeps_a_trail_and_nulls(spark):
    rows = spark.createDataFrame([(1, " BRG  2 IN. "), (2, None), (3, "  ")], "id long, d string")
    out = {r.id: (r.normalized, r.rules) for r in text.normalised(rows, "d").collect()}
    assert out[1] == ("bearing 2 in", ["TRIM_WHITESPACE", "COLLAPSE_WHITESPACE", "SAFE_PUNCTUATION", "LOWERCASE_TEXT", "ABBREVIATION_EXPANSION"])
    assert out[2] == out[3] == (None, [])


def test_lcs_by_bits_equals_rows(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 5, 30, 61, 62, 63, 90]))) for _ in range(60)]
    rows = spark.createDataFrame([(texts[k], rng.choice(texts)) for k in range(60)], "a string, b string")

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for r in rows.select("a", "b", similarity.lcs(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == table(r.a, r.b)


@pytest.mark.parametrize(
    ("a", "b", "expected", "reason"),
    [
        ({"family": "VALVE"}, {"family": "pump"}, "HARD", "Material family mismatch: 'VALVE' vs 'pump'"),
        ({"text": "bolt SS304"}, {"text": "bolt SS316"}, "HARD", "Incompatible fastener grade: SS304 vs SS316"),
        ({"text": "bolt SS304"}, {"text": "bolt SS 304L"}, "NO", "No engineering"),
        ({"text": "flange class 150"}, {"text": "flange CLASS 300"}, "HARD", "Incompatible pressure rating: CLASS 150 vs CLASS 300"),
        ({"text": "flange 150#"}, {"text": "flange PN 150"}, "NO", "No engineering"),
        ({"text": "valve WCB"}, {"text": "valve CF8M"}, "HARD", "Incompatible casting metallurgy: WCB vs CF8M"),
        ({"text": "valve CF8"}, {"text": "valve CF8M"}, "HARD", "Incompatible casting metallurgy: CF8 vs CF8M"),
        ({"text": "ball bearing 6205"}, {"text": "check nut"}, "NO", "No engineering"),
        ({"text": "wire aluminum"}, {"text": "wire aluminium"}, "NO", "No engineering"),
        ({"text": "wire aluminum"}, {"text": "wire copper"}, "HARD", "Incompatible conductor metallurgy: ALUMINUM vs COPPER"),
        ({"text": "seal viton"}, {"text": "seal nbr"}, "HARD", "Incompatible sealing elastomer: VITON vs NBR"),
        ({"text": "cable 3 c 25 sqmm"}, {"text": "cable 4C 25 SQ.MM"}, "HARD", "Incompatible cable core count: 3C vs 4C".replace("3C vs 4C", "3 vs 4")),
        ({"size": "M16"}, {"size": "M16X75"}, "SOFT", "Fastener length/specification variance: 'M16' vs 'M16X75'"),
        ({"size": "M16"}, {"size": "M20"}, "HARD", "Incompatible metric bolt diameter: 'M16' vs 'M20'"),
        ({"size": "4-WIRE"}, {"size": "500 MM"}, "SOFT", "Sensor wiring specification vs dimension: '4-WIRE' vs '500 MM'"),
        ({"size": "2 IN"}, {"size": "50 MM"}, "HARD", "Incompatible engineering size: '2 IN' vs '50 MM'"),
        ({"length": "1 M"}, {"length": "2 M"}, "SOFT", "Length dimension variance: '1 M' vs '2 M'"),
        ({"subtype": "spiral wound"}, {"subtype": "flat"}, "SOFT", "Construction subtype variance: 'spiral wound' vs 'flat'"),
        ({"grade": "A105"}, {"grade": "ASTM A105"}, "REPR", "Standard/grade prefix representation difference: 'A105' vs 'ASTM A105'"),
        ({"conflicts": "A105"}, {}, "REPR", "Phase 3 preserved grade representation conflict: ASTM A105 vs A105"),
        ({}, {"conflicts": "A105"}, "NO", "No engineering"),
        ({"standard": "API 600"}, {"standard": "API 608"}, "HARD", "Standard incompatibility (gate vs ball valve): 'API 600' vs 'API 608'"),
        ({"family": "nan", "type": "X"}, {"family": "pump", "type": "x"}, "NO", "No engineering"),
    ],
)
def test_conflicts(spark, a, b, expected, reason):
    fields = "text family type subtype grade material size length diameter pressure standard conflicts".split()
    schema = ", ".join(f"{s}_{f} string" for s in "ab" for f in fields)
    rows = spark.createDataFrame([tuple([a.get(f) for f in fields] + [b.get(f) for f in fields])], schema)
    rows = rows.withColumn("a_marks", matching.text_marks(F.col("a_text"))).withColumn("b_marks", matching.text_marks(F.col("b_text")))
    said = rows.select(matching.conflict("a_", "b_").alias("c")).first().c
    assert said["class"].startswith(expected) and said["reasons"][0].startswith(reason)


@pytest.mark.parametrize(("a", "b", "expected"), [("BALL GATE VALVE", "BALL VALVE", 0.8), ("a b", "b a", 1.0), ("", "", 1.0), ("", "x", 0.0), ("abc", "xyz", 0.0)])
def test_token_sort(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.token_sort(F.col("a"), F.col("b")).alias("y")).first()
    assert row.y == pytest.approx(expected)


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(similarity.cosine(F.col("a"), F.col("b")).alias("c"), similarity.cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert row.c == pytest.approx(0.5**0.5) and row.z == 0.0


@pytest.mark.parametrize("name", ["", "LEGACY_MAP:A:B:C", "é" * 40])
def test_uuid5(spark, name):
    assert one(spark, ids.uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def record(**values):
    return Row(**{c: values.get(c) for c in extraction.RECORD})


SCHEMA = ", ".join(f"{c} string" for c in extraction.RECORD)


@pytest.mark.parametrize(
    ("values", "standardized", "key", "conflicts"),
    [
        (dict(category="Valves", type="Gate Valve", description="GATE VALVE 2 IN API 600 ASTM A216 WCB FLANGED", specification="API 600", grade="ASTM A216 WCB", size="2 IN", coating="NIL", unit="NOS"), "VALVE | GATE VALVE | ASTM A216 WCB | 2 IN | API 600 | NIL | FLANGED", "VALVE|GATE_VALVE|ASTM_A216_WCB|2_IN|API_600|NIL|FLANGED", "size: '2 IN' vs '2 in'; material_grade: 'ASTM A216 WCB' vs 'WCB'"),
        (dict(category="Valves", type="Ball Valve", description="STAINLESS STEEL BALL VALVE 1 IN SS316 THREADED", specification="API 608", grade="SS316", size="1 IN", coating="NIL", unit="NOS"), "VALVE | BALL VALVE | STAINLESS STEEL | SS 316 | 1 IN | API 608 | NIL | THREADED", "VALVE|BALL_VALVE|STAINLESS_STEEL|SS_316|1_IN|API_608|NIL|THREADED", "size: '1 IN' vs '1 in'; material_grade: 'SS316' vs 'SS 316'"),
    ],
)
def test_extraction_and_standard_form(spark, values, standardized, key, conflicts):
    row = extraction.standardised(extraction.extracted(spark.createDataFrame([record(**values)], SCHEMA))).first()
    assert (row.standardized, row.canonical_key, row.conflicts) == (standardized, key, conflicts)


def test_flange_overrides_and_hose_length(spark):
    rows = [record(category="Pipes & Fittings", description="WELD NECK FLANGE 4 IN CLASS 300 A105"), record(category="Hoses", description="HYDRAULIC HOSE 1/2 IN 1000 MM"), record(description="ELBOW 90 DEGREE 2 IN"), record()]
    out = [r.attributes for r in extraction.extracted(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert (out[0]["material_family"], out[0]["material_type"], out[0]["pressure_class"], out[0]["connection_type"]) == ("flange", "weld neck flange", "300", "weld neck")
    assert (out[1]["size"], out[1]["length"]) == ("1/2 in", "1000 mm")
    assert out[2]["rating"] == "90°" and out[3] == {}


def pair(**values):
    base = dict(key_exact=False, embedding=0.9, standard_sim=0.9, raw_sim=0.9, agreement=0.9, n=7, raw_same=False, upstream=False, cross=True)
    return base | {"class": "NO_CONFLICT"} | values


def test_scores(spark):
    rows = [pair(), pair(key_exact=True), pair(**{"class": "HARD_INCOMPATIBLE"}), pair(raw_sim=0.45), pair(**{"class": "SOFT_ENGINEERING_DIFFERENCE"})]
    out = matching.score(spark.createDataFrame([Row(**r) for r in rows])).collect()
    assert [r.score for r in out] == pytest.approx([0.675, 0.925, 0.05, 0.45, 0.525], abs=1e-4)
    assert [r.confidence for r in out] == ["MEDIUM", "HIGH", "LOW", "LOW", "LOW"]


@pytest.mark.parametrize(("embedding", "sim", "agreement", "hard", "expected"), [(0.9169, 0.9194, 0.8571, False, 0.6182), (0.9484, 0.9385, 0.9481, True, 0.1628), (0.699, 0.6027, 0.5384, True, 0.0)])
def test_configured_scores(spark, embedding, sim, agreement, hard, expected):
    row = pair(embedding=embedding, standard_sim=sim, raw_sim=sim, agreement=agreement, raw_same=True, **{"class": "HARD_INCOMPATIBLE" if hard else "NO_CONFLICT"})
    assert matching.score(spark.createDataFrame([Row(**row)]), matching.CONFIGURED).first().score == pytest.approx(expected, abs=2e-4)


def test_validation_and_refinement(spark):
    rows = [
        pair(score=0.6182, upstream=True, a_size="2 IN", b_size="2 IN", a_grade="X", b_grade="X", a_family="V", b_family="V", cross=False),
        pair(score=0.9, a_size="2 IN", b_size="3 IN", a_grade="X", b_grade="X", a_family="V", b_family="V"),
        pair(score=0.9, a_size="M16", b_size="M16X75", a_grade="A105", b_grade="ASTM A105", a_family="V", b_family="V"),
        pair(score=0.9, a_size="1", b_size="1", a_grade="316", b_grade="SS 316", a_family="V", b_family="V"),
        pair(score=0.9, a_size="1", b_size=None, a_grade=None, b_grade="x", a_family="V", b_family="N/A"),
        pair(score=0.9, a_size="1", b_size="1", a_grade="y", b_grade="Y", a_family="V", b_family="V"),
    ]
    schema = "key_exact boolean, embedding double, standard_sim double, raw_sim double, agreement double, n long, raw_same boolean, upstream boolean, cross boolean, class string, score double, a_size string, b_size string, a_grade string, b_grade string, a_family string, b_family string"
    names = [f.split()[0] for f in schema.split(", ")]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    out = matching.refined(matching.validated(frame, ["size", "grade", "family"])).collect()
    assert [r.validation for r in out] == ["REVIEW_REQUIRED", "ENGINEERING_INCOMPATIBLE", "REVIEW_REQUIRED", "PROBABLE_COMPATIBLE", "INSUFFICIENT_EVIDENCE", "VALIDATED_COMPATIBLE"]
    assert out[0].reasons == ["CORE_ATTR_MATCH", "UPSTREAM_CONFLICT_PRESERVED"] and out[1].reasons == ["SIZE_MISMATCH"]
    assert [r.refined for r in out] == pytest.approx([0.4682, 0.39, 0.75, 0.9, 0.49, 0.9], abs=1e-4)
    assert [r.priority for r in out] == ["MEDIUM", "LOW", "CRITICAL", "HIGH", "LOW", "HIGH"]


def test_large_blocks_make_no_pairs(spark):
    rows = spark.createDataFrame([(k, "big") for k in range(6)] + [(10, "two"), (11, "TWO"), (12, None), (13, "nan")], "id long, v string")
    got = {(r.a, r.b) for r in matching.blocked_pairs(rows, "id", {"X": F.col("v")}, most=5).collect()}
    assert got == {(10, 11)}


def test_components_and_cliques(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0 - k / 100) for k in range(1, 40)] + [(100, 101, 0.9), (101, 102, 0.8)], "a long, b long, score double")
    parts = {r.node: r.component for r in grouping.components(edges).collect()}
    assert {parts[k] for k in range(1, 41)} == {1} and {parts[k] for k in (100, 101, 102)} == {100}
    barred = spark.createDataFrame([(100, 102)], "a long, b long")
    split = {r.node: r.clique for r in grouping.cliques(edges.where("a >= 100"), barred).collect()}
    assert split == {100: 100, 101: 100, 102: 102}


def test_decisions(spark):
    matches = spark.createDataFrame([(k, "ALREADY_MAPPED" if k == 6 else "PENDING_REVIEW") for k in range(1, 8)], "match_id long, status string")
    log = [
        (1, 1, "A", "ACCEPT"), (1, 2, "B", "ACCEPT"), (2, 1, "A", "ACCEPT"), (2, 2, "A", "ACCEPT"), (3, 1, "A", "ACCEPT"), (3, 2, "B", "REJECT"),
        (4, 1, "A", "REJECT"), (5, 1, "A", "OVERRIDE"), (5, 2, "A", "REJECT"), (6, 1, "A", "ACCEPT"),
    ]
    rows = spark.createDataFrame([(m, i, f"2024-01-01 00:00:0{i}", e, v) for m, i, e, v in log], "match_id long, decision_id long, at string, enterprise string, verdict string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = {r.match_id: (r.status, r.errors) for r in review.decided(matches, rows).collect()}
    assert out == {1: ("ACCEPTED", 0), 2: ("GATE_1_APPROVED", 1), 3: ("DIFFERENT", 0), 4: ("REJECTED", 0), 5: ("ACCEPTED", 1), 6: ("ACCEPTED", 0), 7: ("PENDING_REVIEW", 0)}


def test_consolidation(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x long"), (2, "x"), (2, "y"), (3, None), (4, "z")], "g long, v string")
    out = {r.g: (r.value, r.conflict) for r in grouping.consolidated(rows, "g", "v").collect()}
    assert out[1] == ("x long", False) and out[2] == ("UNRESOLVED_CONFLICT: x / y", True) and out[3] == (None, False) and out[4] == ("z", False)


def test_catalog_files(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",".join(catalogs.COLUMNS) + "\n" + "E1,M-1,gate valve" + "," * 15 + "\nE1,M-1,ball valve" + "," * 15 + "\n", encoding="utf-8")
    rows = catalogs.read_catalog(spark, str(path))
    assert rows.columns == catalogs.COLUMNS and catalogs.missing(rows) == ([], [])
    assert catalogs.problems(rows) == ["duplicate code M-1 of E1"]
    assert catalogs.problems(rows.drop("Unit")) == ["missing columns: Unit"]
    assert catalogs.mapped_columns(rows) == {"material_code": "Material_Code", "description": "Material_Description", "uom": "Unit"}
    hashed = catalogs.fingerprints(spark, str(path)).first().sha256
    assert catalogs.unchanged(spark, str(path), {hashed}) and not catalogs.unchanged(spark, str(path), {"x"})
    latin = tmp_path / "l.csv"
    latin.write_bytes("Enterprise\nÄ\n".encode("latin-1"))
    assert catalogs.read_catalog(spark, str(latin)).first().Enterprise == "Ä"
    assert catalogs.next_upload(["UPLOAD-20260101-001", "UPLOAD-20260101-007"], "20260101") == "UPLOAD-20260101-008"


def test_recovered_columns(spark):
    rows = spark.createDataFrame([("a", "X", None), ("b", "Bolt", None)], "code string, description string, unit string")
    source = spark.createDataFrame([("a", "q", "NOS", 1), ("a", "q", "SET", 2), ("z", "bolt", "MTR", 3)], "code string, description string, unit string, position long")
    assert {r.code: r.unit for r in catalogs.recovered(rows, source, ["unit"]).collect()} == {"a": "SET", "b": "MTR"}


def test_streams_equal_batches(spark, tmp_path):
    from orevein.streaming import daily

    rows = spark.range(2000).selectExpr("id as match_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id / 20 as int)) as ts", "if(id % 3 = 0, 'a', 'b') as action")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = daily.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = {(str(r.day), r.action): r.n for r in spark.table("days").collect()}
    batch = {(str(r.day), r.action): r.n for r in rows.groupBy(F.to_date("ts").alias("day"), "action").count().withColumnRenamed("count", "n").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_no_prices_in_facts_and_no_sums_across_units(spark):
    from orevein.plans import queries

    sf = "/root/testdata/sf0.001"
    facts = queries.QUERIES["procurement_facts"](spark, sf)
    assert not any(w in c for c in facts.columns for w in ("price", "spend", "cost"))
    for name in ("inventory_by_code", "demand_by_code"):
        rows = queries.QUERIES[name](spark, sf)
        assert "uom" in rows.columns and rows.count() == rows.select("common_code", "uom").distinct().count()


def test_cliques_against_brute_force(spark):
    """Edges in order of score, then ends; one merges two groups unless a barred pair would meet."""
    import random

    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    scored = [(a, b, rng.choice([0.5, 0.7, 0.9])) for a, b in edges]
    barred = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(40)})
    group = {n: {n} for e in edges for n in e}
    for a, b, _ in sorted(scored, key=lambda e: (-e[2], e[0], e[1])):
        x, y = group[a], group[b]
        if x is not y and not any((min(p, q), max(p, q)) in barred for p in x for q in y):
            x |= y
            for n in y:
                group[n] = x
    got = {r.node: r.clique for r in grouping.cliques(spark.createDataFrame(scored, "a long, b long, score double"), spark.createDataFrame(barred, "a long, b long")).collect()}
    assert got == {n: min(g) for n, g in group.items()}


def test_first_decisions_of_a_stream(spark, tmp_path):
    """Each match and action once, whatever the batch that its copies come in, and none missing."""
    from orevein.streaming import daily

    rows = [(k % 7, "ACCEPT" if k % 2 else "REJECT", f"2024-01-01 00:{k:02d}:00") for k in range(40)]
    for part in range(4):
        batch = spark.createDataFrame(rows[part::4], "match_id long, action string, t string").selectExpr("match_id", "action", "cast(t as timestamp) as ts")
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("match_id long, action string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = daily.first_decisions(stream).writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    got = [(r.match_id, r.action) for r in spark.table("decided").collect()]
    assert len(got) == len(set(got)) and set(got) == {(m, a) for m, a, _ in rows}
