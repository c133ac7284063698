"""Exact quantiles, versions of tables, the stream of decisions and workbooks against plain versions."""

import io
import random
import threading
import zipfile

import numpy as np
import pytest
from orevein.operators import profile, review
from orevein.operators.quantiles import quantiles
from orevein.sources import versioned, workbooks
from orevein.streaming import decisions as D
from pyspark.sql import functions as F


def test_quantiles_equal_numpy(spark):
    """A key with nine tenths of the rows, one with ties alone, one with a single value, a null key, one of nulls alone."""
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 100)) for _ in range(5000)] + [("ties", 2.5)] * 300 + [("one", -1.0), ("none", None)] + [(None, float(rng.randrange(9))) for _ in range(200)]
    rng.shuffle(rows)
    wanted = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.key: r for r in quantiles(spark.createDataFrame(rows, "key string, x double"), "x", ["key"], wanted, parts=16).collect()}
    assert set(got) == {"hot", "ties", "one", None}
    for key, r in got.items():
        x = np.array([v for k, v in rows if k == key and v is not None])
        assert r.n == len(x)
        for name, q in wanted.items():
            want = np.quantile(x, q)
            assert r[name] == pytest.approx(want, abs=1e-9)
            assert r[f"above_{name}"] == (x > r[name]).sum()


def test_quantiles_hold_no_hot_key_in_one_task(spark):
    """All rows of one key and all different: they lie in many ranges, and the few with the rank are sorted."""
    rows = spark.range(40_000).select(F.lit("all").alias("key"), ((F.col("id") * 7919) % 40_009).cast("double").alias("x"))
    ranges = rows.groupBy("key", "x").count().repartitionByRange(32, "key", "x").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranges < 40_000 / 8
    x = np.array([(k * 7919) % 40_009 for k in range(40_000)], float)
    got = quantiles(rows, "x", ["key"], {"p": 0.95}, parts=32).first()
    assert got.p == pytest.approx(np.quantile(x, 0.95)) and got.above_p == (x > got.p).sum()


def test_quantiles_of_nothing_and_without_keys(spark):
    empty = spark.createDataFrame([], "key string, x double")
    assert quantiles(empty, "x", ["key"], {"p": 0.5}).count() == 0
    few = spark.createDataFrame([(3,), (1,), (None,), (10,)], "x int")
    assert [tuple(r) for r in quantiles(few, "x", [], {"p": 0.5}).collect()] == [(3, 3.0, 1)]
    row = profile.numbers(few, "x").first()
    assert (row.valid, row.missing, row.median) == (3, 1, 3.0)
    assert profile.numbers(few.where("x > 99"), "x").first().median is None


def test_versions_of_tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    numbers = lambda *x: spark.createDataFrame([(v,) for v in x], "match_id int")
    with pytest.raises(KeyError):
        versioned.as_of(spark, root, "matches").count()
    assert versioned.latest(spark, root) == 0
    assert versioned.commit(spark, root, 0, matches=numbers(1, 2, 3), decisions=numbers(1)) == 1
    before = versioned.as_of(spark, root, "matches", 1)
    assert review.replaced_by_run(spark, root, 1, numbers(2, 9)) == 2
    with pytest.raises(versioned.StaleVersion):
        versioned.commit(spark, root, 1, matches=numbers(7))
    held = lambda name, v=None: sorted(r.match_id for r in versioned.as_of(spark, root, name, v).collect())
    assert held("matches") == [2, 9] and held("decisions") == [] and sorted(r.match_id for r in before.collect()) == [1, 2, 3] and held("decisions", 1) == [1]
    assert versioned.commit(spark, root, 2, decisions=numbers(9)) == 3
    assert held("matches") == [2, 9] and held("decisions") == [9]  # what a commit doesn't name stays
    assert versioned.commit(spark, root, 3, decisions=numbers()) == 4
    assert len(versioned.expired(spark, root, keep=2)) == 1  # of version 1 alone: 2's matches are still 4's
    assert held("matches") == [2, 9] and held("decisions", 3) == [9]
    with pytest.raises(KeyError):
        versioned.as_of(spark, root, "matches", 1)


def test_of_writers_at_once_one_wins(spark, tmp_path, monkeypatch):
    """Both have seen version 1 as the last when they write: one rename succeeds, the other writer's data is gone."""
    root, out, both = str(tmp_path / "tables"), [], threading.Barrier(2)
    versioned.commit(spark, root, 0, t=spark.range(1))
    seen = versioned.latest

    def waiting(*args):
        found = seen(*args)
        both.wait(60)
        return found

    monkeypatch.setattr(versioned, "latest", waiting)

    def write(n):
        try:
            out.append((n, versioned.commit(spark, root, 1, t=spark.range(n))))
        except versioned.StaleVersion:
            out.append((n, None))

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 8)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    monkeypatch.setattr(versioned, "latest", seen)
    won = [n for n, v in out if v == 2]
    assert len(out) == 2 and len(won) == 1
    assert versioned.latest(spark, root) == 2 and versioned.as_of(spark, root, "t").count() == won[0]
    assert versioned.expired(spark, root, keep=5) == []


def _events(spark, n=400, matches=23, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(matches), k, 60 * rng.randrange(n), rng.choice(["A", "B", None]), rng.choice(["ACCEPT", "ACCEPT", "REJECT", "DEFER", "DIFFERENT", "OVERRIDE", "OTHER"])) for k in range(n)]
    rows += [(None, n, 0, "A", "ACCEPT"), (1, n + 1, None, "A", "ACCEPT"), (1, n + 2, 0, "A", None)]
    made = spark.createDataFrame(rows, "match_id long, decision_id long, s long, enterprise string, verdict string")
    return made.selectExpr("match_id", "decision_id", "cast(timestamp_seconds(1700000000 + s) as timestamp_ntz) as at", "enterprise", "verdict", "case when match_id % 3 = 0 then 'ALREADY_MAPPED' else 'PENDING_REVIEW' end as status")


def test_stream_of_decisions_equals_the_table(spark, tmp_path):
    """Stopped halfway and started again, in several batches out of order."""
    events = _events(spark).repartition(8).cache()
    whole = events.where("match_id is not null and at is not null and verdict is not null")
    want = sorted(map(tuple, review.decided(whole.select("match_id", "status").distinct(), whole.drop("status")).select("match_id", "status", "endorser", "decisions", "errors").collect()))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2)
    run = lambda: D.run_to_end(D.decided_stream(source.parquet(f"{tmp_path}/in"), late="1 day"), f"{tmp_path}/out")
    events.where("decision_id % 2 = 0").write.parquet(f"{tmp_path}/in")
    half = run().agg(F.sum("decisions")).first()[0]
    assert 0 < half < whole.count()
    events.where("decision_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, run().collect())) == want


def test_late_decisions_and_idle_matches(spark, tmp_path):
    """A decision behind the watermark changes nothing; a match that gives its state up starts anew."""
    rows = [[(1, 1, "2024-01-01 00:00:00", "A", "ACCEPT"), (2, 2, "2024-01-01 00:00:00", "A", "REJECT")], [(2, 3, "2024-01-20 00:00:00", "B", "ACCEPT")], [(1, 4, "2024-01-02 00:00:00", "B", "ACCEPT")], [(2, 5, "2024-08-01 00:00:00", "B", "DEFER")], [(1, 6, "2024-08-02 00:00:00", "B", "ACCEPT")]]
    for batch in rows:
        made = spark.createDataFrame(batch, "match_id long, decision_id long, t string, enterprise string, verdict string").selectExpr("match_id", "decision_id", "cast(t as timestamp) as at", "enterprise", "verdict", "'PENDING_REVIEW' as status")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = D.decided_stream(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in"), late="1 day", idle_days=30)
        last = {r.match_id: (r.status, r.endorser, r.decisions, r.errors) for r in D.run_to_end(changes, f"{tmp_path}/out").collect()}
        if len(batch) == 1 and batch[0][1] == 4:
            assert last == {1: ("GATE_1_APPROVED", "A", 1, 0), 2: ("REJECTED", None, 2, 1)}
    every = spark.read.parquet(f"{tmp_path}/out/changes").where("match_id = 1").collect()
    assert [(r.status, r.endorser, r.decisions) for r in every if r.endorser == "B"] == [("GATE_1_APPROVED", "B", 1)]


def _workbook(sheets, shared=()):
    """A workbook of raw sheet XML by name."""
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_cells_of_every_kind(spark, tmp_path):
    row = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#N/A</v></c><c r="F1"><v>12</v></c><c r="G1"><v>1.50</v></c><c r="H1" s="1"><v>45292</v></c><c r="I1" s="2"><v>45292.5</v></c><c r="J1" s="3"><v>2</v></c><c r="AA1" t="str"><f>A1</f><v>f</v></c></row>'
    (tmp_path / "a.xlsx").write_bytes(_workbook({"First": row, "Empty": "", "Third": '<row r="5"><c r="B5"><v>7</v></c></row><row r="6"><c r="A6"/></row>'}, ["<r><t>two </t></r><r><t>parts</t></r><rPh><t>hint</t></rPh>"]))
    got = {(r.sheet, r.place, r.row): r["cells"] for r in workbooks.cells(spark, str(tmp_path)).collect()}
    assert set(got) == {("First", 0, 1), ("Third", 2, 5)}
    assert got["First", 0, 1] == ["two parts", None, "in", "True", None, "12", "1.50", "2024-01-01", "2024-01-01 12:00:00", "2", *[None] * 16, "f"]
    assert got["Third", 2, 5] == [None, "7"]


def test_workbooks_equal_their_csv(spark, tmp_path):
    """Part of a real table as two workbooks with columns in another order and one missing."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_retailprice").orderBy("p_partkey").collect()
    cell = lambda x: f"<c><v>{x}</v></c>" if not isinstance(x, str) else f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    sheet = lambda names, rows: "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *rows])
    (tmp_path / "a.xlsx").write_bytes(_workbook({"s": sheet(["p_partkey", "p_name", "p_retailprice", "p_name"], [(*r, "again") for r in part[::2]])}))
    (tmp_path / "b.xlsx").write_bytes(_workbook({"s": sheet(["p_name", "p_partkey"], [(r.p_name, r.p_partkey) for r in part[1::2]])}))
    (tmp_path / "c.xlsx").write_bytes(_workbook({"other": sheet(["p_name"], [("elsewhere",)])}))
    got = workbooks.read_sheets(spark, str(tmp_path), "s")
    assert got.columns == ["p_name", "p_partkey", "p_retailprice"]
    assert sorted((int(r.p_partkey), r.p_name, r.p_retailprice and float(r.p_retailprice)) for r in got.collect()) == [(r.p_partkey, r.p_name, None if k % 2 else r.p_retailprice) for k, r in enumerate(part)]
    assert workbooks.read_sheets(spark, str(tmp_path), "absent").columns == []


def test_agreement_of_distinct_values_equals_that_of_pairs(spark):
    """The form that compares each different pair of values once against the one that compares them pair by pair."""
    from orevein.functions import similarity as S
    from orevein.plans.path import _agreement

    rng = random.Random(5)
    values = [None, "BALL VALVE", "VALVE BALL", "GATE VALVE", "150", "M16X75", "Q"]
    rows = [(k, k + 1000, *(rng.choice(values) for _ in range(6))) for k in range(200)] + [(900, 901, *[None] * 6)]
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, a_p string, b_p string, a_q string, b_q string, a_r string, b_r string")
    want = {r.a_id: tuple(r.g) for r in pairs.select("a_id", S.agreement([(F.col(f"a_{n}"), F.col(f"b_{n}")) for n in "pqr"]).alias("g")).collect()}
    got = {r.source: (r.agreement, r.n) for r in _agreement(pairs, list("pqr")).collect()}
    assert got == want and got[900] == (0.0, 0)
