"""Pairs of records that are too many to be written down: the same rows from what hangs on a block, a form or a source, against plain versions and SQL."""

import datetime
import json
import random

import duckdb
import pytest
from orevein.functions import similarity
from orevein.operators import grouping, linkage, matching
from orevein.plans import queries
from pyspark.sql import functions as F

#: Number, name, size and price of parts: three kinds, of which the first has members of every sort.
PARTS = [(k, "steel pipe", 5, 900.0 + k % 7) for k in (1, 2, 3, 9, 10, 11, 101, 102)] + [(20, "old pump", 5, 906.3), (21, "old pump", 5, 912.0), (12, "red bolt", 5, 993.7), (13, "red bolt", 5, 1000.0), (14, "blue nut", 1, 10.0)]
EVENTS = [(n, n % 12, n % 7) for n in range(1, 26)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pairs"))
    made = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(k, f"NATION_{k}", 0) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, f"S{k}", 0, 1.0) for k in range(1, 8)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(k, name, "FLANGE" if k % 2 else "VALVE", "Brand#1", size, price) for k, name, size, price in PARTS], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"),
        "events": ([(n, datetime.datetime(2024, 1, n), actor, "click", 1.0, json.dumps({"k": k})) for n, k, actor in EVENTS], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "lineitem": ([(1, 1, 1, 1, 1.0, 1.0, 0.0, "N", datetime.date(2024, 1, 1))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate date"),
        "orders": ([(1, 1, datetime.date(2024, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate date"),
        "customer": ([(1, 0)], "c_custkey long, c_nationkey int"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
        duck.sql(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
    return at, duck


def _both(spark, tables, name):
    """Rows of a query, the same as those of its SQL twin."""
    at, duck = tables
    ours = queries.QUERIES[name](spark, at)
    columns = ", ".join(ours.columns)
    rows = sorted(map(tuple, ours.collect()), key=str)
    assert rows == sorted(duck.sql(f"select {columns} from ({queries.ORACLE_SQL[name]})").fetchall(), key=str)
    return rows


def test_best_of_blocks_equals_ranking_all_pairs(spark):
    rng = random.Random(4)
    rows = [(block, value, k, rng.randrange(3), k % 5) for block in ("X", "Y") for k in range(40) for value in [str(rng.randrange(3))]]
    known = {(a, b): (rng.choice([0.25, 0.5, 0.75]), rng.random() < 0.3) for a in range(5) for b in range(5)}
    owner = {}
    rows = [(block, value, k, owner.setdefault(k, o), f) for block, value, k, o, f in rows]
    pairs = {(x[2], y[2]): (*known[x[4], y[4]], x[3] != y[3]) for x in rows for y in rows if x[:2] == y[:2] and x[2] < y[2]}
    every = [(p, q, *v) for (a, b), v in pairs.items() for p, q in ((a, b), (b, a))]
    want = {(r.source, r.candidate, r.rank) for r in matching.ranked(spark.createDataFrame(every, "source long, candidate long, score double, key_exact boolean, cross boolean"), 5).collect()}
    members = spark.createDataFrame(rows, "block string, value string, id long, owner long, form long")
    scores = spark.createDataFrame([(a, b, *v) for (a, b), v in known.items()], "a long, b long, score double, key_exact boolean")
    met = matching.form_pairs(members)
    assert {tuple(r) for r in met.collect()} == {(x[0], x[1], x[4], y[4]) for x in rows for y in rows if x[:2] == y[:2] and x[2] < y[2]}
    best = matching.best_of_blocks(members, met.join(scores, ["a", "b"]), 5)
    assert {(r.source, r.candidate, r.rank) for r in matching.ranked(best, 5).collect()} == want and len(want) == 200


def test_ratios_a_hair_under_a_half_are_rounded_as_in_sql(spark, tables):
    rows = {r[0]: r for r in _both(spark, tables, "label_order") if r[0] in (12, 20)}
    assert rows[20][3] < rows[12][3]  # 906.3 / 912 is 0.99375, which goes up; 993.7 / 1000 is 0.9937


def test_cliques_of_a_full_component_take_no_rounds_and_equal_those_by_rounds(spark):
    edges = [(a, b, s) for a in range(14) for b in range(a) for s in ((a * b) % 4 / 4,)] + [(90, 91, None), (91, 92, 1.0)]
    frame = spark.createDataFrame(edges, "a long, b long, score double")
    bars = spark.createDataFrame([(a, b) for a, b, _ in edges if (a + b) % 3 == 0] + [(3, 90), (92, 90)], "a long, b long")
    out = {r.node: (r.component, r.clique) for r in grouping.cliques(frame, bars, most_rounds=1).collect()}
    assert out == {r.node: (r.component, r.clique) for r in grouping.cliques(frame, bars, small=0).collect()} and out[91] == (90, 90) and out[92] == (90, 92)
    mixed = {r.node: (r.component, r.clique) for r in grouping.cliques(frame, bars, small=50).collect()}
    assert mixed == out


PAIRED = ["materials_after_decisions", "run_replaced", "audit_append", "candidate_ids", "record_for_match", "record_export"]


@pytest.mark.parametrize("name", PAIRED)
def test_same_rows_as_sql(spark, tables, name):
    assert len(_both(spark, tables, name)) > 2


@pytest.fixture(scope="module")
def crowded(spark, tables, tmp_path_factory):
    """One block of 300 parts, which make 44,850 pairs, and some events for each."""
    at = str(tmp_path_factory.mktemp("crowded"))
    for name in ("region", "nation", "supplier", "lineitem", "orders", "customer"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    spark.range(1, 301).selectExpr("id as p_partkey", "'old pipe' as p_name", "'VALVE' as p_type", "'Brand#1' as p_brand", "5 as p_size", "900.0D + id as p_retailprice").write.parquet(f"{at}/part.parquet")
    spark.range(900).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "id % 7 as user_id", "'click' as event_type", "1.0D as value", "concat('{\"k\": ', id % 100, '}') as props").write.parquet(f"{at}/events.parquet")
    return at


def _shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("name", ["materials_after_decisions", "run_replaced", "audit_append", "candidate_ids", "record_for_match"])
def test_pairs_are_not_dealt_out_anew(spark, crowded, name):
    before = _shuffled(spark)
    queries.QUERIES[name](spark, crowded).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < 20_000


def test_cosine_join_moves_no_candidates_about(spark, monkeypatch):
    monkeypatch.setattr(linkage, "ENTRIES", 500)
    rng = random.Random(6)
    alone = [k % 2 == 0 and k >= 200 for k in range(400)]
    rows = [(k, t, w) for k in range(400) for t, w in (("common", 0.85), (f"a{k // 2}", 0.42 if alone[k] else 0.52678), (f"b{k}", 0.318 * alone[k])) if w]
    rng.shuffle(rows)
    before = _shuffled(spark)
    got = {(r.a, r.b): round(r.cosine, 6) for r in linkage.cosine_join(spark.createDataFrame(rows, "id long, term string, w double"), 0.8).collect()}
    assert got == {(k, k + 1): 1.0 if k < 200 else 0.943748 for k in range(0, 400, 2)}
    assert _shuffled(spark) - before < 20_000


def test_nearest_in_blocks_equals_ranking_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linkage, "WIDE", 20)
    rng = random.Random(2)
    made = [[rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(4)] for _ in range(60)]
    rows = [(k, k % 3, rng.choice(made)) for k in range(300)] + [(300, 0, None), (301, 0, [0.0] * 4), (302, 7, [1.0] * 4), (303, 7, None), (304, 7, [1.0, None, 0.0, 0.0]), (305, None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    asked = v.where("vec_id % 20 = 0 or vec_id >= 300")
    flags = [F.lit(True).alias("cross"), F.lit(False).alias("key_exact")]
    a, b = asked.select("label", F.col("vec_id").alias("source"), F.col("embedding").alias("x")), v.select("label", F.col("vec_id").alias("candidate"), F.col("embedding").alias("y"))
    every = a.join(b, "label").where("source <> candidate").select("source", "candidate", F.round(similarity.cosine(F.col("x"), F.col("y")), 4).alias("score"), *flags)
    want = sorted(map(tuple, matching.ranked(every, 5).collect()))
    found = linkage.nearest(asked, v, "label", 5).select("source", "candidate", F.round("score", 4).alias("score"), *flags)
    assert sorted(map(tuple, matching.ranked(found, 5).collect())) == want and len(want) == 17 * 5 + 3 * 2
