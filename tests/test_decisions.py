"""Queries of decisions on made tables, where a review event of match_id k is a decision on every match whose source's number ends in k."""

import datetime
import json

import duckdb
import pytest

from orevein.plans import queries

PARTS = [1, 2, 3, 101]  # the first and the last two are of one kind each
EVENTS = [(7, 1, 4), (3, 1, 5), (10, 1, 2), (4, 2, 2), (5, 3, 2), (8, 3, 6), (6, 1, 4), (9, 99, 2)]  # number, match_id, actor


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("decisions"))
    kinds = {1: "pipe", 2: "pipe", 3: "pump", 101: "pipe"}
    made = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(k, f"NATION_{k}", 0) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, f"S{k}", 0, 1.0) for k in range(1, 8)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(k, f"steel {kinds[k]}", "FLANGE", "Brand#1", 5, 10.0) for k in PARTS] + [(103, "steel pump", "FLANGE", "Brand#1", 5, 10.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"),
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


def _both(spark, tables, name, *columns):
    """Rows of a query, the same as those of its SQL twin."""
    at, duck = tables
    ours = sorted(map(tuple, queries.QUERIES[name](spark, at).select(*columns).collect()))
    assert ours == sorted(duck.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall())
    return ours


def test_match_details_has_every_decision_on_a_source_of_that_ending(spark, tables):
    first = (4, "OVERRIDE;REJECT;DIFFERENT;ACCEPT", "R2", "ACCEPT")  # events 3, 6, 7, 10
    assert _both(spark, tables, "match_details", "match_id", "decisions", "history", "dispute_reviewer", "dispute_decision") == [
        ("1-101", *first), ("1-2", *first), ("2-101", 1, "DEFER", "R2", "DEFER"), ("3-103", 2, "ACCEPT;OVERRIDE", "R6", "OVERRIDE"),
    ]


def test_accepted_overlay_has_the_last_of_all_decisions(spark, tables):
    assert _both(spark, tables, "accepted_overlay", "match_id", "source_id", "verdict", "reviewer") == [("1-101", 1, "ACCEPT", "R2"), ("1-2", 1, "ACCEPT", "R2"), ("2-101", 2, "DEFER", "R2"), ("3-103", 3, "OVERRIDE", "R6")]


def test_decisions_persisted_follows_the_last_of_all_decisions(spark, tables):
    assert _both(spark, tables, "decisions_persisted", "match_id", "source_id", "candidate_id", "status", "gate1_reviewer", "gate1_enterprise") == [
        ("1-101", 1, 101, "ACCEPTED", None, None), ("1-2", 1, 2, "ACCEPTED", None, None), ("2-101", 2, 101, "DEFER", None, None), ("3-103", 3, 103, "OVERRIDDEN", None, None),
    ]


def test_roster_counts_every_event_that_is_a_decision_on_some_match(spark, tables):
    assert _both(spark, tables, "roster_by_any_key", "reviewer_id", "decisions", "last") == [("R1", 0, None), ("R2", 3, 10), ("R3", 0, None), ("R4", 3, 7), ("R5", 1, 3), ("R6", 1, 8), ("R7", 0, None)]
