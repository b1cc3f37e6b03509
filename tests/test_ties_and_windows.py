"""Open ties of an order, and book windows against plain lists."""

import random

import duckdb
import pytest

from tapeloom.plans import books, lines  # noqa: F401  they register further queries
from tapeloom.plans import queries as plans


@pytest.mark.parametrize("turned", [False, True])
def test_book_payload_does_not_depend_on_the_order_of_tied_lines(spark, tmp_path, turned):
    rng = random.Random(3)
    # the ninth and tenth line of every supplier have one order and line number, and so have the second and third
    rows = [(i, s, 1 + s % 3, float(rng.randrange(1, 51))) for s in range(1, 9) for i in (1, 2, 2, 3, 4, 5, 6, 7, 8, 8, 9)]
    table = spark.createDataFrame(rows[::-1] if turned else rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").selectExpr("*", "0L AS l_partkey")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    flat = lambda r: (*r[:4], *[[tuple(x) for x in side] for side in r[4:]])
    want = sorted(map(flat, c.execute(plans.SQL["s26_book_payload_ordered"]).fetchall()))
    for name in ("s26_book_payload", "s26_book_payload_ordered"):
        assert sorted(map(flat, plans.QUERIES[name](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("name", ["w14_book_pressure", "c15_pressure", "c16_book_light"])
def test_book_windows_take_one_shuffle_and_no_lists(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "collect_list" not in plan and "lambdafunction" not in plan
