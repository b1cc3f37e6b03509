"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tapeloom.plans import books, lines, more, publishing, scans, screens, session, streams  # noqa: F401  these register further queries
from tapeloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else float(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = sql.execute(plans.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_k01_all_sorted_scores_keeps_every_item(spark):
    got = plans.QUERIES["k01_all_sorted_scores"](spark, SF).collect()
    assert len(got) == plans.QUERIES["c01_hybrid_daily"](spark, SF).count() > 40
    assert [r.place for r in got] == list(range(1, len(got) + 1))
    want = sorted(got, key=lambda r: (-(r.score or 0), r.place))
    assert [r.score for r in got] == [r.score for r in want]


def test_k04_ranked_abs_net_keeps_every_pair(spark):
    got = plans.QUERIES["k04_ranked_abs_net"](spark, SF).collect()
    pairs = plans.net(spark, SF, ("broker", "ticker")).select("broker", "ticker").collect()
    assert sorted((r.broker, r.ticker) for r in got) == sorted((r.broker, r.ticker) for r in pairs) and len(got) > 25
    for broker in {r.broker for r in got}:
        own = sorted((r for r in got if r.broker == broker), key=lambda r: (-abs(r.net), r.ticker))
        assert [r.place for r in own] == list(range(1, len(own) + 1))


def test_p15_repair_plan_thin_repairs_thin_days(spark):
    thin = {(r.instrument, r.date): r.thin for r in plans.QUERIES["p16_thin_candles"](spark, SF).collect()}
    plain_plan = {(r.instrument, r.date): r.repair for r in plans.QUERIES["p15_repair_plan"](spark, SF).collect()}
    got = {(r.instrument, r.date): r.repair for r in plans.QUERIES["p15_repair_plan_thin"](spark, SF).collect()}
    assert got == {k: v or thin[k] for k, v in plain_plan.items()} and got != plain_plan


def test_c11_inputs_have_a_cvd_slope_and_the_divergence_of_the_hybrid_score(spark):
    rows = more.hot_inputs(spark, SF).orderBy("instrument", "date").collect()
    for a, b in zip(rows, rows[1:]):
        if a.instrument == b.instrument:
            assert b.c_slope == b.delta - a.delta
    assert any(r.c_slope for r in rows)
    kinds = {(r.instrument, r.date): r.div_type for r in plans.QUERIES["c01_hybrid_daily"](spark, SF).collect()}
    assert {(r.instrument, r.date) for r in rows if r.divergent} == {k for k, v in kinds.items() if v} != set()
    hot = {(r.instrument, r.date): r.hot for r in plans.QUERIES["c11_hot_score"](spark, SF).collect()}
    fixed = more.hot_inputs(spark, SF).withColumn("c_slope", more.F.lit(0.0)).withColumn("divergent", more.F.lit(False))
    fixed = {(r.instrument, r.date): r.hot for r in more.activity.hot_score(fixed, ["date"]).collect()}
    assert hot.keys() == fixed.keys() and hot != fixed
