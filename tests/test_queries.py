"""The registered queries against their oracles at sf0.001, and operators against loops on small inputs."""

import math
import random

import duckdb
import numpy as np
import pytest

from taktwerk.operators import causes, feed, spc
from taktwerk.plans import registry, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
SLOW_SIZE = {"q_spc_blocks", "q_spc_baseline", "q_spc_cusum", "q_spc_ewma", "q_spc_first_signal", "q_spc_scan", "q_spc_sweep", "q_spc_score"}


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 4) + 0.0 if isinstance(v, float) else v
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW_SIZE))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


def test_evidence_and_drift_of_the_whole_table(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    units = {r.l_orderkey for r in lines.select("l_orderkey").distinct().collect()}
    assert {r.unit for r in registry.QUERIES["q_top_evidence_all"](spark, SF).collect()} == units
    got = {(r.trigger_unit, r.j): r for r in registry.QUERIES["q_drift_slope_triggers"](spark, SF).collect()}
    assert set(got) == {(t, j) for t in (480, 960, 1440) for j in range(1, 8)} and {r.n for r in got.values()} == {480}
    visits = tables.plant.sql(spark, SF, tables.spark_text(f"WITH {tables.STATES} SELECT unit, j, dwell_s FROM state WHERE j = 4")).toPandas()
    near = visits[(visits.unit >= 960) & (visits.unit < 1440)].dropna()
    slope = np.polyfit(near.unit - 960.0, near.dwell_s, 1)[0]
    assert math.isclose(got[1440, 4].slope, slope, abs_tol=2e-6)


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_cusum_equals_the_loop(spark):
    random.seed(3)
    means = [random.gauss(0, 1) + (1.5 if i > 12 else 0) for i in range(20)]
    df = spark.createDataFrame([("a", i, m) for i, m in enumerate(means)], "series string, blk long, m double")
    base = spark.createDataFrame([("a", 0.1, 0.9)], "series string, mu double, sd double")
    rows = spc.cusum(df, base).orderBy("blk").collect()
    hi = lo = 0.0
    start_hi = start_lo = 0
    for i, (m, r) in enumerate(zip(means, rows, strict=True)):
        z = (m - 0.1) / 0.9
        hi, lo = max(0.0, hi + z - 0.5), max(0.0, lo - z - 0.5)
        start_hi, start_lo = (i if hi == 0 else start_hi), (i if lo == 0 else start_lo)
        assert math.isclose(r.hi, hi, abs_tol=1e-9) and math.isclose(r.lo, lo, abs_tol=1e-9)
        assert r.onset == (start_hi if hi >= lo else start_lo)


def test_fisher_of_a_known_table(spark):
    df = spark.createDataFrame([(8, 10, 16, 9)], "a long, ne long, n long, nd long")
    assert abs(causes.fisher(df).first().p - 0.024476) < 1e-6


def test_duplicate_repair_restarts_after_a_gap(spark):
    x = [10.0, 9.0, None, 5.0, 4.0, 30.0]
    df = spark.createDataFrame([(1, j, v) for j, v in enumerate(x, 1)], "unit long, j int, x double")
    got = [r.x_dup for r in feed.repair_duplicates(df).orderBy("j").collect()]
    assert got == [10.0, 14.5, None, 5.0, 9.5, 30.0]


def test_interpolation_at_edges_and_inside(spark):
    x = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([(1, j, v) for j, v in enumerate(x, 1)], "unit long, j int, x_late double")
    assert [r.x_fill for r in feed.interpolate(df).orderBy("j").collect()] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_queries_on_states_register_what_they_read(spark):
    """A view left from other tables, or none at all, must not matter."""
    spark.catalog.dropTempView("lineitem")
    spark.createDataFrame([(42, 1)], "o_orderkey long, o_custkey long").createOrReplaceTempView("orders")
    assert registry.QUERIES["q_unit_thread"](spark, SF).count() == 7
