import pandas as pd
import pytest
from pyspark.sql import functions as F

from celltide import fixed_values as fixed, schemas
from celltide.operators import panel as ops, summaries
from celltide.plans import panel as plans
from tests.conftest import rows


@pytest.fixture(scope="module")
def events(spark):
    data = [
        # cell, month, day, dyad, adm, best, type, a, b, prec
        (1, "2021-01", "2021-01-05", "x", None, 2.0, 1, "military_sac", "nug_pdf", 1),
        (1, "2021-01", "2021-01-07", "y", "North", 1.0, 3, "military_sac", "civ", 5),
        (1, "2021-01", "2021-01-06", "x", "South", None, 2, None, "kio_kia", 2),
        (1, "2021-03", "2021-03-01", "x", "South", 4.0, 3, "nug_pdf", "nug_pdf", 3),
        (2, "2021-05", "2021-05-01", None, None, 0.0, 1, "cnf", "uwsa", 4),
        (2, "2021-02", "2021-02-01", "z", "East", 9.0, 1, "cnf", "uwsa", 6),
        (2, "2021-02", "2021-02-01", "z", "East", 9.0, 1, "cnf", "uwsa", None),
        (None, "2021-02", "2021-02-01", "z", "East", 9.0, 1, "cnf", "uwsa", 1),
    ]
    df = spark.createDataFrame(data, "priogrid_gid long, year_month string, d string, dyad_name string, adm_1 string, best double, "
                               "type_of_violence int, side_a_level3 string, side_b_level3 string, where_prec int")
    return df.withColumn("date_start", F.to_date("d")).withColumns({c: F.col("best") for c in ("deaths_a", "deaths_b", "deaths_civilians")})


def test_cell_months(events):
    got = rows(plans.cell_months(events), "priogrid_gid", "year_month", "total_events", "total_fatalities", "n_unique_dyads",
               "adm_1", "is_onesided", "gov_vs_civilians", "events_gov", "events_nug", "events_kio")
    assert got == [
        (1, "2021-01", 3, 3.0, 2, "South", 1, 1, 2, 1, 1),
        (1, "2021-03", 1, 4.0, 1, "South", 1, 0, 0, 1, 0),
        (2, "2021-05", 1, 0.0, 0, None, 0, 0, 0, 0, 0),
    ]


def test_dense_panel_calendars(events):
    aggregates = plans.cell_months(events)
    observed = plans.dense_panel(aggregates)
    assert rows(observed, "priogrid_gid", "year_month", "total_events", "adm_1") == [
        (1, "2021-01", 3, "South"), (1, "2021-03", 1, "South"), (1, "2021-05", 0, "South"),
        (2, "2021-01", 0, None), (2, "2021-03", 0, None), (2, "2021-05", 1, None)]
    full = plans.dense_panel(aggregates, "full")
    assert full.count() == 2 * 5
    assert full.filter("year_month = '2021-02'").count() == 2


def test_panel_has_no_cross_join_and_one_window_exchange(events):
    store = plans.build_feature_store(plans.build_panel(events))
    plan = store._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # one exchange by cell feeds every window; the other one makes the cells distinct
    assert plan.count("Exchange hashpartitioning(priogrid_gid#") <= 4
    assert len(summaries.numeric_features(store, schemas.PANEL_METADATA)) == 93


def test_windows_match_pandas(spark):
    n = 15
    pdf = pd.DataFrame([(c, f"2020-{m:02d}" if m <= 12 else f"2021-{m - 12:02d}", float((m * 7 + c * 3) % 11))
                        for c in (1, 2) for m in range(1, n + 1)] + [(3, "2020-01", 5.0)], columns=["priogrid_gid", "year_month", "v"])
    df = spark.createDataFrame(pdf).repartition(3)
    got = ops.add_trend(ops.add_rolling_std(ops.add_rolling_mean(ops.add_lags(df, ["v"], [1, 12]), ["v"], [3, 6]), ["v"], [3]), ["v"])
    got = got.toPandas().sort_values(["priogrid_gid", "year_month"]).reset_index(drop=True)
    g = pdf.groupby("priogrid_gid")["v"]
    expected = {
        "v_lag1": g.shift(1).fillna(0), "v_lag12": g.shift(12).fillna(0),
        "v_roll3m": g.transform(lambda x: x.rolling(3, min_periods=1).mean()),
        "v_roll6m": g.transform(lambda x: x.rolling(6, min_periods=1).mean()),
        "v_std3m": g.transform(lambda x: x.rolling(3, min_periods=2).std().fillna(0)),
    }
    expected["v_trend"] = expected["v_roll3m"] - expected["v_roll6m"]
    for name, series in expected.items():
        pd.testing.assert_series_equal(got[name], series.reset_index(drop=True), check_names=False)


def test_fills(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (1, "c", None), (2, "a", None)], "priogrid_gid long, year_month string, s string")
    assert rows(ops.carry_forward(df, ["s"])) == [(1, "a", None), (1, "b", "x"), (1, "c", "x"), (2, "a", None)]
    assert rows(ops.fill_both_ways(df, ["s"])) == [(1, "a", "x"), (1, "b", "x"), (1, "c", "x"), (2, "a", None)]


def test_changed_nearby_boundaries(spark):
    data = [(1, "a", "g"), (1, "b", "g"), (1, "c", "g"), (1, "d", "o"), (1, "e", "o"), (1, "f", "o"), (2, "a", "g")]
    df = spark.createDataFrame(data, "priogrid_gid long, year_month string, s string")
    flags = lambda b: {(r[0], r[1]): r[2] for r in df.select("priogrid_gid", "year_month", ops.changed_nearby("s", b)).collect()}
    changed, stable = flags("changed"), flags("stable")
    assert [changed[1, m] for m in "abcdef"] == [True, False, True, True, False, True] and changed[2, "a"]
    assert [stable[1, m] for m in "abcdef"] == [False, False, True, True, False, False] and not stable[2, "a"]


def test_latest_non_null_is_per_column(spark):
    df = spark.createDataFrame([(1, 2000, 1.0, 5.0), (1, 2001, 2.0, None), (1, None, 9.0, 9.0), (2, 1999, None, None)],
                               "priogrid_gid long, year int, a double, b double")
    assert rows(ops.latest_non_null(df, "priogrid_gid", "year", ["a", "b"])) == [(1, 2001, 2.0, 5.0), (2, 1999, None, None)]


def test_covariates(spark):
    cells = spark.createDataFrame([(1,), (2,)], "priogrid_gid long")
    static = spark.createDataFrame([(1, 2.0, None), (3, 1.0, 1.0)], "gid long, forest_gc double, agri_gc double")
    assert rows(plans.static_covariates(static, cells)) == [(1, 2.0, 0.0)]
    yearly = spark.createDataFrame([(1, "2000", 1.0), (1, "x", 7.0), (1, "2001", None)], "gid long, year string, capdist double")
    assert rows(plans.yearly_covariates(yearly, cells)) == [(1, 2001, 1.0)]
    assert rows(plans.yearly_covariates(yearly.drop("capdist"), cells)) == [(1,), (2,)]


def test_feature_store_with_covariates(events, spark):
    static = spark.createDataFrame([(1, 3.0)], "priogrid_gid long, forest_gc double")
    store = plans.build_feature_store(plans.build_panel(events), static)
    assert {r["forest_gc"] for r in store.filter("priogrid_gid = 2").collect()} == {0.0}
    assert set(f"{c}_lag12" for c in fixed.LAG_COLUMNS) <= set(store.columns)


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3), ("b", 7), ("b", 21), (None, 5)], "k string, v int")
    assert rows(summaries.intensity_bins(df, "v")) == [("1-5", 2, 40.0), ("6-20", 1, 20.0), ("<=0", 1, 20.0), (">20", 1, 20.0)]
    assert rows(summaries.frequency(df, "k"), "k", "n") == [("a", 2), ("b", 2), (None, 1)]
    assert [tuple(r) for r in summaries.top_values(df, "k", 1).collect()] == [("a", 2)]
    line = summaries.describe_columns(df, ["v"]).first()
    assert (line["count"], line["mean"], line["p50"]) == (5, 7.2, 5.0)
    months = spark.createDataFrame([(f"2020-{m:02d}",) for m in range(1, 8)], "year_month string")
    assert rows(summaries.evenly_spaced_periods(months, 4)) == [("2020-01",), ("2020-03",), ("2020-05",), ("2020-07",)]
    assert rows(summaries.evenly_spaced_periods(months, 20)) == [(f"2020-{m:02d}",) for m in range(1, 8)]
    assert rows(summaries.middle_period(months)) == [("2020-04",)]


def test_quantiles_are_exact_without_a_buffer_of_values(spark):
    import random
    import numpy as np
    from celltide.operators import summaries
    rng = random.Random(2)
    data = [(rng.choice([None, 1.5, 2.0, rng.random() * 9]), rng.randint(-3, 3), None) for _ in range(501)]
    table = spark.createDataFrame(data, "a double, b int, c double").repartition(5)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = {r["column"]: r for r in summaries.quantiles(table, ["a", "b", "c"], shares).collect()}
    assert set(found) == {"a", "b"}  # a column without values has no quantiles
    for k, c in enumerate(("a", "b")):
        values = [d[k] for d in data if d[k] is not None]
        for i, q in enumerate(shares):
            assert abs(found[c][f"q{i}"] - np.quantile(values, q)) < 1e-9
    described = summaries.describe_columns(table, ["a", "c"])
    assert "percentile" not in described._jdf.queryExecution().optimizedPlan().toString()
    line = {r["column"]: r for r in described.collect()}
    assert line["c"]["count"] == 0 and line["c"]["p50"] is None and line["a"]["count"] == sum(d[0] is not None for d in data)
