"""Properties that hold for any input, on random panels with gaps, ties and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from celltide.operators import curves, dedup, evaluation as ev, panel, votes
from celltide.plans import panel as plans
from tests.conftest import rows

SEEDS = [1, 2]


def random_events(spark, seed):
    """A third of the rows share one id and one cell."""
    rng = random.Random(seed)
    data = []
    for k in range(1500):
        hot = k % 3 == 0
        data.append((1 if hot else rng.randrange(400), 158235 if hot else 158235 + rng.randrange(9), rng.choice("abc"),
                     f"20{20 + rng.randrange(2)}-{1 + rng.randrange(12):02d}-{1 + rng.randrange(28):02d}" if rng.random() > 0.02 else None,
                     rng.choice(["x", "y", None]), rng.choice(["N", "S", None]), float(rng.randrange(5))))
    df = spark.createDataFrame(data, "id long, priogrid_gid long, data_source string, d string, dyad_name string, adm_1 string, best double")
    return df.withColumn("date_start", F.to_date("d")).repartition(5)


@pytest.mark.parametrize("seed", SEEDS)
def test_dedup_is_idempotent_and_order_free(spark, seed):
    df = random_events(spark, seed)
    order = [F.desc("data_source"), F.col("date_start").asc_nulls_last()]
    once = dedup.dedup_by_priority(df, "id", order)
    assert once.count() == df.select("id").distinct().count()
    assert rows(dedup.dedup_by_priority(once, "id", order)) == rows(once)
    assert rows(dedup.dedup_by_priority(df.repartition(2, "best"), "id", order)) == rows(once)


@pytest.mark.parametrize("seed", SEEDS)
def test_panel_is_complete_and_loses_no_event(spark, seed):
    df = random_events(spark, seed)
    aggregates = panel.aggregate_cell_period(df, {"total": "best"}, {"n_dyads": "dyad_name"}, ["adm_1"])
    dated = df.filter("date_start IS NOT NULL")
    assert aggregates.agg(F.sum("total_events"), F.sum("total")).first() == dated.agg(F.count("*"), F.sum("best")).first()
    plain = dated.groupBy("priogrid_gid", F.date_format("date_start", "yyyy-MM").alias("m")).agg(F.count_distinct("dyad_name").alias("n"))
    assert rows(aggregates, "priogrid_gid", "year_month", "n_dyads") == rows(plain, "priogrid_gid", "m", "n")
    dense = plans.dense_panel(aggregates)
    cells, months = dense.agg(F.count_distinct("priogrid_gid"), F.count_distinct("year_month")).first()
    assert dense.count() == dense.select("priogrid_gid", "year_month").distinct().count() == cells * months


@pytest.mark.parametrize("seed", SEEDS)
def test_carry_forward_never_invents_values(spark, seed):
    rng = random.Random(seed)
    data = [(c, f"{m:03d}", rng.choice(["g", "o", None, None])) for c in range(8) for m in range(30)]
    df = spark.createDataFrame(data, "priogrid_gid long, year_month string, s string")
    got = {(r[0], r[1]): r[2] for r in panel.carry_forward(df, ["s"]).collect()}
    for cell in range(8):
        last = None
        for c, m, s in data:
            if c == cell:
                last = s or last
                assert got[c, m] == last


@pytest.mark.parametrize("seed", SEEDS)
def test_votes_add_up(spark, seed):
    rng = random.Random(seed)
    data = [(1 if k % 3 == 0 else rng.randrange(6), rng.choice("ab"), rng.choice(["government", "resistance", "contested"]), rng.choice(["high", "low"])) for k in range(900)]
    df = spark.createDataFrame(data, "priogrid_gid long, year_month string, control_status string, confidence string")
    got = votes.majority_vote(df)
    assert got.agg(F.sum("n_towns_in_cell"), F.sum("high_conf_towns")).first() == (900, sum(c == "high" for *_, c in data))
    for r in got.collect():
        counts = {}
        for c, m, s, _ in data:
            if (c, m) == (r[0], r[1]):
                counts[s] = counts.get(s, 0) + 1
        top = max(counts.values())
        assert counts[r["control_status"]] == top
        share = top / sum(counts.values())
        assert r["label_confidence"] == ("high" if share >= 0.75 else "medium" if share >= 0.5 else "low")


@pytest.mark.parametrize("seed", SEEDS)
def test_confusion_sums_and_area_bounds(spark, seed):
    rng = random.Random(seed)
    classes = ["gov", "opo", "uncertain"]
    data = [(rng.choice(classes), rng.choice(classes), *[0.5 if k % 3 == 0 else rng.random() for _ in classes]) for k in range(600)]
    df = spark.createDataFrame(data, "true_class string, pred_class string, prob_gov double, prob_opo double, prob_uncertain double")
    assert ev.confusion_matrix(df).agg(F.sum("n")).first()[0] == 600
    flipped = df.withColumns({f"prob_{c}": 1 - F.col(f"prob_{c}") for c in classes})
    a = {r["class"]: r["auc"] for r in curves.ranking_areas(df).collect()}
    b = {r["class"]: r["auc"] for r in curves.ranking_areas(flipped).collect()}
    for c in classes:
        assert a[c] + b[c] == pytest.approx(1.0)
