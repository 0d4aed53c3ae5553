import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from celltide import schemas
from celltide.operators import baselines, bootstrap, curves, evaluation as ev, running
from tests.conftest import rows

CLASSES = list(schemas.CLASSES)


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(7)
    data = []
    for model in ("a", "b"):
        for cell in range(1, 13):
            for month in range(1, 13):
                data.append((model, cell, f"2024-{month:02d}", rng.choice(CLASSES[:2] if cell < 3 else CLASSES), rng.choice(CLASSES),
                             *[rng.randrange(6) / 5 for _ in CLASSES], month <= 5))
    return pd.DataFrame(data, columns=["model", "priogrid_gid", "year_month", "true_class", "pred_class", "prob_gov", "prob_opo", "prob_uncertain", "is_train_month"])


@pytest.fixture(scope="module")
def predictions(spark, frame):
    return spark.createDataFrame(frame).repartition(3)


def f1_of(y, p, c):
    hit = ((y == c) & (p == c)).sum()
    size = (y == c).sum() + (p == c).sum()
    return 2 * hit / size if size else 0.0


def auc_of(y, s):
    pos, neg = s[y], s[~y]
    if not len(pos) or not len(neg):
        return np.nan
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


def knots(y, s):
    """Cumulative (positives, negatives) at falling distinct scores."""
    return [((y & (s >= v)).sum(), (~y & (s >= v)).sum()) for v in sorted(set(s), reverse=True)]


def ap_of(y, s):
    total, before, area = y.sum(), 0, 0.0
    for p, n in knots(y, s):
        area += (p - before) / total * p / (p + n)
        before = p
    return area


def test_report_and_confusion(predictions, frame):
    val = frame[~frame.is_train_month]
    report = {(r["model"], r["class"]): r for r in ev.classification_report(ev.validation_rows(predictions), ["model"]).collect()}
    for model, g in val.groupby("model"):
        y, p = g.true_class, g.pred_class
        per = [f1_of(y, p, c) for c in CLASSES]
        for c, f in zip(CLASSES, per):
            assert report[model, c]["f1"] == pytest.approx(f)
            assert report[model, c]["support"] == (y == c).sum()
        assert report[model, "macro avg"]["f1"] == pytest.approx(np.mean(per))
        assert report[model, "weighted avg"]["f1"] == pytest.approx(np.average(per, weights=[(y == c).sum() for c in CLASSES]))
    matrix = ev.confusion_matrix(ev.validation_rows(predictions), ["model"])
    assert matrix.count() == 18
    assert matrix.agg(F.sum("n")).first()[0] == len(val)


def test_macro_over_present_classes(spark):
    df = spark.createDataFrame([("gov", "gov"), ("gov", "opo")], "true_class string, pred_class string")
    assert ev.f1_summary(df, average_over="present").first()["macro_f1"] == pytest.approx(0.3333, abs=1e-4)
    assert ev.f1_summary(df, average_over="all").first()["macro_f1"] == pytest.approx(0.2222, abs=1e-4)


def test_transition_scopes(predictions, frame):
    one = frame[frame.model == "a"].sort_values(["priogrid_gid", "year_month"])
    prev = one.groupby("priogrid_gid").true_class.shift(1)
    val = ~one.is_train_month
    full = one[val & prev.notna() & (prev != one.true_class)]
    df = predictions.filter("model = 'a'")
    assert rows(ev.transition_keys(df)) == sorted(zip(full.priogrid_gid, full.year_month), key=repr)
    inside = one[val].copy()
    inside["prev"] = inside.groupby("priogrid_gid").true_class.shift(1)
    inside = inside.dropna(subset=["prev"])
    moved, stable = inside[inside.prev != inside.true_class], inside[inside.prev == inside.true_class]
    line = ev.model_comparison(predictions).filter("model = 'a'").first()
    assert (line["n_val"], line["n_trans"], line["n_stable"]) == (val.sum(), len(moved), len(stable))
    assert line["trans_acc"] == pytest.approx((moved.true_class == moved.pred_class).mean(), abs=1e-4)
    assert line["stable_acc"] == pytest.approx((stable.true_class == stable.pred_class).mean(), abs=1e-4)


def test_areas_match_pairwise_definition(predictions, frame):
    got = {(r["model"], r["class"]): r for r in curves.ranking_areas(predictions, ["model"]).collect()}
    for model, g in frame.groupby("model"):
        for c in CLASSES:
            y, s = (g.true_class == c).to_numpy(), g[f"prob_{c}"].to_numpy()
            assert got[model, c]["auc"] == pytest.approx(auc_of(y, s))
            assert got[model, c]["ap"] == pytest.approx(ap_of(y, s))


def test_absent_class_has_no_area(spark):
    df = spark.createDataFrame([("gov", 0.2, 0.3, 0.5), ("gov", 0.1, 0.4, 0.5)], "true_class string, prob_gov double, prob_opo double, prob_uncertain double")
    got = {r["class"]: (r["auc"], r["ap"]) for r in curves.ranking_areas(df).collect()}
    assert got == {"gov": (None, 1.0), "opo": (None, None), "uncertain": (None, None)}


def test_grid_interpolation_matches_numpy(predictions, frame):
    g = frame[frame.model == "b"]
    grid = np.arange(101) / 100
    roc = {(r["class"], r["step"]): r["tpr"] for r in curves.roc_on_grid(predictions.filter("model = 'b'")).collect()}
    pr = {(r["class"], r["step"]): r["precision"] for r in curves.pr_on_grid(predictions.filter("model = 'b'")).collect()}
    assert len(roc) == len(pr) == 303
    for c in CLASSES:
        y, s = (g.true_class == c).to_numpy(), g[f"prob_{c}"].to_numpy()
        cum = np.array([(0, 0), *knots(y, s)], dtype=float)
        fpr, tpr = cum[:, 1] / (~y).sum(), cum[:, 0] / y.sum()
        np.testing.assert_allclose([roc[c, i] for i in range(101)], np.interp(grid, fpr, tpr), atol=1e-9)
        precision = np.append(1.0, cum[1:, 0] / cum[1:].sum(axis=1))
        np.testing.assert_allclose([pr[c, i] for i in range(101)], np.interp(grid, tpr, precision), atol=1e-9)


def test_trapezoid_of_roc_points_equals_auc(predictions):
    df = predictions.filter("model = 'a'")
    area = {r["class"]: r["area"] for r in curves.area_under(curves.roc_points(df), "fpr", "tpr", ["class"]).collect()}
    auc = {r["class"]: r["auc"] for r in curves.ranking_areas(df).collect()}
    assert area == pytest.approx(auc)


@pytest.mark.parametrize("parts", [None, 7])
def test_running_totals_over_a_hot_score(spark, parts):
    n = 5000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id", F.lit(1).cast("long").alias("one"))
    got = running.running_totals(df, ["g"], [F.desc("k"), F.asc("id")], {"total": "one"}, parts).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["k", "id"], ascending=[False, True])
        assert list(part.total) == list(range(1, len(part) + 1))
    numbers = running.number_rows(df.select("id"), [F.desc("id")], parts=parts).toPandas()
    assert (numbers.row_index == n - 1 - numbers.id).all()


def drawn_by_hand(seed, replicate, n):
    def mix(x):
        for shift in (16, 15):
            x = ((x ^ (x >> shift)) * 73244475) % 2**31
        return x ^ (x >> 16)
    return [mix(mix(mix(seed) ^ replicate) ^ i) * n // 2**31 for i in range(n)]


def test_bootstrap_matches_brute_force(spark, frame):
    g = frame[~frame.is_train_month].sort_values(["model", "priogrid_gid", "year_month"]).reset_index(drop=True)
    dropped = g[(g.model == "b")].index[:3]  # keys that one model lacks
    kept = g.drop(dropped)
    df = spark.createDataFrame(kept).repartition(3)
    keys = g[g.model == "a"].reset_index(drop=True)[["priogrid_gid", "year_month"]]
    n, n_boot, seed = len(keys), 25, 5
    metrics = bootstrap.replicate_metrics(df, n_boot, seed, block=10, by=["model"]).toPandas()
    assert len(metrics) == (n_boot + 1) * 4 * g.model.nunique() and metrics.replicate.nunique() == n_boot + 1
    indexed = metrics.set_index(["replicate", "model", "class"])
    for model in ("a", "b"):
        of_model = kept[kept.model == model].set_index(["priogrid_gid", "year_month"])
        for r in (-1, 0, 7, 24):
            index = list(range(n)) if r < 0 else drawn_by_hand(seed, r, n)  # one draw for all models
            drawn = [tuple(k) for k in keys.iloc[index].itertuples(index=False)]
            sample = of_model.loc[[k for k in drawn if k in of_model.index]]
            for c in CLASSES:
                y, s = (sample.true_class == c).to_numpy(), sample[f"prob_{c}"].to_numpy()
                got = indexed.loc[(r, model, c)]
                assert got.f1 == pytest.approx(f1_of(sample.true_class, sample.pred_class, c)) and got.n == y.sum()
                assert got.auc == pytest.approx(auc_of(y, s)) and got.ap == pytest.approx(ap_of(y, s))
    table = bootstrap.bootstrap_intervals(spark.createDataFrame(metrics), by=["model"]).filter("class = 'macro' AND measure = 'auc' AND model = 'a'").first()
    values = metrics[(metrics["class"] == "macro") & (metrics.model == "a") & (metrics.replicate >= 0)].auc
    assert table["lower"] == pytest.approx(np.percentile(values, 2.5)) and table["upper"] == pytest.approx(np.percentile(values, 97.5))


def test_bootstrap_blocks_agree_and_share_one_draw(spark, frame):
    df = spark.createDataFrame(frame[(frame.model == "a") & ~frame.is_train_month])
    whole = bootstrap.replicate_metrics(df, 10, 1).toPandas()
    split = bootstrap.replicate_metrics(df, 10, 1, block=2).toPandas()
    order = ["replicate", "class"]
    pd.testing.assert_frame_equal(whole.sort_values(order).reset_index(drop=True), split.sort_values(order).reset_index(drop=True))
    twice = df.unionByName(df.withColumn("model", F.lit("z")))
    paired = bootstrap.replicate_metrics(twice, 10, 1, by=["model"]).toPandas().set_index(["replicate", "class"])
    for c in ("f1", "auc", "ap"):
        pd.testing.assert_series_equal(paired[paired.model == "a"][c].sort_index(), paired[paired.model == "z"][c].sort_index())


def test_undefined_measures_and_empty_rows(spark, frame):
    df = spark.createDataFrame(frame[(frame.model == "a") & ~frame.is_train_month])
    alone = bootstrap.replicate_metrics(df.filter("true_class = 'gov'"), 5, 1).toPandas().set_index(["replicate", "class"])
    assert alone.loc[(-1, "gov"), "auc"] is None or np.isnan(alone.loc[(-1, "gov"), "auc"])
    assert np.isnan(alone.loc[(2, "opo"), "ap"]) and alone.loc[(2, "gov"), "ap"] == pytest.approx(1.0)
    assert bootstrap.replicate_metrics(df.limit(0), 5, 1).count() == 0


def test_ranges_do_not_change_areas(predictions):
    counts = curves.score_counts(predictions, ["model"])
    keys, order, sums = ["model", "class"], [F.desc("score")], {"cum_pos": "pos", "cum_neg": "neg"}
    split = running.place(counts, keys, order, 9)
    assert split.select(running.PART).distinct().count() > 3
    area = lambda df: rows(df.groupBy(*keys).agg(*[c for c in curves.area_terms()]).select(*keys, F.round("auc", 9), F.round("ap", 9)))
    assert area(running.totals_of_placed(split, keys, order, sums)) == area(running.running_totals(counts, keys, order, sums, 1))


def test_format_interval(spark):
    df = spark.createDataFrame([(0.5, 0.25, 0.75), (0.5, None, 0.7), (float("nan"), 0.1, 0.2)], "v double, l double, u double")
    got = [r[0] for r in df.select(bootstrap.format_interval(F.col("v"), F.col("l"), F.col("u"), 2)).collect()]
    assert got == ["0.50 [0.25, 0.75]", "n/a", "n/a"]


# --- baselines ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def target(spark):
    data = [(1, "2024-01", "gov"), (1, "2024-02", "opo"), (1, "2024-04", "opo"), (2, "2024-01", "gov"), (2, "2024-02", None), (2, "2024-03", "uncertain"), (3, "2024-03", "opo")]
    return spark.createDataFrame(data, "priogrid_gid long, year_month string, target string")


def test_persistence(target, spark):
    valid = spark.createDataFrame([(1,), (2,)], "priogrid_gid long")
    got = baselines.predict_no_change(target, valid, "2024-02")
    assert got.columns == schemas.PREDICTION_COLUMNS
    assert rows(got, "priogrid_gid", "year_month", "pred_class", "prob_opo", "is_train_month") == [
        (1, "2024-01", "gov", 0.0, True), (1, "2024-02", "gov", 0.0, True), (1, "2024-04", "opo", 1.0, False),
        (2, "2024-01", "gov", 0.0, True), (2, "2024-02", "gov", 0.0, True), (2, "2024-03", "gov", 0.0, False)]


def test_persistence_never_hits_a_transition(spark, frame):
    one = frame[frame.model == "a"][["priogrid_gid", "year_month", "true_class"]].rename(columns={"true_class": "target"})
    df = spark.createDataFrame(one)
    got = baselines.predict_no_change(df, df, "2024-05")
    line = ev.transition_accuracy(got).first()
    assert (line["trans_acc"], line["stable_acc"]) == (0.0, 1.0)


def test_random_draws_follow_the_shares(spark):
    df = spark.range(6000).select((F.col("id") + 1).alias("priogrid_gid"), F.lit("2024-01").alias("year_month"),
                                  F.when(F.col("id") % 10 < 6, "gov").when(F.col("id") % 10 < 9, "opo").otherwise("uncertain").alias("target"))
    got = baselines.predict_random(df, df, "2024-01", 3)
    share = {r[0]: r[1] / 6000 for r in got.groupBy("pred_class").count().collect()}
    assert share["gov"] == pytest.approx(0.6, abs=0.03) and share["uncertain"] == pytest.approx(0.1, abs=0.02)
    assert rows(got, "priogrid_gid", "pred_class") == rows(baselines.predict_random(df.repartition(5), df, "2024-01", 3), "priogrid_gid", "pred_class")


def test_weights_and_standardisation(target, spark):
    got = {r["class"]: r["weight"] for r in baselines.class_weights(target.filter("target <> 'uncertain'")).collect()}
    assert got == {"gov": pytest.approx(5 / 6), "opo": pytest.approx(5 / 9), "uncertain": None}
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 9.0, 3.0)], "k string, x double, y double")
    assert rows(baselines.standardize(df, ["x", "y"], F.col("k") == "a"), "k", "y") == [("a", 0.0), ("a", 0.0), ("b", 1.0)]


def test_metrics_without_rows_are_null(spark, predictions):
    none = predictions.filter("false")
    summary = ev.f1_summary(none).first()
    assert summary["n"] == 0 and summary["accuracy"] is None and summary["macro_f1"] is None
    assert ev.f1_summary(none, average_over="all").first()["macro_f1"] == 0
    report = {r["class"]: r for r in ev.classification_report(none).collect()}
    assert report["weighted avg"]["f1"] is None and report["gov"]["support"] == 0
    assert ev.confusion_matrix(none).agg(F.sum("n")).first()[0] == 0 and ev.misclassifications(none).count() == 0
    assert ev.accuracy_lift(none).first()["lift"] is None and ev.accuracy_by_class(none).count() == 0
