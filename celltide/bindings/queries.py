"""One registered query per operator or pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructType

from celltide import fixed_values as fixed
from celltide.bindings import tables as t
from celltide.functions import dates, grid, values
from celltide.operators import (
    actors, baselines, bootstrap, curves, dedup, evaluation as ev, folds, grid as grid_ops, keys, models,
    panel as panel_ops, running, shapes, summaries, votes,
)
from celltide.plans import events as event_plans, labels as label_plans, panel as panel_plans, target as target_plans
from celltide.runtime import checkpoint, checkpoint_folder
from celltide.schemas import CELL, CLASSES, EVENTS, KEY, PERIOD
from celltide.sources import dimensions, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that engines that add in another order agree."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# --- sources ------------------------------------------------------------------------------


def _sources(spark, sf):
    """Three labelled event sources; one of them lacks a column."""
    parts = {f"src_{flag}": t.events(spark, sf, flag).drop("data_source") for flag in "ANR"}
    parts["src_N"] = parts["src_N"].drop("deaths_b")
    return [readers.Source(df, name) for name, df in parts.items()]


MERGED_COLUMNS = ["id", "date_start", "type_of_violence", "side_a", "side_b", "best", "deaths_b", "where_prec", "country", "adm_1", "adm_2", "data_source"]


@query
def align_union(spark, sf):
    return readers.union_sources(spark, _sources(spark, sf), EVENTS).select("id", "date_start", "deaths_b", "adm_2", "best", "data_source")


@query
def merge_sources(spark, sf):
    return event_plans.merge_sources(spark, _sources(spark, sf), F.col("country") == "Home").select(*MERGED_COLUMNS)


@query
def dedup_priority(spark, sf):
    return dedup.dedup_by_priority(
        t.events(spark, sf).select("id", "data_source", "date_start", "best", "where_prec"), "id", [F.desc("data_source"), F.col("date_start").asc_nulls_last()])


@query
def duplicate_report(spark, sf):
    return dedup.duplicate_report(t.events(spark, sf), "id")


@query
def precision_filter(spark, sf):
    return summaries.precision_report(t.events(spark, sf), "where_prec", fixed.MAX_WHERE_PRECISION)


@query
def latest_snapshot(spark, sf):
    named = t.table(spark, sf, "orders").withColumn(
        "file", F.concat(F.lit("extract_"), F.date_format("o_orderdate", "yyyy-MM-01"), F.lit(".csv")))
    return readers.latest_snapshot(named, F.col("file")).select("o_orderkey", "file")


@query
def parse_dates(spark, sf):
    raw = t.events(spark, sf).select(
        "id", F.coalesce(F.col("date_start").cast("string"), F.lit("n/a")).alias("date_start"), "best")
    parsed = event_plans.with_period(raw)
    return parsed.withColumn("month_start", dates.month_start(F.col(PERIOD))).select("id", "best", "date_start", PERIOD, "month_start")


@query
def iso_timestamps(spark, sf):
    text = t.table(spark, sf, "events").select(
        "event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("text"))
    parsed = dates.iso_timestamp(F.col("text"))
    return text.select("event_id", F.unix_timestamp(parsed).alias("epoch"))


@query
def event_overview(spark, sf):
    return summaries.overview(
        t.labelled_events(spark, sf), {"n_cells": CELL, "n_periods": PERIOD}, {"fatalities": "best"}, "date_start")


# --- taxonomy and actors ------------------------------------------------------------------


@query
def label_events(spark, sf):
    return t.labelled_events(spark, sf).select(
        "id", PERIOD, "best", "side_a", "side_b", *[f"{s}_{level}" for s in ("side_a", "side_b") for level in ("level1", "level2", "level3", "display")])


@query
def unmatched_keys(spark, sf):
    return keys.unmatched_keys(t.events(spark, sf), t.taxonomy(spark, sf), "ucdp_name", ["side_a", "side_b"])


@query
def presence_flags(spark, sf):
    flagged = panel_plans.presence_flags(t.labelled_events(spark, sf), t.ACTORS)
    return flagged.select("id", "data_source", *t.ACTORS)


@query
def violence_flags(spark, sf):
    flagged = panel_plans.violence_flags(t.labelled_events(spark, sf), "actor_0")
    return flagged.select("id", "best", "is_onesided", "is_statebased", "gov_vs_civilians")


@query
def classify_actors(spark, sf):
    named = actors.classify_actors(t.signal_events(spark, sf), t.RULES, overrides=t.OVERRIDES)
    return named.select("event_id_cnty", "event_date", "actor1", "inter1", "side", "coalition", "actor_group")


@query
def actor_patterns(spark, sf):
    """First matching rule of every distinct part name."""
    names = t.table(spark, sf, "part").select(F.col("p_name").alias("actor1")).distinct()
    matched = actors.match_actor(F.col("actor1"), t.RULES)
    return names.select("actor1", matched["side"].alias("side"), matched["coalition"].alias("coalition"), matched["actor_group"].alias("actor_group"))


@query
def time_override(spark, sf):
    base = actors.classify_actors(t.signal_events(spark, sf), t.RULES, overrides=[])
    final = actors.classify_actors(t.signal_events(spark, sf), t.RULES, overrides=t.OVERRIDES)
    count = lambda df, name: df.groupBy("actor_group", "coalition").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
    return count(base, "before").unionByName(count(final, "after"))


@query
def type_fallback(spark, sf):
    unnamed = t.signal_events(spark, sf).filter("actor1 IS NULL")
    named = actors.classify_actors(unnamed, t.RULES, overrides=[])
    return named.groupBy("inter1", "side", "coalition", "actor_group").agg(F.count("*").alias("n"))


# --- grid ---------------------------------------------------------------------------------


@query
def grid_assign(spark, sf):
    return t.table(spark, sf, "customer").select(
        "c_custkey", grid.cell_id(F.expr(t.LAT), F.expr(t.LON)).alias(CELL))


@query
def cell_geometry(spark, sf):
    return grid_ops.cell_geometry(t.events(spark, sf))


@query
def grid_layout(spark, sf):
    return grid_ops.grid_layout(t.feature_cells(spark, sf))


@query
def valid_cells(spark, sf):
    return grid_ops.valid_cells(t.feature_cells(spark, sf), label_plans.place_points(t.points(spark, sf)))


@query
def raster_positions(spark, sf):
    points = label_plans.place_points(t.points(spark, sf)).select(CELL).distinct()
    return grid_ops.to_raster(points, grid_ops.grid_layout(t.feature_cells(spark, sf)))


@query
def changing_cells(spark, sf):
    return grid_ops.changing_cells(t.target(spark, sf))


@query
def focal_cells(spark, sf):
    return grid_ops.focal_cells(t.stored_target(spark, sf), grid_ops.grid_layout(t.feature_cells(spark, sf)), 1, fit=baselines.is_train(t.CUTOFF))


def _as_text(dense, *keys):
    """Arrays as text, so that any engine can compare them."""
    return dense.select(
        *keys, F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"),
        F.array_join(F.transform("mask", lambda x: x.cast("string")), ",").alias("mask"),
        F.array_join(F.transform("n_gov", lambda x: x.cast("int").cast("string")), ",").alias("n_gov"))


@query
def dense_grid(spark, sf):
    rows = t.stored_target(spark, sf)
    return _as_text(grid_ops.dense_grid(rows, grid_ops.grid_layout(rows), ["n_gov"]), PERIOD)


@query
def dense_grid_tiles(spark, sf):
    """The same rasters in bands of eight rows."""
    rows = t.stored_target(spark, sf)
    return _as_text(grid_ops.dense_grid(rows, grid_ops.grid_layout(rows), ["n_gov"], band_rows=8), PERIOD, "band")


@query
def clip_cells(spark, sf):
    return grid_ops.clip_cells(t.events(spark, sf).select(CELL).distinct(), t.boundary(spark, sf))


@query
def clip_shapes(spark, sf):
    """Share of each event cell that each diamond covers, from the polygons cut along the cells."""
    shares = shapes.clip_shapes(t.events(spark, sf).select(CELL).distinct(), shapes.rings(t.corners(spark, sf)))
    return rounded(shares.select(CELL, "polygon_id", "share"))


@query
def neighbour_features(spark, sf):
    return rounded(grid_ops.neighbour_features(
        t.dense_panel(spark, sf).select(*KEY, "total_events", "total_fatalities"), ["total_events", "total_fatalities"]))


@query
def neighbour_features_wide(spark, sf):
    """Sums and means over the 17 x 17 cells around each."""
    return rounded(grid_ops.window_features(
        t.dense_panel(spark, sf).select(*KEY, "total_events", "total_fatalities"), ["total_events", "total_fatalities"], radius=8))


# --- panel --------------------------------------------------------------------------------


@query
def cell_month_agg(spark, sf):
    return t.cell_months(spark, sf)


@query
def panel_dense(spark, sf):
    return t.dense_panel(spark, sf)


@query
def panel_full_calendar(spark, sf):
    """Every month between first and last."""
    aggregates = panel_plans.cell_months(t.labelled_events(spark, sf), t.ACTORS)
    return panel_plans.dense_panel(aggregates, "full").select(*KEY, "total_events", "adm_1")


@query
def lag_features(spark, sf):
    dense = t.dense_panel(spark, sf)
    return panel_ops.add_lags(dense.select(*KEY, *fixed.LAG_COLUMNS), fixed.LAG_COLUMNS, fixed.BASE_LAGS + fixed.EXTENDED_LAGS)


@query
def rolling_mean(spark, sf):
    dense = t.dense_panel(spark, sf).select(*KEY, *fixed.ROLL_COLUMNS)
    return rounded(panel_ops.add_rolling_mean(dense, fixed.ROLL_COLUMNS, [3, 6, 12]))


@query
def rolling_std(spark, sf):
    dense = t.dense_panel(spark, sf).select(*KEY, *fixed.SPREAD_COLUMNS)
    return rounded(panel_ops.add_rolling_std(dense, fixed.SPREAD_COLUMNS, [3, 6]))


@query
def trend(spark, sf):
    dense = t.dense_panel(spark, sf).select(*KEY, *fixed.SPREAD_COLUMNS)
    return rounded(panel_ops.add_trend(dense, fixed.SPREAD_COLUMNS))


@query
def event_shares(spark, sf):
    columns = ["gov_event_share", "nug_event_share", "kio_event_share", "ula_event_share", "knu_event_share"]
    return rounded(panel_plans.build_feature_store(t.panel(spark, sf)).select(*KEY, *columns))


@query
def fill_both_ways(spark, sf):
    aggregates = checkpoint(t.cell_months(spark, sf).select(*KEY, "adm_1"))
    dense = panel_ops.densify(aggregates, panel_ops.observed_periods(aggregates))
    return panel_ops.fill_both_ways(dense, ["adm_1"])


@query
def feature_store(spark, sf):
    cells = t.feature_cells(spark, sf)
    store = panel_plans.build_feature_store(
        t.panel(spark, sf), panel_plans.static_covariates(t.static_table(spark, sf), cells),
        panel_plans.yearly_covariates(t.yearly_table(spark, sf), cells))
    return rounded(store)


@query
def latest_non_null(spark, sf):
    return panel_ops.latest_non_null(
        readers.normalize_key(t.yearly_table(spark, sf)).withColumn("year", F.col("year").cast("int")), CELL, "year", ["bdist1", "capdist"])


@query
def yearly_covariates(spark, sf):
    return panel_plans.yearly_covariates(t.yearly_table(spark, sf), t.feature_cells(spark, sf))


@query
def static_enrich(spark, sf):
    cells = t.feature_cells(spark, sf)
    static = panel_plans.static_covariates(t.static_table(spark, sf), cells)
    return keys.left_enrich(t.events(spark, sf).select("id", CELL, "best"), static, [CELL])


# --- labels -------------------------------------------------------------------------------


@query
def last_per_period(spark, sf):
    rows = t.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return dedup.last_per_period(rows, "ts", F.date_format("ts", "yyyy-MM-dd"), "event_id").select("event_id", "event_type")


@query
def extract_records(spark, sf):
    """Link blocks of every page, with target and text of each."""
    pages = t.table(spark, sf, "pages").select("page_id", "html")
    return label_plans.extract_entries(
        pages, "html", r"(<a href=[^>]*>[^<]*</a>)", {"href": r'href="([^"]*)"', "title": r'title="([^"]*)"', "label": r">([^<]+)<"})


def _revisions(spark, sf):
    """One map revision per order, with usable, unreadable, incomplete and skipped entries."""
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("revid"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"), F.lit(":00:00Z")).alias("timestamp"),
        F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END").alias("comment"),
        F.format_string(
            'return {\n { lat = "%d.25", long = "%d.5", mark = "%s", label = "[[Town %d|T]]" },'
            '\n { lat = "north", long = "97.1", mark = "Location dot red.svg" }, { lat = "20.5", mark = "Location dot red.svg" },'
            '\n { lat = "%d.75", long = "95.5", mark = " Dot green 0d0.svg ", label = "Plain" } }',
            F.col("o_custkey") % 90, F.col("o_orderkey") % 180,
            F.expr("""element_at(array('Location dot red.svg', 'WhiteDot.svg', 'Location dot green.svg', 'New icon.svg',
                '80x80-red-blue-anim.gif'), CAST(1 + o_orderkey % 5 AS INT))"""),
            F.col("o_orderkey"), F.col("o_custkey") % 80,
        ).alias("content"))


@query
def parse_snapshots(spark, sf):
    return label_plans.parse_snapshots(_revisions(spark, sf))


@query
def revision_records(spark, sf):
    """JSON documents with two revisions each, one of them without a comment."""
    documents = t.table(spark, sf, "orders").select(F.format_string(
        '{"query": {"pages": [{"revisions": [{"revid": %d, "timestamp": "t%d", "comment": "%s"}, {"revid": -%d, "timestamp": "u"}]}]}}',
        "o_orderkey", F.col("o_orderkey") % 7, "o_orderpriority", "o_orderkey").alias("value"))
    return label_plans.revisions_from_json(documents)


@query
def majority_vote(spark, sf):
    return votes.majority_vote(label_plans.place_points(t.points(spark, sf)))


@query
def locf_panel(spark, sf):
    return t.labels(spark, sf)


@query
def snapshot_months(spark, sf):
    return summaries.period_flag_counts(t.labels(spark, sf), "is_direct_snapshot")


@query
def point_locations(spark, sf):
    return dedup.distinct_locations(t.points(spark, sf))


@query
def label_frequency(spark, sf):
    return summaries.frequency(t.points(spark, sf), "control_status", "confidence")


# --- target -------------------------------------------------------------------------------


@query
def changed_recent(spark, sf):
    labels = t.labels(spark, sf).select(*KEY, "control_status")
    return labels.withColumns({
        "changed": panel_ops.changed_nearby("control_status"),
        "changed_inside": panel_ops.changed_nearby("control_status", "stable"),
    })


@query
def signal_panel(spark, sf):
    return t.signals(spark, sf)


@query
def agreement(spark, sf):
    return target_plans.compare_signals(t.signals(spark, sf), t.labels(spark, sf))


@query
def target_cascade(spark, sf):
    return t.target(spark, sf)


@query
def slim_target(spark, sf):
    return target_plans.slim_target(t.target(spark, sf, "stable"))


@query
def target_checks(spark, sf):
    return target_plans.check_target(t.target(spark, sf))


@query
def target_summary(spark, sf):
    return target_plans.summarize_target(t.target(spark, sf))


@query
def reason_breakdown(spark, sf):
    return target_plans.reason_breakdown(t.target(spark, sf))


@query
def monthly_composition(spark, sf):
    return rounded(summaries.composition(t.target(spark, sf), PERIOD, "target", CLASSES))


@query
def cell_composition(spark, sf):
    return rounded(summaries.cell_composition(t.target(spark, sf), "target", CLASSES))


@query
def top_uncertain_months(spark, sf):
    rates = rounded(summaries.composition(t.target(spark, sf), PERIOD, "target", CLASSES))
    return rates.orderBy(F.desc("uncertain_rate"), PERIOD).limit(10)


@query
def changed_share(spark, sf):
    return rounded(summaries.true_share(t.target(spark, sf), F.col("wiki_changed_recent"), "changed_share"))


# --- baselines ----------------------------------------------------------------------------


@query
def no_change(spark, sf):
    rows = t.stored_target(spark, sf)
    return baselines.predict_no_change(rows, grid_ops.valid_cells(t.feature_cells(spark, sf), rows), t.CUTOFF)


@query
def random_proportional(spark, sf):
    rows = t.stored_target(spark, sf)
    valid = grid_ops.valid_cells(t.feature_cells(spark, sf), rows)
    return rounded(baselines.predict_random(rows, checkpoint(valid), t.CUTOFF, t.SEED))


@query
def class_shares(spark, sf):
    return rounded(baselines.class_shares(t.target(spark, sf), baselines.is_train(t.CUTOFF)))


@query
def class_weights(spark, sf):
    return rounded(baselines.class_weights(t.target(spark, sf), baselines.is_train(t.CUTOFF)))


@query
def standardize(spark, sf):
    dense = checkpoint(t.dense_panel(spark, sf).select(*KEY, "total_events", "total_fatalities", "n_unique_dyads"))
    return rounded(baselines.standardize(dense, ["total_events", "total_fatalities", "n_unique_dyads"], baselines.is_train(t.CUTOFF)))


@query
def labelled_features(spark, sf):
    columns = ["total_events", "total_fatalities", "total_events_lag1"]
    return models.labelled_features(t.target(spark, sf), t.panel(spark, sf), columns)


@query
def training_weights(spark, sf):
    """Class weight inside the focal region, 0 outside."""
    rows = t.stored_target(spark, sf)
    focal = grid_ops.focal_cells(rows, grid_ops.grid_layout(t.feature_cells(spark, sf)), 1, fit=baselines.is_train(t.CUTOFF))
    weights = baselines.class_weights(rows, baselines.is_train(t.CUTOFF))
    return rounded(models.training_weights(rows.select(*KEY, "target"), weights, focal))


@query
def softmax_scores(spark, sf):
    """Class probabilities from raw scores, with the winner and its probability."""
    scores = [F.col("l_quantity") / 10, F.col("l_discount") * 100, F.col("l_tax") * 50]
    shares = values.softmax(scores)
    return rounded(t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[p.alias(f"prob_{c}") for p, c in zip(shares, CLASSES)],
        values.top_class(scores, CLASSES).alias("pred_class"), F.greatest(*shares).alias("confidence")))


# --- evaluation ---------------------------------------------------------------------------


@query
def confusion(spark, sf):
    return rounded(ev.confusion_matrix(ev.validation_rows(t.predictions(spark, sf)), ["model"]))


@query
def class_report(spark, sf):
    return rounded(ev.classification_report(ev.validation_rows(t.predictions(spark, sf)), ["model"]))


@query
def misclassified(spark, sf):
    return ev.misclassifications(ev.validation_rows(t.predictions(spark, sf)), ["model"])


@query
def accuracy_lift(spark, sf):
    return rounded(ev.accuracy_lift(ev.validation_rows(t.predictions(spark, sf)), ["model"]))


@query
def accuracy_by_class(spark, sf):
    return rounded(ev.accuracy_by_class(ev.validation_rows(t.predictions(spark, sf)), ["model"]))


def _soft(spark, sf):
    return t.soft_predictions(t.stored_target(spark, sf))


@query
def transition_keys(spark, sf):
    return ev.transition_keys(_soft(spark, sf))


@query
def transition_eval(spark, sf):
    return rounded(ev.transition_accuracy(t.predictions(spark, sf), ["model"]))


@query
def direction_table(spark, sf):
    return rounded(ev.direction_table(t.predictions(spark, sf), ["model"]))


@query
def transition_types(spark, sf):
    return summaries.frequency(ev.transition_types(_soft(spark, sf)), "transition_type")


@query
def common_transition(spark, sf):
    """Most common transition of each cell, on all cells."""
    rows = t.stored_target(spark, sf)
    top = dedup.most_common(ev.transition_types(t.soft_predictions(rows)), [CELL], "transition_type")
    return ev.attach_to_cells(rows, top)


@query
def model_comparison(spark, sf):
    return ev.model_comparison(t.predictions(spark, sf))


@query
def monthly_f1(spark, sf):
    stored = checkpoint(t.predictions(spark, sf))
    moved = ev.transition_keys(stored.filter("model = 'soft'"))
    every = ev.monthly_macro_f1(stored).withColumn("subset", F.lit("overall"))
    return rounded(every.unionByName(ev.monthly_macro_f1(stored, moved).withColumn("subset", F.lit("transition"))))


@query
def stable_summary(spark, sf):
    stored = checkpoint(t.predictions(spark, sf))
    return ev.stable_transition_summary(stored, ev.transition_keys(stored.filter("model = 'soft'")))


@query
def cell_recall(spark, sf):
    stored = checkpoint(t.predictions(spark, sf))
    return rounded(ev.cell_recall(stored, ev.transition_keys(stored.filter("model = 'soft'"))))


@query
def key_alignment(spark, sf):
    rows = t.stored_target(spark, sf)
    months = rows.filter(F.col(PERIOD) <= "2001-06")
    cells = rows.filter(F.col(CELL) % 7 != 0).unionByName(rows.filter(F.col(PERIOD) == "2000-01").withColumn(PERIOD, F.lit("1900-01")))
    return keys.key_differences(rows, {"months": months, "cells": cells, "same": rows})


@query
def prediction_status(spark, sf):
    rows = t.stored_target(spark, sf)
    month = ev.validation_rows(t.soft_predictions(rows)).join(
        summaries.middle_period(rows.filter(F.col(PERIOD) > t.CUTOFF)), PERIOD, "left_semi")
    return ev.prediction_status(t.feature_cells(spark, sf), month)


@query
def sample_sizes(spark, sf):
    return ev.sample_sizes(_soft(spark, sf))


@query
def headline(spark, sf):
    return ev.headline_table(t.predictions(spark, sf))


@query
def pivot_models(spark, sf):
    monthly = ev.monthly_macro_f1(t.predictions(spark, sf))
    return rounded(summaries.pivot_models(monthly, PERIOD, "model", "macro_f1", ["no_change", "random_proportion", "soft"]))


# --- curves -------------------------------------------------------------------------------


def _validation(spark, sf):
    return checkpoint(ev.validation_rows(t.predictions(spark, sf)))


@query
def ranking_areas(spark, sf):
    return rounded(curves.ranking_areas(_validation(spark, sf), ["model"]))


@query
def macro_areas(spark, sf):
    areas = curves.ranking_areas(_validation(spark, sf), ["model"])
    return rounded(curves.macro_areas(areas, ["model"]))


@query
def chance_reference(spark, sf):
    return rounded(curves.chance_reference(_validation(spark, sf), ["model"]))


@query
def roc_points(spark, sf):
    return rounded(curves.roc_points(_validation(spark, sf), ["model"]))


@query
def pr_points(spark, sf):
    return rounded(curves.pr_points(_validation(spark, sf), ["model"]))


@query
def macro_roc(spark, sf):
    return rounded(curves.macro_curve(curves.roc_on_grid(_validation(spark, sf), ["model"]), "tpr", ["model"]))


@query
def macro_pr(spark, sf):
    return rounded(curves.macro_curve(curves.pr_on_grid(_validation(spark, sf), ["model"]), "precision", ["model"]))


@query
def macro_roc_area(spark, sf):
    macro = curves.macro_curve(curves.roc_on_grid(_validation(spark, sf), ["model"]), "tpr", ["model"])
    return rounded(curves.area_under(macro, "step", "tpr", ["model"]))


@query
def bootstrap_ci(spark, sf):
    """Paired intervals of all three models on the transition rows."""
    rows = checkpoint(t.predictions(spark, sf))
    moved = ev.validation_rows(rows, ev.transition_keys(rows.filter("model = 'soft'")))
    intervals = bootstrap.bootstrap_intervals(bootstrap.replicate_metrics(moved, 1000, t.SEED, by=["model"]), by=["model"])
    return rounded(intervals.withColumn("text", bootstrap.format_interval(F.col("value"), F.col("lower"), F.col("upper"))))


# --- folds and models ---------------------------------------------------------------------


@query
def block_stats(spark, sf):
    return rounded(folds.block_stats(t.blocks(t.events(spark, sf))))


@query
def fold_pairs(spark, sf):
    return rounded(folds.pair_blocks(t.blocks(t.events(spark, sf))))


@query
def fold_roles(spark, sf):
    return folds.fold_roles(folds.assign_folds(t.blocks(t.events(spark, sf))))


@query
def holdout_sizes(spark, sf):
    roles = folds.fold_roles(folds.assign_folds(t.blocks(t.events(spark, sf))))
    leaks = folds.leaking_cells(roles).groupBy("fold").agg(F.count("*").alias("n_leaks"))
    return folds.holdout_sizes(roles).join(leaks, "fold", "left").fillna(0)


@query
def class_coverage(spark, sf):
    rows = t.stored_target(spark, sf)
    return folds.class_coverage(rows, folds.assign_folds(t.blocks(rows)))


@query
def changed_assignments(spark, sf):
    current = folds.assign_folds(t.blocks(t.events(spark, sf)))
    saved = current.withColumn("fold", F.when(F.col(CELL) % 13 == 0, (F.col("fold") + 1) % 5).otherwise(F.col("fold")))
    return folds.changed_assignments(current, saved)


@query
def fold_class_weights(spark, sf):
    rows = t.stored_target(spark, sf)
    roles = folds.fold_roles(folds.assign_folds(t.blocks(rows)))
    return rounded(folds.fold_class_weights(rows, roles, baselines.is_train(t.CUTOFF)))


def _fold_metrics(spark, sf):
    rows = t.stored_target(spark, sf)
    scored = ev.validation_rows(t.soft_predictions(rows))
    roles = folds.fold_roles(folds.assign_folds(t.blocks(rows)))
    return checkpoint(scored.join(roles, CELL)), ["fold", "role"]


@query
def fold_metrics(spark, sf):
    scored, by = _fold_metrics(spark, sf)
    f1 = ev.f1_summary(scored, by, digits=None)
    auc = curves.macro_areas(curves.ranking_areas(scored, by), by).select(*by, "macro_auc")
    return rounded(ev.fold_differences(f1.join(auc, by), ["macro_f1", "macro_auc"]), 4)


@query
def fold_summary(spark, sf):
    scored, by = _fold_metrics(spark, sf)
    sides = checkpoint(ev.fold_differences(ev.f1_summary(scored, by, digits=None), ["accuracy", "macro_f1"]))
    table = ev.fold_summary(sides, ["h_macro_f1", "nh_macro_f1", "delta_macro_f1"])
    extreme = F.struct("best", "worst")
    table = table.withColumn("_x", ev.best_and_worst(sides, "fold", "h_macro_f1").select(extreme.alias("x")).scalar())
    return rounded(table.select(
        "metric", "mean", "std", F.size("missing_folds").cast("long").alias("n_missing"),
        F.col("_x.best").alias("best_fold"), F.col("_x.worst").alias("worst_fold")))


FEATURES = ["total_events", "total_fatalities", "events_gov", "gov_event_share", "total_events_lag1", "total_fatalities_lag1"]


def _model_rows(spark, sf):
    target = t.stored_target(spark, sf)
    features = grid_ops.neighbour_features(t.panel(spark, sf).select(*KEY, *FEATURES), ["total_events"])
    columns = [*FEATURES, "total_events_nbr_mean"]
    return checkpoint(models.labelled_features(target, features, columns)), columns


def _fitted(rows, columns, algorithm="logistic"):
    data = checkpoint(baselines.standardize(rows, columns, baselines.is_train(t.CUTOFF)))
    weights = baselines.class_weights(rows, baselines.is_train(t.CUTOFF))
    focal = grid_ops.focal_cells(rows, grid_ops.grid_layout(rows), fit=baselines.is_train(t.CUTOFF))
    train = models.fit_weights(data.filter(baselines.is_train(t.CUTOFF)), weights, focal)
    return data, models.train_classifier(train, columns, algorithm)


@query
def geo_blocks(spark, sf):
    return folds.geo_blocks(t.feature_cells(spark, sf), k=10, restarts=20)


@query
def geo_block_cover(spark, sf):
    """Every cell in exactly one of the ten blocks."""
    blocks = folds.geo_blocks(t.feature_cells(spark, sf), k=10, restarts=20)
    return blocks.agg(
        F.count("*").alias("n_rows"), F.count_distinct(CELL).alias("n_cells"), F.count_distinct("block").alias("n_blocks"))


@query
def geo_block_optimum(spark, sf):
    """Cells that lie nearer to another block's mean than to their own: none, once no centre moves any more."""
    return folds.block_faults(checkpoint(folds.geo_blocks(t.feature_cells(spark, sf), k=10, restarts=20)))


@query
def classifier_contract(spark, sf):
    """Scored rows by part, and rows that break a rule of the prediction contract."""
    rows, columns = _model_rows(spark, sf)
    data, model = _fitted(rows, columns)
    shares = [F.col(f"prob_{c}") for c in CLASSES]
    scored = models.score(model, data, t.CUTOFF)
    return scored.groupBy("is_train_month", "true_class").agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(shares[0] + shares[1] + shares[2] - 1) > 1e-9).alias("bad_sums"),
        F.count_if(F.col("confidence") != F.greatest(*shares)).alias("bad_confidence"),
        F.count_if(F.col("pred_class") != values.top_class(shares, CLASSES)).alias("bad_class"))


@query
def spatial_cv_rows(spark, sf):
    """Validation rows that each fold scores, by role and true class."""
    rows, columns = _model_rows(spark, sf)
    roles = checkpoint(folds.fold_roles(folds.assign_folds(t.blocks(rows))))
    scored = models.spatial_validation(rows, columns, roles, t.CUTOFF)
    return scored.groupBy("fold", "role", "true_class").agg(F.count("*").alias("n"), F.count_distinct(CELL).alias("n_cells"))


@query
def classifier_scores(spark, sf):
    rows, columns = _model_rows(spark, sf)
    data, model = _fitted(rows, columns)
    return models.score(model, data, t.CUTOFF)


@query
def forest_scores(spark, sf):
    rows, columns = _model_rows(spark, sf)
    data, model = _fitted(rows, columns, "forest")
    return models.score(model, data, t.CUTOFF)


@query
def spatial_cv(spark, sf):
    rows, columns = _model_rows(spark, sf)
    roles = checkpoint(folds.fold_roles(folds.assign_folds(t.blocks(rows))))
    return models.spatial_scores(models.spatial_validation(rows, columns, roles, t.CUTOFF))


@query
def feature_ablation(spark, sf):
    rows, columns = _model_rows(spark, sf)
    weights = baselines.class_weights(rows, baselines.is_train(t.CUTOFF))
    return models.ablation(rows, {"f2": columns[:2], "f4": columns[:4], "f7": columns}, t.CUTOFF, weights)


@query
def permutation_importance(spark, sf):
    rows, columns = _model_rows(spark, sf)
    data, model = _fitted(rows, columns)
    return models.permutation_importance(model, data, columns, t.CUTOFF, t.SEED)


@query
def permuted_column(spark, sf):
    rows = t.stored_target(spark, sf).select(*KEY, "target", "n_gov")
    numbered = checkpoint(running.number_rows(rows, [F.col(k) for k in KEY]))
    shuffled = models.permuted_values(numbered, ["n_gov"], t.SEED, numbered.count())
    return numbered.drop("n_gov").join(shuffled, "row_index").select(
        "row_index", *KEY, "target", F.col("shuffled")[0].cast("long").alias("n_gov"))


@query
def fold_moments(spark, sf):
    """Mean and deviation of two columns over each fold's training rows, without its holdout cells."""
    rows = t.stored_target(spark, sf)
    roles = checkpoint(folds.fold_roles(folds.assign_folds(t.blocks(rows))))
    moments = models.fold_moments(rows, ["n_gov", "n_opo"], roles, baselines.is_train(t.CUTOFF))
    return rounded(moments.select("fold", "n", F.inline(F.arrays_zip(
        F.array(F.lit("n_gov"), F.lit("n_opo")).alias("feature"), F.col("means").alias("mean"), F.col("deviations").alias("deviation")))).toDF(
        "fold", "n", "feature", "mean", "deviation"))


# --- summaries ----------------------------------------------------------------------------


@query
def source_frequency(spark, sf):
    return summaries.frequency(t.events(spark, sf), "data_source", "type_of_violence")


@query
def intensity_bins(spark, sf):
    return summaries.intensity_bins(t.dense_panel(spark, sf), "total_events")


@query
def top_cells(spark, sf):
    return summaries.top_groups(t.dense_panel(spark, sf), CELL, "total_events", "adm_1")


@query
def top_dyads(spark, sf):
    return summaries.top_values(t.events(spark, sf), "dyad_name")


@query
def describe_columns(spark, sf):
    static = panel_plans.static_covariates(t.static_table(spark, sf), t.feature_cells(spark, sf))
    return summaries.describe_columns(static, ["ttime_mean", "forest_gc", "agri_gc"])


@query
def even_pick(spark, sf):
    return summaries.evenly_spaced_periods(t.active(spark, sf), 6)


@query
def middle_period(spark, sf):
    return summaries.middle_period(t.active(spark, sf))


@query
def cell_row_counts(spark, sf):
    """Group sizes attached to all cells that carry a label, NULL where no event was."""
    sizes = t.events(spark, sf).groupBy(CELL).agg(F.count("*").alias("n"))
    return ev.attach_to_cells(label_plans.place_points(t.points(spark, sf)), sizes)


# --- written and read again -------------------------------------------------------------------

def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/celltide-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf):
    """Orders through a CSV file, with quotes and line breaks in a field."""
    note = F.concat(F.lit('a "quoted" note, '), F.lit("\n"), F.col("o_orderpriority"))
    path = _folder(spark)
    writers.write_csv(t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", note.alias("note")), path)
    return readers.read_csv_table(spark, path, StructType.fromDDL("note string, o_orderkey long, o_totalprice double"))


@query
def large_csv_round_trip(spark, sf):
    """The same rows by the reader that splits files."""
    note = F.concat(F.lit('a "quoted" note, '), F.lit("\n"), F.col("o_orderpriority"))
    path = _folder(spark)
    writers.write_csv(t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", note.alias("note")), path)
    return readers.read_large_csv(spark, path, StructType.fromDDL("note string, o_orderkey long, o_totalprice double"))


@query
def json_revision_log(spark, sf):
    path, orders = _folder(spark), t.table(spark, sf, "orders")
    comment = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))
    writers.write_revision_log(orders.select(
        F.col("o_orderkey").alias("revid"), F.col("o_orderstatus").alias("timestamp"), comment.alias("comment")), path)
    return spark.read.schema("revid long, timestamp string, comment string").json(path)


@query
def parquet_by_period(spark, sf):
    path = _folder(spark)
    writers.write_panel(t.cell_months(spark, sf).select(*KEY, "total_events"), path, by_period=True)
    # as the folder names alone are read, the months stay text
    return spark.read.schema(f"{CELL} long, total_events long, {PERIOD} string").parquet(path)


@query
def append_variants(spark, sf):
    path, orders = _folder(spark), t.table(spark, sf, "orders")
    for variant in ("f10", "f20"):
        summary = orders.groupBy("o_orderpriority").agg((F.count("*") + int(variant[1:])).alias("n"))
        writers.append_variant(summary, path, variant)
    return spark.read.parquet(path)


@query
def header_columns(spark, sf):
    """Column names of a CSV table by its header, with the number of its rows."""
    path = _folder(spark)
    writers.write_csv(t.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    names = F.posexplode(F.array(*[F.lit(c) for c in readers.available_columns(spark, path)])).alias("place", "name")
    stored = readers.read_csv_table(spark, path, StructType.fromDDL("o_orderkey long"))
    return stored.agg(F.count("*").alias("n_rows")).select(names, "n_rows").withColumn("place", F.col("place").cast("long"))


@query
def type_table(spark, sf):
    """Signals by what the literal table of actor types says of theirs."""
    signals = t.signal_events(spark, sf).select("inter1")
    return keys.left_enrich(signals, dimensions.fallback_table(spark), ["inter1"]).groupBy(
        "side", "coalition", "actor_group", "inter1").agg(F.count("*").alias("n"))


def _column_sums(spark, sf):
    """(feature, total) of every numeric column of the events that is no key or place."""
    events = t.events(spark, sf)
    names = summaries.numeric_features(events, ["id", CELL, "latitude", "longitude"])
    sums = events.agg(*[F.sum(c).cast("double").alias(c) for c in names])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("total")) for c in names])))


@query
def numeric_columns(spark, sf):
    return _column_sums(spark, sf)


@query
def ranked_columns(spark, sf):
    """The first three of a ranked list of columns, each with its place and sum."""
    sums = checkpoint(_column_sums(spark, sf).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "feature"))))  # a row per column
    first = readers.ranked_features(sums, 3)
    place = F.array_position(F.array(*[F.lit(c) for c in first]), F.col("feature"))
    return sums.select(place.alias("place"), "feature", "total").filter("place > 0")


@query
def stable_rows(spark, sf):
    """Target rows whose cell and month had no event."""
    return keys.exclude_keys(t.target(spark, sf), t.cell_months(spark, sf)).select(*KEY, "target")
