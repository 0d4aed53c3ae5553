"""The whole chain from raw files to evaluated predictions.

Every stage writes its result as parquet and the next one reads it, so a stage can be rerun alone
and a lost executor never costs more than the stage at hand. Stored tables from the panel on are
bounded by cells times months.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from celltide import fixed_values as fixed, schemas
from celltide.operators import baselines, bootstrap, evaluation, folds, models as model_ops
from celltide.operators.actors import ActorRule
from celltide.operators.grid import focal_cells, grid_layout, valid_cells
from celltide.operators.keys import require_aligned, unmatched_keys
from celltide.operators.panel import observed_periods
from celltide.operators.summaries import numeric_features
from celltide.plans import events as event_plans, labels as label_plans, panel as panel_plans, target as target_plans
from celltide.sources.readers import Source
from celltide.sources.writers import write_panel


BASELINES = ("no_change", "random_proportion")


@dataclass
class Stages:
    """Inputs and settings; each method is one stage and returns the stored table."""

    spark: SparkSession
    output: str
    sources: Sequence[Source]
    taxonomy: DataFrame
    revisions: DataFrame
    signals: DataFrame
    rules: Sequence[ActorRule]
    keep: Column | None = None
    keep_signals: Column | None = None
    static: DataFrame | None = None
    yearly: DataFrame | None = None
    actors: Mapping[str, str] = field(default_factory=lambda: fixed.TRACKED_ACTORS)
    events_since: str = fixed.EVENTS_SINCE
    labels_since: str = fixed.LABELS_SINCE
    cutoff: str = fixed.TRAIN_CUTOFF
    seed: int = 42
    feature_columns: Sequence[str] | None = None
    models: set[str] = field(default_factory=set)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.output}/{name}")

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        write_panel(df, f"{self.output}/{name}")
        return self.read(name)

    def events(self) -> DataFrame:
        merged = event_plans.merge_sources(self.spark, self.sources, self.keep)
        return self._store(event_plans.label_events(merged, self.taxonomy, self.events_since), "events")

    def unmatched_actors(self) -> DataFrame:
        return unmatched_keys(self.read("events"), self.taxonomy, "ucdp_name", ["side_a", "side_b"])

    def features(self) -> DataFrame:
        panel = self._store(panel_plans.build_panel(self.read("events"), self.actors), "panel")
        static = None if self.static is None else panel_plans.static_covariates(self.static, panel)
        yearly = None if self.yearly is None else panel_plans.yearly_covariates(self.yearly, panel)
        return self._store(panel_plans.build_feature_store(panel, static, yearly), "features")

    def labels(self) -> DataFrame:
        points = self._store(label_plans.parse_snapshots(self.revisions), "points")
        months = observed_periods(self.read("panel"), self.labels_since)
        return self._store(label_plans.labels_to_panel(points, months), "labels")

    def target(self) -> DataFrame:
        signals = self._store(target_plans.signals_to_panel(self.signals, self.rules, since=self.events_since, keep=self.keep_signals), "signals")
        stored = self._store(target_plans.build_target(self.read("labels"), signals), "target")
        target_plans.require_sound(stored)
        return stored

    def baselines(self) -> DataFrame:
        target = self.read("target")
        valid = self._store(valid_cells(self.read("features"), target), "valid_cells")
        models = {
            "no_change": baselines.predict_no_change(target, valid, self.cutoff),
            "random_proportion": baselines.predict_random(target, valid, self.cutoff, self.seed),
        }
        for name, df in models.items():
            write_panel(df.withColumn("model", F.lit(name)), f"{self.output}/predictions/run={name}")
        return self.predictions()

    def predictions(self) -> DataFrame:
        """The declared runs: the baselines and what ``add_predictions`` was given, whatever else lies in the folder."""
        return self.read("predictions").filter(F.col("run").isin(*BASELINES, *self.models)).drop("run")

    def add_predictions(self, name: str, predictions: DataFrame) -> None:
        """Store a model's predictions beside the baselines, after checking that the keys agree."""
        if name in BASELINES:
            raise ValueError(f"{name} is a baseline's name")
        require_aligned(self.read("predictions/run=no_change"), {name: predictions})
        self.models.add(name)
        write_panel(predictions.withColumn("model", F.lit(name)), f"{self.output}/predictions/run={name}")

    def model_rows(self) -> tuple[DataFrame, list[str]]:
        """Labelled rows of the valid cells with their features, and the features' names: those given, or all numeric ones."""
        features = self.read("features")
        columns = list(self.feature_columns or numeric_features(features, schemas.PANEL_METADATA))
        valid = self.read("target").join(self.read("valid_cells"), schemas.CELL, "left_semi")
        return self._store(model_ops.labelled_features(valid, features, columns), "model_rows"), columns

    def _focal(self, rows: DataFrame) -> DataFrame:
        return self._store(focal_cells(rows, grid_layout(rows), fit=baselines.is_train(self.cutoff)), "focal_cells")

    def classifier(self, algorithm: str = "logistic", name: str = "classifier") -> DataFrame:
        """Train on the focal cells' training months, score all rows and put the predictions beside the baselines."""
        rows, columns = self.model_rows()
        fit = baselines.is_train(self.cutoff)
        data = self._store(baselines.standardize(rows, columns, fit), "scaled_rows")
        train = model_ops.fit_weights(data.filter(fit), baselines.class_weights(rows, fit), self._focal(rows))
        fitted = model_ops.train_classifier(train, columns, algorithm, self.seed)
        self.add_predictions(name, model_ops.score(fitted, data, self.cutoff))
        return self.predictions().filter(F.col("model") == name)

    def spatial_cv(self, n_blocks: int = 10, n_folds: int = 5, algorithm: str = "logistic") -> DataFrame:
        """Scores of holdout and training cells by fold, with the folds' blocks, roles and predictions stored as well."""
        rows, columns = self.model_rows()
        blocks = self._store(folds.geo_blocks(rows.select(schemas.CELL), n_blocks, self.seed), "blocks")
        roles = self._store(folds.fold_roles(folds.assign_folds(blocks, n_folds), n_folds), "fold_roles")
        if not folds.leaking_cells(roles).isEmpty():
            raise ValueError("cells are both held out and trained on in one fold")
        scored = model_ops.spatial_validation(rows, columns, roles, self.cutoff, n_folds, self._focal(rows), algorithm)
        return self._store(model_ops.spatial_scores(self._store(scored, "fold_predictions")), "fold_scores")

    def ablation(self, variants: Mapping[str, Sequence[str]], algorithm: str = "logistic") -> DataFrame:
        """Metrics per feature list, each stored as soon as it is there; a rerun replaces its own variants only."""
        rows, _ = self.model_rows()
        keep = lambda name, line: write_panel(line.drop("variant"), f"{self.output}/ablation/variant={name}")
        weights = baselines.class_weights(rows, baselines.is_train(self.cutoff))
        model_ops.ablation(rows, variants, self.cutoff, weights, self._focal(rows), keep, algorithm)
        return self.read("ablation")

    def report(self, n_boot: int = 1000) -> DataFrame:
        """Paired bootstrap intervals of all models on the transition rows, beside the stored headline table."""
        predictions = self.predictions()
        self._store(evaluation.headline_table(predictions), "headline")
        moved = evaluation.transition_keys(predictions.filter(F.col("model") == BASELINES[0]))
        metrics = bootstrap.replicate_metrics(evaluation.validation_rows(predictions, moved), n_boot, self.seed, by=["model"])
        intervals = bootstrap.bootstrap_intervals(metrics, by=["model"])
        text = bootstrap.format_interval(F.col("value"), F.col("lower"), F.col("upper"))
        return self._store(intervals.withColumn("text", text), "intervals")

    def evaluate(self) -> DataFrame:
        return self._store(evaluation.model_comparison(self.predictions()), "comparison")

    def run(self) -> DataFrame:
        for stage in (self.events, self.features, self.labels, self.target, self.baselines):
            stage()
        return self.evaluate()
