import datetime as dt

import pytest
from pyspark.sql import functions as F

from celltide import schemas
from celltide.operators import baselines, grid, models
from celltide.operators.actors import ActorRule
from celltide.plans.stages import Stages
from celltide.runtime import checkpoint
from celltide.sources.readers import Source
from tests.conftest import rows

MONTHS = [f"2024-{m:02d}" for m in range(1, 13)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    lines, n = ["id,date_start,date_end,type_of_violence,dyad_name,side_a,side_b,latitude,longitude,priogrid_gid,country,adm_1,best,deaths_a,deaths_b,deaths_civilians,where_prec"], 0
    for k, month in enumerate(MONTHS):
        for lat, gid in ((19.5, 158235), (21.5, 161111)):
            n += 1
            lines.append(f"{n},{month}-05,{month}-05,{1 + n % 3},d{n % 4},Gov,Reb,{lat},{97.0 if gid == 158235 else 95.0},{gid},Home,A,{n % 5},0,0,0,{1 + n % 5}")
    lines.append("99,2024-01-01,2024-01-01,1,d,Gov,Reb,1,1,1,Away,A,1,0,0,0,1")
    (folder / "annual.csv").write_text("\n".join(lines) + "\n")
    (folder / "candidate.csv").write_text(lines[0] + "\n" + lines[1].replace("Home,A", "Home,B") + "\n")

    def content(k):
        colour = "red" if k < 8 else "limegreen"
        return ('{ lat = "19.6", long = "97.1", mark = "Location dot %s.svg" }, { lat = "21.6", long = "95.1", mark = "Location dot yellow.svg" }' % colour)
    revisions = spark.createDataFrame([(k, f"{m}-20T00:00:00Z", None, content(k)) for k, m in enumerate(MONTHS)], schemas.REVISIONS)
    signals = spark.createDataFrame(
        [("s1", dt.date(2024, 3, 3), "Home", "Government regains territory", "some army", None, "A", 21.6, 95.2),
         ("s2", dt.date(2024, 10, 3), "Home", "Non-violent transfer of territory", "some army", None, "A", 19.6, 97.2)], schemas.SIGNALS)
    taxonomy = spark.createDataFrame([("Gov", "", "State", "State", "military_sac", "Government", "")], schemas.TAXONOMY)
    done = Stages(
        spark, str(folder / "out"), [Source(str(folder / "annual.csv"), "GED"), Source(str(folder / "candidate.csv"), "Candidate")],
        taxonomy, revisions, signals, [ActorRule(("army",), "Pro-junta", "State", "Army")], keep=F.col("country") == "Home",
        labels_since="2024-01", cutoff="2024-06")
    done.run()
    return done


def test_stages(stages):
    assert stages.read("events").count() == 24
    assert stages.read("events").filter("data_source = 'Candidate'").count() == 0
    assert rows(stages.unmatched_actors()) == [("side_b", "Reb")]
    features = stages.read("features")
    assert features.count() == 24 and features.agg(F.min("gov_event_share")).first()[0] == 1.0
    target = {(r[0], r[1]): (r[2], r[3]) for r in stages.read("target").select("priogrid_gid", "year_month", "target", "reason").collect()}
    assert len(target) == 24
    assert target[161111, "2024-03"] == ("gov", "wiki_contested_use_acled") and target[161111, "2024-04"] == ("uncertain", "wiki_only")
    assert target[158235, "2024-08"] == ("gov", "wiki_only") and target[158235, "2024-09"] == ("opo", "wiki_only")
    assert target[158235, "2024-10"] == ("gov", "disagree_stable_wiki_use_acled")


def test_comparison(stages):
    line = {r["model"]: r for r in stages.read("comparison").collect()}
    assert set(line) == {"no_change", "random_proportion"}
    assert line["no_change"]["n_val"] == 12
    assert (line["no_change"]["trans_acc"], line["no_change"]["stable_acc"]) == (0.0, 1.0)
    assert line["no_change"]["n_trans"] == 3  # into opo, into gov by a signal, and back


def test_added_predictions_must_cover_the_same_keys(stages):
    base = stages.read("predictions").filter("model = 'no_change'").select(*schemas.PREDICTION_COLUMNS)
    with pytest.raises(ValueError, match="mismatch"):
        stages.add_predictions("partial", base.limit(5))
    stages.add_predictions("copy", base)
    assert stages.evaluate().count() == 3


FEATURES = ["total_events", "total_fatalities", "total_events_lag1"]


def test_model_stages_equal_their_operators(stages, spark):
    stages.feature_columns = FEATURES
    scored = stages.classifier()
    data, fit = checkpoint(stages.read("model_rows")), baselines.is_train("2024-06")
    assert data.columns == [*schemas.KEY, "target", *FEATURES] and data.count() == 24
    scaled = baselines.standardize(data, FEATURES, fit)
    focal = grid.focal_cells(data, grid.grid_layout(data), fit=fit)
    fitted = models.train_classifier(models.training_weights(scaled.filter(fit), baselines.class_weights(data, fit), focal), FEATURES)
    rounded = lambda df: rows(df.select(*schemas.KEY, "pred_class", F.round("prob_gov", 6)))
    assert rounded(scored) == rounded(models.score(fitted, scaled, "2024-06"))
    assert {r["model"] for r in stages.evaluate().collect()} >= {"no_change", "random_proportion", "classifier"}

    scores = {r["fold"]: r for r in stages.spatial_cv(n_blocks=2, n_folds=2).collect()}
    assert set(scores) == {0, 1}
    roles = stages.read("fold_roles")
    direct = models.spatial_scores(models.spatial_validation(data, FEATURES, roles, "2024-06", 2, focal))
    assert rows(direct) == rows(stages.read("fold_scores"))

    table = stages.ablation({"one": FEATURES[:1], "all": FEATURES})
    assert rows(table, "variant", "subset", "n_features") == [("all", "overall", 3), ("all", "transition", 3), ("one", "overall", 1), ("one", "transition", 1)]
    stages.ablation({"one": FEATURES[:2]})
    assert rows(stages.read("ablation"), "variant", "n_features") == [("all", 3), ("all", 3), ("one", 2), ("one", 2)]


def test_report_covers_all_models(stages):
    intervals = stages.report(20)
    names = {r["model"] for r in stages.predictions().select("model").distinct().collect()}
    assert {r["model"] for r in intervals.collect()} == names and intervals.count() == len(names) * 4 * 3
    line = intervals.filter("model = 'no_change' AND class = 'macro' AND measure = 'f1'").first()
    assert line["lower"] <= line["upper"] and line["text"].startswith(f"{line['value']:.3f} [")
    assert rows(stages.read("headline"), "model") == [(n,) for n in sorted(names)]
