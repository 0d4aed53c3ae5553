import datetime as dt

import pytest
from pyspark.sql import functions as F

from celltide import schemas
from celltide.operators import actors, dedup, votes
from celltide.plans import labels as plans, target as target_plans
from tests.conftest import rows

RULES = [
    actors.ActorRule((r"\bpdf\b", r"people.s\s+def"), "Anti-junta", "NUG", "PDF"),
    actors.ActorRule((r"army",), "Pro-junta", "State", "Army"),
    actors.ActorRule((r"^tnla",), "Anti-junta", "Brotherhood", "TNLA"),
    actors.ActorRule((r"knplf",), "Anti-junta", "4K", "KNPLF"),
]


def vote(spark, *labels):
    df = spark.createDataFrame([(1, "m", s, c) for s, c in labels], "priogrid_gid long, year_month string, control_status string, confidence string")
    return tuple(votes.majority_vote(df).first())[2:]


def test_vote_confidence_steps(spark):
    g, r, c = ("government", "high"), ("resistance", "low"), ("contested", "high")
    assert vote(spark, g, g) == ("government", "high", 2, 2)
    assert vote(spark, g, g, g, r) == ("government", "high", 4, 3)
    assert vote(spark, r, r, g, g) == ("government", "medium", 4, 2)
    assert vote(spark, r, r, g, c, ("ethnic_armed_group", "x")) == ("resistance", "low", 5, 2)


def test_vote_is_independent_of_row_order(spark):
    data = [(k % 7, "m", ["government", "resistance", "contested"][(k * k) % 3], "high") for k in range(300)]
    schema = "priogrid_gid long, year_month string, control_status string, confidence string"
    a = rows(votes.majority_vote(spark.createDataFrame(data, schema)))
    assert a == rows(votes.majority_vote(spark.createDataFrame(data[::-1], schema).repartition(4)))


def test_label_panel(spark):
    points = spark.createDataFrame(
        [(dt.date(2024, 1, 5), 10.1, 95.1, "government", "high"), (dt.date(2024, 3, 1), 10.2, 95.2, "resistance", "low"),
         (dt.date(2024, 2, 1), 12.1, 95.1, "contested", "high"), (dt.date(2024, 1, 1), 12.1, 95.1, "unknown", "high")],
        "date date, lat double, lon double, control_status string, confidence string")
    months = F.array(*[F.lit(m) for m in ("2023-12", "2024-01", "2024-02", "2024-03", "2024-04")])
    got = rows(plans.labels_to_panel(points, months), "priogrid_gid", "year_month", "control_status", "is_direct_snapshot", "is_cell_snapshot")
    a, b = got[0][0], got[-1][0]
    assert got == [
        (a, "2024-01", "government", True, True), (a, "2024-02", "government", True, False),
        (a, "2024-03", "resistance", True, True), (a, "2024-04", "resistance", False, False),
        (b, "2024-02", "contested", True, True), (b, "2024-03", "contested", True, False), (b, "2024-04", "contested", False, False)]


def test_last_per_period_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 4), (4, "b", 1)], "id int, p string, ts int")
    assert rows(dedup.last_per_period(df, "ts", F.col("p"), "id"), "id") == [(2,), (4,)]


def test_most_common(spark):
    df = spark.createDataFrame([(1, "y"), (1, "x"), (1, "y"), (2, "b"), (2, "a")], "k int, c string")
    assert rows(dedup.most_common(df, ["k"], "c")) == [(1, "y", 2), (2, "a", 1)]


def test_parse_snapshots(spark):
    text = '''return {
      { lat = "19.5", long = "97.1", mark = "Location dot red.svg", label = "[[Town|Town label]]" },
      { lat = "20.5", long = "96.1", mark = " Location dot green.svg ", label_size = "0", label = "Plain" },
      { lat = "21", long = "95", mark = "WhiteDot.svg" }, { lat = "21", mark = "Location dot red.svg" },
      { lat = "n/a", long = "95", mark = "Location dot red.svg" }, { lat = "1", long = "2", mark = "Strange.svg" } }'''
    revisions = spark.createDataFrame([
        (1, "2024-01-05T00:00:00Z", None, "{ lat = \"1\", long = \"1\", mark = \"Location dot red.svg\" }"),
        (2, "2024-01-31T23:59:59Z", "c", text), (3, "bad", None, text)], schemas.REVISIONS)
    got = plans.parse_snapshots(revisions)
    assert got.columns == schemas.POINTS.fieldNames()
    assert rows(got.drop("source")) == [
        (dt.date(2024, 1, 31), 1.0, 2.0, "", "unknown", "UNMAPPED:Strange.svg", "low"),
        (dt.date(2024, 1, 31), 19.5, 97.1, "Town", "government", "Military Forces of Myanmar (SAC)", "high"),
        (dt.date(2024, 1, 31), 20.5, 96.1, "Plain", "resistance", "Arakan Army / NUG-aligned", "high")]


def signal(spark, *data):
    return spark.createDataFrame(
        [(str(i), d, "Home", "Government regains territory", a, k, adm, 10.1, 95.1) for i, (d, a, k, adm) in enumerate(data)], schemas.SIGNALS)


DAY = dt.date(2022, 6, 15)


def test_actor_rules_fallback_and_overrides(spark):
    df = signal(
        spark, (DAY, "PDF Army", "State forces", None), (DAY, "an ARMY", None, None), (DAY, None, "State forces", None),
        (DAY, "Nobody", "Rioters", None), (DAY, "Nobody", "Martians", None), (DAY, "KNPLF", None, None),
        (dt.date(2023, 1, 1), "KNPLF", None, None), (dt.date(2025, 12, 31), "TNLA", None, None), (dt.date(2026, 1, 1), "TNLA", None, None))
    got = [tuple(r) for r in actors.classify_actors(df, RULES).orderBy("event_id_cnty").select("side", "coalition", "actor_group").collect()]
    other = "Other / Unmapped"
    assert got == [
        ("Anti-junta", "NUG", "PDF"), ("Pro-junta", "State", "Army"), ("Pro-junta", "Tatmadaw and allies", "Tatmadaw"),
        (other, "Unmapped", "Protesters"), (other, "Unmapped", "Unmapped"), (other, "Unmapped", "KNPLF"),
        ("Anti-junta", "4K", "KNPLF"), ("Anti-junta", "Brotherhood", "TNLA"), (other, "Other combatant", "TNLA")]


def test_signals_to_panel(spark):
    df = signal(spark, (DAY, "pdf", None, None), (DAY, "army", None, "B"), (DAY, "army", None, "A"),
                (dt.date(2022, 7, 1), "zzz", "Rioters", None), (dt.date(2020, 7, 1), "army", None, None))
    df = df.unionByName(df.limit(1).withColumn("sub_event_type", F.lit("Battle")))
    got = rows(target_plans.signals_to_panel(df, RULES), "year_month", "n_gov", "n_opo", "n_unmapped", "total_ctrl_evs", "admin1", "acled_side")
    assert got == [("2022-06", 2, 1, 0, 3, "A", "mixed"), ("2022-07", 0, 0, 1, 1, None, "unmapped_only")]


def test_rules_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('rule_id,pattern,side,coalition,actor_group\n2,^b,S2,C2,G2\n1,"a{1,2}x",S1,C1,G1\n1,\\bz\\b,S1,C1,G1\n')
    got = actors.read_actor_rules(spark, str(tmp_path / "r.csv"))
    assert got == [actors.ActorRule(("a{1,2}x", r"\bz\b"), "S1", "C1", "G1"), actors.ActorRule(("^b",), "S2", "C2", "G2")]


# --- cascade ------------------------------------------------------------------------------


@pytest.mark.parametrize("boundary", ["changed", "stable"])
def test_target_cascade_truth_table(spark, boundary):
    status = {"gov": "government", "opo": "resistance", "contested": "contested"}
    labels, signals, expected = [], [], {}
    cell = 0
    for wiki in status:
        for side in ("none", "gov", "opo", "mixed", "unmapped_only"):
            for changed in (False, True):
                cell += 1
                neighbour = "ethnic_armed_group" if changed else status[wiki]
                labels += [(cell, f"2024-0{m}", s) for m, s in enumerate([neighbour, status[wiki], status[wiki]] if changed else [status[wiki]] * 3, 1)]
                if side != "none":
                    signals.append((cell, "2024-02", 1, 1, 0, 2, "adm", side))
                own = {"gov": "gov", "opo": "opo", "contested": "uncertain"}[wiki]
                if side in ("none", "unmapped_only"):
                    expected[cell] = (own, "wiki_only")
                elif side == "mixed":
                    expected[cell] = ("uncertain", "acled_mixed")
                elif wiki == "contested":
                    expected[cell] = (side, "wiki_contested_use_acled")
                elif side == wiki:
                    expected[cell] = (side, "agree")
                elif changed:
                    expected[cell] = (own, "disagree_recent_wiki_use_wiki")
                else:
                    expected[cell] = (side, "disagree_stable_wiki_use_acled")
    label_df = spark.createDataFrame(labels, "priogrid_gid long, year_month string, control_status string")
    signal_df = spark.createDataFrame(
        signals, "priogrid_gid long, year_month string, n_gov long, n_opo long, n_unmapped long, total_ctrl_evs long, admin1 string, acled_side string")
    target = target_plans.build_target(label_df, signal_df, boundary)
    assert target.columns == schemas.TARGET_COLUMNS
    got = {r["priogrid_gid"]: (r["target"], r["reason"]) for r in target.filter("year_month = '2024-02'").collect()}
    # a resistance label next to an ethnic armed group's is a changed status, though both sides are 'opo'
    assert got == expected
    assert all(r["n_bad"] == 0 for r in target_plans.check_target(target).collect())
    target_plans.require_sound(target)
    with pytest.raises(ValueError, match="target_domain"):
        target_plans.require_sound(target.withColumn("target", F.lit("other")))


def test_agreement_defaults(spark):
    df = spark.createDataFrame(
        [("gov", None), ("gov", "contested"), ("mixed", None), ("unmapped_only", "gov"), ("opo", "opo"), ("opo", "gov")], "s string, w string")
    got = [tuple(r) for r in df.select(*[target_plans.agreement(F.col("s"), F.col("w"), d) for d in ("no_info", "wiki_only")]).collect()]
    assert got == [("no_info", "wiki_only"), ("wiki_contested",) * 2, ("acled_mixed",) * 2, ("no_info", "wiki_only"), ("agree",) * 2, ("disagree",) * 2]
