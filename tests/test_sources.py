import json

import pytest
from pyspark.sql import functions as F, types as T

from celltide import schemas
from celltide.operators import actors, dedup, keys
from celltide.plans import events as plans
from celltide.sources import dimensions, readers, writers
from tests.conftest import rows


@pytest.fixture
def csv_files(tmp_path):
    a = tmp_path / "a.csv"
    a.write_text("id,date_start,side_a,side_b,best,country,where_prec,extra\n"
                 "1,2021-02-03,Gov,Reb,5,Home,1,x\n2,soon,Gov,Reb,NA,Home,nan,x\n3,2021-03-01,Gov,Oth,1,Away,2,x\n")
    b = tmp_path / "b.csv"
    b.write_text("country,id,best,date_start,side_a,side_b,adm_1\nHome,1,7,2021-02-04,Gov,Reb,North\nHome,4,2,2021-04-01,,Reb,\n")
    return str(a), str(b)


def test_header_probe(spark, csv_files):
    assert readers.available_columns(spark, csv_files[1])[:3] == ["country", "id", "best"]


def test_csv_is_aligned_and_null_spellings_apply(spark, csv_files):
    df = readers.read_csv_table(spark, csv_files[0], schemas.EVENTS)
    assert df.schema == schemas.EVENTS
    got = rows(df, "id", "best", "where_prec", "adm_1")
    assert got == [(1, 5.0, 1, None), (2, None, None, None), (3, 1.0, 2, None)]


def test_union_filters_and_labels(spark, csv_files):
    sources = [readers.Source(csv_files[0], "A"), readers.Source(csv_files[1], "B")]
    df = readers.union_sources(spark, sources, keep=F.col("country") == "Home")
    assert rows(df, "id", "data_source", "adm_1") == [(1, "A", None), (1, "B", "North"), (2, "A", None), (4, "B", None)]


def test_missing_source_is_an_error(spark, csv_files):
    lost = [readers.Source("/nowhere/x.csv", "B"), readers.Source("/nowhere/y.parquet", "C")]
    with pytest.raises(FileNotFoundError, match="x.csv.*y.parquet"):
        readers.union_sources(spark, [readers.Source(csv_files[0], "A"), *lost])


def test_merge_keeps_label_that_sorts_last(spark, csv_files):
    sources = [readers.Source(csv_files[0], "GED"), readers.Source(csv_files[1], "Candidate")]
    df = plans.merge_sources(spark, sources, F.col("country") == "Home")
    assert rows(df, "id", "data_source", "best") == [(1, "GED", 5.0), (2, "GED", None), (4, "Candidate", 2.0)]
    again = dedup.dedup_by_priority(df, "id", [F.desc("data_source")])
    assert rows(again) == rows(df)


def test_dedup_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    best = dedup.dedup_by_priority(df, "k", [F.desc("v")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(best) == [(0, 998), (1, 999)]
    assert tuple(dedup.duplicate_report(df, "k").first()) == (1000, 2, 998)


def test_latest_snapshot_and_latest_csv(spark, tmp_path):
    for day, value in (("2024-01-31", 1), ("2024-02-01", 2)):
        (tmp_path / f"signals_{day}.csv").write_text(f"event_id_cnty,latitude\n{value},1.5\n")
    (tmp_path / "notes.csv").write_text("event_id_cnty\n9\n")
    assert rows(readers.read_latest_csv(spark, str(tmp_path), schemas.SIGNALS), "event_id_cnty") == [("2",)]
    named = spark.createDataFrame([("a_2024-01-01.csv", 1), ("a_2024-03-01.csv", 2), ("none", 3)], "f string, v int")
    assert rows(readers.latest_snapshot(named, F.col("f"))) == [("a_2024-03-01.csv", 2)]


def test_key_aliases(spark):
    assert readers.normalize_key(spark.range(1).toDF("gid")).columns == ["priogrid_gid"]
    with pytest.raises(ValueError):
        readers.normalize_key(spark.range(1).toDF("cell"))


def test_ranked_features(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "feature string, rank int")
    assert readers.ranked_features(df, 2) == ["a", "b"]
    with pytest.raises(ValueError, match="feature"):
        readers.ranked_features(df.drop("feature"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2021-01", 'say "hi", you')], "priogrid_gid long, year_month string, note string")
    writers.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert rows(back) == [("1", "2021-01", 'say "hi", you')]
    writers.write_panel(df, str(tmp_path / "p"), by_period=True)
    assert rows(spark.read.parquet(str(tmp_path / "p")), "priogrid_gid", "note") == [(1, 'say "hi", you')]
    for name in ("f10", "f20"):
        writers.append_variant(df, str(tmp_path / "v"), name)
    assert rows(spark.read.parquet(str(tmp_path / "v")), "variant") == [("f10",), ("f20",)]
    revisions = spark.createDataFrame([(5, "t", None, "long text")], schemas.REVISIONS)
    writers.write_revision_log(revisions, str(tmp_path / "j"))
    line = "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert json.loads(line) == {"revid": 5, "timestamp": "t", "comment": ""}


def test_taxonomy_join_and_unmatched(spark):
    events = spark.createDataFrame([(1, "Gov", "Reb"), (2, "Gov", "New"), (3, None, "Reb")], "id long, side_a string, side_b string")
    tax = spark.createDataFrame([("Gov", "State", "g"), ("Reb", "Rebel", "r")], "ucdp_name string, level1 string, level3 string")
    joined = keys.join_dimension(events, tax, "ucdp_name", {"level1": "level1", "level3": "level3"}, ["side_a", "side_b"])
    assert rows(joined, "id", "side_a_level3", "side_b_level1") == [(1, "g", "Rebel"), (2, "g", None), (3, None, "Rebel")]
    assert rows(keys.unmatched_keys(events, tax, "ucdp_name", ["side_a", "side_b"])) == [("side_b", "New")]


def test_dimension_join_leaves_the_strategy_to_spark(spark):
    dim = spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("v"))
    joined = keys.join_dimension(spark.range(9).select(F.col("id").alias("a")), dim, "k", {"v": "v"}, ["a"])
    assert "broadcast" not in joined._jdf.queryExecution().logical().toString().lower()


def test_quoted_line_breaks_stay_in_their_record(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,"two\nlines",3\n4,plain,5\n')
    schema = T.StructType.fromDDL("a int, b string, c int")
    assert rows(readers.read_csv_table(spark, str(path), schema)) == [(1, "two\nlines", 3), (4, "plain", 5)]


def test_all_files_of_the_newest_day(spark, tmp_path):
    for name, value in (("x_2024-01-01.csv", 1), ("a_2024-02-01.csv", 2), ("b_2024-02-01.csv", 3), ("undated.csv", 4)):
        (tmp_path / name).write_text(f"a\n{value}\n")
    assert rows(readers.read_latest_csv(spark, str(tmp_path), T.StructType.fromDDL("a int"))) == [(2,), (3,)]


def test_long_rule_lists_are_read_whole(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("rule_id,pattern,side,coalition,actor_group\n" + "".join(f"{i},p{i},gov,c,g\n" for i in range(10_050)))
    assert len(actors.read_actor_rules(spark, str(path))) == 10_050

def test_key_differences(spark):
    a = spark.createDataFrame([(1, "m"), (2, "m")], "priogrid_gid long, year_month string")
    b = spark.createDataFrame([(2, "m"), (3, "m"), (4, "m")], "priogrid_gid long, year_month string")
    assert rows(keys.key_differences(a, {"b": b, "a": a})) == [("a", 0, 0), ("b", 1, 2)]
    keys.require_aligned(a, {"a": a})
    with pytest.raises(ValueError, match="mismatch"):
        keys.require_aligned(a, {"b": b})


def test_restrict_exclude_and_optional_join(spark):
    a = spark.createDataFrame([(1, "m"), (2, "m")], "priogrid_gid long, year_month string")
    k = spark.createDataFrame([(2, "m")], "priogrid_gid long, year_month string")
    assert rows(keys.restrict_to_keys(a, k)) == [(2, "m")]
    assert rows(keys.exclude_keys(a, k)) == [(1, "m")]
    assert keys.left_enrich(a, None, ["priogrid_gid"]) is a
    extra = spark.createDataFrame([(1, 2.5)], "priogrid_gid long, z double")
    assert rows(keys.left_enrich(a, extra, ["priogrid_gid"]), "priogrid_gid", "z") == [(1, 2.5), (2, 0.0)]


def test_literal_tables(spark):
    assert dimensions.mark_table(spark).count() == 28
    assert dimensions.fallback_table(spark).filter("side = 'Pro-junta'").count() == 1


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_csv_files_are_split_inside_quotes(spark, tmp_path, end):
    import random
    rng = random.Random(6)
    lines = ["id,note,best"]
    for i in range(400):
        note = "".join(rng.choice(["a", ",", end, '""', " ", "é"]) for _ in range(rng.randint(0, 120)))
        lines.append(f'{i},"{note}",{rng.choice(["1.5", "", "NA"])}')
    lines.append('400,"' + f"long{end}" * 3000 + '",2')  # a record over several blocks
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes((end.join(lines) + end).encode())
    schema = T.StructType.fromDDL("best double, id long, note string, absent string")
    plain = rows(readers.read_csv_table(spark, str(tmp_path), schema))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20  # several tasks, cut inside quotes
        found = rows(readers.read_large_csv(spark, str(tmp_path), schema))
    finally:
        for key, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{key}", value)
    assert len(found) == 802
    strip = lambda table: [tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in r) for r in table]
    assert sorted(strip(found), key=repr) == sorted(strip(plain), key=repr)
