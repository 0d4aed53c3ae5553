import os
from types import SimpleNamespace

import pytest

from celltide.runtime import checkpoint, checkpoint_folder, drop_tables
from tests.conftest import rows


def session(master, named=None, current=None):
    conf = SimpleNamespace(get=lambda key, default: named if key == "spark.checkpoint.dir" and named else default)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current, setCheckpointDir=lambda folder: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_folder_named_by_the_cluster_wins():
    assert checkpoint_folder(session("spark://host:7077", "/shared/cp")) == "/shared/cp"
    assert checkpoint_folder(session("yarn", None, "/shared/set")) == "/shared/set"


def test_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(session("yarn"))


def test_stored_table_is_cut_and_pruned(spark):
    df = spark.range(10).selectExpr("id AS a", "id * 2 AS b", "cast(id AS string) AS c")
    stored = checkpoint(df)
    assert stored.schema.names == df.schema.names and rows(stored) == rows(df)
    plan = stored.filter("a > 3").select("a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "c#" not in plan.split("ReadSchema")[1] and "GreaterThan(a,3)" in plan


def test_drop_tables(spark):
    path = checkpoint(spark.range(3)).inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(path)
    drop_tables(spark)
    assert not os.path.exists(path)


def test_superseded_tables_can_go_one_by_one(spark):
    from celltide.runtime import checkpoint, drop_table

    first = checkpoint(spark.range(5))
    second = checkpoint(first.selectExpr("id + 1 AS id"))
    drop_table(first, spark.range(1))
    assert second.count() == 5 and not os.path.exists(first._stored_at) and os.path.exists(second._stored_at)
