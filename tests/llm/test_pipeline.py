"""The registered queries at the smallest scale, and the pipeline stage by stage."""

import ast
import os
import pathlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from celltide.llm import queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parents[2]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_operator_is_registered_once():
    numbers = Counter(name.split("_")[0] for name in entry.queries() if name.startswith("op"))
    assert numbers == {f"op{n}": 1 for n in range(1, 11)} and "pipeline" in entry.queries()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    verdict, _, _ = compare(spark, connect(SF), name, queries.REGISTRY[name], queries.SQL[name], SF)
    assert verdict.startswith("ok"), verdict


@needs_data
def test_stages_chain_over_whole_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert sizes[0] == sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4] > 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == sizes[-1]
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert whole.select(key).exceptAll(docs.select(key)).count() == 0


@needs_data
def test_toxic_stage_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id", F.lit(1).alias("kept"))
    shares = labels.join(kept, "doc_id", "left").groupBy("toxic").agg((F.count("kept") / F.count("*")).alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in shares}
    assert share[0] > 0.99 and share[1] < 0.35


def test_rules_of_the_folder():
    for path in [*(ROOT / "celltide" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]:
        names = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & {"localCheckpoint", "crossJoin", "toPandas"}, path
        if path.stem in ("url_graph", "line_spread"):
            assert not names & {"pandas_udf", "udf", "mapInPandas", "applyInPandas", "rdd", "mapInArrow"}, path
    for path in (ROOT / "celltide").rglob("*.py"):
        if "llm" not in path.parts:
            assert "celltide.llm" not in path.read_text(), path
