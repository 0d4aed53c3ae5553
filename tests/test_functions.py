import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide.functions import dates, grid, mixing, text, values
from tests.conftest import rows


def test_known_cells(spark):
    df = spark.createDataFrame([(19.5, 97.0), (21.5, 95.0), (-90.0, -180.0), (89.99, 179.99)], "lat double, lon double")
    got = [r[0] for r in df.select(grid.cell_id(F.col("lat"), F.col("lon"))).collect()]
    assert got == [158235, 161111, 1, 259200]


def test_cell_round_trip(spark):
    df = spark.createDataFrame([(158235,), (160401,), (720,), (721,)], "c long")
    c = F.col("c")
    got = df.select(
        "c", grid.cell_row(c).alias("r"), grid.cell_col(c).alias("k"), grid.centroid_lon(c).alias("lon"),
        grid.cell_id(grid.centroid_lat(c), grid.centroid_lon(c)).alias("back"), grid.cell_wkt(c).alias("wkt")).collect()
    assert [r["back"] for r in got] == [r["c"] for r in got]
    assert got[1]["lon"] == 100.25
    assert (got[2]["r"], got[2]["k"], got[3]["r"], got[3]["k"]) == (0, 719, 1, 0)
    assert got[3]["wkt"] == (
        "POLYGON ((-180.00 -89.50, -179.50 -89.50, -179.50 -89.00, -180.00 -89.00, -180.00 -89.50))")


def test_bad_dates_are_null(spark):
    df = spark.createDataFrame([("2021-02-03",), ("2021-02-03 10:11:12",), ("soon",), ("2021-13-01",), (None,)], "d string")
    got = df.select(dates.safe_date(F.col("d")), dates.month_of(dates.safe_date(F.col("d")))).collect()
    day = dt.date(2021, 2, 3)
    assert [tuple(r) for r in got] == [(day, "2021-02"), (day, "2021-02"), (None, None), (None, None), (None, None)]


def test_month_number_is_consecutive(spark):
    df = spark.createDataFrame([("2021-12",), ("2022-01",)], "p string")
    a, b = [r[0] for r in df.select(dates.month_number(F.col("p"))).collect()]
    assert b - a == 1


def test_iso_timestamp(spark):
    df = spark.createDataFrame([("2024-05-06T07:08:09Z",), ("x",)], "t string")
    got = [r[0] for r in df.select(dates.iso_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2024-05-06 07:08:09", None]


def test_mapping_and_ratio(spark):
    df = spark.createDataFrame([("a", 1, 2), ("z", 3, 0), (None, 1, 4)], "k string, x int, y int")
    got = df.select(
        values.map_values(F.col("k"), {"a": 1, "b": 2}, 9), values.map_values(F.col("k"), {"a": "p"}),
        values.safe_ratio(F.col("x"), F.col("y")), values.flag(F.col("k") == "a")).collect()
    assert [tuple(r) for r in got] == [(1, "p", 0.5, 1), (9, None, 0.0, 0), (9, None, 0.25, 0)]


def test_softmax_is_stable_and_ties_take_first(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, 999.0), (1.0, 2.0, 3.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    got = df.select(*values.softmax(cols), values.top_class(cols, ["x", "y", "z"])).collect()
    assert math.isclose(sum(got[0][:3]), 1.0) and math.isclose(sum(got[1][:3]), 1.0)
    assert (got[0][3], got[1][3]) == ("x", "z")


def test_dominant_side(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (0, 1), (0, 0)], "g long, o long")
    got = [r[0] for r in df.select(values.dominant_side(F.col("g"), F.col("o"))).collect()]
    assert got == ["mixed", "gov", "opo", "unmapped_only"]


def test_hash_numbers_are_even_and_repeatable(spark):
    df = spark.range(4000)
    u = values.hash_uniform(F.lit(1), F.col("id"))
    mean, low, high = df.select(u.alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(mean - 0.5) < 0.02 and 0 <= low and high < 1
    assert rows(df.select(u)) == rows(df.repartition(3).select(u))


def test_patterns(spark):
    df = spark.createDataFrame([("PDF: Kani",), ("updf",), (None,)], "s string")
    got = df.select(text.matches_any(F.col("s"), [r"\bpdf\b", "^zz"]), text.group_of(F.col("s"), r"(\w+): (\w+)", 2)).collect()
    assert [tuple(r) for r in got] == [(True, "Kani"), (False, None), (None, None)]


@pytest.mark.parametrize("n", [1, 2, 7, 12, 210, 1000, 30030])
def test_keyed_shuffle_is_a_bijection_in_every_engine(spark, n):
    frame = spark.range(n).select("id", mixing.shuffled(F.col("id"), F.lit(99), n).alias("to")).orderBy("id").toPandas()
    assert sorted(frame["to"]) == list(range(n))
    assert frame["to"].tolist() == mixing.shuffle_values(np.arange(n), 99, n).tolist()
    con = duckdb.connect()
    sql = con.execute(f"SELECT id, place FROM ({mixing.shuffled_sql(f'(SELECT range AS id FROM range({n}))', 'id', 99, 'place')}) ORDER BY id").fetchall()
    assert [p for _, p in sql] == frame["to"].tolist()


def test_keyed_shuffles_look_random():
    n = 4001
    a, b = mixing.shuffle_values(np.arange(n), 1, n), mixing.shuffle_values(np.arange(n), 2, n)
    assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.06 and abs(np.corrcoef(a, b)[0, 1]) < 0.06
    steps = np.diff(a) % n
    assert len(np.unique(steps)) > 0.5 * n  # no constant stride
