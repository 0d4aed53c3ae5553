import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide import schemas
from celltide.operators import folds, grid as ops, models, shapes
from celltide.operators.baselines import class_weights
from celltide.streaming import stream_cell_months
from tests.conftest import rows


def at(row, col):
    return row * 720 + col + 1


def cells_of(spark, *positions):
    return spark.createDataFrame([(at(r, c),) for r, c in positions], "priogrid_gid long")


def test_layout_and_valid_cells(spark):
    features = cells_of(spark, (200, 500), (208, 503))
    line = ops.grid_layout(features).first()
    assert (line["height"], line["width"], line["pad_height"], line["pad_width"]) == (9, 4, 16, 8)
    targets = cells_of(spark, (215, 507), (216, 500), (200, 508), (199, 500), (200, 500))
    assert rows(ops.valid_cells(features, targets)) == [(at(200, 500),), (at(208, 503),), (at(215, 507),)]


def test_focal_cells_are_clipped(spark):
    labels = spark.createDataFrame(
        [(at(200, 500), "a", "gov"), (at(200, 500), "b", "opo"), (at(204, 504), "a", "gov"), (at(204, 504), "b", "gov")],
        "priogrid_gid long, year_month string, target string")
    layout = ops.grid_layout(labels)
    got = rows(ops.focal_cells(labels, layout, 1), "local_row", "local_col")
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert rows(ops.focal_cells(labels, layout, 1, fit=F.col("year_month") == "a")) == []


def test_dense_grid(spark):
    panel = spark.createDataFrame([(at(10, 20), "m", "opo", 2.5), (at(11, 21), "m", "gov", 1.0)], "priogrid_gid long, year_month string, target string, x double")
    line = ops.dense_grid(panel, ops.grid_layout(panel), ["x"]).first()
    assert len(line["labels"]) == 64 and line["labels"][:2] == [1, -1] and line["labels"][9] == 0
    assert sum(line["mask"]) == 2 and line["x"][0] == 2.5 and line["x"][9] == 1.0


def test_neighbour_sums_match_brute_force(spark):
    rng = random.Random(3)
    data = {(r, c): float(rng.randrange(9)) for r in range(100, 106) for c in range(50, 56) if rng.random() < 0.7}
    panel = spark.createDataFrame([(at(r, c), "m", v) for (r, c), v in data.items()], "priogrid_gid long, year_month string, x double")
    got = {r["priogrid_gid"]: (r["x_nbr_sum"], r["x_nbr_mean"]) for r in ops.neighbour_features(panel, ["x"], 2).collect()}
    for (r, c), _ in data.items():
        near = [v for (a, b), v in data.items() if (a, b) != (r, c) and abs(a - r) <= 2 and abs(b - c) <= 2]
        assert got[at(r, c)] == (sum(near), pytest.approx(sum(near) / len(near)) if near else 0.0)


def segment_meets_box(p, q, w, s, e, n):
    """Liang-Barsky clipping."""
    t0, t1 = 0.0, 1.0
    dx, dy = q[0] - p[0], q[1] - p[1]
    for d, lo in ((-dx, p[0] - w), (dx, e - p[0]), (-dy, p[1] - s), (dy, n - p[1])):
        if d == 0:
            if lo < 0:
                return False
        elif d < 0:
            t0 = max(t0, lo / d)
        else:
            t1 = min(t1, lo / d)
    return t0 <= t1


def test_clip_matches_brute_force(spark):
    rng = random.Random(11)
    star = [(5.013 + (2.5 if k % 2 else 4.7) * math.cos(k * math.pi / 7), 4.017 + (2.5 if k % 2 else 4.7) * math.sin(k * math.pi / 7)) for k in range(14)]
    hole = [(4.631, 3.611), (5.427, 3.633), (5.411, 4.429), (4.617, 4.443)]
    far = [(-7.013 + rng.random(), -7.017 + rng.random()) for _ in range(3)]
    edges = []
    for polygon, ring in ((1, star), (1, hole), (2, far)):
        edges += [(polygon, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    frame = spark.createDataFrame(edges, "polygon_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    cells = [(r, c) for r in range(160, 205) for c in range(340, 385)]
    def inside(x, y, polygon):
        hits = [1 for k, a, b, c, d in edges if k == polygon and (b > y) != (d > y) and a + (c - a) * (y - b) / (d - b) > x]
        return len(hits) % 2 == 1
    expected = set()
    for r, c in cells:
        s, w = r * 0.5 - 90, c * 0.5 - 180
        if any(inside(w + 0.25, s + 0.25, k) for k in (1, 2)) or any(segment_meets_box((a, b), (x, y), w, s, w + 0.5, s + 0.5) for _, a, b, x, y in edges):
            expected.add(at(r, c))
    got = {r[0] for r in ops.clip_cells(cells_of(spark, *cells), frame).collect()}
    assert got == expected and 150 < len(got) < len(cells)


def test_folds_partition_cells_without_leaks(spark):
    blocks = spark.createDataFrame([(at(r, c), float(r), float(c), (r * 3 + c) % 10) for r in range(20) for c in range(5)],
                                   "priogrid_gid long, lat double, lon double, block long")
    assigned = folds.assign_folds(blocks)
    assert assigned.groupBy("fold").agg(F.count_distinct("block").alias("n")).filter("n <> 2").count() == 0
    roles = folds.fold_roles(assigned)
    assert roles.count() == 500 and folds.leaking_cells(roles).count() == 0
    assert folds.holdout_sizes(roles).agg(F.sum("n_cells")).first()[0] == 100
    assert folds.leaking_cells(roles.unionByName(roles.filter("fold = 0").withColumn("role", F.lit("holdout")))).count() > 0
    assert folds.changed_assignments(assigned, assigned).count() == 0
    first = assigned.orderBy(schemas.CELL).first()[schemas.CELL]
    fewer = assigned.filter(F.col(schemas.CELL) != first)
    assert [r["fold"] is None for r in folds.changed_assignments(fewer, assigned).collect()] == [True]
    assert [r["fold"] is None for r in folds.changed_assignments(assigned, fewer).collect()] == [False]


def test_geo_blocks(spark):
    cells = cells_of(spark, *[(r, c) for base in (100, 150, 200) for r in range(base, base + 4) for c in range(base, base + 4)])
    blocks = folds.geo_blocks(cells, k=3, restarts=4)
    assert blocks.count() == 48
    assert sorted(r["n_cells"] for r in folds.block_stats(blocks).collect()) == [16, 16, 16]


def test_blocks_are_at_rest_and_the_best_of_all_restarts(spark, monkeypatch):
    rng = random.Random(4)
    cells = cells_of(spark, *{(rng.randint(150, 250), rng.randint(300, 420)) for _ in range(400)}).repartition(5)
    steps, plain = [], folds._added
    monkeypatch.setattr(folds, "_added", lambda *a: steps.append(plain(*a)) or steps[-1])
    blocks = folds.geo_blocks(cells, k=6, seed=3, restarts=8).persist()
    assert folds.block_faults(blocks).first()[:] == (cells.distinct().count(), 6, 0)
    held = blocks.toPandas()
    cost = sum(((g[["lat", "lon"]] - g[["lat", "lon"]].mean()) ** 2).to_numpy().sum() for _, g in held.groupby("block"))
    costs = steps[-1][:, :, 3].sum(axis=1)
    assert cost == pytest.approx(costs.min()) and len(set(costs.round(6))) > 1  # the restarts differ
    again = folds.geo_blocks(cells.repartition(2), k=6, seed=3, restarts=8)
    assert rows(again, "priogrid_gid", "block") == rows(blocks, "priogrid_gid", "block")
    wrong = blocks.withColumn("block", F.when(F.col("lat") == F.lit(held.lat.max()), (F.col("block") + 1) % 6).otherwise(F.col("block")))
    assert folds.block_faults(wrong).first()["n_nearer_elsewhere"] > 0
    assert folds.geo_blocks(cells.limit(0)).count() == 0 and folds.geo_blocks(cells.limit(1)).first()["block"] == 0
    with pytest.raises(RuntimeError):
        folds.geo_blocks(cells, k=6, restarts=2, max_iterations=1)


def test_classifier_learns_and_contract_holds(spark):
    rng = random.Random(1)
    data = []
    for cell in range(1, 41):
        for month in range(1, 7):
            x, y = rng.random(), rng.random()
            data.append((cell, f"2024-{month:02d}", "gov" if x > 0.6 else "opo" if y > 0.5 else "uncertain", x, y))
    rows_ = spark.createDataFrame(data, "priogrid_gid long, year_month string, target string, x double, y double")
    weighted = models.training_weights(rows_.filter("year_month <= '2024-04'"), class_weights(rows_), None)
    model = models.train_classifier(weighted, ["x", "y"])
    scored = models.score(model, rows_, "2024-04")
    assert scored.filter("NOT is_train_month AND pred_class = true_class").count() / scored.filter("NOT is_train_month").count() > 0.75
    assert scored.filter("abs(prob_gov + prob_opo + prob_uncertain - 1) > 1e-9").count() == 0
    importance = {r["feature"]: r["f1_drop"] for r in models.permutation_importance(model, rows_, ["x", "y"], "2024-04").collect()}
    assert set(importance) == {"x", "y"} and importance["x"] > 0.05


def test_focal_weights(spark):
    rows_ = spark.createDataFrame([(1, "m", "gov"), (2, "m", "opo"), (3, "m", "gov")], "priogrid_gid long, year_month string, target string")
    focal = spark.createDataFrame([(1,), (2,)], "priogrid_gid long")
    got = rows(models.training_weights(rows_, class_weights(rows_), focal), "priogrid_gid", "weight")
    assert got == [(1, 0.5), (2, 1.0), (3, 0.0)]


def test_models_are_fitted_without_a_changing_cell(spark):
    names = ["gov", "opo", "uncertain"]  # by cell, so no cell ever changes and the focal region is empty
    table = spark.createDataFrame(
        [(c, f"2024-{m:02d}", names[c // 3 % 3], float(c // 3 % 3 == 0) + m / 100, float(c // 3 % 3 == 1), c / 10) for c in range(1, 37) for m in range(1, 7)],
        "priogrid_gid long, year_month string, target string, x double, y double, z double")
    fit, columns = F.col("year_month") <= "2024-04", ["x", "y", "z"]
    focal = ops.focal_cells(table, ops.grid_layout(table), fit=fit)
    assert focal.isEmpty()
    for algorithm in ("logistic", "forest"):
        train = models.fit_weights(table.filter(fit), class_weights(table, fit), focal)
        assert train.count() == 144 and train.filter("weight = 1").count() == 144
        model = models.train_classifier(train, columns, algorithm, trees=5)
        assert models.score(model, table, "2024-04").filter("pred_class = true_class").count() == 216
    variant = models.ablation(table, {"all": columns}, "2024-04", class_weights(table, fit), focal)
    assert variant.filter("subset = 'overall'").first()["macro_f1"] == 1.0
    # a fold whose focal cells are all held out trains on all its training rows, the others on their focal ones
    roles = roles_of(spark).filter("priogrid_gid BETWEEN 1 AND 36")
    weights = folds.fold_class_weights(table, roles, fit)
    for inside, whole in (([], {0, 1, 2}), ([3, 6, 9], {0}), ([3, 4, 5, 6], set())):
        marks = spark.createDataFrame([(c,) for c in inside], "priogrid_gid long")
        held = models._fold_rows(table, columns, roles, weights, "2024-04", 3, marks).selectExpr("x", "own", "posexplode(weights) AS (fold, w)")
        used = held.filter("own <> fold AND w > 0").selectExpr("fold", "CAST(round(x[2] * 10) AS LONG) AS cell").distinct()
        got = {(r["fold"], r["cell"]) for r in used.collect()}
        assert got == {(f, c) for f in range(3) for c in range(1, 37) if c % 3 != f and (f in whole or c in inside)}
    scored = models.spatial_validation(table, columns, roles, "2024-04", n_folds=3, focal=focal)
    assert scored.filter("pred_class = true_class").count() == scored.count() == 36 * 2 * 3


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(500).select(
        (F.lit(10.0) + (F.col("id") % 7) / 3).alias("latitude"), F.lit(95.0).alias("longitude"), F.col("id").cast("double").alias("value"),
        F.timestamp_seconds(F.col("id") * 86400).alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (stream_cell_months(stream).writeStream.outputMode("complete").format("memory").queryName("cell_months")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("cell_months")) == rows(stream_cell_months(events))


@pytest.mark.parametrize("row, col", [(200, 0), (200, 719), (0, 300), (359, 300), (0, 0), (359, 719)])
def test_focal_cells_stay_on_the_grid(spark, row, col):
    near = [(r, c) for r in (row - 1, row, row + 1) for c in (col - 1, col, col + 1) if 0 <= r < 360 and 0 <= c < 720]
    labels = spark.createDataFrame(
        [(at(r, c), f"2024-0{m}", "gov" if (r, c) != (row, col) or m == 1 else "opo") for r, c in near for m in (1, 2)],
        "priogrid_gid long, year_month string, target string")
    got = ops.focal_cells(labels, ops.grid_layout(labels.select("priogrid_gid").distinct()), radius=2).collect()
    want = {at(r, c) for r in range(row - 2, row + 3) for c in range(col - 2, col + 3) if 0 <= r < 360 and 0 <= c < 720}
    assert {r[0] for r in got} <= want and at(row, col) in {r[0] for r in got}


def test_clip_at_the_end_of_the_grid(spark):
    box = lambda w, s, e, n: [(1, w, s, e, s), (1, e, s, e, n), (1, e, n, w, n), (1, w, n, w, s)]
    cells = cells_of(spark, *[(r, c) for r in (199, 200, 201, 204, 205, 359, 0) for c in (0, 709, 710, 719)])
    frame = lambda edges: spark.createDataFrame(edges, "polygon_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {r[0] for r in ops.clip_cells(cells, frame(box(175.1, 10.1, 180.0, 12.1))).collect()}
    assert got == {at(r, c) for r in (200, 201, 204) for c in (710, 719)}
    got = {r[0] for r in ops.clip_cells(cells, frame(box(175.1, 88.1, 180.0, 90.0))).collect()}
    assert got == {at(359, 710), at(359, 719)}


# --- clipped shapes -----------------------------------------------------------------------

POINTS = "polygon_id long, ring int, hole boolean, seq int, lon double, lat double"


def ring_points(polygon, ring, hole, corners):
    return [(polygon, ring, hole, i, float(x), float(y)) for i, (x, y) in enumerate(corners)]


def covered_by_slabs(polygon_rings, w, s, step=0.5):
    """Area of a polygon inside a box by the even-odd rule, exact between the heights where any edge bends or meets the box."""
    edges = [(a, b) for ring in polygon_rings for a, b in zip(ring, ring[1:] + ring[:1])]
    heights = {s, s + step} | {y for ring in polygon_rings for _, y in ring}
    for (x1, y1), (x2, y2) in edges:
        heights |= {y1 + (y2 - y1) * (x - x1) / (x2 - x1) for x in (w, w + step) if (x1 - x) * (x2 - x) < 0}
    heights = sorted(y for y in heights if s <= y <= s + step)
    area = 0.0
    for low, high in zip(heights, heights[1:]):
        middle, width = (low + high) / 2, 0.0
        xs = sorted(x1 + (x2 - x1) * (middle - y1) / (y2 - y1) for (x1, y1), (x2, y2) in edges if (y1 > middle) != (y2 > middle))
        for a, b in zip(xs[::2], xs[1::2]):
            width += max(0.0, min(b, w + step) - max(a, w))
        area += width * (high - low)
    return area / step**2


def shapes_of(spark, points, positions):
    table = spark.createDataFrame(points, POINTS).repartition(3)
    out = shapes.clip_shapes(cells_of(spark, *positions), shapes.rings(table)).collect()
    return {(r["polygon_id"], r["priogrid_gid"]): r for r in out}


def test_clipped_shapes_of_concave_and_holed_polygons(spark):
    star = [(5.013 + (2.5 if k % 2 else 4.7) * math.cos(k * math.pi / 7), 4.017 + (2.5 if k % 2 else 4.7) * math.sin(k * math.pi / 7)) for k in range(14)]
    hole = [(4.631, 3.611), (5.427, 3.633), (6.411, 5.429), (4.617, 4.443)]
    comb = [(-3.0, -3.0)] + [(x / 10, -1.2 if x % 2 else -2.8) for x in range(-29, 0)] + [(0.0, -3.0)]  # leaves and re-enters each cell
    whole = {1: [star, hole], 2: [comb], 3: [list(reversed(star))]}
    points = ring_points(1, 0, False, star) + ring_points(1, 1, True, hole) + ring_points(2, 0, False, [*comb, comb[0]]) + ring_points(3, 0, None, whole[3][0])
    positions = [(r, c) for r in range(165, 200) for c in range(345, 385)]
    found = shapes_of(spark, points, positions)
    full = 0
    for k, polygon in whole.items():
        for r, c in positions:
            share = covered_by_slabs(polygon, c * 0.5 - 180, r * 0.5 - 90)
            got = found.get((k, at(r, c)))
            assert abs((got["share"] if got else 0.0) - share) < 1e-9, (k, r, c)
            full += share > 1 - 1e-9
            for ring in got["rings"] if got else ():
                assert all(c * 0.5 - 180 - 1e-9 <= v["lon"] <= c * 0.5 - 179.5 + 1e-9 and r * 0.5 - 90 - 1e-9 <= v["lat"] <= r * 0.5 - 89.5 + 1e-9 for v in ring["points"])
    assert full > 20  # cells wholly inside


def test_clipped_shapes_over_the_date_line_and_at_the_pole(spark):
    corners = [(178.9, 10.2), (-178.8, 10.2), (-178.8, 11.3), (178.9, 11.3)]
    points = ring_points(1, 0, False, corners) + ring_points(2, 0, False, [(x + 360 if x < 0 else x, y) for x, y in corners])
    points += ring_points(3, 0, False, [(-180, 89.2), (180, 89.2), (180, 90), (-180, 90)])
    points += [(3, 0, False, 9, None, 1.0)] + ring_points(4, 0, False, [(1, 1), (2, 2)]) + ring_points(5, 0, False, [(1.0, 1.0), (1.5, 1.0), (1.5, 1.5), (1.0, 1.5)])
    positions = [(r, c) for r in (199, 200, 201, 202, 203) for c in (717, 718, 719, 0, 1, 2, 3)] + [(358, 5), (359, 719), (182, 361), (182, 362), (182, 363), (181, 362)]
    found = shapes_of(spark, points, positions)
    for k in (1, 2):
        assert abs(sum(r["share"] for (i, _), r in found.items() if i == k) * 0.25 - 2.3 * 1.1) < 1e-9
        assert abs(found[k, at(200, 717)]["share"] - 0.2 * 0.6) < 1e-9 and found[k, at(201, 0)]["share"] == pytest.approx(1.0)
        assert (k, at(200, 3)) not in found
    assert found[3, at(358, 5)]["share"] == pytest.approx(0.6) and found[3, at(359, 719)]["share"] == pytest.approx(1.0)
    # a polygon along grid lines covers its own cell only, one of two vertices none
    assert [key for key in found if key[0] in (4, 5)] == [(5, at(182, 362))]
    text = spark.createDataFrame([([(False, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])],)], "rings array<struct<hole:boolean,points:array<struct<lon:double,lat:double>>>>")
    assert text.select(shapes.shape_wkt(F.col("rings"))).first()[0] == (
        "MULTIPOLYGON (((1.000000 2.000000, 3.000000 4.000000, 5.000000 6.000000, 1.000000 2.000000)))")


def test_clipping_shapes_needs_one_shuffle_to_the_cells(spark):
    table = spark.createDataFrame(ring_points(1, 0, False, [(0.1, 0.1), (3.2, 0.4), (2.0, 2.7)]), POINTS)
    pieces = shapes.clipped_rings(shapes.rings(table))
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- models by fold and shuffles ------------------------------------------------------------

def labelled_rows(spark, n_cells=60, seed=1):
    rng, data = random.Random(seed), []
    for cell in range(1, n_cells + 1):
        for month in range(1, 7):
            x, y = rng.random() + cell / 40, 5 * rng.random()
            label = "gov" if x + rng.random() / 3 > 1.4 else "opo" if y > 2.5 else "uncertain"
            data.append((cell, f"2024-{month:02d}", label, x, y, 3.0))
    return data, spark.createDataFrame(data, "priogrid_gid long, year_month string, target string, x double, y double, z double")


def roles_of(spark, n_cells=60, n_folds=3):
    return spark.createDataFrame(
        [(c, f, "holdout" if c % n_folds == f else "training") for c in range(1, n_cells + 1) for f in range(n_folds)],
        "priogrid_gid long, fold long, role string")


def test_fold_moments_leave_the_holdout_out(spark):
    data, table = labelled_rows(spark)
    found = models.fold_moments(table, ["x", "y", "z"], roles_of(spark), F.col("year_month") <= "2024-04").collect()
    assert sorted(r["fold"] for r in found) == [0, 1, 2]
    for r in found:
        held = [d for d in data if d[1] <= "2024-04" and d[0] % 3 != r["fold"]]
        assert r["n"] == len(held)
        for k, c in enumerate((3, 4)):
            values = [d[c] for d in held]
            assert r["means"][k] == pytest.approx(statistics.mean(values)) and r["deviations"][k] == pytest.approx(statistics.stdev(values))
        assert r["deviations"][2] == 1.0  # a column that doesn't vary


def test_all_folds_are_fitted_in_shared_passes(spark, monkeypatch):
    data, table = labelled_rows(spark)
    roles, columns = roles_of(spark), ["x", "y", "z"]
    passes, plain = [], type(table).mapInPandas
    monkeypatch.setattr(type(table), "mapInPandas", lambda self, *a, **k: passes.append(1) or plain(self, *a, **k))
    weights = folds.fold_class_weights(table, roles, F.col("year_month") <= "2024-04")
    held = models._fold_rows(table, columns, roles, weights, "2024-04", 3, None)
    moments = models.fold_moments(table, columns, roles, F.col("year_month") <= "2024-04")
    fitted, iterations = models.fit_folds(held, moments, 3)
    assert len(passes) == iterations <= 25  # one reading of the rows per iteration, whatever the folds
    # the optimum of each fold: the gradient of the penalised loss over its own training rows is 0
    weight_of = {(r["fold"], r["class"]): r["weight"] for r in weights.collect()}
    for m in moments.collect():
        f, mean, deviation = m["fold"], np.array(m["means"]), np.array(m["deviations"])
        train = [d for d in data if d[1] <= "2024-04" and d[0] % 3 != f]
        x, y = np.array([d[3:] for d in train]), np.array([schemas.CLASS_CODES[d[2]] for d in train])
        w = np.array([weight_of[f, d[2]] for d in train])
        raw = np.hstack([x, np.ones((len(x), 1))]) @ fitted[f].T
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        z = (x - mean) / deviation
        gradient = ((p - np.eye(3)[y]) * w[:, None]).T @ z / w.sum() + 1e-3 * fitted[f][:, :3] * deviation
        assert np.abs(gradient).max() < 1e-6
    with pytest.raises(RuntimeError, match="max_iterations"):
        models.fit_folds(held, moments, 3, max_iterations=1)
    scored = models.spatial_validation(table, columns, roles, "2024-04", n_folds=3).toPandas()
    assert len(scored) == 60 * 2 * 3 and (scored.role == "holdout").sum() == 120
    one = scored[(scored.priogrid_gid == 5) & (scored.year_month == "2024-06") & (scored.fold == 1)].iloc[0]
    row = next(d for d in data if d[:2] == (5, "2024-06"))
    raw = fitted[1] @ np.array([*row[3:], 1.0])
    assert one.prob_gov == pytest.approx((np.exp(raw) / np.exp(raw).sum())[schemas.CLASS_CODES["gov"]])
    assert (scored.pred_class == scored.true_class).mean() > 0.75
    assert set(models.spatial_validation(table, columns, roles, "2024-04", n_folds=3, algorithm="forest").toPandas().role) == {"holdout", "training"}


def test_shuffles_of_many_columns_need_no_sort(spark):
    n, columns = 211, [f"c{k}" for k in range(93)]
    table = spark.range(n).select(F.col("id").alias("row_index"), *[(F.col("id") * 100 + k).alias(c) for k, c in enumerate(columns)])
    out = models.permuted_values(table, columns, 42, n)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") == 1
    found = sorted(out.collect())
    assert [r["row_index"] for r in found] == list(range(n))
    moved = np.array([r["shuffled"] for r in found])
    for k in range(93):  # every column keeps its values, in an order of its own
        assert sorted(moved[:, k]) == [i * 100 + k for i in range(n)]
        assert (moved[:, k] != moved[:, 0] + k).any() or k == 0


# --- windows of any radius, rasters in bands --------------------------------------------------

@pytest.mark.parametrize("radius, include_self", [(1, False), (3, True), (8, False), (40, False)])
def test_windows_of_any_radius_equal_brute_force(spark, radius, include_self):
    rng, data = random.Random(radius), {}
    spots = [(r, c) for r in (0, 1, 30, 31, 32, 33, 63, 64, 100, 358, 359) for c in (0, 1, 5, 9, 300, 301, 308, 718, 719)]
    for month in ("2024-01", "2024-02"):
        for r, c in rng.sample(spots, 60):
            data[month, r, c] = (rng.randint(0, 9) if rng.random() > 0.1 else None, rng.random())
    table = spark.createDataFrame([(at(r, c), m, n, x, "kept") for (m, r, c), (n, x) in data.items()], "priogrid_gid long, year_month string, n int, x double, other string")
    found = ops.window_features(table.repartition(4), ["n", "x"], radius, include_self)
    assert found.schema["n_nbr_sum"].dataType.simpleString() == "bigint" and found.count() == len(data)
    for row in found.collect():
        r, c = divmod(row["priogrid_gid"] - 1, 720)
        near = [v for (m, a, b), v in data.items() if m == row["year_month"] and abs(a - r) <= radius and abs(b - c) <= radius and (include_self or (a, b) != (r, c))]
        for k, name in enumerate(("n", "x")):
            values = [v[k] for v in near if v[k] is not None]
            assert row[f"{name}_nbr_sum"] == pytest.approx(sum(values)), (r, c, name)
            assert row[f"{name}_nbr_mean"] == pytest.approx(sum(values) / len(values) if values else 0.0)
    if radius == 1:
        same = ops.neighbour_features(table, ["n"], 1)
        assert rows(same, "priogrid_gid", "year_month", "n_nbr_sum") == rows(found, "priogrid_gid", "year_month", "n_nbr_sum")


def test_windows_send_few_copies(spark):
    table = spark.createDataFrame([(at(r, c), "m", 1) for r in range(120, 160) for c in range(10)], "priogrid_gid long, year_month string, n long")
    sent, plain = [], type(table).groupBy
    class Seen(Exception):
        pass
    def caught(self, *a):
        sent.append(self.count())
        raise Seen
    try:
        type(table).groupBy = caught
        with pytest.raises(Seen):
            ops.window_features(table, ["n"], 8)
    finally:
        type(table).groupBy = plain
    assert sent[0] <= 3 * 400  # 289 copies each by sending values to every cell of the window


def test_bands_hold_the_raster_of_a_month(spark):
    data = [(at(r, c), m, "gov", float(r * c)) for m in ("a", "b") for r in range(100, 113) for c in range(200, 207) if (r + c) % 3]
    panel = spark.createDataFrame(data, "priogrid_gid long, year_month string, target string, v double")
    layout = ops.grid_layout(panel)
    whole = {r["year_month"]: r for r in ops.dense_grid(panel, layout, ["v"]).collect()}
    bands = ops.dense_grid(panel, layout, ["v"], band_rows=5).collect()
    assert len(bands) == 2 * 4 and max(len(r["labels"]) for r in bands) == 5 * 8
    for month, r in whole.items():
        parts = sorted((b for b in bands if b["year_month"] == month), key=lambda b: b["band"])
        for c in ("labels", "mask", "v"):
            assert sum((b[c] for b in parts), []) == r[c]
