"""Views that give the star-schema tables the roles of the pipelines' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from celltide.functions import dates, grid
from celltide.functions.values import top_class
from celltide.operators import baselines, panel as panel_ops
from celltide.operators.actors import ActorRule
from celltide.operators.grid import valid_cells
from celltide.plans import events as event_plans, labels as label_plans, panel as panel_plans, target as target_plans
from celltide.runtime import checkpoint
from celltide.schemas import CELL, CLASSES, KEY, PERIOD

EVENTS_SINCE = "1995-01-01"
LABELS_SINCE = "1996-01"
CUTOFF = "2000-06"
SEED = 42

ACTORS = {
    "events_gov": "actor_0", "events_nug": "actor_1", "events_kio": "actor_2", "events_ula": "actor_3",
    "events_knu": "actor_4", "events_mndaa": "actor_5", "events_pslf": "actor_6", "events_cnf": "actor_7",
    "events_rcss": "actor_8", "events_uwsa": "actor_9",
}
RULES = [
    ActorRule((r"\bhot\b", r"\bred\b"), "Anti-junta", "Northern", "TNLA"),
    ActorRule((r"^cold", r"blue"), "Pro-junta", "Tatmadaw and allies", "Tatmadaw"),
    ActorRule((r"small gear", r"widget$"), "Anti-junta", "Southern", "PNLA"),
    ActorRule((r"\bnew\b",), "Neutral / Self-administered", "Eastern", "KNPLF"),
    ActorRule((r"large (bolt|ring)",), "Other / Unmapped", "Unmapped", "Protesters"),
]
OVERRIDES = [
    ("TNLA", "after", "2000-01-01", ("Other / Unmapped", "Other combatant", "TNLA")),
    ("PNLA", "before", "1997-01-15", ("Other / Unmapped", "Unmapped", "PNLA")),
]

LAT = "9.5D + (c_custkey * 7919 % 1900) / 100.0D"
LON = "92.0D + (c_custkey * 104729 % 950) / 100.0D"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its footer is read for the schema only the first time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumns({
        "latitude": F.expr(LAT), "longitude": F.expr(LON),
    })


def events(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """Two-sided events: one per line item, between the customer's and the supplier's nation.

    ``flag`` keeps one return flag, filtered at the scan, as the events of one source.
    """
    line, orders = table(spark, sf_dir, "lineitem"), _placed_orders(spark, sf_dir)
    line = line if flag is None else line.filter(F.col("l_returnflag") == flag)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    buyer = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("side_a"), F.col("r_name").alias("_region"))
    seller = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("side_b"))
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(buyer, "c_nationkey").join(seller, "l_suppkey")
    )
    located = joined.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("id"),
        F.expr("CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END").alias("date_start"),
        F.expr("1 + l_linenumber % 3").alias("type_of_violence"),
        F.concat("side_a", F.lit("-"), "side_b").alias("dyad_name"), "side_a", "side_b",
        "latitude", "longitude",
        F.expr("CASE WHEN o_custkey % 10 = 0 THEN 'Elsewhere' ELSE 'Home' END").alias("country"),
        F.expr("CASE WHEN l_partkey % 11 <> 0 THEN _region END").alias("adm_1"),
        F.col("l_quantity").alias("best"),
        F.expr("CAST(l_partkey % 5 AS DOUBLE)").alias("deaths_a"),
        F.expr("CAST(l_suppkey % 4 AS DOUBLE)").alias("deaths_b"),
        F.expr("CAST(l_linenumber % 3 AS DOUBLE)").alias("deaths_civilians"),
        F.expr("CAST(nullif(1 + l_partkey % 8, 8) AS INT)").alias("where_prec"),
        F.concat(F.lit("src_"), "l_returnflag").alias("data_source"),
    )
    return located.withColumn(CELL, grid.cell_id(F.col("latitude"), F.col("longitude")))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels for all but the last two nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).filter("n_nationkey < 23").select(
        F.col("n_name").alias("ucdp_name"), F.col("r_name").alias("level1"),
        F.concat(F.lit("group_"), "n_regionkey").alias("level2"),
        F.concat(F.lit("actor_"), "n_nationkey").alias("level3"), F.lower("n_name").alias("display_name"))


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_plans.label_events(events(spark, sf_dir), taxonomy(spark, sf_dir), EVENTS_SINCE)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point labels: one per order."""
    return _placed_orders(spark, sf_dir).select(
        F.expr("CAST(o_orderdate AS DATE)").alias("date"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'government' WHEN '2-HIGH' THEN 'resistance'
            WHEN '3-MEDIUM' THEN 'ethnic_armed_group' WHEN '4-NOT SPECIFIED' THEN 'contested' ELSE 'unknown' END"""
               ).alias("control_status"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END").alias("confidence"))


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-actor events: the returned line items, with the part as actor."""
    line, orders = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), _placed_orders(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, "l_partkey").select(
        F.expr("CAST(l_orderkey * 10 + l_linenumber AS STRING)").alias("event_id_cnty"),
        F.expr("CAST(l_shipdate AS DATE)").alias("event_date"), F.lit("Home").alias("country"),
        F.expr("CASE l_linestatus WHEN 'F' THEN 'Government regains territory' ELSE 'Battle' END").alias("sub_event_type"),
        F.expr("CASE WHEN l_partkey % 17 <> 0 THEN p_name END").alias("actor1"),
        F.expr("""CASE p_type WHEN 'STANDARD' THEN 'State forces' WHEN 'ECONOMY' THEN 'Rebel group'
            WHEN 'MEDIUM' THEN 'Rioters' WHEN 'LARGE' THEN 'Civilians' ELSE 'Other' END""").alias("inter1"),
        F.expr("CASE WHEN l_partkey % 7 <> 0 THEN concat('adm_', c_custkey % 5) END").alias("admin1"),
        "latitude", "longitude")


def cell_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_plans.cell_months(labelled_events(spark, sf_dir), ACTORS)


def dense_panel(spark: SparkSession, sf_dir: str, calendar: str = "observed") -> DataFrame:
    return panel_plans.dense_panel(cell_months(spark, sf_dir), calendar)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_plans.build_panel(labelled_events(spark, sf_dir), ACTORS)


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and months of precisely located events: the keys the panel is built on."""
    return panel_plans.filter_precision(event_plans.with_period(events(spark, sf_dir))).filter(
        F.col("date_start") >= F.lit(EVENTS_SINCE).cast("date")).select(*KEY).distinct()


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = panel_ops.observed_periods(active(spark, sf_dir), LABELS_SINCE)
    return label_plans.labels_to_panel(points(spark, sf_dir), months)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_plans.signals_to_panel(
        signal_events(spark, sf_dir), RULES, since=EVENTS_SINCE, overrides=OVERRIDES)


def target(spark: SparkSession, sf_dir: str, boundary: str = "changed") -> DataFrame:
    return target_plans.build_target(labels(spark, sf_dir), signals(spark, sf_dir), boundary)


def stored_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target as later stages read it: computed once, a grid-bounded table."""
    return checkpoint(target(spark, sf_dir))


def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(spark, sf_dir).select(CELL).distinct()


def soft_predictions(target_rows: DataFrame) -> DataFrame:
    """Deterministic scores with ties, standing in for a classifier's probabilities."""
    month = dates.month_number(F.col(PERIOD))
    scored = target_rows.select(*KEY, F.col("target").alias("true_class")).withColumns({
        f"prob_{c}": ((F.col(CELL) * 31 + month * 17 + k * 7) % 1000) / F.lit(1000.0) for k, c in enumerate(CLASSES)
    })
    probability = [F.col(f"prob_{c}") for c in CLASSES]
    return baselines.to_contract(scored.withColumns({
        "pred_class": top_class(probability, CLASSES), "confidence": F.greatest(*probability),
        "is_train_month": baselines.is_train(CUTOFF),
    }))


def predictions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Predictions of three models on the target's rows, with a model column."""
    rows = stored_target(spark, sf_dir) if rows is None else rows
    valid = checkpoint(valid_cells(feature_cells(spark, sf_dir), rows))
    named = lambda df, name: df.withColumn("model", F.lit(name))
    kept = rows.join(valid, CELL, "left_semi")
    return (
        named(baselines.predict_no_change(rows, valid, CUTOFF), "no_change")
        .unionByName(named(baselines.predict_random(rows, valid, CUTOFF, SEED), "random_proportion"))
        .unionByName(named(soft_predictions(kept), "soft"))
    )


def blocks(rows: DataFrame) -> DataFrame:
    """A fixed assignment of cells to ten blocks, for the fold operators."""
    c = F.col(CELL)
    return rows.select(CELL).distinct().select(
        CELL, grid.centroid_lat(c).alias("lat"), grid.centroid_lon(c).alias("lon"),
        ((grid.cell_row(c) * 7 + grid.cell_col(c)) % 10).alias("block"))


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diamond per supplier as a table of vertices."""
    centre = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("polygon_id"),
        F.expr("10.003D + (s_suppkey * 7919 % 1800) / 100.0D").alias("y"),
        F.expr("92.5041D + (s_suppkey * 104729 % 900) / 100.0D").alias("x"),
        F.expr("0.3D + (s_suppkey % 7) / 4.0D").alias("r"))
    at = [F.struct(F.lit(i).alias("seq"), F.expr(x).alias("lon"), F.expr(y).alias("lat")) for i, (x, y) in enumerate(
        [("x", "y + r"), ("x + r", "y"), ("x", "y - r"), ("x - r", "y")])]
    return centre.select("polygon_id", F.lit(0).alias("ring"), F.lit(False).alias("hole"), F.inline(F.array(*at)))


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the same diamonds, as a polygon table."""
    of_polygon = corners(spark, sf_dir).groupBy("polygon_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v"))
    edge = lambda i: F.struct(*[F.col("v")[k % 4][c].alias(f"{c}{1 + k - i}") for k in (i, i + 1) for c in ("lon", "lat")])
    return of_polygon.select("polygon_id", F.inline(F.array(*[edge(i) for i in range(4)])))


def static_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static covariates under the alias ``gid``: customer averages per cell."""
    placed = table(spark, sf_dir, "customer").select(
        grid.cell_id(F.expr(LAT), F.expr(LON)).alias("gid"), "c_acctbal", "c_custkey")
    return placed.groupBy("gid").agg(
        F.round(F.avg("c_acctbal"), 4).alias("ttime_mean"), F.count("*").cast("double").alias("forest_gc"),
        F.max(F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END")).alias("agri_gc"))


def yearly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly covariates with NULLs that differ by column and year; the year is text."""
    placed = _placed_orders(spark, sf_dir).select(
        grid.cell_id(F.col("latitude"), F.col("longitude")).alias("gid"),
        F.expr("CAST(year(o_orderdate) AS STRING)").alias("year"), "o_totalprice", "o_custkey")
    return placed.groupBy("gid", "year").agg(
        F.expr("CASE WHEN count(*) % 5 <> 0 THEN CAST(count(*) AS DOUBLE) END").alias("bdist1"),
        F.expr("CASE WHEN max(o_custkey) % 3 <> 0 THEN max(o_totalprice) END").alias("capdist"))
