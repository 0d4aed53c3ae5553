"""Column names and schemas shared by every stage."""

from pyspark.sql import types as T

CELL = "priogrid_gid"
PERIOD = "year_month"
KEY = [CELL, PERIOD]

CLASSES = ("gov", "opo", "uncertain")
CLASS_CODES = {"gov": 0, "opo": 1, "uncertain": 2}

PREDICTION_COLUMNS = [
    CELL, PERIOD, "pred_class", "pred_class_int",
    "prob_gov", "prob_opo", "prob_uncertain", "confidence",
    "true_class", "has_label", "is_train_month",
]

TARGET_COLUMNS = [
    CELL, PERIOD, "wiki_side", "acled_side", "control_status",
    "wiki_changed_recent", "n_gov", "n_opo", "n_unmapped", "total_ctrl_evs",
    "admin1", "agreement", "target", "reason",
]
SLIM_TARGET_COLUMNS = [
    CELL, PERIOD, "target", "wiki_side", "wiki_changed_recent", "acled_side", "reason",
]

# Columns of a panel that identify or describe a row and are never features.
PANEL_METADATA = [CELL, PERIOD, "year_month_dt", "adm_1"]


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "date": T.DateType(), "boolean": T.BooleanType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENTS = _schema(
    "id long, year int, date_start string, date_end string, type_of_violence int, "
    "conflict_name string, dyad_name string, side_a string, side_b string, "
    "latitude double, longitude double, priogrid_gid long, country string, country_id int, "
    "adm_1 string, adm_2 string, best double, deaths_a double, deaths_b double, "
    "deaths_civilians double, deaths_unknown double, where_prec int, date_prec int, code_status string"
)
TAXONOMY = _schema(
    "ucdp_name string, wiki_mark string, level1 string, level2 string, level3 string, "
    "display_name string, notes string"
)
SIGNALS = _schema(
    "event_id_cnty string, event_date date, country string, sub_event_type string, "
    "actor1 string, inter1 string, admin1 string, latitude double, longitude double"
)
REVISIONS = _schema("revid long, timestamp string, comment string, content string")
POINTS = _schema(
    "date date, lat double, lon double, location_name string, control_status string, "
    "actor string, source string, confidence string"
)
