"""SQL counterparts of the registered queries, written independently for another engine."""

from __future__ import annotations

import re

from celltide import fixed_values as fixed
from celltide.bindings import tables as t
from celltide.functions.mixing import mix_sql, mix_values, shuffled_sql
from celltide.schemas import CLASSES

KEY = "priogrid_gid, year_month"
W = "(PARTITION BY priogrid_gid ORDER BY year_month)"
ACTORS = list(t.ACTORS)


def cell(lat: str, lon: str) -> str:
    return (f"CAST(floor(({lat} + CAST(90 AS DOUBLE)) / CAST(0.5 AS DOUBLE)) * 720 "
            f"+ floor(({lon} + CAST(180 AS DOUBLE)) / CAST(0.5 AS DOUBLE)) + 1 AS BIGINT)")


def trailing(n: int) -> str:
    return f"(PARTITION BY priogrid_gid ORDER BY year_month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def case(value: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {value} {whens} ELSE {default} END"


def hashed(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def rounded(sql: str, *columns: str, digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({sql})"


def month_no(period: str = "year_month") -> str:
    return f"(CAST(substr({period}, 1, 4) AS BIGINT) * 12 + CAST(substr({period}, 6, 2) AS BIGINT) - 1)"


ROW = "CAST((priogrid_gid - 1) // 720 AS BIGINT)"
COL = "CAST((priogrid_gid - 1) % 720 AS BIGINT)"


# --- shared views -------------------------------------------------------------------------

CTE: dict[str, str] = {}

CTE["v_orders"] = """SELECT *,
  CAST(9.5 AS DOUBLE) + (c_custkey * 7919 % 1900) / CAST(100 AS DOUBLE) AS latitude,
  CAST(92 AS DOUBLE) + (c_custkey * 104729 % 950) / CAST(100 AS DOUBLE) AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey"""
CTE["v_events"] = f"""SELECT l_orderkey * 10 + l_linenumber AS id,
  CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS date_start,
  1 + l_linenumber % 3 AS type_of_violence,
  cn.n_name || '-' || sn.n_name AS dyad_name, cn.n_name AS side_a, sn.n_name AS side_b,
  latitude, longitude,
  CASE WHEN o_custkey % 10 = 0 THEN 'Elsewhere' ELSE 'Home' END AS country,
  CASE WHEN l_partkey % 11 <> 0 THEN r_name END AS adm_1, l_quantity AS best,
  CAST(l_partkey % 5 AS DOUBLE) AS deaths_a, CAST(l_suppkey % 4 AS DOUBLE) AS deaths_b,
  CAST(l_linenumber % 3 AS DOUBLE) AS deaths_civilians,
  CAST(NULLIF(1 + l_partkey % 8, 8) AS INTEGER) AS where_prec,
  'src_' || l_returnflag AS data_source, {cell('latitude', 'longitude')} AS priogrid_gid
  FROM lineitem JOIN v_orders ON l_orderkey = o_orderkey
  JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region ON cn.n_regionkey = r_regionkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey"""
CTE["v_tax"] = """SELECT n_name AS ucdp_name, r_name AS level1, 'group_' || n_regionkey AS level2,
  'actor_' || n_nationkey AS level3, lower(n_name) AS display
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 23"""
LEVELS = ["level1", "level2", "level3", "display"]
CTE["v_labelled"] = f"""SELECT e.*, strftime(date_start, '%Y-%m') AS year_month,
  {', '.join(f'{p}.{x} AS {s}_{x}' for s, p in (('side_a', 'ta'), ('side_b', 'tb')) for x in LEVELS)}
  FROM v_events e LEFT JOIN v_tax ta ON e.side_a = ta.ucdp_name LEFT JOIN v_tax tb ON e.side_b = tb.ucdp_name
  WHERE date_start >= DATE '{t.EVENTS_SINCE}'"""
FLAGS = {
    **{a: f"(COALESCE(side_a_level3 = '{c}', FALSE) OR COALESCE(side_b_level3 = '{c}', FALSE))" for a, c in t.ACTORS.items()},
    "is_statebased": "type_of_violence = 1", "is_onesided": "type_of_violence = 3",
    "gov_vs_civilians": "(COALESCE(side_a_level3 = 'actor_0', FALSE) AND type_of_violence = 3)",
}


def cell_month_sql(source: str) -> str:
    return f"""SELECT {KEY}, COUNT(*) AS total_events,
  {', '.join(f'COUNT(*) FILTER (WHERE {c}) AS {n}' for n, c in FLAGS.items())},
  SUM(best) AS total_fatalities, SUM(deaths_a) AS deaths_a, SUM(deaths_b) AS deaths_b, SUM(deaths_civilians) AS deaths_civilians,
  COUNT(DISTINCT dyad_name) AS n_unique_dyads,
  arg_min(adm_1, CAST(date_start AS VARCHAR) || adm_1) FILTER (WHERE adm_1 IS NOT NULL) AS adm_1
  FROM {source} WHERE where_prec <= 5 AND priogrid_gid IS NOT NULL AND year_month IS NOT NULL GROUP BY {KEY}"""


NUMBERS = ["total_events", *FLAGS, "total_fatalities", "deaths_a", "deaths_b", "deaths_civilians", "n_unique_dyads"]
CTE["cell_month"] = cell_month_sql("v_labelled")
CTE["active"] = f"SELECT {KEY} FROM cell_month"
CTE["feature_cell"] = "SELECT DISTINCT priogrid_gid FROM cell_month"
CTE["skeleton"] = "SELECT * FROM feature_cell CROSS JOIN (SELECT DISTINCT year_month FROM cell_month)"


def dense_sql(skeleton: str, source: str) -> str:
    both = (f"COALESCE(last_value(adm_1 IGNORE NULLS) OVER (PARTITION BY priogrid_gid ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value(adm_1 IGNORE NULLS) OVER (PARTITION BY priogrid_gid ORDER BY year_month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
    return f"""SELECT {KEY}, {', '.join(f'COALESCE({c}, 0) AS {c}' for c in NUMBERS)}, {both} AS adm_1
  FROM {skeleton} LEFT JOIN {source} USING ({KEY})"""


CTE["dense"] = dense_sql("skeleton", "cell_month")


def lags(columns, steps) -> list[str]:
    return [f"COALESCE(lag({c}, {k}) OVER {W}, 0) AS {c}_lag{k}" for k in steps for c in columns]


def means(columns, widths) -> list[str]:
    return [f"avg({c}) OVER {trailing(w)} AS {c}_roll{w}m" for w in widths for c in columns]


def deviations(columns, widths) -> list[str]:
    return [f"COALESCE(stddev_samp({c}) OVER {trailing(w)}, 0) AS {c}_std{w}m" for w in widths for c in columns]


def trends(columns) -> list[str]:
    return [f"avg({c}) OVER {trailing(3)} - avg({c}) OVER {trailing(6)} AS {c}_trend" for c in columns]


def shares(actors) -> list[str]:
    return [f"CASE WHEN total_events > 0 THEN events_{a} / CAST(total_events AS DOUBLE) ELSE 0 END AS {a}_event_share" for a in actors]


def names(columns: list[str]) -> list[str]:
    return [c.rsplit(" AS ", 1)[1] for c in columns]


CTE["panel"] = f"""SELECT *, {', '.join(lags(fixed.LAG_COLUMNS, [1, 3, 6]) + means(fixed.ROLL_COLUMNS, [3, 6]) + shares(['gov', 'nug']))},
  CAST(year_month || '-01' AS DATE) AS year_month_dt FROM dense"""

CTE["v_points"] = """SELECT CAST(o_orderdate AS DATE) AS date, latitude AS lat, longitude AS lon,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'government' WHEN '2-HIGH' THEN 'resistance' WHEN '3-MEDIUM' THEN 'ethnic_armed_group'
    WHEN '4-NOT SPECIFIED' THEN 'contested' ELSE 'unknown' END AS control_status,
  CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence FROM v_orders"""
CTE["placed"] = f"""SELECT *, {cell('lat', 'lon')} AS priogrid_gid, strftime(date, '%Y-%m') AS year_month
  FROM v_points WHERE control_status IN ('government', 'resistance', 'ethnic_armed_group', 'contested')"""
CTE["ballot"] = f"""SELECT {KEY}, control_status, COUNT(*) AS votes, COUNT(*) FILTER (WHERE confidence = 'high') AS high
  FROM placed GROUP BY {KEY}, control_status"""
PRIORITY = "CASE control_status WHEN 'government' THEN 1 WHEN 'resistance' THEN 2 WHEN 'ethnic_armed_group' THEN 3 ELSE 4 END"
CTE["ranked_ballot"] = f"""SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY votes DESC, {PRIORITY}) AS place,
  SUM(votes) OVER (PARTITION BY {KEY}) AS towns, SUM(high) OVER (PARTITION BY {KEY}) AS sure FROM ballot"""
CTE["vote"] = f"""SELECT {KEY}, control_status,
  CASE WHEN votes / CAST(towns AS DOUBLE) >= 0.75 THEN 'high' WHEN votes / CAST(towns AS DOUBLE) >= 0.5 THEN 'medium' ELSE 'low' END AS label_confidence,
  CAST(towns AS BIGINT) AS n_towns_in_cell, CAST(sure AS BIGINT) AS high_conf_towns FROM ranked_ballot WHERE place = 1"""
VOTE = ["control_status", "label_confidence", "n_towns_in_cell", "high_conf_towns"]
PAST = "OVER (PARTITION BY priogrid_gid ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CTE["label_panel"] = f"""SELECT * FROM (SELECT {KEY}, {', '.join(f'last_value({c} IGNORE NULLS) {PAST} AS {c}' for c in VOTE)},
  v.control_status IS NOT NULL AS is_cell_snapshot,
  year_month IN (SELECT year_month FROM vote) AS is_direct_snapshot
  FROM (SELECT DISTINCT priogrid_gid FROM vote) CROSS JOIN (SELECT DISTINCT year_month FROM active WHERE year_month >= '{t.LABELS_SINCE}')
  LEFT JOIN vote v USING ({KEY})) WHERE control_status IS NOT NULL"""

CTE["v_signals"] = """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS event_id_cnty, CAST(l_shipdate AS DATE) AS event_date,
  CASE l_linestatus WHEN 'F' THEN 'Government regains territory' ELSE 'Battle' END AS sub_event_type,
  CASE WHEN l_partkey % 17 <> 0 THEN p_name END AS actor1,
  CASE p_type WHEN 'STANDARD' THEN 'State forces' WHEN 'ECONOMY' THEN 'Rebel group' WHEN 'MEDIUM' THEN 'Rioters' WHEN 'LARGE' THEN 'Civilians' ELSE 'Other' END AS inter1,
  CASE WHEN l_partkey % 7 <> 0 THEN 'adm_' || (c_custkey % 5) END AS admin1, latitude, longitude
  FROM lineitem JOIN v_orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'"""
_RULES = [[p for p in r.patterns] for r in t.RULES]
RULE_NO = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"regexp_matches(actor1, '(?i){p}')" for p in patterns) + f" THEN {i}"
    for i, patterns in enumerate(_RULES)) + " END"


def outcome(part: int) -> str:
    """Part of the outcome (side, coalition, group) by rule number, then by actor type."""
    by_rule = " ".join(f"WHEN {i} THEN '{(r.side, r.coalition, r.actor_group)[part]}'" for i, r in enumerate(t.RULES))
    by_type = " ".join(f"WHEN '{k}' THEN '{v[part]}'" for k, v in fixed.TYPE_FALLBACK.items())
    return f"CASE rule_no {by_rule} ELSE CASE inter1 {by_type} ELSE '{fixed.UNMATCHED_ACTOR[part]}' END END"


CTE["sig_rule"] = f"SELECT *, {RULE_NO} AS rule_no FROM v_signals"
CTE["sig_base"] = f"SELECT * EXCLUDE (rule_no), {outcome(0)} AS side, {outcome(1)} AS coalition, {outcome(2)} AS actor_group FROM sig_rule"


def overridden(column: str, part: int) -> str:
    whens = " ".join(
        f"WHEN actor_group = '{g}' AND event_date {'>=' if d == 'after' else '<'} DATE '{c}' THEN '{o[part]}'" for g, d, c, o in t.OVERRIDES)
    return f"CASE {whens} ELSE {column} END AS {column}"


CTE["sig_final"] = f"SELECT * REPLACE ({overridden('side', 0)}, {overridden('coalition', 1)}, {overridden('actor_group', 2)}) FROM sig_base"
CTE["sig_cell"] = f"""SELECT *, {cell('latitude', 'longitude')} AS priogrid_gid, strftime(event_date, '%Y-%m') AS year_month,
  {case('side', fixed.ACTOR_SIDES, "'unmapped'")} AS side2
  FROM sig_final WHERE sub_event_type = 'Government regains territory' AND event_date >= DATE '{t.EVENTS_SINCE}'"""
CTE["signal"] = f"""SELECT *, CASE WHEN n_gov > 0 AND n_opo > 0 THEN 'mixed' WHEN n_gov > 0 THEN 'gov' WHEN n_opo > 0 THEN 'opo' ELSE 'unmapped_only' END AS acled_side
  FROM (SELECT {KEY}, COUNT(*) FILTER (WHERE side2 = 'gov') AS n_gov, COUNT(*) FILTER (WHERE side2 = 'opo') AS n_opo,
  COUNT(*) FILTER (WHERE side2 = 'unmapped') AS n_unmapped, COUNT(event_id_cnty) AS total_ctrl_evs,
  arg_min(admin1, CAST(event_date AS VARCHAR) || admin1) FILTER (WHERE admin1 IS NOT NULL) AS admin1 FROM sig_cell GROUP BY {KEY})"""
AGREE = """CASE WHEN acled_side = 'mixed' THEN 'acled_mixed'
  WHEN acled_side IN ('gov', 'opo') AND wiki_side = 'contested' THEN 'wiki_contested'
  WHEN acled_side IN ('gov', 'opo') AND wiki_side = acled_side THEN 'agree'
  WHEN acled_side IN ('gov', 'opo') AND wiki_side IS NOT NULL THEN 'disagree' ELSE '{}' END"""
SIDES = case("control_status", fixed.STATUS_SIDES)
CHANGED = f"(lag(control_status) OVER {W} IS DISTINCT FROM control_status OR lead(control_status) OVER {W} IS DISTINCT FROM control_status)"
INSIDE = (f"(COALESCE(lag(control_status) OVER {W}, control_status) <> control_status "
          f"OR COALESCE(lead(control_status) OVER {W}, control_status) <> control_status)")


def target_sql(changed: str) -> str:
    return f"""SELECT {KEY}, wiki_side, acled_side, control_status, wiki_changed_recent, n_gov, n_opo, n_unmapped, total_ctrl_evs, admin1, agreement,
  CASE agreement WHEN 'wiki_only' THEN own WHEN 'agree' THEN acled_side WHEN 'wiki_contested' THEN acled_side
    WHEN 'disagree' THEN CASE WHEN wiki_changed_recent THEN own ELSE acled_side END ELSE 'uncertain' END AS target,
  CASE agreement WHEN 'wiki_contested' THEN 'wiki_contested_use_acled'
    WHEN 'disagree' THEN CASE WHEN wiki_changed_recent THEN 'disagree_recent_wiki_use_wiki' ELSE 'disagree_stable_wiki_use_acled' END ELSE agreement END AS reason
  FROM (SELECT *, {AGREE.format('wiki_only')} AS agreement, CASE wiki_side WHEN 'contested' THEN 'uncertain' ELSE wiki_side END AS own
  FROM (SELECT {KEY}, l.control_status, {SIDES} AS wiki_side, changed AS wiki_changed_recent, COALESCE(s.acled_side, 'none') AS acled_side,
    COALESCE(n_gov, 0) AS n_gov, COALESCE(n_opo, 0) AS n_opo, COALESCE(n_unmapped, 0) AS n_unmapped,
    COALESCE(total_ctrl_evs, 0) AS total_ctrl_evs, COALESCE(admin1, '') AS admin1
    FROM (SELECT *, {changed} AS changed FROM label_panel) l LEFT JOIN signal s USING ({KEY})))"""


CTE["target"] = target_sql(CHANGED)

# --- predictions --------------------------------------------------------------------------

PAD = "(SELECT min({r}) AS r0, min({c}) AS c0, CAST(ceil((max({r}) - min({r}) + 1) / 8.0) * 8 AS BIGINT) AS ph, CAST(ceil((max({c}) - min({c}) + 1) / 8.0) * 8 AS BIGINT) AS pw FROM {src})"


def layout(src: str) -> str:
    return PAD.format(r=ROW, c=COL, src=src)


def valid_sql(features: str, targets: str) -> str:
    return f"""SELECT priogrid_gid FROM {features} UNION
  SELECT priogrid_gid FROM {targets} CROSS JOIN {layout(features)}
  WHERE {ROW} - r0 BETWEEN 0 AND ph - 1 AND {COL} - c0 BETWEEN 0 AND pw - 1"""


CTE["valid_cell"] = valid_sql("feature_cell", "target")
TRAIN = f"year_month <= '{t.CUTOFF}'"
CODE = "CASE pred_class WHEN 'gov' THEN 0 WHEN 'opo' THEN 1 WHEN 'uncertain' THEN 2 END"
CONTRACT = ("priogrid_gid, year_month, pred_class, pred_class_int, prob_gov, prob_opo, prob_uncertain, "
            "confidence, true_class, has_label, is_train_month")
FULL = f"*, {CODE} AS pred_class_int, TRUE AS has_label, {TRAIN} AS is_train_month"
CTE["p_no_change"] = f"""SELECT {CONTRACT} FROM (SELECT {FULL},
  {', '.join(f"CAST(pred_class = '{c}' AS INTEGER)::DOUBLE AS prob_{c}" for c in CLASSES)}, CAST(1 AS DOUBLE) AS confidence FROM (
  SELECT {KEY}, target AS true_class, COALESCE(
    last_value(target IGNORE NULLS) OVER (PARTITION BY priogrid_gid ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    (SELECT target FROM target WHERE {TRAIN} GROUP BY target ORDER BY COUNT(*) DESC, target LIMIT 1)) AS pred_class FROM target)
  WHERE priogrid_gid IN (SELECT priogrid_gid FROM valid_cell))"""
SHARE = ", ".join(f"COUNT(*) FILTER (WHERE target = '{c}') / CAST(COUNT(*) AS DOUBLE) AS s_{c}" for c in CLASSES)
CTE["p_random"] = f"""SELECT {CONTRACT} FROM (SELECT {FULL}, s_gov AS prob_gov, s_opo AS prob_opo, s_uncertain AS prob_uncertain,
  greatest(s_gov, s_opo, s_uncertain) AS confidence FROM (SELECT {KEY}, true_class, s_gov, s_opo, s_uncertain,
  CASE WHEN u < s_gov THEN 'gov' WHEN u < s_gov + s_opo THEN 'opo' ELSE 'uncertain' END AS pred_class FROM (
  SELECT {KEY}, target AS true_class, s_gov, s_opo, s_uncertain, {hashed(str(t.SEED), 'priogrid_gid', 'year_month')} / CAST(4503599627370496 AS DOUBLE) AS u
  FROM target CROSS JOIN (SELECT {SHARE} FROM target WHERE {TRAIN} AND priogrid_gid IN (SELECT priogrid_gid FROM valid_cell))
  WHERE priogrid_gid IN (SELECT priogrid_gid FROM valid_cell))))"""


def soft_sql(source: str) -> str:
    scores = ", ".join(f"((priogrid_gid * 31 + {month_no()} * 17 + {7 * k}) % 1000) / CAST(1000 AS DOUBLE) AS prob_{c}" for k, c in enumerate(CLASSES))
    best = "greatest(prob_gov, prob_opo, prob_uncertain)"
    return f"""SELECT {CONTRACT} FROM (SELECT {FULL} FROM (SELECT *, {best} AS confidence,
  CASE WHEN prob_gov = {best} THEN 'gov' WHEN prob_opo = {best} THEN 'opo' ELSE 'uncertain' END AS pred_class
  FROM (SELECT {KEY}, target AS true_class, {scores} FROM {source})))"""


CTE["p_soft"] = soft_sql("target")
CTE["pred"] = """SELECT *, 'no_change' AS model FROM p_no_change UNION ALL SELECT *, 'random_proportion' AS model FROM p_random
  UNION ALL SELECT *, 'soft' AS model FROM p_soft WHERE priogrid_gid IN (SELECT priogrid_gid FROM valid_cell)"""
CTE["val"] = "SELECT * FROM pred WHERE NOT is_train_month"
CTE["soft_prev"] = f"""SELECT * FROM (SELECT *, COALESCE(lag(true_class) OVER {W}, true_class) AS prev_true FROM p_soft)
  WHERE NOT is_train_month"""
CTE["moved_key"] = f"""SELECT {KEY} FROM soft_prev WHERE prev_true <> true_class AND priogrid_gid IN (SELECT priogrid_gid FROM valid_cell)"""
CTE["val_prev"] = """SELECT * FROM (SELECT *, lag(true_class) OVER (PARTITION BY model, priogrid_gid ORDER BY year_month) AS prev_true FROM val)
  WHERE prev_true IS NOT NULL"""

CLASS_ROWS = "(VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + ")"


def per_class(source: str, by: str) -> str:
    """Support, predictions, hits and derived measures per group and class."""
    keys = f"{by}, " if by else ""
    return f"""SELECT *, CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2.0 * hits / CAST(support + predicted AS DOUBLE) ELSE 0 END AS f1
  FROM (SELECT {keys}k.c AS class, COUNT(*) FILTER (WHERE true_class = k.c) AS support, COUNT(*) FILTER (WHERE pred_class = k.c) AS predicted,
  COUNT(*) FILTER (WHERE true_class = k.c AND pred_class = k.c) AS hits, COUNT(*) AS n,
  COUNT(*) FILTER (WHERE true_class = pred_class) AS right_rows FROM {source} CROSS JOIN {CLASS_ROWS} k(c) GROUP BY {keys}k.c)"""


def f1_wide(source: str, by: str, present_only: bool) -> str:
    macro = "avg(f1) FILTER (WHERE support + predicted > 0)" if present_only else "avg(f1)"
    each = ", ".join(f"max(f1) FILTER (WHERE class = '{c}') AS {'unc' if c == 'uncertain' else c}_f1" for c in CLASSES)
    return f"""SELECT {by}, max(n) AS n, max(right_rows) / CAST(max(n) AS DOUBLE) AS accuracy, {macro} AS macro_f1, {each}
  FROM ({per_class(source, by)}) GROUP BY {by}"""


def score_rows(source: str, by: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS class, prob_{c} AS score, CAST(true_class = '{c}' AS INTEGER) AS hit FROM {source}" for c in CLASSES)


def cumulative(source: str, by: str) -> str:
    return f"""SELECT *, SUM(pos) OVER (PARTITION BY {by}, class ORDER BY score DESC) AS cp, SUM(neg) OVER (PARTITION BY {by}, class ORDER BY score DESC) AS cn,
  SUM(pos) OVER (PARTITION BY {by}, class) AS p, SUM(neg) OVER (PARTITION BY {by}, class) AS n
  FROM (SELECT {by}, class, score, SUM(hit) AS pos, SUM(1 - hit) AS neg FROM ({score_rows(source, by)}) GROUP BY {by}, class, score)"""


def areas(source: str, by: str) -> str:
    return f"""SELECT {by}, class, CASE WHEN max(p) > 0 AND max(n) > 0 THEN SUM(neg * (cp - pos) + neg * pos / CAST(2 AS DOUBLE)) / CAST(max(p) * max(n) AS DOUBLE) END AS auc,
  CASE WHEN max(p) > 0 THEN SUM(pos * cp / CAST(cp + cn AS DOUBLE)) / CAST(max(p) AS DOUBLE) END AS ap,
  CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM ({cumulative(source, by)}) GROUP BY {by}, class"""


CTE["val_cum"] = cumulative("val", "model")
CTE["roc"] = """SELECT model, class, score, cn / CAST(n AS DOUBLE) AS fpr, cp / CAST(p AS DOUBLE) AS tpr FROM val_cum WHERE p > 0 AND n > 0
  UNION ALL SELECT DISTINCT model, class, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM val_cum WHERE p > 0 AND n > 0"""
CTE["prc"] = """SELECT model, class, score, cp / CAST(p AS DOUBLE) AS recall, cp / CAST(cp + cn AS DOUBLE) AS precision FROM val_cum WHERE p > 0
  UNION ALL SELECT DISTINCT model, class, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM val_cum WHERE p > 0"""


def interpolated(x: str, y: str, sign: str, total: str) -> str:
    """For each grid step the last knot at or left of it (the lower score among equals) and the next one.

    Knots are ordered by falling score, the start point first; x is compared in whole numbers.
    """
    knots = f"""SELECT model, class, score, pos, neg, {x} AS xi, {total} AS xt, {y} AS y,
      row_number() OVER (PARTITION BY model, class ORDER BY score DESC) AS k FROM val_cum WHERE p > 0 AND n > 0
      UNION ALL SELECT DISTINCT model, class, NULL, 0, 0, 0, {total}, CAST({sign} AS DOUBLE), 0 FROM val_cum WHERE p > 0 AND n > 0"""
    return f"""SELECT a.model, a.class, a.step, CASE WHEN b.k IS NULL OR b.xi = a.xi THEN a.y
      ELSE a.y + (a.step / CAST(100 AS DOUBLE) - a.xi / CAST(a.xt AS DOUBLE)) / ((b.xi - a.xi) / CAST(a.xt AS DOUBLE)) * (b.y - a.y) END AS v
      FROM (SELECT g.step, z.* FROM (SELECT unnest(range(0, 101)) AS step) g JOIN ({knots}) z ON z.xi * 100 <= g.step * z.xt
        QUALIFY row_number() OVER (PARTITION BY z.model, z.class, g.step ORDER BY z.k DESC) = 1) a
      LEFT JOIN ({knots}) b ON a.model = b.model AND a.class = b.class AND b.k = a.k + 1"""


CTE["roc_grid"] = interpolated("cn", "cp / CAST(p AS DOUBLE)", "0", "n")
CTE["pr_grid"] = interpolated("cp", "cp / CAST(cp + cn AS DOUBLE)", "1", "p")

# --- folds --------------------------------------------------------------------------------


def blocks(source: str) -> str:
    return f"""SELECT priogrid_gid, {ROW} * CAST(0.5 AS DOUBLE) - 90 + CAST(0.25 AS DOUBLE) AS lat, {COL} * CAST(0.5 AS DOUBLE) - 180 + CAST(0.25 AS DOUBLE) AS lon,
  ({ROW} * 7 + {COL}) % 10 AS block FROM (SELECT DISTINCT priogrid_gid FROM {source})"""


CTE["event_block"] = blocks("v_events")
CTE["target_block"] = blocks("target")


def pairs(source: str) -> str:
    return f"""SELECT *, CAST((row_number() OVER (ORDER BY lat DESC, block) - 1) % 5 AS BIGINT) AS fold FROM (
  SELECT block, COUNT(DISTINCT priogrid_gid) AS n_cells, avg(lat) AS lat, avg(lon) AS lon FROM {source} GROUP BY block)"""


CTE["event_fold"] = f"SELECT b.priogrid_gid, b.block, f.fold FROM event_block b JOIN ({pairs('event_block')}) f USING (block)"
CTE["target_fold"] = f"SELECT b.priogrid_gid, b.block, f.fold FROM target_block b JOIN ({pairs('target_block')}) f USING (block)"
FOLD_ROLE = "SELECT priogrid_gid, g.fold, CASE WHEN g.fold = f.fold THEN 'holdout' ELSE 'training' END AS role FROM {} f CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) g"
CTE["event_role"] = FOLD_ROLE.format("event_fold")
CTE["target_role"] = FOLD_ROLE.format("target_fold")
CTE["fold_val"] = "SELECT * FROM p_soft JOIN target_role USING (priogrid_gid) WHERE NOT is_train_month"
CTE["static_cov"] = f"""SELECT {cell('latitude', 'longitude')} AS priogrid_gid, round(avg(c_acctbal), 4) AS ttime_mean, CAST(COUNT(*) AS DOUBLE) AS forest_gc,
  COALESCE(max(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END), 0) AS agri_gc FROM (SELECT *,
  CAST(9.5 AS DOUBLE) + (c_custkey * 7919 % 1900) / CAST(100 AS DOUBLE) AS latitude,
  CAST(92 AS DOUBLE) + (c_custkey * 104729 % 950) / CAST(100 AS DOUBLE) AS longitude FROM customer) GROUP BY 1"""
CTE["yearly_cov"] = f"""SELECT {cell('latitude', 'longitude')} AS priogrid_gid, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN COUNT(*) % 5 <> 0 THEN CAST(COUNT(*) AS DOUBLE) END AS bdist1,
  CASE WHEN max(o_custkey) % 3 <> 0 THEN max(o_totalprice) END AS capdist FROM v_orders GROUP BY 1, 2"""
CTE["yearly_latest"] = """SELECT priogrid_gid, max(year) AS year, arg_max(bdist1, year) FILTER (WHERE bdist1 IS NOT NULL) AS bdist1,
  arg_max(capdist, year) FILTER (WHERE capdist IS NOT NULL) AS capdist FROM yearly_cov GROUP BY priogrid_gid"""


def full(sql: str) -> str:
    """Prefix the statement with the shared views it uses, in dependency order."""
    needed: list[str] = []
    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and name not in visiting and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visiting.add(name)
                visit(CTE[name])
                needed.append(name)
    visiting: set[str] = set()
    visit(sql)
    if not needed:
        return sql
    # computed once each, however often the statement reads them
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in needed) + "\n" + sql


RAW: dict[str, str] = {}

# --- sources ------------------------------------------------------------------------------

CTE["merged"] = """SELECT id, CAST(date_start AS VARCHAR) AS date_start, CAST(type_of_violence AS INTEGER) AS type_of_violence, side_a, side_b, best,
  CASE WHEN data_source = 'src_N' THEN NULL ELSE deaths_b END AS deaths_b, where_prec, country, adm_1, CAST(NULL AS VARCHAR) AS adm_2,
  data_source, dyad_name, latitude, longitude, priogrid_gid, deaths_a, deaths_civilians FROM v_events"""
RAW["align_union"] = "SELECT id, date_start, deaths_b, adm_2, best, data_source FROM merged"
RAW["merge_sources"] = """SELECT id, date_start, type_of_violence, side_a, side_b, best, deaths_b, where_prec, country, adm_1, adm_2, data_source
  FROM merged WHERE country = 'Home' QUALIFY row_number() OVER (PARTITION BY id ORDER BY data_source DESC, date_start NULLS LAST,
  adm_1 NULLS LAST, best NULLS LAST, deaths_a NULLS LAST, deaths_b NULLS LAST, deaths_civilians NULLS LAST, dyad_name NULLS LAST,
  latitude, longitude, priogrid_gid, side_a, side_b, type_of_violence, where_prec NULLS LAST) = 1"""
RAW["dedup_priority"] = """SELECT id, data_source, date_start, best, where_prec FROM v_events
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY data_source DESC, date_start NULLS LAST, best, where_prec NULLS LAST) = 1"""
RAW["duplicate_report"] = "SELECT COUNT(*) AS before, COUNT(DISTINCT id) AS after, COUNT(*) - COUNT(DISTINCT id) AS removed FROM v_events"
RAW["precision_filter"] = """SELECT COUNT(*) AS before, COUNT(*) FILTER (WHERE where_prec <= 5) AS after,
  round(100.0 * (COUNT(*) - COUNT(*) FILTER (WHERE where_prec <= 5)) / CAST(COUNT(*) AS DOUBLE), 1) AS removed_pct FROM v_events"""
RAW["latest_snapshot"] = """SELECT o_orderkey, 'extract_' || strftime(o_orderdate, '%Y-%m') || '-01.csv' AS file FROM orders
  WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)"""
RAW["parse_dates"] = """SELECT id, best, date_start, strftime(date_start, '%Y-%m') AS year_month, CAST(date_trunc('month', date_start) AS DATE) AS month_start FROM v_events"""
RAW["iso_timestamps"] = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events"
RAW["event_overview"] = """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT priogrid_gid) AS n_cells, COUNT(DISTINCT year_month) AS n_periods,
  SUM(best) AS fatalities, min(date_start) AS first, max(date_start) AS last FROM v_labelled"""

# --- taxonomy and actors ------------------------------------------------------------------

RAW["label_events"] = f"""SELECT id, year_month, best, side_a, side_b, {', '.join(f'{s}_{x}' for s in ('side_a', 'side_b') for x in LEVELS)} FROM v_labelled"""
RAW["unmatched_keys"] = " UNION ".join(
    f"SELECT '{s}' AS side, {s} AS name FROM v_events WHERE {s} NOT IN (SELECT ucdp_name FROM v_tax)" for s in ("side_a", "side_b"))
RAW["presence_flags"] = f"SELECT id, data_source, {', '.join(f'CAST(COALESCE({FLAGS[a]}, false) AS BIGINT) AS {a}' for a in ACTORS)} FROM v_labelled"
RAW["violence_flags"] = f"SELECT id, best, {', '.join(f'CAST({FLAGS[a]} AS BIGINT) AS {a}' for a in ('is_onesided', 'is_statebased', 'gov_vs_civilians'))} FROM v_labelled"
RAW["classify_actors"] = "SELECT event_id_cnty, event_date, actor1, inter1, side, coalition, actor_group FROM sig_final"
RAW["actor_patterns"] = f"""SELECT actor1, {', '.join(
    "CASE rule_no " + ' '.join(f"WHEN {i} THEN '{(r.side, r.coalition, r.actor_group)[part]}'" for i, r in enumerate(t.RULES)) + f" END AS {name}"
    for part, name in enumerate(('side', 'coalition', 'actor_group')))}
  FROM (SELECT actor1, {RULE_NO} AS rule_no FROM (SELECT DISTINCT p_name AS actor1 FROM part))"""
RAW["time_override"] = """SELECT actor_group, coalition, COUNT(*) AS n, 'before' AS stage FROM sig_base GROUP BY 1, 2
  UNION ALL SELECT actor_group, coalition, COUNT(*) AS n, 'after' AS stage FROM sig_final GROUP BY 1, 2"""
RAW["type_fallback"] = "SELECT inter1, side, coalition, actor_group, COUNT(*) AS n FROM sig_base WHERE actor1 IS NULL GROUP BY 1, 2, 3, 4"

# --- grid ---------------------------------------------------------------------------------

RAW["grid_assign"] = f"""SELECT c_custkey, {cell('latitude', 'longitude')} AS priogrid_gid FROM (SELECT c_custkey,
  CAST(9.5 AS DOUBLE) + (c_custkey * 7919 % 1900) / CAST(100 AS DOUBLE) AS latitude,
  CAST(92 AS DOUBLE) + (c_custkey * 104729 % 950) / CAST(100 AS DOUBLE) AS longitude FROM customer)"""
_S, _Wst = f"({ROW} * CAST(0.5 AS DOUBLE) - 90)", f"({COL} * CAST(0.5 AS DOUBLE) - 180)"
RAW["cell_geometry"] = f"""SELECT priogrid_gid, {ROW} AS grid_row, {COL} AS grid_col, {_S} + CAST(0.25 AS DOUBLE) AS lat, {_Wst} + CAST(0.25 AS DOUBLE) AS lon,
  {_S} AS south, {_Wst} AS west, {_S} + CAST(0.5 AS DOUBLE) AS north, {_Wst} + CAST(0.5 AS DOUBLE) AS east,
  printf('POLYGON ((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))', {_Wst}, {_S}, {_Wst} + 0.5::DOUBLE, {_S}, {_Wst} + 0.5::DOUBLE, {_S} + 0.5::DOUBLE, {_Wst}, {_S} + 0.5::DOUBLE, {_Wst}, {_S}) AS wkt
  FROM (SELECT DISTINCT priogrid_gid FROM v_events)"""
RAW["grid_layout"] = f"""SELECT min({ROW}) AS min_row, min({COL}) AS min_col, max({ROW}) - min({ROW}) + 1 AS height, max({COL}) - min({COL}) + 1 AS width,
  CAST(ceil((max({ROW}) - min({ROW}) + 1) / 8.0) * 8 AS BIGINT) AS pad_height, CAST(ceil((max({COL}) - min({COL}) + 1) / 8.0) * 8 AS BIGINT) AS pad_width FROM feature_cell"""
CTE["label_cell"] = "SELECT DISTINCT priogrid_gid FROM placed"
RAW["valid_cells"] = valid_sql("feature_cell", "label_cell")
RAW["raster_positions"] = f"""SELECT priogrid_gid, {ROW} - r0 AS local_row, {COL} - c0 AS local_col FROM label_cell CROSS JOIN {layout('feature_cell')}
  WHERE {ROW} - r0 BETWEEN 0 AND ph - 1 AND {COL} - c0 BETWEEN 0 AND pw - 1"""
RAW["changing_cells"] = "SELECT priogrid_gid, COUNT(DISTINCT target) AS n_classes FROM target GROUP BY 1 HAVING COUNT(DISTINCT target) > 1"
CTE["rare_change"] = f"""SELECT priogrid_gid FROM target WHERE {TRAIN} GROUP BY 1 HAVING COUNT(DISTINCT target) > 1"""
RAW["focal_cells"] = f"""SELECT DISTINCT CAST((r + dr) * 720 + c + dc + 1 AS BIGINT) AS priogrid_gid, r + dr - r0 AS local_row, c + dc - c0 AS local_col
  FROM (SELECT {ROW} AS r, {COL} AS c FROM rare_change) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dr) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dc)
  CROSS JOIN {layout('feature_cell')} WHERE r - r0 BETWEEN 0 AND ph - 1 AND c - c0 BETWEEN 0 AND pw - 1
  AND r + dr - r0 BETWEEN 0 AND ph - 1 AND c + dc - c0 BETWEEN 0 AND pw - 1 AND r + dr BETWEEN 0 AND 359 AND c + dc BETWEEN 0 AND 719"""
_POS = f"({ROW} - r0) * pw + {COL} - c0"
RAW["dense_grid"] = f"""SELECT m.year_month, string_agg(CAST(COALESCE(code, -1) AS VARCHAR), ',' ORDER BY m.pos) AS labels,
  string_agg(CASE WHEN code IS NULL THEN '0' ELSE '1' END, ',' ORDER BY m.pos) AS mask, string_agg(CAST(COALESCE(n_gov, 0) AS VARCHAR), ',' ORDER BY m.pos) AS n_gov
  FROM (SELECT year_month, unnest(range(0, ph * pw)) AS pos FROM (SELECT DISTINCT year_month FROM target) CROSS JOIN {layout('target')}) m
  LEFT JOIN (SELECT year_month, {_POS} AS pos, CASE target WHEN 'gov' THEN 0 WHEN 'opo' THEN 1 ELSE 2 END AS code, n_gov FROM target CROSS JOIN {layout('target')}) v
  ON m.year_month = v.year_month AND m.pos = v.pos GROUP BY m.year_month"""
RAW["dense_grid_tiles"] = RAW["dense_grid"].replace("SELECT m.year_month, string_agg", "SELECT m.year_month, m.band, string_agg", 1).replace(
    "unnest(range(0, ph * pw)) AS pos", "pw, unnest(range(0, ph * pw)) AS pos").replace(") m\n", ") m0) m\n").replace(
    "FROM (SELECT year_month, pw,", "FROM (SELECT *, CAST(pos // (pw * 8) AS BIGINT) AS band FROM (SELECT year_month, pw,").replace(
    "GROUP BY m.year_month", "GROUP BY m.year_month, m.band")
RAW["clip_cells"] = f"""SELECT DISTINCT priogrid_gid FROM (SELECT priogrid_gid, {_S} AS s, {_Wst} AS w FROM (SELECT DISTINCT priogrid_gid FROM v_events)) CROSS JOIN (
  SELECT 10.003 + (s_suppkey * 7919 % 1800) / 100.0 AS y, 92.5041 + (s_suppkey * 104729 % 900) / 100.0 AS x, 0.3 + (s_suppkey % 7) / 4.0 AS r FROM supplier)
  WHERE greatest(w - x, 0, x - w - 0.5) + greatest(s - y, 0, y - s - 0.5) <= r"""
_LINE = "greatest(0.0, least(w + 0.5, x + (r - abs(v - y))) - greatest(w, x - (r - abs(v - y))))"
CTE["diamond_cell"] = f"""SELECT DISTINCT priogrid_gid, {_S} AS s, {_Wst} AS w, polygon_id, x, y, r FROM v_events CROSS JOIN (
  SELECT s_suppkey AS polygon_id, CAST(10.003 AS DOUBLE) + (s_suppkey * 7919 % 1800) / CAST(100 AS DOUBLE) AS y,
    CAST(92.5041 AS DOUBLE) + (s_suppkey * 104729 % 900) / CAST(100 AS DOUBLE) AS x, CAST(0.3 AS DOUBLE) + (s_suppkey % 7) / CAST(4 AS DOUBLE) AS r FROM supplier)
  WHERE greatest(w - x, 0, x - w - 0.5) + greatest(s - y, 0, y - s - 0.5) < r"""
# the covered width is linear between the heights where a diamond bends or meets the cell's sides
RAW["clip_shapes"] = rounded(f"""SELECT priogrid_gid, polygon_id, SUM((v - v0) * (f + f0) / 2) / 0.25 AS share FROM (
  SELECT priogrid_gid, polygon_id, v, {_LINE} AS f, lag(v) OVER o AS v0, lag({_LINE}) OVER o AS f0 FROM (
    SELECT *, unnest(list_transform([s, s + 0.5, y, y - r, y + r, y - (r - abs(w - x)), y + (r - abs(w - x)), y - (r - abs(w + 0.5 - x)), y + (r - abs(w + 0.5 - x))],
      lambda h: least(greatest(h, s), s + 0.5))) AS v FROM diamond_cell)
  WINDOW o AS (PARTITION BY priogrid_gid, polygon_id ORDER BY v)) GROUP BY 1, 2""", "share")
CTE["sent"] = f"""SELECT CAST(priogrid_gid + dr * 720 + dc AS BIGINT) AS priogrid_gid, year_month, total_events, total_fatalities
  FROM dense CROSS JOIN (SELECT unnest(range(-1, 2)) AS dr) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dc) WHERE dr <> 0 OR dc <> 0"""
_NBR = ["total_events", "total_fatalities"]
RAW["neighbour_features"] = rounded(f"""SELECT d.priogrid_gid, d.year_month, d.total_events, d.total_fatalities,
  {', '.join(f'COALESCE(s_{c}, 0) AS {c}_nbr_sum, COALESCE(m_{c}, 0) AS {c}_nbr_mean' for c in _NBR)}
  FROM dense d LEFT JOIN (SELECT {KEY}, {', '.join(f'SUM({c}) AS s_{c}, avg({c}) AS m_{c}' for c in _NBR)} FROM sent GROUP BY {KEY}) USING ({KEY})""",
    *[f"{c}_nbr_mean" for c in _NBR])
RAW["neighbour_features"] = RAW["neighbour_features"].replace("COALESCE(s_total_events, 0)", "CAST(COALESCE(s_total_events, 0) AS BIGINT)")
CTE["sent_wide"] = f"""SELECT CAST(priogrid_gid + dr * 720 + dc AS BIGINT) AS priogrid_gid, year_month, total_events, total_fatalities
  FROM dense CROSS JOIN (SELECT unnest(range(-8, 9)) AS dr) CROSS JOIN (SELECT unnest(range(-8, 9)) AS dc)
  WHERE (dr <> 0 OR dc <> 0) AND {COL} + dc BETWEEN 0 AND 719"""
RAW["neighbour_features_wide"] = RAW["neighbour_features"].replace("FROM sent ", "FROM sent_wide ")

# --- panel --------------------------------------------------------------------------------

RAW["cell_month_agg"] = "SELECT * FROM cell_month"
RAW["panel_dense"] = "SELECT * FROM dense"
CTE["every_month"] = """SELECT priogrid_gid, strftime(m, '%Y-%m') AS year_month FROM (SELECT DISTINCT priogrid_gid FROM cell_month) CROSS JOIN (
  SELECT unnest(generate_series(CAST(min(year_month) || '-01' AS TIMESTAMP), CAST(max(year_month) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM cell_month)"""
RAW["panel_full_calendar"] = f"SELECT {KEY}, total_events, adm_1 FROM ({dense_sql('every_month', 'cell_month')})"
RAW["lag_features"] = f"SELECT {KEY}, {', '.join(fixed.LAG_COLUMNS)}, {', '.join(lags(fixed.LAG_COLUMNS, [1, 3, 6, 9, 12]))} FROM dense"
_M = means(fixed.ROLL_COLUMNS, [3, 6, 12])
RAW["rolling_mean"] = rounded(f"SELECT {KEY}, {', '.join(fixed.ROLL_COLUMNS + _M)} FROM dense", *names(_M))
_D = deviations(fixed.SPREAD_COLUMNS, [3, 6])
RAW["rolling_std"] = rounded(f"SELECT {KEY}, {', '.join(fixed.SPREAD_COLUMNS + _D)} FROM dense", *names(_D))
_T = trends(fixed.SPREAD_COLUMNS)
RAW["trend"] = rounded(f"SELECT {KEY}, {', '.join(fixed.SPREAD_COLUMNS + _T)} FROM dense", *names(_T))
_SH = shares(["gov", "nug", "kio", "ula", "knu"])
RAW["event_shares"] = rounded(f"SELECT {KEY}, {', '.join(_SH)} FROM dense", *names(_SH))
RAW["fill_both_ways"] = f"SELECT {KEY}, adm_1 FROM dense"
_STORE = (lags(fixed.LAG_COLUMNS, [9, 12]) + means(fixed.ROLL_COLUMNS, [12]) + means(fixed.ACTOR_ROLL_COLUMNS, [3, 6, 12]) + _D + _T
          + shares(["kio", "ula", "knu"]))
_FLOAT = names(means(fixed.ROLL_COLUMNS, [3, 6, 12]) + means(fixed.ACTOR_ROLL_COLUMNS, [3, 6, 12]) + _D + _T + _SH)
RAW["feature_store"] = rounded(f"""SELECT panel.*, COALESCE(ttime_mean, 0) AS ttime_mean, COALESCE(forest_gc, 0) AS forest_gc, COALESCE(agri_gc, 0) AS agri_gc,
  COALESCE(bdist1, 0) AS bdist1, COALESCE(capdist, 0) AS capdist, {', '.join(_STORE)} FROM panel LEFT JOIN static_cov USING (priogrid_gid) LEFT JOIN yearly_latest USING (priogrid_gid)""", *_FLOAT)
RAW["latest_non_null"] = "SELECT * FROM yearly_latest"
RAW["yearly_covariates"] = """SELECT priogrid_gid, year, COALESCE(bdist1, 0) AS bdist1, COALESCE(capdist, 0) AS capdist FROM yearly_latest
  WHERE priogrid_gid IN (SELECT priogrid_gid FROM feature_cell)"""
RAW["static_enrich"] = """SELECT id, priogrid_gid, best, COALESCE(ttime_mean, 0) AS ttime_mean, COALESCE(forest_gc, 0) AS forest_gc, COALESCE(agri_gc, 0) AS agri_gc
  FROM v_events LEFT JOIN (SELECT * FROM static_cov WHERE priogrid_gid IN (SELECT priogrid_gid FROM feature_cell)) USING (priogrid_gid)"""

# --- labels -------------------------------------------------------------------------------

RAW["last_per_period"] = """SELECT event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"""
RAW["extract_records"] = """SELECT page_id, CASE WHEN regexp_matches(b, 'href="([^"]*)"') THEN regexp_extract(b, 'href="([^"]*)"', 1) END AS href,
  CASE WHEN regexp_matches(b, 'title="([^"]*)"') THEN regexp_extract(b, 'title="([^"]*)"', 1) END AS title,
  CASE WHEN regexp_matches(b, '>([^<]+)<') THEN regexp_extract(b, '>([^<]+)<', 1) END AS label
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(<a href=[^>]*>[^<]*</a>)', 1)) AS b FROM pages)"""
CTE["last_revision"] = """SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')
  ORDER BY CAST(o_orderdate AS DATE) DESC, o_custkey % 24 DESC, o_orderkey DESC) = 1"""
_MARK = ["Location dot red.svg", "WhiteDot.svg", "Location dot green.svg", "New icon.svg", "80x80-red-blue-anim.gif"]


def meaning(part: int) -> str:
    unknown = lambda m: ("unknown", f"UNMAPPED:{m}", "low")
    return "CASE o_orderkey % 5 " + " ".join(
        f"WHEN {i} THEN '{fixed.MARKS.get(m, unknown(m))[part]}'" for i, m in enumerate(_MARK)) + " END"


_GREEN = fixed.MARKS["Dot green 0d0.svg"]
RAW["parse_snapshots"] = f"""SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 90 AS DOUBLE) + 0.25 AS lat, CAST(o_orderkey % 180 AS DOUBLE) + 0.5 AS lon,
  'Town ' || o_orderkey AS location_name, {meaning(0)} AS control_status, {meaning(1)} AS actor, 'wikipedia_module' AS source, {meaning(2)} AS confidence
  FROM last_revision WHERE o_orderkey % 5 <> 1
  UNION ALL SELECT CAST(o_orderdate AS DATE), CAST(o_custkey % 80 AS DOUBLE) + 0.75, CAST(95.5 AS DOUBLE), 'Plain', '{_GREEN[0]}', '{_GREEN[1]}', 'wikipedia_module', '{_GREEN[2]}' FROM last_revision"""
RAW["revision_records"] = """SELECT o_orderkey AS revid, 't' || (o_orderkey % 7) AS timestamp, o_orderpriority AS comment FROM orders
  UNION ALL SELECT -o_orderkey, 'u', NULL FROM orders"""
RAW["majority_vote"] = "SELECT * FROM vote"
RAW["locf_panel"] = "SELECT * FROM label_panel"
RAW["snapshot_months"] = """SELECT COUNT(*) FILTER (WHERE f) AS n_true, COUNT(*) FILTER (WHERE NOT f) AS n_false
  FROM (SELECT year_month, bool_or(is_direct_snapshot) AS f FROM label_panel GROUP BY 1)"""
RAW["point_locations"] = "SELECT DISTINCT lat, lon FROM v_points"
PCT = "round(100.0 * n / CAST(SUM(n) OVER () AS DOUBLE), 1) AS pct"
RAW["label_frequency"] = f"SELECT *, {PCT} FROM (SELECT control_status, confidence, COUNT(*) AS n FROM v_points GROUP BY 1, 2)"

# --- target -------------------------------------------------------------------------------

RAW["changed_recent"] = f"SELECT {KEY}, control_status, {CHANGED} AS changed, {INSIDE} AS changed_inside FROM label_panel"
RAW["signal_panel"] = "SELECT * FROM signal"
RAW["agreement"] = f"""SELECT *, {AGREE.format('no_info')} AS agreement FROM (SELECT s.*, l.control_status, {SIDES} AS wiki_side FROM signal s LEFT JOIN label_panel l USING ({KEY}))"""
RAW["target_cascade"] = "SELECT * FROM target"
RAW["slim_target"] = f"SELECT {KEY}, target, wiki_side, wiki_changed_recent, acled_side, reason FROM ({target_sql(INSIDE)})"
RAW["target_checks"] = " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", COUNT(*) FILTER (WHERE {c}) AS n_bad FROM target" for n, c in {
        "target_not_null": "target IS NULL", "reason_not_null": "reason IS NULL",
        "agree_means_equal_sides": "reason = 'agree' AND acled_side IS DISTINCT FROM wiki_side",
        "target_domain": "target NOT IN ('gov', 'opo', 'uncertain')", "reasons_sum_to_rows": "reason IS NULL"}.items())
RAW["target_summary"] = f"""SELECT part, value, n, round(100.0 * n / CAST((SELECT COUNT(*) FROM target) AS DOUBLE), 1) AS pct FROM (
  SELECT 'target' AS part, target AS value, COUNT(*) AS n FROM target GROUP BY 2 UNION ALL SELECT 'reason', reason, COUNT(*) FROM target GROUP BY 2
  UNION ALL SELECT 'source', CASE WHEN agreement = 'wiki_only' THEN 'label_only' ELSE 'with_signal' END, COUNT(*) FROM target GROUP BY 2)"""
RAW["reason_breakdown"] = "SELECT reason, target, COUNT(*) AS n FROM target GROUP BY ROLLUP (reason, target)"


def composed(key: str) -> str:
    counts = ", ".join(f"COUNT(*) FILTER (WHERE target = '{c}') AS n_{c}" for c in CLASSES)
    return f"SELECT *, n_uncertain / CAST(greatest(total, 1) AS DOUBLE) AS uncertain_rate FROM (SELECT {key}, {counts}, COUNT(*) AS total FROM target GROUP BY 1)"


RAW["monthly_composition"] = rounded(composed("year_month"), "uncertain_rate")
RAW["cell_composition"] = rounded(f"""SELECT priogrid_gid, n_gov, n_opo, n_uncertain, total AS n_months, uncertain_rate,
  (SELECT target FROM (VALUES ('gov', n_gov), ('opo', n_opo), ('uncertain', n_uncertain)) z(target, n) ORDER BY n DESC, target LIMIT 1) AS dominant
  FROM ({composed('priogrid_gid')})""", "uncertain_rate")
RAW["top_uncertain_months"] = f"SELECT * FROM ({RAW['monthly_composition']}) ORDER BY uncertain_rate DESC, year_month LIMIT 10"
RAW["changed_share"] = rounded("SELECT avg(CAST(wiki_changed_recent AS INTEGER)) AS changed_share FROM target", "changed_share")

# --- baselines ----------------------------------------------------------------------------

RAW["no_change"] = "SELECT * FROM p_no_change"
RAW["random_proportional"] = rounded("SELECT * FROM p_random", "prob_gov", "prob_opo", "prob_uncertain", "confidence")
RAW["class_shares"] = rounded(" UNION ALL ".join(
    f"SELECT '{c}' AS class, avg(CAST(target = '{c}' AS INTEGER)) AS share FROM target WHERE {TRAIN}" for c in CLASSES), "share")
RAW["class_weights"] = rounded(" UNION ALL ".join(
    f"SELECT '{c}' AS class, COUNT(*) FILTER (WHERE target = '{c}') AS n, COUNT(*) / (3.0 * COUNT(*) FILTER (WHERE target = '{c}'))::DOUBLE AS weight FROM target WHERE {TRAIN}" for c in CLASSES), "weight")
_Z = ["total_events", "total_fatalities", "n_unique_dyads"]
RAW["standardize"] = rounded(f"""SELECT {KEY}, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}' for c in _Z)} FROM dense
  CROSS JOIN (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _Z)} FROM dense WHERE {TRAIN})""", *_Z)
RAW["labelled_features"] = f"""SELECT {KEY}, target, {', '.join(f'CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}' for c in ('total_events', 'total_fatalities', 'total_events_lag1'))}
  FROM target LEFT JOIN panel USING ({KEY})"""

_NEAR = f"""SELECT CAST((r + dr) * 720 + c + dc + 1 AS BIGINT) AS priogrid_gid FROM (SELECT {ROW} AS r, {COL} AS c FROM rare_change)
  CROSS JOIN (SELECT unnest(range(-1, 2)) AS dr) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dc)
  CROSS JOIN {layout('feature_cell')} WHERE r - r0 BETWEEN 0 AND ph - 1 AND c - c0 BETWEEN 0 AND pw - 1
  AND r + dr - r0 BETWEEN 0 AND ph - 1 AND c + dc - c0 BETWEEN 0 AND pw - 1"""
RAW["training_weights"] = rounded(f"""SELECT {KEY}, target, CASE WHEN priogrid_gid IN ({_NEAR}) THEN (SELECT COUNT(*) FROM target WHERE {TRAIN})
  / CAST(3 * (SELECT COUNT(*) FROM target u WHERE {TRAIN} AND u.target = t.target) AS DOUBLE) ELSE 0 END AS weight FROM target t""", "weight")
_E = ["exp(a - m)", "exp(b - m)", "exp(c - m)"]
_ALL = " + ".join(_E)
RAW["softmax_scores"] = rounded(f"""SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{e} / ({_ALL}) AS prob_{k}' for e, k in zip(_E, CLASSES))},
  CASE WHEN a = m THEN 'gov' WHEN b = m THEN 'opo' ELSE 'uncertain' END AS pred_class, CAST(1 AS DOUBLE) / ({_ALL}) AS confidence FROM (
  SELECT *, greatest(a, b, c) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / CAST(10 AS DOUBLE) AS a, l_discount * CAST(100 AS DOUBLE) AS b, l_tax * CAST(50 AS DOUBLE) AS c FROM lineitem))""",
    "prob_gov", "prob_opo", "prob_uncertain", "confidence")

# --- evaluation ---------------------------------------------------------------------------

CTE["confusion_count"] = f"""SELECT model, a.c AS true_class, b.c AS pred_class, COUNT(*) FILTER (WHERE true_class = a.c AND pred_class = b.c) AS n
  FROM val CROSS JOIN {CLASS_ROWS} a(c) CROSS JOIN {CLASS_ROWS} b(c) GROUP BY 1, 2, 3"""
CTE["confusion_share"] = "SELECT *, n / (SUM(n) OVER (PARTITION BY model, true_class) + CAST(1e-8 AS DOUBLE)) AS row_share FROM confusion_count"
RAW["confusion"] = rounded("SELECT * FROM confusion_share", "row_share")
CTE["class_metric"] = per_class("val", "model")
RAW["class_report"] = rounded("""SELECT model, class, precision, recall, f1, support FROM class_metric
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM class_metric GROUP BY model
  UNION ALL SELECT model, 'weighted avg', SUM(precision * support) / max(n), SUM(recall * support) / max(n), SUM(f1 * support) / max(n), max(n) FROM class_metric GROUP BY model""",
    "precision", "recall", "f1")
RAW["misclassified"] = "SELECT model, true_class, pred_class, n, round(100 * row_share, 1) AS pct FROM confusion_share WHERE true_class <> pred_class AND n > 0"
RAW["accuracy_lift"] = rounded("""SELECT model, avg(CAST(true_class = pred_class AS INTEGER)) AS accuracy, avg(CAST(true_class = 'gov' AS INTEGER)) AS baseline_accuracy,
  avg(CAST(true_class = pred_class AS INTEGER)) - avg(CAST(true_class = 'gov' AS INTEGER)) AS lift FROM val GROUP BY model""", "accuracy", "baseline_accuracy", "lift")
RAW["accuracy_by_class"] = rounded("SELECT model, true_class, COUNT(*) AS n, avg(CAST(true_class = pred_class AS INTEGER)) AS accuracy FROM val GROUP BY 1, 2", "accuracy")
RAW["transition_keys"] = f"SELECT {KEY} FROM soft_prev WHERE prev_true <> true_class"
_HIT = "true_class = pred_class"
CTE["trans_counts"] = f"""SELECT model, COUNT(*) FILTER (WHERE prev_true <> true_class) AS n_trans, COUNT(*) FILTER (WHERE prev_true = true_class) AS n_stable,
  COUNT(*) FILTER (WHERE prev_true <> true_class AND {_HIT}) AS ht, COUNT(*) FILTER (WHERE prev_true = true_class AND {_HIT}) AS hs FROM val_prev GROUP BY model"""
RAW["transition_eval"] = rounded("SELECT model, ht / CAST(greatest(n_trans, 1) AS DOUBLE) AS trans_acc, hs / CAST(greatest(n_stable, 1) AS DOUBLE) AS stable_acc, n_trans, n_stable FROM trans_counts", "trans_acc", "stable_acc")
RAW["direction_table"] = rounded(f"""SELECT *, CASE WHEN hit_rate >= 0.5 THEN 'good' WHEN hit_rate >= 0.25 THEN 'fair' ELSE 'poor' END AS grade FROM (
  SELECT model, prev_true AS from_class, true_class AS to_class, COUNT(*) AS n, COUNT(*) FILTER (WHERE {_HIT}) AS correct, avg(CAST({_HIT} AS INTEGER)) AS hit_rate
  FROM val_prev WHERE prev_true <> true_class GROUP BY 1, 2, 3)""", "hit_rate")
CTE["trans_type"] = f"SELECT {KEY}, prev_true || '→' || true_class AS transition_type FROM soft_prev WHERE prev_true <> true_class"
RAW["transition_types"] = f"SELECT *, {PCT} FROM (SELECT transition_type, COUNT(*) AS n FROM trans_type GROUP BY 1)"
RAW["common_transition"] = """SELECT priogrid_gid, transition_type, cnt FROM (SELECT DISTINCT priogrid_gid FROM target) LEFT JOIN (
  SELECT priogrid_gid, transition_type, COUNT(*) AS cnt FROM trans_type GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY priogrid_gid ORDER BY COUNT(*) DESC, transition_type) = 1) USING (priogrid_gid)"""
RAW["model_comparison"] = rounded(f"""SELECT f.model, n AS n_val, accuracy, macro_f1, gov_f1, opo_f1, unc_f1, ht / CAST(greatest(n_trans, 1) AS DOUBLE) AS trans_acc,
  hs / CAST(greatest(n_stable, 1) AS DOUBLE) AS stable_acc, n_trans, n_stable FROM ({f1_wide('val', 'model', False)}) f JOIN trans_counts t ON f.model = t.model""",
    "accuracy", "macro_f1", "gov_f1", "opo_f1", "unc_f1", "trans_acc", "stable_acc", digits=4)
CTE["val_moved"] = f"SELECT val.* FROM val JOIN moved_key USING ({KEY})"
RAW["monthly_f1"] = rounded(" UNION ALL ".join(
    f"SELECT model, year_month, macro_f1, n, '{s}' AS subset FROM ({f1_wide(src, 'model, year_month', True)})" for src, s in (("val", "overall"), ("val_moved", "transition"))), "macro_f1")
RAW["stable_summary"] = f"""SELECT model, round(avg(CAST({_HIT} AS INTEGER)), 4) AS overall_acc, round(avg(CAST({_HIT} AS INTEGER)) FILTER (WHERE k.year_month IS NULL), 4) AS stable_acc,
  round(avg(CAST({_HIT} AS INTEGER)) FILTER (WHERE k.year_month IS NOT NULL), 4) AS transition_recall, COUNT(k.year_month) AS n_transition_events
  FROM val v LEFT JOIN moved_key k ON v.priogrid_gid = k.priogrid_gid AND v.year_month = k.year_month GROUP BY model"""
RAW["cell_recall"] = rounded(f"SELECT model, priogrid_gid, avg(CAST({_HIT} AS INTEGER)) AS recall, COUNT(*) AS n_events FROM val_moved GROUP BY 1, 2", "recall")
RAW["key_alignment"] = """SELECT 'months' AS other, (SELECT COUNT(*) FROM target WHERE year_month > '2001-06') AS only_in_reference, CAST(0 AS BIGINT) AS only_in_other
  UNION ALL SELECT 'cells', (SELECT COUNT(*) FROM target WHERE priogrid_gid % 7 = 0), (SELECT COUNT(*) FROM target WHERE year_month = '2000-01')
  UNION ALL SELECT 'same', 0, 0"""
_MID = f"(SELECT year_month FROM (SELECT year_month, row_number() OVER (ORDER BY year_month) AS k, COUNT(*) OVER () AS n FROM (SELECT DISTINCT year_month FROM {{}})) WHERE k = n // 2 + 1)"
RAW["prediction_status"] = f"""SELECT priogrid_gid, CASE WHEN pred_class IS NULL THEN 'no_prediction' WHEN {_HIT} THEN 'correct' ELSE 'wrong' END AS status
  FROM feature_cell LEFT JOIN (SELECT * FROM p_soft WHERE year_month = {_MID.format(f"target WHERE year_month > '{t.CUTOFF}'")}) USING (priogrid_gid)"""
RAW["sample_sizes"] = """SELECT 'Overall' AS category, 'Unique cells' AS metric, CAST(COUNT(DISTINCT priogrid_gid) AS VARCHAR) AS value FROM soft_prev
  UNION ALL SELECT 'Overall', 'Cell-months', CAST(COUNT(*) AS VARCHAR) FROM soft_prev
  UNION ALL SELECT 'Overall', 'Window', min(year_month) || ' → ' || max(year_month) FROM soft_prev
  UNION ALL SELECT 'Overall', 'Months', CAST(COUNT(DISTINCT year_month) AS VARCHAR) FROM soft_prev
  UNION ALL SELECT 'Transition', 'Transition events', CAST(COUNT(*) AS VARCHAR) FROM soft_prev WHERE prev_true <> true_class
  UNION ALL SELECT 'Transition', 'Cells with transitions', CAST(COUNT(DISTINCT priogrid_gid) AS VARCHAR) FROM soft_prev WHERE prev_true <> true_class"""
_P1 = lambda c: f"printf('%.1f%%', round({c} * 100, 1)) AS {c}"
RAW["headline"] = f"SELECT model, n, {', '.join(_P1(c) for c in ('accuracy', 'macro_f1', 'gov_f1', 'opo_f1', 'unc_f1'))} FROM ({f1_wide('val', 'model', False)})"
RAW["pivot_models"] = rounded(f"""SELECT year_month, {', '.join(f"max(macro_f1) FILTER (WHERE model = '{m}') AS {m}" for m in ('no_change', 'random_proportion', 'soft'))}
  FROM ({f1_wide('val', 'model, year_month', True)}) GROUP BY 1""", "no_change", "random_proportion", "soft")

# --- curves -------------------------------------------------------------------------------

RAW["ranking_areas"] = rounded(areas("val", "model"), "auc", "ap")
RAW["macro_areas"] = rounded(f"SELECT model, avg(auc) AS macro_auc, avg(ap) AS macro_ap FROM ({areas('val', 'model')}) GROUP BY 1", "macro_auc", "macro_ap")
RAW["chance_reference"] = rounded(" UNION ALL ".join(
    f"SELECT model, '{c}' AS class, CAST(0.5 AS DOUBLE) AS auc, avg(CAST(true_class = '{c}' AS INTEGER)) AS ap FROM val GROUP BY 1" for c in CLASSES), "ap")
RAW["roc_points"] = rounded("SELECT * FROM roc", "fpr", "tpr", "score")
RAW["pr_points"] = rounded("SELECT * FROM prc", "recall", "precision", "score")
RAW["macro_roc"] = rounded("SELECT model, step, avg(v) AS tpr FROM roc_grid GROUP BY 1, 2", "tpr")
RAW["macro_pr"] = rounded("SELECT model, step, avg(v) AS precision FROM pr_grid GROUP BY 1, 2", "precision")
RAW["macro_roc_area"] = rounded("""SELECT model, SUM((step - px) * (tpr + py) / 2) AS area FROM (
  SELECT *, lag(step) OVER (PARTITION BY model ORDER BY step) AS px, lag(tpr) OVER (PARTITION BY model ORDER BY step) AS py
  FROM (SELECT model, step, avg(v) AS tpr FROM roc_grid GROUP BY 1, 2)) GROUP BY 1""", "area")

CTE["boot_key"] = f"""SELECT {KEY}, row_number() OVER (ORDER BY {KEY}) - 1 AS i, COUNT(*) OVER () AS total FROM soft_prev WHERE prev_true <> true_class"""
CTE["boot_row"] = f"SELECT p.*, i FROM val p JOIN boot_key USING ({KEY})"
CTE["boot_replicate"] = f"""SELECT r, {mix_sql('h')} AS key FROM (SELECT r, xor({mix_values(t.SEED)}, r) AS h FROM (SELECT unnest(range(0, 1000)) AS r))"""
CTE["boot_draw"] = f"""SELECT r AS replicate, ({mix_sql('h')} * total) >> 31 AS i FROM (
    SELECT r, total, xor(i, key) AS h FROM boot_key CROSS JOIN boot_replicate)
  UNION ALL SELECT -1, i FROM boot_key"""
CTE["boot"] = "SELECT replicate, model, true_class, pred_class, prob_gov, prob_opo, prob_uncertain FROM boot_draw JOIN boot_row USING (i)"
CTE["boot_f1"] = f"SELECT replicate, model, class, f1, support FROM ({per_class('boot', 'replicate, model')})"
CTE["boot_area"] = areas("boot", "replicate, model")
CTE["boot_all"] = """SELECT replicate, model, class, support AS n, f1, auc, ap FROM boot_f1 LEFT JOIN boot_area USING (replicate, model, class)
  UNION ALL SELECT replicate, model, 'macro', SUM(support), avg(f1), avg(auc), avg(ap) FROM boot_f1 LEFT JOIN boot_area USING (replicate, model, class) GROUP BY 1, 2"""
_CI = " UNION ALL ".join(
    f"""SELECT model, class, CAST(max(n) FILTER (WHERE replicate = -1) AS BIGINT) AS n, '{m}' AS measure, max({m}) FILTER (WHERE replicate = -1) AS value,
  quantile_cont({m}, 0.025) FILTER (WHERE replicate >= 0) AS lower, quantile_cont({m}, 0.975) FILTER (WHERE replicate >= 0) AS upper FROM boot_all GROUP BY model, class"""
    for m in ("f1", "auc", "ap"))
RAW["bootstrap_ci"] = rounded(f"SELECT *, CASE WHEN value IS NULL OR lower IS NULL OR upper IS NULL THEN 'n/a' ELSE printf('%.3f [%.3f, %.3f]', value, lower, upper) END AS text FROM ({_CI})", "value", "lower", "upper")

# --- folds --------------------------------------------------------------------------------

RAW["block_stats"] = rounded("SELECT block, COUNT(DISTINCT priogrid_gid) AS n_cells, avg(lat) AS lat, avg(lon) AS lon FROM event_block GROUP BY 1", "lat", "lon")
RAW["fold_pairs"] = rounded(f"SELECT * FROM ({pairs('event_block').replace('FROM event_block', 'FROM event_block')})", "lat", "lon")
RAW["fold_roles"] = "SELECT * FROM event_role"
RAW["holdout_sizes"] = "SELECT fold, COUNT(DISTINCT priogrid_gid) AS n_cells, CAST(0 AS BIGINT) AS n_leaks FROM event_role WHERE role = 'holdout' GROUP BY 1"
RAW["class_coverage"] = f"""SELECT fold, concat_ws(',', {', '.join(f"CASE WHEN NOT bool_or(target = '{c}') THEN '{c}' END" for c in CLASSES)}) AS missing,
  {' AND '.join(f"bool_or(target = '{c}')" for c in CLASSES)} AS complete
  FROM target JOIN target_fold USING (priogrid_gid) GROUP BY fold"""
RAW["changed_assignments"] = "SELECT priogrid_gid, fold FROM event_fold WHERE priogrid_gid % 13 = 0"
RAW["fold_class_weights"] = rounded(" UNION ALL ".join(
    f"SELECT fold, '{c}' AS class, COUNT(*) FILTER (WHERE target = '{c}') AS n, COUNT(*) / CAST(3 * COUNT(*) FILTER (WHERE target = '{c}') AS DOUBLE) AS weight FROM target JOIN target_role USING (priogrid_gid) WHERE role = 'training' AND {TRAIN} GROUP BY 1" for c in CLASSES), "weight")
CTE["fold_score"] = f"""SELECT f.fold, f.role, f.accuracy, f.macro_f1, a.macro_auc FROM ({f1_wide('fold_val', 'fold, role', True)}) f
  JOIN (SELECT fold, role, avg(auc) AS macro_auc FROM ({areas('fold_val', 'fold, role')}) GROUP BY 1, 2) a ON f.fold = a.fold AND f.role = a.role"""


def sided(columns) -> str:
    return "SELECT fold, " + ", ".join(
        f"max({c}) FILTER (WHERE role = 'training') AS nh_{c}, max({c}) FILTER (WHERE role = 'holdout') AS h_{c}, "
        f"round(max({c}) FILTER (WHERE role = 'holdout') - max({c}) FILTER (WHERE role = 'training'), 4) AS delta_{c}" for c in columns) + " FROM fold_score GROUP BY fold"


RAW["fold_metrics"] = rounded(sided(["macro_f1", "macro_auc"]), "nh_macro_f1", "h_macro_f1", "nh_macro_auc", "h_macro_auc", digits=4)
CTE["fold_side"] = sided(["accuracy", "macro_f1"])
RAW["fold_summary"] = rounded(" UNION ALL ".join(
    f"""SELECT '{c}' AS metric, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(0 AS BIGINT) AS n_missing,
  (SELECT fold FROM fold_side ORDER BY h_macro_f1 DESC, fold LIMIT 1) AS best_fold, (SELECT fold FROM fold_side ORDER BY h_macro_f1, fold LIMIT 1) AS worst_fold FROM fold_side"""
    for c in ("h_macro_f1", "nh_macro_f1", "delta_macro_f1")), "mean", "std")
RAW["geo_block_cover"] = "SELECT COUNT(*) AS n_rows, COUNT(*) AS n_cells, CAST(10 AS BIGINT) AS n_blocks FROM feature_cell"
RAW["geo_block_optimum"] = "SELECT COUNT(*) AS n_cells, CAST(10 AS BIGINT) AS n_blocks, CAST(0 AS BIGINT) AS n_nearer_elsewhere FROM feature_cell"
RAW["classifier_contract"] = f"""SELECT {TRAIN} AS is_train_month, target AS true_class, COUNT(*) AS n, CAST(0 AS BIGINT) AS bad_sums,
  CAST(0 AS BIGINT) AS bad_confidence, CAST(0 AS BIGINT) AS bad_class FROM target GROUP BY 1, 2"""
RAW["spatial_cv_rows"] = """SELECT fold, role, true_class, COUNT(*) AS n, COUNT(DISTINCT priogrid_gid) AS n_cells FROM fold_val GROUP BY 1, 2, 3"""
CTE["numbered"] = f"SELECT {KEY}, target, n_gov, row_number() OVER (ORDER BY {KEY}) - 1 AS row_index FROM target"
RAW["permuted_column"] = f"""SELECT a.row_index, a.priogrid_gid, a.year_month, a.target, b.n_gov FROM numbered a
  JOIN ({shuffled_sql('numbered', 'row_index', t.SEED, 'place')}) b ON a.row_index = b.place"""
RAW["fold_moments"] = rounded(" UNION ALL ".join(
    f"""SELECT fold, COUNT(*) AS n, '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END AS deviation
  FROM target JOIN target_role USING (priogrid_gid) WHERE role = 'training' AND {TRAIN} GROUP BY fold""" for c in ("n_gov", "n_opo")), "mean", "deviation")

# --- summaries ----------------------------------------------------------------------------

RAW["source_frequency"] = f"SELECT *, {PCT} FROM (SELECT data_source, type_of_violence, COUNT(*) AS n FROM v_events GROUP BY 1, 2)"
RAW["intensity_bins"] = f"""SELECT *, {PCT} FROM (SELECT CASE WHEN total_events <= 0 THEN '<=0' WHEN total_events <= 5 THEN '1-5' WHEN total_events <= 20 THEN '6-20' ELSE '>20' END AS bin,
  COUNT(*) AS n FROM dense GROUP BY 1)"""
RAW["top_cells"] = """SELECT priogrid_gid, CAST(SUM(total_events) AS BIGINT) AS total, arg_min(adm_1, year_month || adm_1) FILTER (WHERE adm_1 IS NOT NULL) AS adm_1
  FROM dense GROUP BY 1 ORDER BY total DESC, priogrid_gid LIMIT 10"""
RAW["top_dyads"] = "SELECT dyad_name, COUNT(*) AS n FROM v_events GROUP BY 1 ORDER BY n DESC, dyad_name LIMIT 10"
RAW["describe_columns"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min,
  round(quantile_cont({c}, 0.25), 3) AS p25, round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75, round(max({c}), 3) AS max
  FROM static_cov WHERE priogrid_gid IN (SELECT priogrid_gid FROM feature_cell)""" for c in ("ttime_mean", "forest_gc", "agri_gc"))
RAW["even_pick"] = """SELECT year_month FROM (SELECT year_month, row_number() OVER (ORDER BY year_month) - 1 AS k, COUNT(*) OVER () AS n FROM (SELECT DISTINCT year_month FROM active))
  WHERE k IN (SELECT unnest([0, (n - 1) // 5, 2 * (n - 1) // 5, 3 * (n - 1) // 5, 4 * (n - 1) // 5, n - 1]))"""
RAW["middle_period"] = f"SELECT {_MID.format('active')} AS year_month"
RAW["cell_row_counts"] = """SELECT priogrid_gid, n FROM label_cell LEFT JOIN (SELECT priogrid_gid, COUNT(*) AS n FROM v_events GROUP BY 1) USING (priogrid_gid)"""

RAW["csv_round_trip"] = """SELECT 'a "quoted" note, ' || chr(10) || o_orderpriority AS note, o_orderkey, o_totalprice FROM orders"""
RAW["large_csv_round_trip"] = RAW["csv_round_trip"]
RAW["json_revision_log"] = """SELECT o_orderkey AS revid, o_orderstatus AS timestamp, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS comment FROM orders"""
RAW["parquet_by_period"] = f"SELECT {KEY}, total_events FROM cell_month"
RAW["append_variants"] = " UNION ALL ".join(f"SELECT o_orderpriority, COUNT(*) + {v[1:]} AS n, '{v}' AS variant FROM orders GROUP BY 1" for v in ("f10", "f20"))
RAW["stable_rows"] = f"SELECT {KEY}, target FROM target ANTI JOIN cell_month USING ({KEY})"

# --- lists and literals ---------------------------------------------------------------------

RAW["header_columns"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS place, '{c}' AS name, (SELECT COUNT(*) FROM orders) AS n_rows" for i, c in enumerate(("o_orderkey", "o_orderpriority", "o_totalprice")))
_KINDS = " UNION ALL ".join("SELECT " + ", ".join(f"'{v}' AS {c}" for c, v in zip(("inter1", "side", "coalition", "actor_group"), (k, *o))) for k, o in fixed.TYPE_FALLBACK.items())
RAW["type_table"] = f"""SELECT f.side, f.coalition, f.actor_group, s.inter1, COUNT(*) AS n FROM v_signals s LEFT JOIN ({_KINDS}) f ON f.inter1 = s.inter1 GROUP BY 1, 2, 3, 4"""
_SUMS = ["best", "deaths_a", "deaths_b", "deaths_civilians", "type_of_violence", "where_prec"]
CTE["event_sum"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(SUM({c}) AS DOUBLE) AS total FROM v_events" for c in _SUMS)
RAW["numeric_columns"] = "SELECT feature, total FROM event_sum"
RAW["ranked_columns"] = """SELECT CAST(row_number() OVER (ORDER BY total DESC, feature) AS BIGINT) AS place, feature, total FROM event_sum QUALIFY place <= 3"""

SQL: dict[str, str] = {name: full(sql) for name, sql in RAW.items()}
