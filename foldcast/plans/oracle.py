"""Plain SQL for the registered queries, put together from named parts."""

from __future__ import annotations

import re

from foldcast import schema as C
from foldcast.operators.folds import DEFAULT

CONFIGS, SEEDS, LEAST = ("ret", "ret_mean_5", "ref_ret"), ("1", "2"), 40
ERRORS = "avg(abs(predicted_return - actual_return)) AS mae, sqrt(avg((predicted_return - actual_return) * (predicted_return - actual_return))) AS rmse, avg(CAST(predicted_direction = actual_direction AS INT)) AS da"
BASE_ERRORS = "avg(abs(baseline_return - actual_return)) AS baseline_mae, sqrt(avg((baseline_return - actual_return) * (baseline_return - actual_return))) AS baseline_rmse, avg(CAST(baseline_direction = actual_direction AS INT)) AS baseline_da"
METRICS = ("mae", "rmse", "da", "skill", "da_diff")


def _roll(value: str, w: int, how: str) -> str:
    f = "avg" if how == "mean" else "stddev_pop"
    return f"CASE WHEN count({value}) OVER w{w} = {w} THEN {f}({value}) OVER w{w} END"


def _windows(key: str) -> str:
    return "WINDOW w AS (PARTITION BY {k} ORDER BY date), ".format(k=key) + ", ".join(f"w{n} AS (PARTITION BY {key} ORDER BY date ROWS {n - 1} PRECEDING)" for n in C.WINDOWS)


def four(values, keep: str = "") -> str:
    return ", ".join(f"avg({v}) AS {v}_mean, stddev_pop({v}) AS {v}_std, min({v}) AS {v}_min, max({v}) AS {v}_max" for v in values)


def sign(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 1e-12 THEN 'positive' WHEN {x} < -1e-12 THEN 'negative' ELSE 'zero' END"


def contrast(cells: str, keys: str) -> str:
    pick = lambda m, s: f"max(CASE WHEN side = {s} THEN {m} END)"
    gap = lambda m, s=1: f"CASE WHEN ok THEN {s} * ({m}1 - {m}0) + 0.0 END"
    return f"""SELECT {keys}, dimension, n0 AS n_reference, n1 AS n_stressed, CASE WHEN ok THEN 'reportable' ELSE 'suppressed' END AS status,
      {gap('skill')} AS skill_change, {gap('mae')} AS mae_change, {gap('rmse')} AS rmse_change, {gap('da')} AS da_change, {gap('da', -1)} AS stability_loss FROM (
      SELECT {keys}, dimension, {pick('n', 0)} AS n0, {pick('n', 1)} AS n1, bool_and(coalesce(status = 'reportable', false)) AND count(*) = 2 AS ok,
      {', '.join(f"{pick(m, s)} AS {m}{s}" for m in ('skill', 'mae', 'rmse', 'da') for s in (0, 1))}
      FROM (SELECT *, CASE WHEN label IN ('positive', 'low', 'stable') THEN 0 ELSE 1 END AS side FROM {cells}) GROUP BY {keys}, dimension)"""


_DIMS = "(VALUES " + ", ".join(f"('{d}', '{v}')" for d, vs in C.DIMENSIONS.items() for v in vs) + ") d(dimension, label)"


def _long(table: str, ids: str) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{d}' AS dimension, {d} AS label FROM {table}" for d in C.DIMENSIONS)


def _fit(rows: str) -> str:
    one = " UNION ALL ".join(f"SELECT fold, asset, '{c}' AS config, origin_date, target_return, {c} AS x FROM {rows}" for c in CONFIGS)
    return f"""SELECT fold, asset, config, seed, coalesce(regr_slope(target_return, x), 0) AS slope,
      avg(target_return) - coalesce(regr_slope(target_return, x), 0) * avg(x) AS intercept, count(*) FILTER (copy = 1) AS n_train FROM (
      SELECT *, NULL AS seed, 1 AS copy FROM ({one}) UNION ALL SELECT a.*, s AS seed, copy FROM ({one}) a, (VALUES ('1'), ('2')) t(s), (VALUES (1), (2)) k(copy)
      WHERE copy = 1 OR ('0x' || substr(md5(asset || '|' || CAST(origin_date AS VARCHAR) || '|' || s), 1, 8))::BIGINT % 2 = 1) GROUP BY fold, asset, config, seed"""


def _predict(rows: str, fits: str) -> str:
    one = " UNION ALL ".join(f"SELECT fold, partition, asset, origin_date, target_date, target_return, target_direction, '{c}' AS config, {c} AS x FROM {rows}" for c in CONFIGS)
    return f"""SELECT CASE WHEN f.seed IS NULL THEN 'plain' ELSE 'seeded' END AS model, f.config, f.seed, fold, partition, asset, origin_date, target_date, target_return AS actual_return,
      intercept + slope * x AS predicted_return, target_direction AS actual_direction, CASE WHEN intercept + slope * x > 0 THEN 1 ELSE 0 END AS predicted_direction
      FROM ({one}) r JOIN {fits} f USING (fold, asset, config)"""


PARTS = {
    "panel": """SELECT date, asset, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume FROM (
      SELECT CAST(l_shipdate AS DATE) AS date, unnest([l_returnflag, 'MKT']) AS asset, CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_quantity AS DOUBLE) AS q,
      row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE isodow(date) < 6 GROUP BY date, asset""",
    "ragged": """SELECT date, asset, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM (
      SELECT CAST(o_orderdate AS DATE) AS date, unnest([c_mktsegment, 'MKT']) AS asset, o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS p
      FROM orders JOIN customer ON o_custkey = c_custkey) WHERE isodow(date) < 6 GROUP BY date, asset""",
    "targets": """SELECT * FROM (SELECT asset, date AS origin_date, lead(date) OVER w AS target_date, ln(lead(close) OVER w / close) AS target_return,
      CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS target_direction FROM panel WHERE asset <> 'MKT'
      WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE target_date IS NOT NULL""",
    "own": f"""SELECT asset, date AS origin_date, ret, lag(ret) OVER w AS ret_lag, {', '.join(f"{_roll(v, n, how)} AS {x}_{how}_{n}" for n in C.WINDOWS for x, v in (('ret', 'ret'), ('vol', 'volume')) for how in ('mean', 'std'))}
      FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS ret FROM panel WHERE asset <> 'MKT') {_windows('asset')}""",
    "ref": f"""SELECT date AS origin_date, ret AS ref_ret, lag(ret) OVER w AS ref_ret_lag, {', '.join(f"{_roll('ret', n, how)} AS ref_{how}_{n}" for n in C.WINDOWS for how in ('mean', 'std'))},
      ln(close / lag(close, {C.TREND}) OVER w) AS ref_trend_{C.TREND}, 1 AS ref_observed
      FROM (SELECT *, ln(close / lag(close) OVER (ORDER BY date)) AS ret FROM panel WHERE asset = 'MKT') {_windows('asset')}""",
    "sup": f"""SELECT asset, origin_date, target_date, target_return, target_direction, {', '.join(C.FEATURES)}, coalesce(ref_observed, 0) AS ref_observed,
      CASE WHEN {' AND '.join(f'{f} IS NOT NULL' for f in C.FEATURES)} AND coalesce(ref_observed, 0) = 1 THEN 1 ELSE 0 END AS eligible
      FROM targets JOIN own USING (asset, origin_date) LEFT JOIN ref USING (origin_date)""",
    "folds": "SELECT fold, partition, CAST(a AS DATE) AS start, CAST(b AS DATE) AS stop, role FROM (VALUES " + ", ".join(str(r) for r in DEFAULT) + ") t(fold, partition, a, b, role)",
    "assigned": "SELECT fold, partition, role, s.* FROM sup s JOIN folds f ON target_date BETWEEN start AND stop WHERE NOT (role = 'holdout' AND partition = 'test')",
    "slices": "SELECT * FROM assigned WHERE eligible = 1",
    "dev": "SELECT * FROM slices WHERE role = 'development'",
    "base": """SELECT fold, partition, asset, origin_date, target_date, target_return AS actual_return, 0.0::DOUBLE AS predicted_return,
      target_direction AS actual_direction, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS predicted_direction FROM dev WHERE partition = 'test'""",
    "train_rows": "SELECT * FROM dev WHERE partition = 'train'",
    "validation_rows": "SELECT * FROM dev WHERE partition = 'validation'",
    "refit_rows": "SELECT * FROM dev WHERE partition <> 'test'",
    "test_rows": "SELECT * FROM dev WHERE partition = 'test'",
    "fits": _fit("train_rows"),
    "refits": _fit("refit_rows"),
    "val": _predict("validation_rows", "fits"),
    "audit": f"""SELECT v.model, v.fold, v.config, v.asset, v.seed, n_validation, mae, rmse, da, n_positive, n_train, CASE WHEN mae IS NOT NULL THEN 'completed' ELSE 'failed' END AS status FROM (
      SELECT model, fold, config, asset, seed, count(*) AS n_validation, {ERRORS}, count(*) FILTER (actual_direction = 1) AS n_positive FROM val GROUP BY ALL) v
      LEFT JOIN fits f ON v.fold = f.fold AND v.config = f.config AND v.asset = f.asset AND v.seed IS NOT DISTINCT FROM f.seed""",
    "macro_audit": """SELECT model, fold, config, count(*) AS n_assets, avg(mae) AS macro_mae, avg(rmse) AS macro_rmse FROM (
      SELECT model, fold, config, asset, avg(mae) AS mae, avg(rmse) AS rmse FROM audit GROUP BY ALL) GROUP BY ALL""",
    "winners": """SELECT *, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS selected, CASE WHEN rn > 1 THEN 'not_selected' WHEN n_tied = 1 THEN 'lowest_error' ELSE 'tie_break' END AS reason FROM (
      SELECT *, sum(tied) OVER (PARTITION BY model, fold) AS n_tied, row_number() OVER (PARTITION BY model, fold ORDER BY tied DESC, CASE WHEN tied = 1 THEN simplicity ELSE 0 END, CASE WHEN tied = 1 THEN macro_rmse ELSE macro_mae END, config) AS rn FROM (
      SELECT *, CASE WHEN delta <= 1e-5 THEN 1 ELSE 0 END AS tied FROM (
      SELECT m.*, s.simplicity, macro_mae - min(macro_mae) OVER (PARTITION BY model, fold) AS delta FROM macro_audit m JOIN (VALUES ('ret', 1), ('ret_mean_5', 2), ('ref_ret', 3)) s(config, simplicity) USING (config))))""",
    "won": "SELECT model, fold, config FROM winners WHERE selected = 1",
    "learned": f"SELECT p.* FROM ({_predict('test_rows', 'refits')}) p JOIN won USING (model, fold, config)",
    "matched": "SELECT l.*, b.predicted_return AS baseline_return, b.predicted_direction AS baseline_direction FROM learned l LEFT JOIN base b USING (fold, asset, origin_date, target_date)",
    "cells": f"SELECT *, 1 - mae / nullif(baseline_mae, 0) AS skill, da - baseline_da AS da_diff FROM (SELECT model, seed, fold, asset, count(*) AS n, {ERRORS}, {BASE_ERRORS} FROM matched GROUP BY ALL)",
    "macro": f"SELECT model, seed, fold, count(*) AS n_assets, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'CASE WHEN count(*) = 3 AND count({v}) = 3 THEN avg({v}) END AS {v}' for v in METRICS)} FROM cells GROUP BY model, seed, fold",
    "seed_cells": f"SELECT model, fold, asset, count(*) AS n_seeds, CASE WHEN count(DISTINCT seed) = 2 AND count(*) = 2 AND min(n) = max(n) THEN 1 ELSE 0 END AS seeds_ok, max(n) AS n, {four(METRICS)} FROM cells WHERE seed IS NOT NULL GROUP BY model, fold, asset",
    "inputs": """SELECT *, CASE WHEN vol IS NOT NULL AND vol_lag > 0 THEN vol / vol_lag END AS jump FROM (SELECT *, lag(vol, 21) OVER (ORDER BY origin_date) AS vol_lag FROM (
      SELECT origin_date, ref_trend_63 AS trend, ref_std_21 * sqrt(252.0::DOUBLE) AS vol, abs(ref_ret) AS abs_ret, lead(origin_date) OVER (ORDER BY origin_date) AS target_date FROM ref))""",
    "limits": """SELECT fold, quantile_cont(vol, 0.5) AS vol_median, quantile_cont(abs_ret, 0.95) AS ret_q95, count(vol) AS n_vol, count(abs_ret) AS n_ret, min(origin_date) AS first_origin, max(origin_date) AS last_origin
      FROM inputs JOIN (SELECT fold, min(start) AS start, max(stop) AS stop FROM folds WHERE partition <> 'test' GROUP BY fold) ON target_date BETWEEN start AND stop GROUP BY fold""",
    "labels": """SELECT fold, origin_date, trend, vol, vol_lag, jump, abs_ret, vol_median, ret_q95, CAST(jump >= 1.5 AS INT) AS jumped, CAST(abs_ret > ret_q95 AS INT) AS shock,
      CASE WHEN trend IS NULL THEN 'unavailable' WHEN trend > 0 THEN 'positive' ELSE 'negative' END AS trend_regime,
      CASE WHEN vol IS NULL OR vol_median IS NULL THEN 'unavailable' WHEN vol > vol_median THEN 'high' ELSE 'low' END AS volatility_regime,
      CASE WHEN jump IS NULL AND (abs_ret IS NULL OR ret_q95 IS NULL) THEN 'unavailable' WHEN coalesce(jump >= 1.5, false) OR coalesce(abs_ret > ret_q95, false) THEN 'stressed' ELSE 'stable' END AS transition_regime
      FROM (SELECT DISTINCT fold, origin_date FROM base) LEFT JOIN inputs USING (origin_date) LEFT JOIN limits USING (fold)""",
    "base_labelled": "SELECT b.*, trend_regime, volatility_regime, transition_regime FROM base b LEFT JOIN labels USING (fold, origin_date)",
    "matched_labelled": "SELECT m.* REPLACE (coalesce(seed, '') AS seed), trend_regime, volatility_regime, transition_regime FROM matched m LEFT JOIN labels USING (fold, origin_date)",
    "base_cells": f"""SELECT fold, asset, dimension, label, coalesce(n, 0) AS n, mae, rmse, da, coalesce(n_positive, 0) AS n_positive, CASE WHEN coalesce(n, 0) >= {LEAST} THEN 'reportable' ELSE 'suppressed' END AS status
      FROM (SELECT DISTINCT fold, asset FROM base_labelled) CROSS JOIN {_DIMS} LEFT JOIN (
      SELECT fold, asset, dimension, label, count(*) AS n, {ERRORS}, count(*) FILTER (actual_direction = 1) AS n_positive
      FROM ({_long('base_labelled', 'fold, asset, actual_return, predicted_return, actual_direction, predicted_direction')}) GROUP BY ALL) USING (fold, asset, dimension, label)""",
    "rcells": f"""SELECT model, seed, fold, asset, dimension, label, coalesce(n, 0) AS n, mae, rmse, da, baseline_mae, baseline_rmse, baseline_da, 1 - mae / nullif(baseline_mae, 0) AS skill, da - baseline_da AS da_diff,
      CASE WHEN coalesce(n, 0) >= {LEAST} THEN 'reportable' ELSE 'suppressed' END AS status
      FROM (SELECT DISTINCT model, seed, fold, asset FROM matched_labelled) CROSS JOIN {_DIMS} LEFT JOIN (
      SELECT model, seed, fold, asset, dimension, label, count(*) AS n, {ERRORS}, {BASE_ERRORS}
      FROM ({_long('matched_labelled', 'model, seed, fold, asset, actual_return, predicted_return, actual_direction, predicted_direction, baseline_return, baseline_direction')}) GROUP BY ALL) USING (model, seed, fold, asset, dimension, label)""",
    "contrasts": contrast("rcells", "model, seed, fold, asset"),
    "rmacro": f"""SELECT model, seed, fold, dimension, label, count(*) FILTER (status = 'reportable') AS n_reportable, CAST(sum(n) AS BIGINT) AS n,
      CASE WHEN count(*) = 3 AND bool_and(status = 'reportable') THEN 'reportable' ELSE 'suppressed' END AS status,
      {', '.join(f"CASE WHEN count(*) = 3 AND bool_and(status = 'reportable') THEN avg({v}) END AS {v}" for v in METRICS)} FROM rcells GROUP BY model, seed, fold, dimension, label""",
    "mcontrasts": contrast("rmacro", "model, seed, fold"),
}


def _needs(text: str, seen: list[str], above: tuple[str, ...] = ()) -> None:
    for name in PARTS:
        if name not in seen and name not in above and re.search(rf"\b{name}\b(?!\s*\()", re.sub(r"'[^']*'", "", text)):
            _needs(PARTS[name], seen, (*above, name))
            if name not in seen:
                seen.append(name)


def sql(body: str, doubles: str = "", places: int = 9) -> str:
    """``body`` with the parts that it names, doubles rounded and without negative zero."""
    seen: list[str] = []
    _needs(body, seen)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in seen)
    if doubles:
        body = f"SELECT * REPLACE ({', '.join(f'round({d}, {places}) + 0.0 AS {d}' for d in doubles.split())}) FROM ({body})"
    return f"WITH {parts}\n{body}" if parts else body
