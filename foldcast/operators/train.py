"""Learned families as Spark jobs: boosted trees (M4), a seeded sequence model (M5), their whole walk (M11, M14) and its replay.

A *block* is one asset's sessions of a fold, in order, as bytes in one row, stored once. A *cell* is a small descriptor (fold, asset,
config, seed, iterations) that reads a block by its id; each is one grouped-map task, so tasks grow with folds, assets and the grid,
never with the windows of a cell: a cell cuts them out of its block.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import ContractError, direction, require_none
from foldcast.operators import boosting, forecast, metrics, sequences
from foldcast.operators.forecast import forecast_rows
from foldcast.sources.artifacts import stored

#: Tree candidates, the simpler first: fewer leaves, then larger ones.
TREES = {"leaves15_least50": boosting.Params(15, 50), "leaves15_least20": boosting.Params(15, 20), "leaves31_least50": boosting.Params(31, 50), "leaves31_least20": boosting.Params(31, 20)}
PARTS = ("train", "validation", "test")
CELL = ["fold", "asset", "config", "seed"]

#: (x, y, validation x, validation y, seed, frozen epochs or None) to (predictor, epochs). With frozen epochs there is no stop.
Fitter = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, "int | None"], tuple[Callable[[np.ndarray], np.ndarray], int]]
#: (block, rows to fit on, rows to forecast, config, seed, frozen iterations or None) to (forecasts, iterations, whether a stop was reached, rows
#: fitted on, rows that the forecasts are of), or None where nothing can be fitted or forecast.
CellFit = Callable[["Block", np.ndarray, np.ndarray, str, "str | None", "int | None"], "tuple[np.ndarray, int, bool, int, np.ndarray] | None"]


class Block:
    """A block's columns: ``part`` 0 to 2 as in ``PARTS`` (-1: history only), days, targets, and features (sessions x features)."""

    def __init__(self, part: bytes, origin: bytes, target: bytes, y: bytes, x: bytes) -> None:
        self.part = np.frombuffer(part, np.int8)
        self.origin, self.target = np.frombuffer(origin, np.int32), np.frombuffer(target, np.int32)
        self.y, self.x = np.frombuffer(y, np.float64), np.frombuffer(x, np.float64).reshape(len(self.part), -1)


def blocks(slices: DataFrame, history: DataFrame | None = None, features: Sequence[str] = C.FEATURES) -> DataFrame:
    """(fold, asset, part, origin, target, y, x) with the rows of ``slices`` in order of their days.

    ``history`` (F9) adds the sessions of the same assets that aren't in a fold's slices; they are never fitted on or forecast.
    """
    narrow = lambda d, *more: d.select(*more, *C.SAMPLE_KEY, "target_return", *(F.col(c).cast("double").alias(c) for c in features))
    part = F.array_position(F.array(*(F.lit(p) for p in PARTS)), F.col("partition")).cast("int") - 1
    if history is None:
        rows = narrow(slices, "fold", part.alias("part"))
    else:
        of = slices.select("fold", *C.SAMPLE_KEY, part.alias("part"))
        whole = narrow(history).join(slices.select("fold", "asset").distinct(), "asset")
        rows = whole.join(of, ["fold", *C.SAMPLE_KEY], "left").withColumn("part", F.coalesce("part", F.lit(-1)))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("origin_date", "ascending"), ("target_date", "ascending")])
        days = [t.column(c).cast(pa.int32()).to_numpy() for c in ("origin_date", "target_date")]
        x = np.stack([t.column(c).to_numpy().astype(np.float64) for c in features], 1)
        told = [t.column("part").to_numpy().astype(np.int8), *days, t.column("target_return").to_numpy().astype(np.float64), x]
        return pa.table({"fold": t.column("fold").slice(0, 1), "asset": t.column("asset").slice(0, 1)} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("part", "origin", "target", "y", "x"), told)})

    return rows.groupBy("fold", "asset").applyInArrow(pack, "fold string, asset string, part binary, origin binary, target binary, y binary, x binary")


_TOLD = "fold string, partition string, asset string, origin_date date, target_date date, target_return double, config string, seed string, predicted double, iteration int, stopped boolean, n_train long, fit_mae double, fit_rmse double, runtime double"


def run_cells(made: DataFrame, cells: DataFrame, fit: CellFit, fit_on: Sequence[str], told: str) -> DataFrame:
    """Fit each cell (fold, asset, config, seed, frozen) on the partitions ``fit_on`` of its block and forecast those of ``told``.

    A row a forecast, with the cell's iterations, rows, errors and seconds beside it. Cells without rows of either kind, or without a
    block, give none.
    """

    def one(t: pa.Table) -> pa.Table:
        began, row = time.perf_counter(), {c: t.column(c)[0].as_py() for c in t.column_names}
        b = Block(*(row[c] for c in ("part", "origin", "target", "y", "x")))
        own, out = np.flatnonzero(np.isin(b.part, [PARTS.index(p) for p in fit_on])), np.flatnonzero(b.part == PARTS.index(told))
        done = fit(b, own, out, row["config"], row["seed"], row["frozen"]) if len(own) and len(out) else None
        names = [f.split()[0] for f in _TOLD.split(", ")]
        if done is None:
            return pa.table({c: [] for c in names})
        predicted, iteration, stopped, fitted, at = done
        error = predicted - b.y[at]
        n, same = len(at), lambda v, kind=None: pa.array([v] * len(at), kind)
        values = [same(row["fold"]), same(told), same(row["asset"]), pa.array(b.origin[at], pa.date32()), pa.array(b.target[at], pa.date32()), pa.array(b.y[at]), same(row["config"]), same(row["seed"], pa.string()), pa.array(predicted), same(iteration, pa.int32()), same(stopped, pa.bool_())]
        values += [same(fitted, pa.int64()), same(float(np.abs(error).mean()) if n else None, pa.float64()), same(float(np.sqrt((error**2).mean())) if n else None, pa.float64()), same(time.perf_counter() - began)]
        return pa.table(values, names)

    return cells.join(made, ["fold", "asset"]).groupBy(*CELL).applyInArrow(one, _TOLD)


def tree_cell(b: Block, own: np.ndarray, out: np.ndarray, config: str, seed: str | None, frozen: int | None):
    """M4 in a cell: candidates stop on the rows that they forecast; refits have their trees frozen."""
    stop = out if frozen is None else out[:0]
    model = boosting.fit(b.x[own], b.y[own], b.x[stop], b.y[stop], TREES[config], frozen)
    return model.predict(b.x[out]), model.best_iteration, model.stopped, len(own), out


def linear_fitter(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, seed: int, frozen: int | None = None, epochs: int = 40, patience: int = 5, min_delta: float = 1e-6, rate: float = 0.01) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    """The default of M5: gradient descent on flattened windows, stopped when validation error stalls or after ``frozen`` epochs."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, x.shape[1]), 0.0
    best, best_w, best_b, best_epoch, waited = np.inf, w, b, 0, 0
    for epoch in range(1, (epochs if frozen is None else frozen) + 1):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            e = np.clip(x[at] @ w + b - y[at], -0.05, 0.05)
            w = w - rate * (x[at].T @ e / max(1, len(at)) + 1e-3 * w)
            b = b - rate * e.mean() if len(at) else b
        if frozen is not None:
            best_w, best_b, best_epoch = w, b, epoch
            continue
        error = float(np.abs(vx @ w + b - vy).mean()) if len(vx) else float(np.abs(x @ w + b - y).mean())
        if error < best - min_delta:
            best, best_w, best_b, best_epoch, waited = error, w, b, epoch, 0
        elif (waited := waited + 1) >= patience:
            break
    return (lambda z: z @ best_w + best_b), best_epoch


def sequence_cell(lengths: Mapping[str, int], fitter: Fitter = linear_fitter) -> CellFit:
    """M5 in a cell: windows (F13) of a context's length, scaled (F15, F16) by the rows that are fitted on.

    Endpoints are those with a whole window of the longest context, so that all contexts are judged on the same ones. A window may
    reach before its partition, never after its origin.
    """
    longest = max(lengths.values())

    def fit(b: Block, own: np.ndarray, out: np.ndarray, config: str, seed: str | None, frozen: int | None):
        mean, scale = b.x[own].mean(0), b.x[own].std(0)
        z = ((b.x.astype(np.float32) - mean) / np.where(scale < 1e-300, 1, scale)).astype(np.float32)
        fine = np.concatenate([[0], np.cumsum(np.isfinite(b.x.astype(np.float32)).all(1))])
        at = np.arange(len(z))
        whole = (at + 1 >= longest) & (fine[at + 1] - fine[np.maximum(at + 1 - longest, 0)] == longest)
        own, out, n = own[whole[own]], out[whole[out]], lengths[config]
        if not len(own) or not len(out):
            return None
        cut = lambda ends: z[ends[:, None] + np.arange(1 - n, 1)].reshape(len(ends), n * z.shape[1]).astype(float)
        stop = out if frozen is None else out[:0]
        predict, epochs = fitter(cut(own), b.y[own], cut(stop), b.y[stop], int(seed), frozen)
        return predict(cut(out)), epochs, frozen is None, len(own), out

    return fit


def _expected(slices: DataFrame, configs: Sequence[str], seeds: Sequence[str | None]) -> DataFrame:
    """The cells that a family must have: each config and seed for each fold and asset."""
    grid = F.array(*(F.struct(F.lit(c).alias("config"), F.lit(s).cast("string").alias("seed")) for c in configs for s in seeds))
    return slices.select("fold", "asset").distinct().withColumn("g", F.explode(grid)).select("fold", "g.config", "asset", "g.seed")


def audit_of(told: DataFrame) -> DataFrame:
    """M7 of cells' rows (:func:`run_cells`): counts, errors recomputed from the forecasts, what the fit told, and a digest of the keys."""
    e, up = F.col("predicted") - F.col("target_return"), F.col("target_return") > 0
    keys = F.sum(F.xxhash64("origin_date", "target_date").cast("decimal(38,0)"))
    return told.groupBy(*CELL).agg(
        F.count("*").alias("n_validation"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((up == (F.col("predicted") > 0)).cast("double")).alias("da"), F.count_if(up).alias("n_positive"), F.count_if(~up).alias("n_other"),
        F.max("n_train").alias("n_train"), F.max("iteration").alias("best_iteration"), F.max("runtime").alias("runtime"), F.max("fit_mae").alias("fit_mae"), F.max("fit_rmse").alias("fit_rmse"), keys.alias("key_sum"),
    ).withColumn("status", F.when(forecast.finite(F.col("mae")), "completed").otherwise("failed"))


def select(audit: DataFrame, expected: DataFrame, simplicity: DataFrame, tolerance: float = 1e-9) -> dict[str, DataFrame]:
    """Winners and the winners' iterations of audited candidates.

    Raises unless the grid is complete, all candidates of a fold and asset are judged on the same rows, and the
    errors that the fits told are those of their forecasts. One job checks all of it.
    """
    told = lambda d, problem: d.select("fold", "config", "asset", F.coalesce("seed", F.lit("")).alias("seed"), F.lit(problem).alias("problem"))
    gaps = forecast.grid_gaps(audit, expected)
    wrong = told(audit.where((F.abs(F.col("mae") - F.col("fit_mae")) > tolerance) | (F.abs(F.col("rmse") - F.col("fit_rmse")) > tolerance)), "errors of fit and forecasts differ")
    uneven = audit.groupBy("fold", "asset").agg(F.countDistinct("n_validation", "key_sum").alias("k")).where("k > 1").select("fold", F.lit("").alias("config"), "asset", F.lit("").alias("seed"), F.lit("judged on different rows").alias("problem"))
    require_none(gaps.unionByName(wrong).unionByName(uneven), "the candidate grid is not complete")
    winners = forecast.fold_winner(audit, simplicity)
    return {"audit": audit, "winners": winners, "iterations": forecast.winner_iterations(winners, audit)}


def _simplicity(slices: DataFrame, configs: Sequence[str]) -> DataFrame:
    return slices.sparkSession.createDataFrame([(c, k + 1) for k, c in enumerate(configs)], "config string, simplicity int")


def family(made: DataFrame, endpoints: DataFrame, configs: Sequence[str], seeds: Sequence[str | None], fit: CellFit, model: str) -> dict[str, DataFrame]:
    """Candidates, complete grid, one config a fold, refits with frozen iterations, refit audit and scores of stored blocks.

    ``endpoints`` has a row (fold, asset, partition) for each row that may be fitted on or forecast; the refit audit counts them. Simpler is the
    earlier in ``configs``. A seed is part of the grid and is never chosen. Stored on the way: the candidates'
    forecasts, their audit, and the test forecasts; nothing is fitted twice.
    """
    rows = lambda d: forecast_rows(d.withColumn("target_direction", direction(F.col("target_return"))), F.lit(model), F.col("config"), F.col("seed"), F.col("predicted"))
    expected = _expected(made, configs, seeds)
    told = stored(run_cells(made, expected.withColumn("frozen", F.lit(None).cast("int")), fit, ["train"], "validation"), "told")
    chosen = select(stored(audit_of(told), "audit"), expected, _simplicity(made, configs))
    chosen["winners"], chosen["iterations"] = (stored(chosen[k], k) for k in ("winners", "iterations"))
    refit = stored(run_cells(made, chosen["iterations"].select(*CELL, F.col("best_iteration").alias("frozen")), fit, ["train", "validation"], "test"), "refit")
    refits = refit.groupBy(*CELL).agg(F.max("n_train").alias("n_train"), F.max("iteration").alias("best_iteration"), F.max("runtime").alias("runtime"))
    forecasts = rows(refit)
    check = stored(forecast.refit_audit(endpoints, refits, forecasts, chosen["winners"], CELL, chosen["iterations"]), "refits")
    require_none(check.where("ok = 0"), "refits that don't add up")
    return chosen | {"validation": rows(told), "forecasts": forecasts, "refit_audit": check, "refits": refits, "told": told, "tested": refit, "scores": metrics.error_metrics(forecasts, ("model", "config", "seed", "fold", "asset"))}


def tree_family(slices: DataFrame) -> dict[str, DataFrame]:
    """M14 with M4. ``slices`` has the eligible rows of the development folds."""
    return family(stored(blocks(slices), "blocks"), slices, list(TREES), [None], tree_cell, "tree")


def sequence_family(sup: DataFrame, slices: DataFrame, lengths: Mapping[str, int], seeds: Sequence[str], fitter: Fitter = linear_fitter) -> dict[str, DataFrame]:
    """M14 with M5: contexts (the simpler first) and seeds."""
    if not lengths or not seeds:
        raise ContractError("a sequence family needs contexts and seeds")
    return family(stored(blocks(slices, sup), "blocks"), sequences.usable_endpoints(sup, slices, max(lengths.values())), list(lengths), list(seeds), sequence_cell(lengths, fitter), "sequence")


def cell_digests(run: Mapping[str, DataFrame]) -> DataFrame:
    """Per refitted cell a digest of its keys, its iterations, a digest of its forecasts and its errors.

    Digests are sums of hashes of rows, so they don't depend on the order of rows; forecasts go by their bits.
    """
    e = F.col("predicted") - F.col("target_return")
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    # errors are sums in no fixed order: twelve digits of them
    return run["tested"].groupBy(*CELL).agg(total("origin_date", "target_date").alias("keys"), F.max("iteration").alias("iterations"), total("origin_date", "target_date", "predicted").alias("forecasts"), F.round(F.avg(F.abs(e)), 12).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 12).alias("rmse"), F.max("n_train").alias("n_train"))


def replay(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs' digests cell by cell: 1 where both have the same keys, iterations, forecasts and metrics. A cell that one run lacks has zeros."""
    named = lambda d, x: d.select(*(F.col(c).alias(f"{x}_{c}") for c in CELL), F.struct(*(c for c in d.columns if c not in CELL)).alias(x))
    same_cell = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in CELL]
    both = named(first, "a").join(named(second, "b"), same_cell[0] & same_cell[1] & same_cell[2] & same_cell[3], "full")
    same = lambda *c: F.coalesce(*([F.least(*((F.col(f"a.{x}") == F.col(f"b.{x}")).cast("int") for x in c))] if len(c) > 1 else [(F.col(f"a.{c[0]}") == F.col(f"b.{c[0]}")).cast("int")]), F.lit(0))
    return both.select(*(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in CELL), same("keys").alias("same_keys"), same("iterations").alias("same_iterations"), same("forecasts").alias("same_forecasts"), same("mae", "rmse", "n_train").alias("same_metrics"))
