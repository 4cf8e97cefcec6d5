"""The walks of the learned families against brute force on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import ContractError
from foldcast.operators import boosting, forecast, train
from foldcast.plans.queries import CONTEXTS, Tables

SEEDS = ("1", "2")


@pytest.fixture(scope="module")
def tables(spark, sf):
    return Tables(spark, sf)


def flat_windows(sup, rows, length, features):
    """{(asset, origin_date): flat window} of the endpoints in ``rows`` that have a full one."""
    out = {}
    for asset, own in sup[sup["asset"] == rows["asset"].iloc[0]].groupby("asset"):
        own = own.sort_values("origin_date")
        x = own[list(features)].to_numpy(dtype=np.float32)
        for i, day in enumerate(own["origin_date"]):
            if i + 1 >= length and np.isfinite(x[i + 1 - length : i + 1]).all():
                out[(asset, day)] = x[i + 1 - length : i + 1]
    return out


def test_sequence_walk_equals_brute_force(spark, tables):
    got = {(r["config"], r["seed"], r["fold"], r["asset"]): (r["n"], r["mae"]) for r in train.sequence_family(tables.sup, tables.dev, CONTEXTS, SEEDS)["scores"].collect()}
    sup, dev = tables.sup.toPandas(), tables.dev.toPandas()
    longest = max(CONTEXTS.values())
    want = {}
    for fold, of_fold in dev.groupby("fold"):
        audit, cells = {}, {}
        for asset, rows in of_fold.groupby("asset"):
            raw = flat_windows(sup, rows, longest, C.FEATURES)
            rows = rows.sort_values("origin_date")

            def part(names, fitted_on, length):
                own = rows[rows["partition"].isin(fitted_on)][list(C.FEATURES)].to_numpy(dtype=float)
                mean, scale = own.mean(0), own.std(0)
                told = [(((raw[(asset, d)].astype(float) - mean) / np.where(scale == 0, 1, scale)).astype(np.float32).astype(float)[-length:].ravel(), y) for d, y, p in zip(rows["origin_date"], rows["target_return"], rows["partition"]) if p in names and (asset, d) in raw]
                return np.stack([x for x, _ in told]), np.array([y for _, y in told])

            for config, n in CONTEXTS.items():
                for seed in SEEDS:
                    (x, y), (vx, vy) = part(["train"], ["train"], n), part(["validation"], ["train"], n)
                    model, epochs = train.linear_fitter(x, y, vx, vy, int(seed))
                    audit.setdefault(config, []).append(np.abs(model(vx) - vy).mean())
                    (x, y), (tx, ty) = part(["train", "validation"], ["train", "validation"], n), part(["test"], ["train", "validation"], n)
                    model, _ = train.linear_fitter(x, y, x[:0], y[:0], int(seed), epochs)
                    cells[(config, seed, fold, asset)] = (len(ty), np.abs(model(tx) - ty).mean())
        won = min(CONTEXTS, key=lambda c: np.mean(audit[c]))
        want |= {k: v for k, v in cells.items() if k[0] == won}
    assert set(got) == set(want) and len(got) == 12
    for k, (n, mae) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(mae, rel=1e-6)


def test_refits_never_see_test_rows(spark, tables):
    """Other returns and features on test rows change neither a fit nor another row's forecast."""
    dev = tables.dev.where("fold = 'D2'")
    is_test = F.col("partition") == "test"
    cells = dev.select("fold", "asset").distinct().withColumns({"config": F.lit("L5"), "seed": F.lit("1"), "frozen": F.lit(3)})
    trees = cells.withColumn("config", F.lit("leaves15_least20"))
    sequence = train.sequence_cell({"L5": 5})
    told = lambda d, c, fit, sup=None: {(r["asset"], r["origin_date"]): r["predicted"] for r in train.run_cells(train.blocks(d, sup), c, fit, ["train", "validation"], "test").collect()}
    moved = dev.withColumn("target_return", F.when(is_test, 9.0).otherwise(F.col("target_return")))
    first = told(dev, trees, train.tree_cell)
    assert first and first == told(moved, trees, train.tree_cell)
    # windows come from the history, so its targets are moved there
    late = tables.sup.withColumn("target_return", F.when(F.col("target_date") >= "2000-01-01", 9.0).otherwise(F.col("target_return")))
    first = told(dev, cells, sequence, tables.sup)
    assert first and first == told(dev, cells, sequence, late)
    # features of later sessions don't reach earlier forecasts
    louder = tables.sup.withColumns({f: F.when(F.col("origin_date") >= "2000-07-01", F.col(f) * 5).otherwise(F.col(f)) for f in C.FEATURES})
    second = told(dev, cells, sequence, louder)
    early = {k for k in first if str(k[1]) < "2000-07-01"}
    assert early and all(first[k] == second[k] for k in early) and first != second


def _slow_tree(codes, residual, p):
    """Best-first growth with exhaustive splits: the values of the rows."""
    sign, leaves = np.sign(residual), [np.arange(len(codes))]

    def best(own):
        out, g = (1e-12, None), sign[own].sum()
        for f in range(codes.shape[1]):
            for b in sorted(set(codes[own, f])):
                left = codes[own, f] <= b
                n, m, gl = left.sum(), (~left).sum(), sign[own][left].sum()
                if n >= p.least and m >= p.least:
                    gain = gl**2 / (n + p.l2) + (g - gl) ** 2 / (m + p.l2) - g**2 / (len(own) + p.l2)
                    if gain > out[0] + 1e-12:
                        out = (gain, left)
        return out

    while len(leaves) < p.leaves:
        gains = [best(own) for own in leaves]
        k = max(range(len(leaves)), key=lambda i: gains[i][0])
        if gains[k][1] is None:
            break
        own = leaves.pop(k)
        leaves += [own[gains[k][1]], own[~gains[k][1]]]
    told = np.zeros(len(codes))
    for own in leaves:
        told[own] = p.rate * np.median(residual[own])
    return told


def test_trees_equal_exhaustive_splits_and_stop_early():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(160, 4)), 1)
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0) * (x[:, 2] < 0.5) + 0.3 * rng.normal(size=160)
    p = boosting.Params(leaves=5, least=7, rate=0.2, rounds=8, most=60, bins=256)
    model = boosting.fit(x[:110], y[:110], x[110:], y[110:], p)
    codes, told, errors = boosting.binned(x[:110], model.cuts), np.full(110, np.median(y[:110])), []
    assert all(len(np.unique(c)) <= p.bins for c in codes.T)
    for k in range(len(model.errors)):
        # the same tree by exhaustive search, as values on the training rows
        slow = _slow_tree(codes, y[:110] - told, p)
        fast = boosting.grow(codes, y[:110] - told, p)[1]
        assert np.allclose(slow, fast, atol=1e-12)
        told = told + fast
    best = int(np.argmin(model.errors))
    assert model.best_iteration == best + 1 and model.stopped and len(model.errors) == best + 1 + p.rounds
    assert np.abs(model.predict(x[110:]) - y[110:]).mean() == pytest.approx(model.errors[best], abs=1e-12)
    frozen = boosting.fit(x[:110], y[:110], x[:0], y[:0], p, model.best_iteration)
    assert np.array_equal(frozen.predict(x), model.predict(x)) and not frozen.stopped
    # a constant feature, one row, no rows to stop on
    assert boosting.fit(np.ones((1, 2)), np.array([3.0]), x[:0, :2], y[:0], p, 2).predict(np.ones((2, 2))).tolist() == [3.0, 3.0]
    many = boosting.edges(rng.normal(size=(5000, 1)), 64)
    assert len(many[0]) <= 63


def test_tree_walk(spark, tables):
    done = train.tree_family(tables.dev)
    audit = done["audit"].collect()
    assert {(r["fold"], r["asset"], r["config"]) for r in audit} == {(f, a, c) for f in ("D1", "D2") for a in "ANR" for c in train.TREES}
    assert all(1 <= r["best_iteration"] <= 1000 and r["runtime"] > 0 and r["n_positive"] + r["n_other"] == r["n_validation"] for r in audit)
    scores = done["scores"].collect()
    assert {(r["fold"], r["asset"]) for r in scores} == {(f, a) for f in ("D1", "D2") for a in "ANR"}
    assert all(len({r["config"] for r in scores if r["fold"] == f}) == 1 for f in ("D1", "D2"))
    # a frozen iteration that isn't the winner's is found, and so is a moved forecast
    planted = done["iterations"].withColumn("best_iteration", F.col("best_iteration") + (F.expr("fold = 'D1' AND asset = 'R'")).cast("int"))
    bad = forecast.refit_audit(tables.dev, done["refits"], done["forecasts"], done["winners"], train.CELL, planted).where("ok = 0")
    assert [(r["fold"], r["asset"]) for r in bad.collect()] == [("D1", "R")]
    first = train.cell_digests(done)
    moved = train.cell_digests({"tested": done["tested"].withColumn("predicted", F.when(F.expr("fold = 'D2' AND asset = 'A'"), F.col("predicted") + 1e-9).otherwise(F.col("predicted")))}).where("NOT (fold = 'D1' AND asset = 'N')")
    odd = {(r["fold"], r["asset"]): (r["same_keys"], r["same_forecasts"]) for r in train.replay(first, moved).where("same_forecasts = 0").collect()}
    assert odd == {("D2", "A"): (1, 0), ("D1", "N"): (0, 0)}


def test_frozen_epochs_run_without_a_stop():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)
    none = x[:0], y[:0]
    assert train.linear_fitter(x, y, *none, 1, 7)[1] == 7
    stopped = train.linear_fitter(x, y, x[:50], y[:50], 1)
    again = train.linear_fitter(x, y, *none, 1, stopped[1])
    assert np.array_equal(stopped[0](x), again[0](x))


def test_selection_refuses_faulty_grids(spark):
    import datetime as dt

    day = lambda k: dt.date(2020, 1, k)
    rows = [("D", "validation", a, day(k), day(k + 1), 0.1, c, None, 0.1 + e, 5, True, 10, e, e, 0.5) for a in "AB" for c, e in (("x", 0.1), ("y", 0.3)) for k in (1, 2)]
    told = spark.createDataFrame(rows, train._TOLD)
    expected = train._expected(told, ["x", "y"], [None])
    simple = train._simplicity(told, ["x", "y"])
    chosen = train.select(train.audit_of(told), expected, simple)
    assert {(r["config"], r["asset"], r["best_iteration"]) for r in chosen["iterations"].collect()} == {("x", "A", 5), ("x", "B", 5)}
    for bad, grid in (
        (told.where("NOT (config = 'y' AND asset = 'B')"), expected),
        (told.where("NOT (config = 'y' AND day(origin_date) = 2)"), expected),
        (told, train._expected(told, ["x"], [None])),
        (told.withColumn("fit_mae", F.col("fit_mae") + F.lit(0.001)), expected),
        (told.withColumn("fit_rmse", F.col("fit_rmse") + F.lit(0.001)), expected),
    ):
        with pytest.raises(ContractError):
            train.select(train.audit_of(bad), grid, simple)


def test_refit_audit_by_seed(spark):
    slices = spark.createDataFrame([("D", p, "A") for p in ("train", "train", "validation", "test")], "fold string, partition string, asset string")
    fits = spark.createDataFrame([("D", "A", "x", s, n) for s, n in (("1", 3), ("2", 2))], "fold string, asset string, config string, seed string, n_train long")
    told = spark.createDataFrame([("D", "A", "x", s) for s in "12"], "fold string, asset string, config string, seed string")
    winners = spark.createDataFrame([("D", "x", 1)], "fold string, config string, selected int")
    got = {r["seed"]: r["ok"] for r in forecast.refit_audit(slices, fits, told, winners, ("fold", "asset", "config", "seed")).collect()}
    assert got == {"1": 1, "2": 0}
