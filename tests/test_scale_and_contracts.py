"""Rules that tables must keep, and plans that must hold at scale."""

import datetime as dt
import hashlib
import math
import os
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import ContractError, halo, table_diff
from foldcast.operators import features, folds, forecast, metrics, moments, quality, regime_metrics, regimes, sequences
from foldcast.plans.queries import Tables
from foldcast.sources import artifacts, panel

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return Tables(spark, sf)


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def series(spark, n, assets=("A",), gap=1):
    rows = [(DAY + dt.timedelta(gap * k), a, 10.0 + math.sin(k), 11.5, 8.5, 10 + math.cos(k * (i + 1)), 5.0 + k % 7) for i, a in enumerate(assets) for k in range(n)]
    return spark.createDataFrame(rows, C.PANEL)


# stored tables
def test_fingerprints_tell_tables_apart(spark):
    of = lambda rows, kind: tuple(artifacts.fingerprint(spark.createDataFrame(rows, kind)).first())
    text = "a string, b string"
    assert of([("a|b", "c")], text) != of([("a", "b|c")], text)
    assert of([("V1:x", "c")], text) != of([("x", "V1:c")], text)
    assert of([(None, "c")], text) != of([("\\N", "c")], text) != of([("N", "c")], text) != of([(None, "c")], text)
    assert of([(1, 2)], "a int, b int") != of([(1, 2)], "a int, c int")
    assert of([(1,)], "a int") != of([(1,)], "a long") != of([("1",)], "a string")
    assert of([], "a int") != of([], "a long") and of([(1, 2)], "a int, b int") != of([(2, 1)], "a int, b int")
    assert of([(1.0,), (1.0,)], "a double") != of([(1.0,)], "a double") != of([(math.nextafter(1.0, 2),)], "a double")
    assert of([(0.0,)], "a double") == of([(-0.0,)], "a double")
    assert of([([1, None],)], "a array<int>") != of([([1],)], "a array<int>") and of([(None,)], "a array<int>") != of([([],)], "a array<int>")
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert artifacts.fingerprint(df).first() == artifacts.fingerprint(df.repartition(7).select("b", "a")).first()


def test_other_content_is_written_beside(spark, tmp_path):
    root = str(tmp_path)
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("a|b", "c"), ("a", "b|c")))
    first, second = artifacts.write_once(a, root, "t"), artifacts.write_once(b, root, "t")
    assert first != second and artifacts.write_once(a.repartition(2), root, "t") == first
    assert spark.read.parquet(second).first()["y"] == "b|c"
    # a place whose content isn't what its name says
    spark.read.parquet(second).write.mode("append").parquet(first)
    with pytest.raises(ContractError):
        artifacts.write_once(a, root, "t")


def test_two_writers_leave_one_whole_table(spark, tmp_path):
    df = spark.range(500).withColumn("x", F.col("id") * 2).repartition(5)
    places, errors = [], []

    def write():
        try:
            places.append(artifacts.write_once(df, str(tmp_path), "race"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(set(places)) == 1
    assert spark.read.parquet(places[0]).count() == 500
    assert len(os.listdir(tmp_path)) == 1  # nothing is left aside, nothing moved into the winner's folder
    assert not [x for x in os.listdir(places[0]) if x.startswith(".aside")]


@pytest.mark.parametrize("most", [panel.BROADCAST_DAYS, 0])
def test_panel_orders_lines_by_their_whole_key_without_sorting_them(spark, monkeypatch, most):
    monkeypatch.setattr(panel, "BROADCAST_DAYS", most)
    r = random.Random(4)
    pick = lambda n, none: None if r.random() < none else r.randrange(n)
    rows = [(dt.datetime(2020, 1, 1 + r.randrange(9), r.randrange(24)), r.choice(["A", "N", None]), pick(6, 0.05), pick(3, 0), pick(3, 0.1), pick(3, 0), float(r.randrange(1000)), 1.0) for _ in range(2000)]
    lines = spark.createDataFrame(rows, "l_shipdate timestamp, l_returnflag string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double")
    df = panel.panel_from_lineitem(lines)
    want = {}
    for t, flag, *k, q in rows:
        if t.weekday() < 5:
            for a in (flag, C.REFERENCE):
                want.setdefault((t.date(), a), []).append((tuple((x is not None, x or 0) for x in k), k[-1], q))
    got = {(r["date"], r["asset"]): tuple(r)[2:] for r in df.collect()}
    assert got == {d: (min(x)[1], max(p for _, p, _ in x), min(p for _, p, _ in x), max(x)[1], sum(q for *_, q in x)) for d, x in want.items()}
    scans = plan_of(df).split("SortAggregate")[-1] if "SortAggregate" in plan_of(df) else ""
    assert "Join" in scans  # what is sorted are lines of each day's first and last order


def test_written_rows_fix_a_files_bytes(spark, tmp_path):
    rows = [("A", 2, 0.5), ("B", 1, 1.0), ("A", 1, 2.25)]
    place = artifacts.write_rows(spark.createDataFrame(rows, "asset string, day int, x double").repartition(3), str(tmp_path / "rows"), "asset", "day")
    got = {re.sub("/part-.*", "", r["path"]): r["digest"] for r in artifacts.inventory(spark, place, "part-*").collect()}
    told = lambda a: "".join(f'{{"asset":"{k}","day":{d},"x":{x}}}\n' for k, d, x in sorted(rows) if k == a)
    assert got == {f"folder={a}": hashlib.sha256(told(a).encode()).hexdigest() for a in "AB"}


def test_inventory_goes_by_relative_path(spark, tmp_path, monkeypatch):
    for name, text in (("a/x.txt", "one"), ("b/x.txt", "two"), ("b/c/x.txt", "two")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    inv = artifacts.inventory(spark, str(tmp_path), "*.txt")
    assert {r["path"] for r in inv.collect()} == {"a/x.txt", "b/x.txt", "b/c/x.txt"}
    assert artifacts.drift(inv, inv).count() == 0
    moved = inv.withColumn("digest", F.when(F.col("path") == "b/x.txt", "other").otherwise(F.col("digest"))).where("path <> 'a/x.txt'")
    assert {tuple(r) for r in artifacts.drift(inv, moved).collect()} == {("b/x.txt", "changed"), ("a/x.txt", "extra")}
    nodes = lambda i: {r["folder"]: (r["n_files"], r["n_bytes"], r["sum_a"], r["sum_b"]) for r in artifacts.tree(i).collect()}
    whole, other = nodes(inv), nodes(moved.unionByName(inv.where("path = 'a/x.txt'")))
    assert set(whole) == {"", "a", "b", "b/c"} and whole[""][:2] == (3, 9) and whole["b"][:2] == (2, 6)
    assert whole["a"] == other["a"] and whole["b/c"] == other["b/c"] and whole["b"] != other["b"] and whole[""] != other[""]
    # a node tells what lies below it, not where it stands
    assert nodes(inv.where("path = 'b/c/x.txt'"))["b/c"][2:] == nodes(inv.where("path = 'b/x.txt'"))["b"][2:]
    monkeypatch.setattr(artifacts, "MOST_BYTES", 3)
    with pytest.raises(ContractError):
        artifacts.inventory(spark, str(tmp_path), "*.txt")


def test_panel_types(spark, tmp_path):
    good = series(spark, 3)
    good.write.parquet(str(tmp_path / "good"))
    assert panel.read_panel(spark, str(tmp_path / "good")).count() == 3
    good.withColumn("close", F.col("close").cast("string")).write.parquet(str(tmp_path / "text"))
    good.withColumn("volume", F.col("volume").cast("int")).write.parquet(str(tmp_path / "ints"))
    good.withColumn("date", F.col("date").cast("timestamp")).write.parquet(str(tmp_path / "times"))
    for name in ("text", "ints", "times"):
        with pytest.raises(ContractError):
            panel.read_panel(spark, str(tmp_path / name))


def test_date_firewall_opens_only_its_years(spark, tmp_path):
    df = series(spark, 1500).select(F.col("date").alias("target_date"), "asset", "open", "close")
    stored = spark.read.parquet(panel.store_by_year(df, str(tmp_path / "t")))
    part = panel.read_until(stored, "2021-03-01", "2022-01-05", ["asset", "target_date", "close"])
    assert part.count() == df.where("target_date BETWEEN '2021-03-01' AND '2022-01-05'").count()
    plan = plan_of(part)
    assert re.search(r"PartitionFilters: \[[^\]]*target_year[^\]]*2021", plan) and "GreaterThanOrEqual(target_date" in plan and "open" not in re.search(r"ReadSchema: (.*)", plan)[1]
    files = {f for f in part.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert {re.search(r"target_year=(\d+)", f)[1] for f in files} == {"2021", "2022"}


# folds and forecasts
@pytest.mark.parametrize("rows", [
    [("D1", "train", "2015-01-01", "2016-12-31", "development"), ("D1", "train", "2014-01-01", "2014-12-31", "development"), ("D1", "validation", "2017-01-01", "2017-12-31", "development"), ("D1", "test", "2018-01-01", "2018-12-31", "development")],
    [("D1", "train", "2015-01-01", "2016-12-31", "oops"), ("D1", "validation", "2017-01-01", "2017-12-31", "oops"), ("D1", "test", "2018-01-01", "2018-12-31", "oops")],
    [("D1", "train", "2015-01-01", "2016-12-31", "development"), ("D1", "validation", "2017-01-01", "2017-12-31", "holdout"), ("D1", "test", "2018-01-01", "2018-12-31", "development")],
    [("D1", "train", "2015-01-01", "2016-12-31", "development"), ("D1", "valid", "2017-01-01", "2017-12-31", "development"), ("D1", "test", "2018-01-01", "2018-12-31", "development")],
    [(f, p, f"{y + k}-01-01", f"{y + k}-12-31", r) for f, y, r in (("F1", 2015, "holdout"), ("D1", 2016, "development")) for k, p in enumerate(("train", "validation", "test"))],
])
def test_registries_that_break_the_rules(spark, rows):
    with pytest.raises(ContractError):
        folds.registry(spark, rows)


def test_persistence_refuses_what_isn_t_finite(spark):
    df = spark.createDataFrame([(0.1,), (-0.2,), (0.0,)], "ret double")
    assert [r[0] for r in df.select(forecast.persistence()).collect()] == [1, 0, 0]
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(bad,)], "ret double").select(forecast.persistence()).collect()


def test_baselines_need_every_asset(spark, tables):
    assets = tables.eligible.select("asset").distinct()
    assert forecast.baseline_forecasts(tables.dev, assets).count() > 0
    with pytest.raises(ContractError):
        forecast.baseline_forecasts(tables.dev.where("NOT (fold = 'D2' AND asset = 'N')"), assets)


def test_mixed_seeds_and_incomplete_labels_are_errors(spark, tables):
    cells = spark.createDataFrame([("m", s, "D", "A", "d", "x", 40, v, v, v, v, v, "reportable") for s, v in (("1", 0.5), ("2", None))], "model string, seed string, fold string, asset string, dimension string, label string, n int, mae double, rmse double, da double, skill double, da_diff double, status string")
    assert regime_metrics.cell_seed_summary(cells.where("seed = '1'")).first()["mixed"] == 0
    with pytest.raises(Exception, match="seeds"):
        regime_metrics.cell_seed_summary(cells).collect()
    with pytest.raises(ContractError):
        regimes.regimes(tables.ref.where("day(origin_date) <> 4"), tables.folds, [tables.dev_base])


def test_diff_of_repeated_keys_and_of_equal_tables(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, None), (3, 0.0, "z")], "k int, v double, s string")
    same = {r["column"]: r["n_mismatch"] for r in table_diff(a, a.repartition(3).withColumn("v", F.when(F.col("k") == 3, -0.0).otherwise(F.col("v"))), ["k"]).collect()}
    assert same == {"key": 0, "v": 0, "s": 0}
    with pytest.raises(Exception, match="repeat"):
        table_diff(a.union(a.where("k = 1")), a, ["k"]).collect()
    near = a.withColumn("v", F.col("v") * (1 + 1e-14))
    assert {r["column"]: r["n_mismatch"] for r in table_diff(near, a, ["k"]).collect()} == {"key": 0, "v": 0, "s": 0}
    odd = spark.createDataFrame([(1, 1.0, None), (4, 0.5, "z"), (3, 0.25, "z")], "k int, v double, s string")
    assert {r["column"]: (r["n_mismatch"], r["max_abs_diff"]) for r in table_diff(odd, a, ["k"]).collect()} == {"key": (2, None), "v": (1, 0.25), "s": (1, None)}


# one pass for all folds
def test_moments_of_all_folds_in_one_scan(spark, tables, tmp_path):
    tables.eligible.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for usage in ("selection", "refit"):
        made = moments.fold_scalers(rows, tables.folds, usage=usage)
        assert plan_of(made).count("FileScan") == 1
        slices = folds.assign(rows, tables.folds)
        want = {(r["fold"], r["asset"], r["feature"]): r for r in sequences.fit_scaler(slices, usage=usage).collect()}
        got = {(r["fold"], r["asset"], r["feature"]): r for r in made.collect()}
        assert set(got) == set(want) and {k[0] for k in got} == {"D1", "D2", "F1"}
        for k, r in want.items():
            assert got[k]["n"] == r["n"] and got[k]["mean"] == pytest.approx(r["mean"], rel=1e-12, abs=1e-14) and got[k]["var"] == pytest.approx(r["var"], rel=1e-12, abs=1e-14)
    fits = moments.fold_fits(rows, tables.folds, ["ret", "ref_ret"], [None, "1"])
    assert plan_of(fits).count("FileScan") == 1
    pdf = folds.assign(rows, tables.folds).where("partition IN ('train', 'validation')").withColumn("twice", moments.counts_twice("1")).toPandas()
    import numpy as np

    for r in fits.collect():
        own = pdf[(pdf["fold"] == r["fold"]) & (pdf["asset"] == r["asset"]) & (pdf["partition"].isin(moments.USAGES[r["usage"]]))]
        w = np.ones(len(own)) if r["seed"] is None else 1 + own["twice"].to_numpy()
        x, y = own[r["config"]].to_numpy(), own["target_return"].to_numpy()
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        slope = (w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum()
        assert r["n_train"] == len(own) and r["slope"] == pytest.approx(slope, rel=1e-9) and r["intercept"] == pytest.approx(my - slope * mx, rel=1e-9, abs=1e-12)
    constant = moments.fold_fits(rows.withColumn("c", F.lit(0.1)), tables.folds, ["c"], [None]).collect()
    assert constant and all(r["slope"] == 0 for r in constant)


def test_states_add_up_and_take_new_folds(spark, tables):
    keys = ["model", "seed", "fold", "asset"]
    matched = tables.matched.withColumn("half", F.dayofmonth("origin_date") % 2)
    finer = metrics.states(matched, [*keys, "half"])
    norm = lambda d: {tuple(r[k] for k in keys): [r[c] for c in ("n", "mae", "rmse", "da", "baseline_mae", "skill", "da_diff")] for r in d.collect()}
    direct, summed = norm(metrics.skill_metrics(matched, keys)), norm(metrics.of_states(metrics.add_up(finer, keys), keys))
    later = metrics.states(matched.where("fold = 'D1'"), keys).unionByName(metrics.states(matched.where("fold = 'D2'"), keys))
    assert direct and set(direct) == set(summed) == set(norm(metrics.of_states(later, keys)))
    for k, v in direct.items():
        assert summed[k] == pytest.approx(v, rel=1e-12)


def test_plans_have_few_exchanges(tables):
    """The tables behind x3, x6, x7, g6, g7 and m9; what they read more than once is stored."""
    for df in (tables.rcells, tables.contrasts, tables.rmacro, tables.cells, tables.macro, tables.family["winners"]):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 15 and "CartesianProduct" not in plan


# long series
def test_blocks_with_a_halo_equal_whole_series(spark):
    p = series(spark, 90, ("A", "B")).where("NOT (asset = 'B' AND day(date) IN (3, 4, 5, 17))")
    for rows in (7, 16, 500):
        a, b = features.asset_features(p), features.asset_features(p, block_rows=rows)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0
        a, b = features.reference_features(p, "A", trend=30), features.reference_features(p, "A", trend=30, block_rows=rows)
        assert a.exceptAll(b).count() == 0
    blocks = halo(p, ["asset"], "date", 16, 5)
    sizes = blocks.groupBy("asset", "halo_block").agg(F.count("*").alias("n"), F.count_if("halo_own").alias("own")).collect()
    assert max(r["n"] for r in sizes) <= 21 and len([r for r in sizes if r["asset"] == "A"]) == 6 and sum(r["own"] for r in sizes) == p.count()


def test_windows_cost_a_halo_and_no_copies(spark):
    n, names = 700, ["f1", "f2"]
    rows = [("A", DAY + dt.timedelta(k), DAY + dt.timedelta(k + 1), 0.1, float(k), None if k == 300 else float(-k)) for k in range(n)]
    sup = spark.createDataFrame(rows, "asset string, origin_date date, target_date date, target_return double, f1 double, f2 double").repartition(3)
    for length in (5, 252):
        made = sequences.window_blocks(sup, length, names, 100)
        sizes = [r[0] for r in made.select(F.size("rows")).collect()]
        # one long asset over several blocks, none with more than its own rows and the halo
        assert len(sizes) >= 7 and max(sizes) <= 100 + length - 1
        got = {r["origin_date"]: r for r in sequences.windows(sup, length, names, 100).collect()}
        assert len(got) == n
        for k in range(n):
            r, whole = got[DAY + dt.timedelta(k)], k + 1 >= length and not k - length < 300 <= k
            assert r["usable"] == int(whole)
            assert r["seq"] == ([[float(j), float(-j)] for j in range(k + 1 - length, k + 1)] if whole else None)


def test_gaps_are_runs(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in range(0, 40, 2)], "date date")
    have = {"A": [0, 2, 8, 9, 38], "B": [], "C": list(range(0, 40, 2)), "D": [4]}
    p = spark.createDataFrame([(a, DAY + dt.timedelta(k)) for a, v in have.items() for k in v], "asset string, date date")
    assets = spark.createDataFrame([(a,) for a in have], "asset string")
    runs = {(r["asset"], r["first"], r["last"]) for r in quality.gap_runs(p, days, assets).collect()}
    assert runs == {("A", 3, 4), ("A", 6, 19), ("B", 1, 20), ("D", 1, 2), ("D", 4, 20)}
    gaps = quality.calendar_gaps(p, days, assets).collect()
    want = {(a, DAY + dt.timedelta(k), "missing") for a, v in have.items() for k in range(0, 40, 2) if k not in v} | {("A", DAY + dt.timedelta(9), "unexpected")}
    assert {tuple(r) for r in gaps} == want and len(gaps) == len(want)
    clean = {r["asset"]: (r["missing"], r["unexpected"], r["is_clean"]) for r in quality.calendar_audit(p, days, assets).collect()}
    assert clean == {"A": (16, 1, 0), "B": (20, 0, 0), "C": (0, 0, 1), "D": (19, 0, 0)}
    assert "CartesianProduct" not in plan_of(quality.calendar_gaps(p, days, assets))
