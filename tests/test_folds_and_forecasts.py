import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import ContractError, checked_join, table_diff
from foldcast.operators import folds, forecast, metrics, regime_metrics, regimes, sequences


@pytest.fixture(scope="module")
def registry(spark):
    return folds.expanding(spark, 2015, 2020, 2023)


def samples(spark, targets):
    rows = [("A", t - dt.timedelta(1), t, 0.01) for t in targets]
    return spark.createDataFrame(rows, "asset string, origin_date date, target_date date, target_return double")


def test_boundary_days(spark, registry):
    s = samples(spark, [dt.date(2018, 12, 31), dt.date(2019, 1, 1), dt.date(2019, 12, 31), dt.date(2020, 1, 2), dt.date(2020, 12, 31)])
    got = {(r["target_date"], r["partition"]) for r in folds.assign(s, registry).where("fold = 'D1'").collect()}
    assert got == {(dt.date(2018, 12, 31), "train"), (dt.date(2019, 1, 1), "validation"), (dt.date(2019, 12, 31), "validation"), (dt.date(2020, 1, 2), "test"), (dt.date(2020, 12, 31), "test")}


def test_holdout_guard(spark, registry):
    s = samples(spark, [dt.date(2023, 6, 1)])
    assert folds.assign(s, registry).count() == 0
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert folds.assign(s, registry, allow_holdout=True).count() == 1
    assert w


def test_disordered_folds(spark):
    with pytest.raises(ContractError):
        folds.registry(spark, [("D1", "train", "2016-01-01", "2017-12-31", "development"), ("D1", "validation", "2017-01-01", "2017-12-31", "development"), ("D1", "test", "2019-01-01", "2019-12-31", "development")])


def test_winner_ties_go_to_the_simpler(spark):
    audit = spark.createDataFrame([("D1", "a", "X", None, 0.100001, 0.2), ("D1", "b", "X", None, 0.1, 0.1), ("D2", "a", "X", None, 0.2, 0.2), ("D2", "b", "X", None, 0.1, 0.1)], "fold string, config string, asset string, seed string, mae double, rmse double")
    simple = spark.createDataFrame([("a", 1), ("b", 2)], "config string, simplicity int")
    got = {(r["fold"], r["config"], r["reason"]) for r in forecast.fold_winner(audit, simple).where("selected = 1").collect()}
    assert got == {("D1", "a", "tie_break"), ("D2", "b", "lowest_error")}


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, y int")
    with pytest.raises(ContractError):
        checked_join(a, b, ["k"])
    with pytest.raises(ContractError):
        checked_join(a, b.where("y > 9"), ["k"])


def test_table_diff_null_equals_null(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 1.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, None, "x"), (2, 1.5, "y")], "k int, v double, s string")
    got = {r["column"]: (r["n_mismatch"], r["max_abs_diff"]) for r in table_diff(a, b, ["k"]).collect()}
    assert got == {"key": (0, None), "v": (1, 0.5), "s": (0, None)}


def test_skill_is_undefined_at_zero(spark):
    m = spark.createDataFrame([("m", None, "D1", "A", 0.5, 0.5, 0.5, 1, 1, 1)], "model string, seed string, fold string, asset string, actual_return double, predicted_return double, baseline_return double, actual_direction int, predicted_direction int, baseline_direction int")
    assert metrics.skill_metrics(m).first()["skill"] is None


def test_regime_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, 1.0, 1.0, 1.5, None, 0.1), (0.1, 1.1, 1.0, 1.4, 0.2, 0.1), (None, None, 1.0, None, None, 0.1), (nan, nan, 1.0, nan, 0.05, 0.1)], "trend double, vol double, med double, jump double, abs_ret double, q double")
    j, s = regimes.transition_flags(F.col("jump"), F.col("abs_ret"), F.col("q"))
    got = [tuple(r) for r in df.select(regimes.trend_class(F.col("trend")), regimes.volatility_class(F.col("vol"), F.col("med")), regimes.transition_class(j, s)).collect()]
    assert got == [("negative", "low", "stressed"), ("positive", "high", "stressed"), ("unavailable", "unavailable", "unavailable"), ("unavailable", "unavailable", "stable")]


def test_report_sizes_and_signs(spark):
    df = spark.createDataFrame([(29, 1e-12), (30, -1e-12), (31, 2e-12), (32, None)], "n int, v double")
    got = [tuple(r) for r in df.select(regime_metrics.status(F.col("n")), regime_metrics.sign(F.col("v"))).collect()]
    assert got == [("suppressed", "zero"), ("reportable", "zero"), ("reportable", "positive"), ("reportable", None)]


def test_patches_end_at_the_origin(spark):
    df = spark.range(1).select(F.array(*(F.array(F.lit(float(i)), F.lit(float(-i))) for i in range(7))).alias("seq"))
    p = df.select(sequences.patches(F.col("seq"), 7, 3, 2, 2)).first()[0]
    assert p[0] == [[0.0, 1.0, 2.0], [2.0, 3.0, 4.0], [4.0, 5.0, 6.0]] and p[1][-1][-1] == -6.0


def test_contrast_signs(spark):
    cells = spark.createDataFrame([("m", "1", "D1", "A", "trend_regime", x, n, s, e, e, d, 0.0, st) for x, n, s, e, d, st in (("positive", 40, 0.1, 1.0, 0.6, "reportable"), ("negative", 40, -0.1, 2.0, 0.5, "reportable"))], "model string, seed string, fold string, asset string, dimension string, label string, n int, skill double, mae double, rmse double, da double, da_diff double, status string")
    r = regime_metrics.contrasts(cells).first()
    assert r["mae_change"] == 1.0 and r["stability_loss"] == -r["da_change"]
    assert C.DIMENSIONS["trend_regime"][1] == "negative"


def test_thresholds_take_origins_by_their_target(spark):
    import datetime as dt

    from foldcast.operators import regimes

    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    ref = spark.createDataFrame([(day(k), 1.0, float(k), float(k)) for k in range(12)], "origin_date date, ref_trend_63 double, ref_std_21 double, ref_ret double")
    rows = [("D", "train", day(2), day(5), "development"), ("D", "validation", day(6), day(8), "development"), ("D", "test", day(9), day(11), "development")]
    got = regimes.thresholds(regimes.volatility_inputs(ref), spark.createDataFrame(rows, "fold string, partition string, start date, end date, role string")).first()
    # targets 2 to 8 are permitted: origins 1 to 7; the origin of day 8 has its target in the test range
    assert (got["first_origin"], got["last_origin"], got["n_ret"]) == (day(1), day(7), 7)


def test_a_winner_has_all_assets_and_needs_no_simplicity(spark):
    from foldcast.operators import forecast

    rows = [("D", "a", x, "", 0.3, 0.3) for x in "AB"] + [("D", "b", "A", "", 0.1, 0.1)] + [("D", "c", x, "", 0.2, 0.2) for x in "AB"]
    audit = spark.createDataFrame(rows, "fold string, config string, asset string, seed string, mae double, rmse double")
    won = forecast.fold_winner(audit, spark.createDataFrame([("a", 1), ("b", 2)], "config string, simplicity int"))
    assert {r["config"]: r["selected"] for r in won.collect()} == {"a": 0, "b": 0, "c": 1}
