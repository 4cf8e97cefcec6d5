import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import ContractError
from foldcast.operators import features, quality
from foldcast.sources import artifacts, panel


def days(n):
    out, d = [], dt.date(2020, 1, 2)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def make(spark, series, dates=None, volume=None):
    rows = []
    for asset, closes in series.items():
        for i, (d, c) in enumerate(zip(dates or days(len(closes)), closes)):
            o = c * 0.997
            rows.append((d, asset, o, max(o, c) * 1.01, min(o, c) * 0.99, float(c), float(volume[i] if volume else 1000 + i)))
    return spark.createDataFrame(rows, C.PANEL)


def market(spark, n=90, bump=None):
    series = {}
    for i, a in enumerate(("A1", "A2", "A3", "A4", C.REFERENCE)):
        base = 100 + 25 * i
        series[a] = [base * math.exp((0.15 + 0.01 * i) * k / (n - 1)) * (1.75 if bump and k > bump else 1) for k in range(n)]
    return make(spark, series, volume=[(1000 + k) * (2 if bump and k > bump else 1) for k in range(n)])


def rows(df, *keys):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: tuple(str(x) for x in r))


def test_hand_computed_windows(spark):
    p = make(spark, {"X": [100, 110, 121, 133.1, 146.41]})
    r = features.asset_features(p, (2, 3)).orderBy("origin_date").collect()[2]
    assert r["ret"] == pytest.approx(math.log(1.1)) and r["ret_lag"] == pytest.approx(math.log(1.1))
    assert r["ret_mean_2"] == pytest.approx(math.log(1.1)) and r["ret_std_2"] == pytest.approx(0, abs=1e-12)
    assert r["ret_mean_3"] is None


def test_windows_are_checked(spark):
    with pytest.raises(ContractError):
        features.asset_features(make(spark, {"X": [1, 2]}), (5, 5))


def test_future_changes_leave_the_past(spark):
    cut = days(90)[45]
    a = features.build_supervised(market(spark)).where(F.col("origin_date") <= F.lit(cut)).select("asset", "origin_date", *C.FEATURES)
    b = features.build_supervised(market(spark, bump=45)).where(F.col("origin_date") <= F.lit(cut)).select("asset", "origin_date", *C.FEATURES)
    assert a.exceptAll(b).count() == 0 and b.count() == 4 * 46


def test_partitioning_doesn_t_matter(spark):
    p = market(spark)
    a, b = (features.build_supervised(x).select(*C.SAMPLE_KEY, "ret_std_21", "eligible") for x in (p, p.repartition(5, "close")))
    assert a.exceptAll(b).count() == 0


def test_reference_by_date(spark):
    d = days(4)
    own = features.asset_features(make(spark, {"B": [1, 2, 3, 4], "A": [4, 3, 2, 1]}, d), (2,))
    ref = features.reference_features(make(spark, {C.REFERENCE: [100, 200, 100, 50]}, d), windows=(2,), trend=3)
    got = features.join_reference(own, ref).where(F.col("origin_date") == F.lit(d[1])).select("ref_ret").collect()
    assert [r[0] for r in got] == [pytest.approx(math.log(2))] * 2
    holed = ref.where(F.col("origin_date") != F.lit(d[1]))
    with pytest.raises(ContractError):
        features.join_reference(own, holed, "raise")
    kept = features.join_reference(own, holed).where(F.col("origin_date") == F.lit(d[1])).collect()
    assert {r["ref_observed"] for r in kept} == {0} and {r["ref_ret"] for r in kept} == {None}


def test_broken_rows(spark):
    d = days(3)
    bad = [(d[0], "A", 1.0, 0.5, 0.4, 1.0, 1.0), (d[1], "A", 1.0, 2.0, 1.5, 1.0, -1.0), (d[2], "Z", 1.0, 2.0, 0.5, float("inf"), 1.0), (dt.date(2020, 1, 4), None, 1.0, 2.0, 0.5, 1.0, 1.0)]
    found = {r["rule"] for r in quality.panel_violations(spark.createDataFrame(bad, C.PANEL), ["A"], "2020-01-01", "2020-01-03").collect()}
    assert {"high_below_open", "high_below_close", "low_above_open", "negative_volume", "unknown_asset", "not_finite", "empty_asset", "weekend", "date_out_of_range"} <= found


def test_wide_provider_table(spark):
    wide = spark.createDataFrame([(dt.date(2020, 1, 2), 1.0, 2.0, 3.0, 0.5, 9.0)], "date date, `Open|X` double, `Close|X` double, `High|X` double, `Low|X` double, `Volume|X` double")
    r = panel.wide_to_long(wide).collect()
    assert len(r) == 1 and r[0]["asset"] == "X" and r[0]["high"] == 3.0


def test_csv_dates_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,asset,open,high,low,close,volume\n2020-01-02,A,1,2,0.5,1,9\n")
    (tmp_path / "b.csv").write_text("date,asset,open,high,low,close,volume\n2020/01/02,A,1,2,0.5,1,9\n")
    assert panel.read_panel(spark, str(tmp_path / "a.csv"), "csv").first()["close"] == 1.0
    with pytest.raises(ContractError):
        panel.read_panel(spark, str(tmp_path / "b.csv"), "csv")


def test_normalize_rejects_nan(spark):
    with pytest.raises(ContractError):
        panel.normalize_panel(make(spark, {"a": [1, float("nan")]}))
    assert panel.normalize_panel(make(spark, {" a ": [1, 2]})).first()["asset"] == "A"


def test_write_once_and_drift(spark, tmp_path):
    p = make(spark, {"A": [1.0], "B": [2.0]})
    path = artifacts.write_once(p, str(tmp_path), "panel")
    assert artifacts.write_once(p.repartition(3), str(tmp_path), "panel") == path
    assert artifacts.write_once(make(spark, {"A": [1.5]}), str(tmp_path), "panel") != path
    inv = artifacts.inventory(spark, path, "*.parquet")
    n = inv.count()
    moved = spark.createDataFrame(inv.withColumn("digest", F.lit("0")).collect(), inv.schema)
    assert n >= 1 and artifacts.drift(inv, moved).count() == n and artifacts.drift(inv, inv).count() == 0
    assert {r["asset"]: r["n_rows"] for r in artifacts.manifest(p).collect()} == {"A": 1, "B": 1}
