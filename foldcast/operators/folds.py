"""Expanding walk-forward folds with a guarded last one."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.functions import ContractError, require_none

PARTITIONS, ROLES = ("train", "validation", "test"), ("development", "holdout")
_SCHEMA = "fold string, partition string, start date, end date, role string"


def registry(spark: SparkSession, rows: Iterable[tuple[str, str, str, str, str]]) -> DataFrame:
    """A fold table of (fold, partition, start, end, role), checked: each fold has each partition once, train before validation before
    test without overlap, one known role, and the only holdout, if there is one, is tested last."""
    import datetime as dt

    rows = [tuple(r) for r in rows]
    named = [(f, p) for f, p, *_ in rows]
    wrong = [r for r in rows if r[1] not in PARTITIONS or r[4] not in ROLES or not r[0]]
    wrong += [r for r in rows if named.count((r[0], r[1])) > 1]
    wrong += [r for r in rows if len({x[4] for x in rows if x[0] == r[0]}) > 1]
    held = {r[0] for r in rows if r[4] == "holdout"}
    tests = {r[0]: r[2] for r in rows if r[1] == "test"}
    if wrong or len(held) > 1 or any(tests.get(h, "") < t for h in held for t in tests.values()):
        raise ContractError(f"folds that break the rules: {wrong or sorted(held)}")
    df = spark.createDataFrame([(f, p, dt.date.fromisoformat(a), dt.date.fromisoformat(b), r) for f, p, a, b, r in rows], _SCHEMA)
    bad = df.groupBy("fold").pivot("partition", ["train", "validation", "test"]).agg(F.min("start").alias("s"), F.max("end").alias("e"))
    broken = bad.where("train_s > train_e OR validation_s > validation_e OR test_s > test_e OR train_e >= validation_s OR validation_e >= test_s OR train_s IS NULL OR validation_s IS NULL OR test_s IS NULL")
    require_none(broken.select("fold"), "folds out of order")
    return df


def expanding(spark: SparkSession, first_year: int, first_test: int, last_test: int, guard_last: bool = True) -> DataFrame:
    """Yearly expanding folds; the last one is the guarded holdout."""
    rows = []
    for k, year in enumerate(range(first_test, last_test + 1), 1):
        final = guard_last and year == last_test
        name, role = ("F1" if final else f"D{k}"), "holdout" if final else "development"
        rows += [(name, "train", f"{first_year}-01-01", f"{year - 2}-12-31", role), (name, "validation", f"{year - 1}-01-01", f"{year - 1}-12-31", role), (name, "test", f"{year}-01-01", f"{year}-12-31", role)]
    if first_test - 2 < first_year:
        raise ContractError("no year is left for training")
    return registry(spark, rows)


def guarded(folds: DataFrame, allow_holdout: bool = False) -> DataFrame:
    """D3: without the holdout's test range unless it is asked for, then with a warning."""
    if allow_holdout:
        warnings.warn("the final holdout is being read", stacklevel=2)
        return folds
    return folds.where("NOT (role = 'holdout' AND partition = 'test')")


def assign(samples: DataFrame, folds: DataFrame, allow_holdout: bool = False) -> DataFrame:
    """(fold, partition, role, sample columns) by target_date in closed ranges.

    The fold table has three rows a fold; samples stay where they are.
    """
    f = F.broadcast(guarded(folds, allow_holdout))
    return samples.join(f, F.col("target_date").between(F.col("start"), F.col("end"))).select("fold", "partition", "role", *samples.columns)


def eligible_slices(sup: DataFrame, folds: DataFrame, assets: DataFrame | None = None, allow_holdout: bool = False) -> DataFrame:
    """D2 on eligible rows; with ``assets``, every (fold, partition) must have them all."""
    out = assign(sup.where("eligible = 1"), folds, allow_holdout)
    if assets is not None:
        want = guarded(folds, allow_holdout).select("fold", "partition").crossJoin(assets.select("asset"))
        require_none(want.join(out, ["fold", "partition", "asset"], "left_anti"), "slices without an asset")
    return out


def coverage(slices: DataFrame) -> DataFrame:
    """Rows and date bounds by fold, partition and asset, with totals by rollup."""
    return slices.rollup("fold", "partition", "asset").agg(F.count("*").alias("n_rows"), F.min("target_date").alias("first_date"), F.max("target_date").alias("last_date"))


DEFAULT = (
    ("D1", "train", "1995-01-01", "1997-12-31", "development"), ("D1", "validation", "1998-01-01", "1998-12-31", "development"), ("D1", "test", "1999-01-01", "1999-12-31", "development"),
    ("D2", "train", "1995-01-01", "1998-12-31", "development"), ("D2", "validation", "1999-01-01", "1999-12-31", "development"), ("D2", "test", "2000-01-01", "2000-12-31", "development"),
    ("F1", "train", "1995-01-01", "1999-12-31", "holdout"), ("F1", "validation", "2000-01-01", "2000-12-31", "holdout"), ("F1", "test", "2001-01-01", "2001-12-31", "holdout"),
)


def development_only(slices: DataFrame) -> DataFrame:
    return slices.where(F.col("role") == "development")


