"""Targets and leakage-safe rolling features (F1-F12). Every window ends at the current row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast import schema as C
from foldcast.functions import ContractError, checked_join, direction, halo, require_none, rolling
from foldcast.operators.quality import eligibility


def _by(*keys: str, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def next_session_target(panel: DataFrame) -> DataFrame:
    """each row with its asset's next row; the last row of an asset has none.

    The direction is decided on prices, so that rounding of the logarithm can't flip it.
    """
    out = panel.select("asset", F.col("date").alias("origin_date"), *_target())
    return out.where("target_date is not null")


def _target() -> list[Column]:
    w = _by("asset")
    p = F.lead("close").over(w)
    return [F.lead("date").over(w).alias("target_date"), F.ln(p / F.col("close")).alias("target_return"), direction(p - F.col("close")).alias("target_direction")]


def log_return(price: str = "close", k: int = 1, keys: Sequence[str] = ("asset",)) -> Column:
    """log return over k rows."""
    return F.ln(F.col(price) / F.lag(price, k).over(_by(*keys)))


def _windows(windows: Sequence[int]) -> None:
    if len(set(windows)) != len(windows) or min(windows) < 2:
        raise ContractError("windows must be unique and 2 or more")


def asset_features(panel: DataFrame, windows: Sequence[int] = C.WINDOWS, keep: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """returns and rolling means and deviations by asset, on one sort; columns in ``keep`` pass through.

    With ``block_rows`` an asset's rows are worked on in blocks of so many (:func:`foldcast.functions.halo`), so a long series is many tasks.
    """
    _windows(windows)
    panel, keys = (panel, ["asset"]) if block_rows is None else (halo(panel, ["asset"], "date", block_rows, max(windows) + 1), ["asset", "halo_block"])
    base = panel.withColumn("ret", log_return(keys=keys))
    base = base.withColumn("ret_lag", F.lag("ret").over(_by(*keys)))
    made = {f"{x}_{how}_{w}": rolling(v, w, keys, "date", how) for w in windows for x, v in (("ret", "ret"), ("vol", "volume")) for how in ("mean", "std")}
    out = base.withColumns(made)
    return (out if block_rows is None else out.where("halo_own")).select("asset", F.col("date").alias("origin_date"), "ret", "ret_lag", *made, *keep)


def reference_features(panel: DataFrame, reference: str = C.REFERENCE, windows: Sequence[int] = C.WINDOWS, trend: int = C.TREND, block_rows: int | None = None) -> DataFrame:
    """features of the reference series, one row a date; ``block_rows`` as in :func:`asset_features`."""
    _windows(windows)
    ref, keys = panel.where(F.col("asset") == reference), ["asset"]
    if block_rows is not None:
        ref, keys = halo(ref, ["asset"], "date", block_rows, max(*windows, trend) + 1), ["asset", "halo_block"]
    ref = ref.withColumn("ref_ret", log_return(keys=keys))
    made = {f"ref_{how}_{w}": rolling("ref_ret", w, keys, "date", how) for w in windows for how in ("mean", "std")}
    ref = ref.withColumns({"ref_ret_lag": F.lag("ref_ret").over(_by(*keys)), **made, f"ref_trend_{trend}": log_return(k=trend, keys=keys)})
    ref = ref if block_rows is None else ref.where("halo_own")
    return ref.select(F.col("date").alias("origin_date"), "ref_ret", "ref_ret_lag", *made, f"ref_trend_{trend}", F.lit(1).alias("ref_observed"))


def join_reference(features: DataFrame, ref: DataFrame, missing: str = "keep") -> DataFrame:
    """same-date join, never filled. ``missing``: 'keep' flags absent dates with 0, 'raise' fails.

    The reference has a row a date; Spark broadcasts it by its size.
    """
    if missing == "raise":
        require_none(features.join(ref, "origin_date", "left_anti").select("asset", "origin_date"), "dates without reference")
    return features.join(ref, "origin_date", "left").withColumn("ref_observed", F.coalesce("ref_observed", F.lit(0)))


def join_targets(targets: DataFrame, features: DataFrame, check: bool = True) -> DataFrame:
    """one-to-one join; every target must have features."""
    keys = ["asset", "origin_date"]
    return checked_join(targets, features, keys) if check else targets.join(features, keys, "left")


def build_supervised(panel: DataFrame, reference: str = C.REFERENCE, missing: str = "keep", check: bool = False) -> DataFrame:
    """F1 to F9 in one plan: sample key, target, features, flags.

    Targets and features come from one sort by asset, without a join of the two; ``check`` makes both
    apart and joins them one to one, with an error for targets without features.
    """
    own, ref = panel.where(F.col("asset") != reference), reference_features(panel, reference)
    if check:
        out = join_targets(next_session_target(own), join_reference(asset_features(own), ref, missing))
    else:
        target = ("target_date", "target_return", "target_direction")
        made = asset_features(own.select("*", *_target()), keep=target)
        out = join_reference(made.where("target_date is not null"), ref, missing)
    out = out.withColumn("eligible", eligibility())
    return out.select(*C.SAMPLE_KEY, "target_return", "target_direction", *C.FEATURES, "ref_observed", "eligible")


def eligibility_stats(sup: DataFrame, fold_rows: DataFrame | None = None) -> DataFrame:
    """eligible, prefix and reference-less rows and date bounds, overall, by asset and by fold, partition and asset.

    The prefix of an asset is what comes before its first eligible row; all rows if there is none.
    ``fold_rows`` is the long table of partition assignment.
    """
    w = Window.partitionBy("asset").orderBy("origin_date")
    n = sup.withColumn("rn", F.row_number().over(w))
    first = F.min(F.when(F.col("eligible") == 1, F.col("rn"))).over(Window.partitionBy("asset"))
    n = n.withColumn("prefix", (F.coalesce(F.col("rn") < first, F.lit(True))).cast("int"))
    aggs = [F.count("*").alias("n_rows"), F.sum("eligible").alias("n_eligible"), F.sum("prefix").alias("n_prefix"), F.count_if(F.col("ref_observed") == 0).alias("n_no_reference"), F.min("origin_date").alias("first_date"), F.max("origin_date").alias("last_date")]
    null = F.lit(None).cast("string")
    flat = n.groupingSets([["asset"], []], "asset").agg(*aggs).select(null.alias("fold"), null.alias("partition"), "asset", *_names(aggs))
    if fold_rows is None:
        return flat
    f = fold_rows.select("fold", "partition", *C.SAMPLE_KEY).join(n, list(C.SAMPLE_KEY))
    by = f.groupingSets([["fold", "partition"], ["fold", "partition", "asset"]], "fold", "partition", "asset").agg(*aggs).select("fold", "partition", "asset", *_names(aggs))
    return flat.unionByName(by)


def _names(aggs) -> list[str]:
    return ["n_rows", "n_eligible", "n_prefix", "n_no_reference", "first_date", "last_date"]


def reference_view(sup: DataFrame, columns: Sequence[str] = ("ref_ret", "ref_std_21", f"ref_trend_{C.TREND}"), assets: int | None = None, tol: float = 1e-12) -> DataFrame:
    """one row an origin of values that every asset row repeats, with checks as counts."""
    spread = [F.max(c) - F.min(c) for c in columns]
    same = [(F.count(c) == 0) | ((F.count(c) == F.count("*")) & (s <= tol)) for c, s in zip(columns, spread)]
    return sup.groupBy("origin_date").agg(
        F.count("*").alias("n_assets"), F.countDistinct("asset").alias("n_distinct"), F.countDistinct("target_date").alias("n_targets"), *(F.max(c).alias(c) for c in columns), *(x.cast("int").alias(f"{c}_same") for c, x in zip(columns, same))
    )


def reconstruct(ref: DataFrame, tol: float = 1e-9, block_rows: int = 4096) -> DataFrame:
    """rebuild 21-row deviation and 63-row trend of the reference from its returns, block by block, and compare."""
    rows = halo(ref.withColumn("series", F.lit(0)), ["series"], "origin_date", block_rows, C.TREND)
    w = Window.partitionBy("series", "halo_block").orderBy("origin_date")
    std = F.when(F.count("ref_ret").over(w.rowsBetween(-20, 0)) == 21, F.stddev_pop("ref_ret").over(w.rowsBetween(-20, 0)))
    trend = F.when(F.count("ref_ret").over(w.rowsBetween(1 - C.TREND, 0)) == C.TREND, F.sum("ref_ret").over(w.rowsBetween(1 - C.TREND, 0)))
    made = rows.select("halo_own", F.col("ref_std_21").alias("std"), std.alias("std2"), F.col(f"ref_trend_{C.TREND}").alias("trend"), trend.alias("trend2")).where("halo_own")
    return made.agg(*(x for a in ("std", "trend") for x in (F.count(F.col(a) + F.col(f"{a}2")).alias(f"n_{a}"), F.count_if(F.abs(F.col(a) - F.col(f"{a}2")) > tol).alias(f"bad_{a}"), F.count_if(F.col(a).isNull() & F.col(f"{a}2").isNotNull()).alias(f"null_{a}"))))
