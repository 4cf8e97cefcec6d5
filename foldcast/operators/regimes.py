"""Market regimes: thresholds on permitted rows, labels, and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast import schema as C
from foldcast.functions import finite, grid_fill, require_none

#: Sessions in a year, the lag of the jump ratio, and the ratio from which volatility has jumped.
YEAR, LAG, JUMP = 252, 21, 1.5


def volatility_inputs(ref: DataFrame) -> DataFrame:
    """Annualised volatility, its lag, their ratio where both are finite and the lag positive, absolute return.

    ``ref`` has one row an origin; the reference series is one series of daily rows. An origin's
    target_date is the series' next date; the last origin has none.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("origin_date")
    out = ref.select("origin_date", F.col(f"ref_trend_{C.TREND}").alias("trend"), (F.col("ref_std_21") * F.sqrt(F.lit(float(YEAR)))).alias("vol"), F.abs("ref_ret").alias("abs_ret"))
    out = out.withColumns({"target_date": F.lead("origin_date").over(w), "vol_lag": F.lag("vol", LAG).over(w)})
    return out.withColumn("jump", F.when(finite(F.col("vol")) & finite(F.col("vol_lag")) & (F.col("vol_lag") > 0), F.try_divide("vol", "vol_lag")))


def thresholds(inputs: DataFrame, folds: DataFrame) -> DataFrame:
    """R2: per fold the median volatility and 95 % absolute return over origins whose target is before its test range.

    An origin is permitted if its target_date is between the fold's first train and last validation day; so the
    last origin of validation, whose target is a test day, is not. Each counts once.
    """
    ranges = folds.where("partition IN ('train', 'validation')").groupBy("fold").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = inputs.join(F.broadcast(ranges), F.col("target_date").between(F.col("start"), F.col("end")))  # a row a fold
    v, a = F.when(finite(F.col("vol")), F.col("vol")), F.when(finite(F.col("abs_ret")), F.col("abs_ret"))
    return rows.groupBy("fold").agg(F.percentile(v, F.lit(0.5)).alias("vol_median"), F.percentile(a, F.lit(0.95)).alias("ret_q95"), F.count(v).alias("n_vol"), F.count(a).alias("n_ret"), F.min("origin_date").alias("first_origin"), F.max("origin_date").alias("last_origin"))


def label_keys(forecasts: DataFrame, n_assets: int | None = None) -> DataFrame:
    """Distinct (fold, origin_date), with how many assets forecast there; ``n_assets``: only full ones."""
    out = forecasts.groupBy("fold", "origin_date").agg(F.countDistinct("asset").alias("n_assets"), F.min("target_date").alias("target_date"))
    return out if n_assets is None else out.where(F.col("n_assets") == n_assets)


def trend_class(trend: Column) -> Column:
    """R4."""
    return F.when(~finite(trend), "unavailable").when(trend > 0, "positive").otherwise("negative")


def volatility_class(vol: Column, median: Column) -> Column:
    """R5."""
    return F.when(~(finite(vol) & finite(median)), "unavailable").when(vol > median, "high").otherwise("low")


def transition_flags(jump: Column, abs_ret: Column, q95: Column) -> tuple[Column, Column]:
    """Whether volatility jumped and whether the return was a shock; null where a part is missing."""
    return F.when(finite(jump), jump >= JUMP), F.when(finite(abs_ret) & finite(q95), abs_ret > q95)


def transition_class(jumped: Column, shock: Column) -> Column:
    """Stressed if either part holds; unavailable only if both are missing."""
    no = F.lit(False)
    return F.when(jumped.isNull() & shock.isNull(), "unavailable").when(F.coalesce(jumped, no) | F.coalesce(shock, no), "stressed").otherwise("stable")


def label_gaps(keys: DataFrame, inputs: DataFrame, limits: DataFrame) -> DataFrame:
    """(problem, fold, origin_date) for keys without reference values, keys without thresholds and folds with thresholds alone."""
    k = keys.select("fold", "origin_date").distinct()
    none = F.lit(None).cast("date").alias("origin_date")
    bare = k.join(inputs, "origin_date", "left_anti").select(F.lit("no_reference").alias("problem"), "fold", "origin_date")
    loose = k.join(limits, "fold", "left_anti").select(F.lit("no_thresholds").alias("problem"), "fold", "origin_date")
    unused = limits.join(k, "fold", "left_anti").select(F.lit("unused_thresholds").alias("problem"), "fold", none)
    return bare.unionByName(loose).unionByName(unused)


def labels(keys: DataFrame, inputs: DataFrame, limits: DataFrame) -> DataFrame:
    """One row a (fold, origin) with source values, flags and the three labels."""
    x = keys.join(inputs, "origin_date", "left").join(F.broadcast(limits.select("fold", "vol_median", "ret_q95")), "fold", "left")
    jumped, shock = transition_flags(F.col("jump"), F.col("abs_ret"), F.col("ret_q95"))
    return x.select(
        "fold", "origin_date", "trend", "vol", "vol_lag", "jump", "abs_ret", "vol_median", "ret_q95", jumped.cast("int").alias("jumped"), shock.cast("int").alias("shock"),
        trend_class(F.col("trend")).alias("trend_regime"), volatility_class(F.col("vol"), F.col("vol_median")).alias("volatility_regime"), transition_class(jumped, shock).alias("transition_regime"),
    )


def label_counts(table: DataFrame) -> DataFrame:
    """Counts of every label by fold and dimension, zero where it doesn't occur."""
    long = table.unpivot(["fold"], list(C.DIMENSIONS), "dimension", "label")
    n = long.groupBy("fold", "dimension", "label").agg(F.count("*").alias("n"))
    values = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("label")) for d, vs in C.DIMENSIONS.items() for v in (*vs, "unavailable")))
    return grid_fill(n, table.select("fold").distinct().select("fold", F.inline(values)), ["fold", "dimension", "label"], ["n"])


def attach(forecasts: DataFrame, table: DataFrame) -> DataFrame:
    """Labels on forecasts by exact key; other columns and the row count stay."""
    out = forecasts.drop(*C.DIMENSIONS).join(table.select("fold", "origin_date", *C.DIMENSIONS), ["fold", "origin_date"], "left")
    return out.select(*forecasts.columns)


def attach_check(before: DataFrame, after: DataFrame, table: DataFrame) -> DataFrame:
    """Row counts before and after, forecasts without labels and labels without forecasts."""
    k = ["fold", "origin_date"]
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(before, "n_before").crossJoin(n(after, "n_after")).crossJoin(n(before.select(*k).distinct().join(table, k, "left_anti"), "n_unlabelled")).crossJoin(n(table.select(*k).join(before, k, "left_anti"), "n_unused"))


def inconsistent(labelled: DataFrame) -> DataFrame:
    """(fold, origin) whose labels differ between models or seeds."""
    return labelled.groupBy("fold", "origin_date").agg(*(F.countDistinct(d).alias(d) for d in C.DIMENSIONS)).where(" OR ".join(f"{d} > 1" for d in C.DIMENSIONS))


def label_mismatches(table: DataFrame) -> DataFrame:
    """Rows of a stored label table whose labels don't follow from its own values."""
    jumped, shock = transition_flags(F.col("jump"), F.col("abs_ret"), F.col("ret_q95"))
    again = {"trend_regime": trend_class(F.col("trend")), "volatility_regime": volatility_class(F.col("vol"), F.col("vol_median")), "transition_regime": transition_class(jumped, shock)}
    wrong = [F.when(~F.col(d).eqNullSafe(x), F.lit(d)) for d, x in again.items()]
    return table.select("fold", "origin_date", F.explode(F.array_compact(F.array(*wrong))).alias("dimension"))


def regimes(sup_ref: DataFrame, folds: DataFrame, forecasts: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inputs, thresholds, labels) for the keys of all forecasts.

    Keys without reference values or thresholds are an error (R7). Thresholds of folds without forecasts, such as the guarded one, are not.
    """
    inputs = volatility_inputs(sup_ref)
    limits = thresholds(inputs, folds)
    keys = forecasts[0].select("fold", "origin_date")
    for f in forecasts[1:]:
        keys = keys.union(f.select("fold", "origin_date"))
    keys = keys.distinct()
    require_none(label_gaps(keys, inputs, limits).where("problem <> 'unused_thresholds'"), "labels would be incomplete")
    return inputs, limits, labels(keys, inputs, limits)
