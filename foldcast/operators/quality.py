"""Rules on panels, supervised tables and forecasts (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast import schema as C
from foldcast.functions import direction, duplicates, finite, require_none, violations


def panel_rules(universe: Sequence[str], start: str, end: str) -> dict[str, Column]:
    """Q1: rules that hold for a broken row."""
    c = F.col
    return {
        "empty_asset": c("asset").isNull() | (F.trim("asset") == ""),
        "unknown_asset": ~c("asset").isin(*universe),
        "date_out_of_range": ~c("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")),
        "weekend": F.weekday("date") >= 5,
        "not_finite": ~(finite(c("open")) & finite(c("high")) & finite(c("low")) & finite(c("close")) & finite(c("volume"))),
        "price_not_positive": F.least(*C.PRICES) <= 0,
        "negative_volume": c("volume") < 0,
    }


def ohlc_rules() -> dict[str, Column]:
    """Q2: how open, high, low and close must relate."""
    c = F.col
    return {"high_below_open": c("high") < c("open"), "high_below_close": c("high") < c("close"), "high_below_low": c("high") < c("low"), "low_above_open": c("low") > c("open"), "low_above_close": c("low") > c("close")}


def panel_violations(panel: DataFrame, universe: Sequence[str], start: str, end: str) -> DataFrame:
    """Q1 and Q2 in one pass: (rule, asset, date)."""
    return violations(panel, panel_rules(universe, start, end) | ohlc_rules(), ["asset", "date"])


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("asset", "date")) -> DataFrame:
    """Q3: all copies of rows whose key repeats."""
    return duplicates(df, keys)


def missing_assets(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Q4: required assets without a row."""
    return universe.join(panel, "asset", "left_anti")


def _ordinals(sessions: DataFrame) -> DataFrame:
    """Sessions with their numbers from 1: a row a day, so one small task."""
    return sessions.select("date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))


def gap_runs(panel: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """Q5: (asset, first, last, n): runs of consecutive sessions that an asset lacks, as session numbers.

    An asset's own sessions are compared with their neighbours; its first and last with the calendar's ends. An asset without rows
    lacks them all. Nothing is multiplied: a run is a row, however long.
    """
    numbered = _ordinals(sessions)
    ends = numbered.agg(F.max("k").alias("most"))
    have = panel.select("asset", "date").join(assets, "asset", "left_semi").distinct().join(F.broadcast(numbered), "date")
    w = Window.partitionBy("asset").orderBy("k")
    inner = have.select("asset", (F.coalesce(F.lag("k").over(w), F.lit(0)) + 1).alias("first"), (F.col("k") - 1).alias("last"))
    seen = have.groupBy("asset").agg(F.max("k").alias("k"))
    tail = assets.select("asset").distinct().join(seen, "asset", "left").crossJoin(F.broadcast(ends)).select("asset", (F.coalesce("k", F.lit(0)) + 1).alias("first"), F.coalesce("most", F.lit(0)).alias("last"))
    return inner.unionByName(tail).where("first <= last").withColumn("n", (F.col("last") - F.col("first") + 1).cast("long"))


def _unexpected(panel: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    return panel.select("asset", "date").join(assets, "asset", "left_semi").distinct().join(F.broadcast(sessions.select("date").distinct()), "date", "left_anti")


def calendar_gaps(panel: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """Q5: (asset, date, kind) of sessions an asset lacks and dates that are no session. Runs are written out here, and here alone."""
    days = gap_runs(panel, sessions, assets).select("asset", F.explode(F.sequence("first", "last")).alias("k"))
    lacking = days.join(F.broadcast(_ordinals(sessions)), "k").select("asset", "date", F.lit("missing").alias("kind"))
    return lacking.unionByName(_unexpected(panel, sessions, assets).select("asset", "date", F.lit("unexpected").alias("kind")))


def calendar_audit(panel: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """Q5 and Q7: counts by asset, and whether the asset's calendar is clean. Runs are counted, not written out."""
    expected = sessions.select("date").distinct().agg(F.count("*").alias("expected"))
    seen = panel.join(assets, "asset", "left_semi").groupBy("asset").agg(F.countDistinct("date").alias("observed"))
    lacking = gap_runs(panel, sessions, assets).groupBy("asset").agg(F.sum("n").alias("missing"))
    more = _unexpected(panel, sessions, assets).groupBy("asset").agg(F.count("*").alias("unexpected"))
    out = assets.select("asset").distinct().join(seen, "asset", "left").join(lacking, "asset", "left").join(more, "asset", "left").crossJoin(F.broadcast(expected))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("asset", "expected", n("observed"), n("missing"), n("unexpected"))
    return out.withColumn("is_clean", ((F.col("missing") == 0) & (F.col("unexpected") == 0)).cast("int"))


def calendar_gate(audit: DataFrame) -> None:
    """Q7: fail unless every asset's calendar is clean."""
    require_none(audit.where("is_clean = 0"), "calendars aren't clean")


def date_difference(panel: DataFrame, reference: str = C.REFERENCE) -> DataFrame:
    """Q6: (date, side) of dates that only targets or only the reference have."""
    own = panel.where(F.col("asset") != reference).select("date").distinct()
    ref = panel.where(F.col("asset") == reference).select("date").distinct()
    return own.join(ref, "date", "left_anti").withColumn("side", F.lit("target_only")).unionByName(ref.join(own, "date", "left_anti").withColumn("side", F.lit("reference_only")))


def supervised_violations(df: DataFrame, start: str, end: str) -> DataFrame:
    """Q8: (rule, sample key) of rows of a supervised table that break a rule."""
    c = F.col
    eligible = eligibility()
    rules = {
        "target_not_after_origin": c("target_date") <= c("origin_date"),
        "date_out_of_range": ~(c("origin_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & c("target_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))),
        "target_not_finite": ~finite(c("target_return")),
        "direction_differs": c("target_direction") != direction(c("target_return")),
        "observed_not_binary": ~c("ref_observed").isin(0, 1),
        "eligible_not_binary": ~c("eligible").isin(0, 1),
        "eligible_differs": ~c("eligible").eqNullSafe(eligible),
    }
    return violations(df, rules, C.SAMPLE_KEY)


def eligibility() -> Column:
    """1 where all numeric features are finite and the reference was observed; the target plays no part."""
    fine = F.forall(F.array(*C.FEATURES), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (fine & (F.col("ref_observed") == 1)).cast("int")


def forecast_violations(df: DataFrame, folds: DataFrame, assets: Sequence[str], seeds: Sequence[str] | None = None, zero_baseline: bool = False) -> DataFrame:
    """Q9: (rule, forecast key) of forecasts that break a rule. Test years come from the fold table."""
    c = F.col
    tests = F.broadcast(folds.where("partition = 'test'").select("fold", F.col("start").alias("t0"), F.col("end").alias("t1")))
    rules = {
        "unknown_fold": c("t0").isNull(),
        "unknown_asset": ~c("asset").isin(*assets),
        "not_test": c("partition") != "test",
        "outside_fold": c("t0").isNotNull() & ~c("target_date").between(c("t0"), c("t1")),
        "not_finite": ~(finite(c("actual_return")) & finite(c("predicted_return"))),
        "actual_direction_differs": c("actual_direction") != direction(c("actual_return")),
    }
    if seeds is not None:
        rules["unknown_seed"] = ~c("seed").isin(*seeds)
    if zero_baseline:
        rules["baseline_not_zero"] = c("predicted_return") != 0
    else:
        rules["predicted_direction_differs"] = c("predicted_direction") != direction(c("predicted_return"))
    keys = [*C.FORECAST_KEY, "seed"]
    broken = violations(df.join(tests, "fold", "left"), rules, keys)
    return broken.unionByName(duplicates(df.select(*keys), keys).select(F.lit("duplicate_key").alias("rule"), *keys))


def examples(found: DataFrame, keys: Sequence[str], most: int = 5) -> DataFrame:
    """Q10: the first rows of each broken rule by key."""
    w = Window.partitionBy("rule").orderBy(*keys)
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
