"""Exact-key comparison and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import checked_join, melt, quartiles

_KEY = list(C.FORECAST_KEY)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = C.FORECAST_KEY) -> DataFrame:
    """G1: counts of keys that only one side has and that both have; keys are never intersected silently."""
    x = a.select(*keys).distinct().withColumn("in_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, list(keys), "full")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("n_missing"), F.count_if(F.col("in_a").isNull()).alias("n_extra"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_common"))


def actual_agreement(a: DataFrame, b: DataFrame, rtol: float = 1e-12, atol: float = 1e-15) -> DataFrame:
    """Rows whose actual values differ beyond tolerance, and the largest difference."""
    x = a.select(*_KEY, F.col("actual_return").alias("x"), F.col("actual_direction").alias("dx"))
    y = b.select(*_KEY, F.col("actual_return").alias("y"), F.col("actual_direction").alias("dy")).distinct()
    gap = F.abs(F.col("x") - F.col("y"))
    both = x.join(y, _KEY, "full")
    return both.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_unmatched"), F.count_if(~(gap <= atol + rtol * F.abs("y"))).alias("n_return"), F.count_if(F.col("dx") != F.col("dy")).alias("n_direction"), F.max(gap).alias("max_abs_diff"))


def match_baseline(forecasts: DataFrame, baseline: DataFrame, check: bool = False) -> DataFrame:
    """Forecasts with their baseline's, one to one by key (many to one for seeds)."""
    b = baseline.select(*_KEY, F.col("predicted_return").alias("baseline_return"), F.col("predicted_direction").alias("baseline_direction"))
    return checked_join(forecasts, b, _KEY) if check else forecasts.join(b, _KEY, "left")


#: What two forecasts of a row are compared by: the prefix of a state's sums, the forecast and its direction.
SIDES = (("", "predicted_return", "predicted_direction"), ("baseline_", "baseline_return", "baseline_direction"))
STATE = ("n", "n_positive", "abs_sum", "sq_sum", "hits", "baseline_abs_sum", "baseline_sq_sum", "baseline_hits")


def states(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable states of metrics by ``keys``: counts and sums of errors, of the forecasts and, where they are there, of the baseline's.

    States of finer keys add up to those of coarser ones (:func:`add_up`), and those of a new fold are simply more rows.
    """
    sums = [F.count("*").alias("n"), F.count_if(F.col("actual_direction") == 1).alias("n_positive")]
    for prefix, value, guess in SIDES:
        if value in matched.columns:
            e = F.col(value) - F.col("actual_return")
            sums += [F.sum(F.abs(e)).alias(f"{prefix}abs_sum"), F.sum(e * e).alias(f"{prefix}sq_sum"), F.count_if(F.col(guess) == F.col("actual_direction")).alias(f"{prefix}hits")]
    return matched.groupBy(*keys).agg(*sums)


def add_up(finer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser keys."""
    return finer.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in STATE if c in finer.columns))


def of_states(made: DataFrame, keys: Sequence[str]) -> DataFrame:
    """N and the metrics of states: errors, accuracy and, beside a baseline, its own, skill and difference of accuracy."""
    n, out = F.nullif(F.col("n"), F.lit(0).cast("long")), {}
    for prefix, *_ in SIDES:
        if f"{prefix}abs_sum" in made.columns:
            out |= {f"{prefix}mae": F.col(f"{prefix}abs_sum") / n, f"{prefix}rmse": F.sqrt(F.col(f"{prefix}sq_sum") / n), f"{prefix}da": F.col(f"{prefix}hits") / n}
    told = made.select(*keys, "n", *(v.alias(k) for k, v in out.items()))
    return told.withColumns({"skill": skill(), "da_diff": F.col("da") - F.col("baseline_da")}) if "baseline_mae" in out else told


def error_metrics(df: DataFrame, keys: Sequence[str] = ("fold", "asset")) -> DataFrame:
    """Rows, mean absolute and root mean squared error, directional accuracy."""
    plain = df.select(*keys, *(c for c in ("predicted_return", "predicted_direction", "actual_return", "actual_direction") if c not in keys))
    return of_states(states(plain, keys), keys)


def class_balance(df: DataFrame, keys: Sequence[str] = ("fold", "asset")) -> DataFrame:
    """Counts and rates of positive and other sessions."""
    n, pos = F.count("*"), F.count_if(F.col("actual_direction") == 1)
    return df.groupBy(*keys).agg(n.alias("n"), pos.alias("n_positive"), (n - pos).alias("n_other"), (pos / n).alias("positive_rate"), (1 - pos / n).alias("other_rate"))


def skill(mae: str = "mae", base: str = "baseline_mae") -> Column:
    """1 - error / baseline error; undefined where the baseline has none."""
    return 1 - F.try_divide(F.col(mae), F.col(base))


def skill_metrics(matched: DataFrame, keys: Sequence[str] = ("model", "seed", "fold", "asset")) -> DataFrame:
    """Metrics beside the matched baseline's, skill and difference of accuracy."""
    return of_states(states(matched, keys), keys)


def macro_metrics(by_asset: DataFrame, n_assets: int, keys: Sequence[str] = ("model", "seed", "fold"), values: Sequence[str] = ("mae", "rmse", "da", "skill", "da_diff")) -> DataFrame:
    """Equal weight over assets, null unless all are there; skill is averaged, not recomputed."""
    full = (F.count("*") == n_assets)
    return by_asset.groupBy(*keys).agg(F.count("*").alias("n_assets"), F.sum("n").alias("n"), *(F.when(full & (F.count(v) == n_assets), F.avg(v)).alias(v) for v in values))


def seed_summary(df: DataFrame, seeds: Sequence[str], keys: Sequence[str] = ("model", "fold", "asset"), values: Sequence[str] = ("mae", "rmse", "da", "skill", "da_diff")) -> DataFrame:
    """Mean, population deviation, least and most over the expected seeds; metrics are averaged, not forecasts."""
    ok = (F.array_sort(F.collect_set("seed")) == F.array(*(F.lit(s) for s in sorted(seeds)))) & (F.count("*") == len(seeds)) & (F.min("n") == F.max("n"))
    aggs = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count("*").alias("n_seeds"), ok.cast("int").alias("seeds_ok"), F.max("n").alias("n"), *aggs)


def development_summary(df: DataFrame, keys: Sequence[str] = ("model", "asset"), values: Sequence[str] = ("mae", "rmse", "da", "skill", "da_diff")) -> DataFrame:
    """Median and quartiles over folds of each metric; null if a fold is undefined."""
    return quartiles(melt(df, keys, values), [*keys, "metric"])


def all_metrics(matched: DataFrame, n_assets: int, seeds: Sequence[str]) -> dict[str, DataFrame]:
    """Every level for plain and seeded models."""
    cells = skill_metrics(matched)
    macro = macro_metrics(cells, n_assets)
    seeded, plain = cells.where("seed IS NOT NULL"), cells.where("seed IS NULL")
    return {"cells": cells, "macro": macro, "seed_cells": seed_summary(seeded, seeds), "seed_macro": seed_summary(macro.where("seed IS NOT NULL"), seeds, ("model", "fold")), "development": development_summary(plain)}
