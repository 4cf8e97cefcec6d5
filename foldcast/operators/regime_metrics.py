"""Metrics by regime cell, contrasts and failure patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import quartiles
from foldcast.operators import metrics

LEAST, TOLERANCE = 30, 1e-12
#: What a contrast takes from a cell: its name, the metric, and the sign with which more is worse.
CONTRASTS = (("skill_change", "skill", 1), ("mae_change", "mae", 1), ("rmse_change", "rmse", 1), ("da_change", "da", 1), ("stability_loss", "da", -1))


def status(n: Column, least: int = LEAST) -> Column:
    """X1."""
    return F.when(n >= least, "reportable").otherwise("suppressed")


def _grid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("label")) for d, vs in C.DIMENSIONS.items() for v in vs))
    return df.select(*keys).distinct().select(*keys, F.inline(values))


def finest(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of all metrics (G) by ``keys`` and the three labels together: all cells, levels and contrasts follow from them."""
    plain = labelled.withColumn("seed", F.coalesce("seed", F.lit(""))) if "seed" in keys else labelled
    return metrics.states(plain, [*keys, *C.DIMENSIONS])


def _cells(made: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Metrics of every cell of the whole keys x dimension x label grid from the finest states; an empty cell has n = 0 and null metrics."""
    cell = [*keys, "dimension", "label"]
    long = made.unpivot([c for c in made.columns if c not in C.DIMENSIONS], list(C.DIMENSIONS), "dimension", "label")
    # zero states of the grid's cells instead of a join with it
    zero = _grid(made, keys).select(*cell, *(F.lit(0).cast(t).alias(c) for c, t in long.dtypes if c in metrics.STATE))
    known = F.concat_ws("|", "dimension", "label").isin([f"{d}|{v}" for d, vs in C.DIMENSIONS.items() for v in vs])
    summed = metrics.add_up(long.where(known).select(*zero.columns).unionByName(zero), cell)
    out = metrics.of_states(summed, cell)
    if "baseline_mae" not in out.columns:
        out = out.join(summed.select(*cell, "n_positive"), cell)
    return out.withColumn("status", status(F.col("n"), least))


def baseline_cells(labelled: DataFrame, least: int = LEAST) -> DataFrame:
    """Baseline metrics of the whole fold x asset x dimension x label grid; an empty cell has n = 0 and null metrics."""
    keys = ["fold", "asset"]
    plain = labelled.select(*keys, "predicted_return", "predicted_direction", "actual_return", "actual_direction", *C.DIMENSIONS)
    return _cells(finest(plain, keys), keys, least)


def learned_cells(matched: DataFrame, least: int = LEAST) -> DataFrame:
    """Per model and seed, with skill against the matched baseline. ``matched`` has forecasts, or states that :func:`finest` made of them."""
    keys = ["model", "seed", "fold", "asset"]
    return _cells(matched if "abs_sum" in matched.columns else finest(matched, keys), keys, least)


def cell_seed_summary(cells: DataFrame, values: Sequence[str] = ("mae", "rmse", "da", "skill", "da_diff")) -> DataFrame:
    """Over seeds; reportable if all are. A metric that some seeds of a cell have and some lack is an error when the cell is read."""
    keys = ["model", "fold", "asset", "dimension", "label"]
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    mixed = sum((((F.count(v) > 0) & (F.count(v) < F.count("*"))).cast("int") for v in values), F.lit(0))
    return cells.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.max("n").alias("n"), F.when(F.bool_and(F.col("status") == "reportable"), "reportable").otherwise("suppressed").alias("status"), F.when(mixed > 0, F.raise_error(F.lit("some seeds of a cell have a metric that others lack")).cast("int")).otherwise(mixed).alias("mixed"), *aggs)


def sign(c: Column, tol: float = TOLERANCE) -> Column:
    """X5."""
    return F.when(c.isNull(), None).when(c > tol, "positive").when(c < -tol, "negative").otherwise("zero")


def contrasts(cells: DataFrame, keys: Sequence[str] = ("model", "seed", "fold", "asset")) -> DataFrame:
    """Stressed side minus reference side of each dimension, only where both cells are reportable.

    The stressed side is the dimension's second label (negative trend, high volatility, stressed).
    """
    ref = F.when(F.col("dimension") == "trend_regime", "positive").when(F.col("dimension") == "volatility_regime", "low").otherwise("stable")
    hot = F.when(F.col("dimension") == "trend_regime", "negative").when(F.col("dimension") == "volatility_regime", "high").otherwise("stressed")
    side = cells.withColumn("side", F.when(F.col("label") == ref, 0).when(F.col("label") == hot, 1))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    ok = F.bool_and(F.coalesce(F.col("status") == "reportable", F.lit(False))) & (F.count("*") == 2)
    out = side.groupBy(*keys, "dimension").agg(
        pick("n", 0).alias("n_reference"), pick("n", 1).alias("n_stressed"), F.when(ok, "reportable").otherwise("suppressed").alias("status"), *(((pick(m, 1) - pick(m, 0)) * s).alias(f"raw_{name}") for name, m, s in CONTRASTS)
    )
    return out.select(*keys, "dimension", "n_reference", "n_stressed", "status", *(F.when(F.col("status") == "reportable", F.col(f"raw_{name}") + F.lit(0.0)).alias(name) for name, _, _ in CONTRASTS))


def seed_signs(table: DataFrame, keys: Sequence[str] = ("model", "fold", "asset"), value: str = "mae_change") -> DataFrame:
    """Mean contrast over seeds, the seeds' signs as text, and whether they disagree."""
    s = sign(F.col(value))
    return table.groupBy(*keys, "dimension").agg(
        F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", s.alias("s")))), lambda x: F.concat_ws(":", x["seed"], F.coalesce(x["s"], F.lit("undefined")))), ",").alias("signs"), (F.countDistinct(s) > 1).cast("int").alias("disagree")
    )


def macro_cells(cells: DataFrame, n_assets: int, values: Sequence[str] = ("mae", "rmse", "da", "skill", "da_diff"), keys: Sequence[str] = ("model", "seed", "fold")) -> DataFrame:
    """Equal weight over assets, only if all are reportable."""
    full = (F.count("*") == n_assets) & F.bool_and(F.col("status") == "reportable")
    out = cells.groupBy(*keys, "dimension", "label").agg(F.count_if(F.col("status") == "reportable").alias("n_reportable"), F.sum("n").alias("n"), F.when(full, "reportable").otherwise("suppressed").alias("status"), *(F.when(full, F.avg(v)).alias(v) for v in values))
    return out


def macro_with_seed_mean(cells: DataFrame, n_assets: int) -> DataFrame:
    """Rows for each seed and, beside them, their mean as seed 'mean'."""
    values = ("mae", "rmse", "da", "skill", "da_diff")
    per = macro_cells(cells, n_assets, values)
    ok = F.bool_and(F.col("status") == "reportable")
    mean = per.groupBy("model", "fold", "dimension", "label").agg(F.min("n_reportable").alias("n_reportable"), F.max("n").alias("n"), F.when(ok, "reportable").otherwise("suppressed").alias("status"), *(F.when(ok, F.avg(v)).alias(v) for v in values))
    return per.unionByName(mean.withColumn("seed", F.lit("mean")))


def contrast_summary(table: DataFrame, keys: Sequence[str] = ("model", "seed", "asset", "dimension")) -> DataFrame:
    """Median, quartiles, least and most over reportable folds; groups without one stay, with nulls."""
    names = [n for n, _, _ in CONTRASTS]
    long = table.unpivot([*keys, "fold", "status"], names, "metric", "value")
    good = long.where("status = 'reportable'")
    k = [*keys, "metric"]
    q = quartiles(good, k).join(good.groupBy(*k).agg(F.min("value").alias("least"), F.max("value").alias("most")), k)
    total = long.groupBy(*k).agg(F.countDistinct("fold").alias("n_expected"))
    out = total.join(q, k, "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)))
    return out.withColumn("completeness", F.when(F.col("n_folds") == 0, "empty").when(F.col("n_folds") < F.col("n_expected"), "partial").otherwise("complete"))


def failure_patterns(by_asset: DataFrame, macro: DataFrame, value: str = "skill_change") -> DataFrame:
    """Reportable, suppressed and sign counts by level, model and dimension, and how many contrasts have seeds of different signs.

    Signs must add up to the reportable; it is an error if they don't.
    """
    keys = ["model", "dimension", "fold", "status", value]
    both = by_asset.select(F.lit("asset").alias("level"), "asset", *keys).unionByName(macro.select(F.lit("macro").alias("level"), F.lit("ALL").alias("asset"), *keys))
    s = sign(F.col(value))
    good = F.col("status") == "reportable"
    signs = ("negative", "zero", "positive")
    counts = {"n": F.count("*"), "n_reportable": F.count_if(good), "n_suppressed": F.count_if(~good), **{f"n_{x}": F.count_if(good & (s == x)) for x in signs}}
    by_seed = both.groupBy("level", "model", "dimension", "fold", "asset").agg(*(c.alias(n) for n, c in counts.items()), (F.countDistinct(F.when(good, s)) > 1).cast("long").alias("n_seed_disagree"))
    out = by_seed.groupBy("level", "model", "dimension").agg(*(F.sum(n).alias(n) for n in (*counts, "n_seed_disagree")))
    whole = F.col("n_negative") + F.col("n_zero") + F.col("n_positive") == F.col("n_reportable")
    return out.withColumn("n_reportable", F.when(whole, F.col("n_reportable")).otherwise(F.raise_error("signs don't add up to the reportable contrasts").cast("long")))


def disagreement(table: DataFrame) -> DataFrame:
    """X11: for each reportable contrast, whether error and direction worsened together."""
    e, d = sign(F.col("mae_change")), sign(F.col("stability_loss"))
    kind = F.when((e == "positive") & (d == "positive"), "both_worse").when((e == "positive") & (d != "positive"), "error_only").when((e != "positive") & (d == "positive"), "direction_only").otherwise("neither")
    return table.where("status = 'reportable'").withColumn("kind", kind)


def run_regimes(labelled_baseline: DataFrame, labelled_matched: DataFrame, n_assets: int, least: int = LEAST) -> dict[str, DataFrame]:
    """All tables of this module from labelled forecasts."""
    cells = learned_cells(labelled_matched, least)
    by_asset = contrasts(cells)
    macro = macro_cells(cells, n_assets)
    by_macro = contrasts(macro, ("model", "seed", "fold"))
    return {"baseline_cells": baseline_cells(labelled_baseline, least), "cells": cells, "seed_cells": cell_seed_summary(cells), "contrasts": by_asset, "macro": macro_with_seed_mean(cells, n_assets), "macro_contrasts": by_macro, "signs": seed_signs(by_asset), "macro_signs": seed_signs(by_macro, ("model", "fold")), "summary": contrast_summary(by_asset), "patterns": failure_patterns(by_asset, by_macro), "disagreement": disagreement(by_asset)}
