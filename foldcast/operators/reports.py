"""Comparison reports (C1-C7, C9-C11); the table diff C8 is in ``functions``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.functions import quartiles, table_diff
from foldcast.operators.regime_metrics import TOLERANCE, sign


def side_by_side(baseline: DataFrame, plain: DataFrame, seeded: DataFrame, keys: Sequence[str] = ("fold", "asset")) -> DataFrame:
    """Baseline, a plain model and the seed summary of another in one row a key."""
    b = baseline.select(*keys, *(F.col(c).alias(f"baseline_{c}") for c in ("mae", "rmse", "da")))
    p = plain.select(*keys, *(F.col(c).alias(f"plain_{c}") for c in ("mae", "rmse", "da", "skill")))
    s = seeded.select(*keys, *(F.col(f"{c}_mean").alias(f"seeded_{c}") for c in ("mae", "rmse", "da", "skill")), F.col("skill_std").alias("seeded_skill_std"))
    return b.join(p, list(keys)).join(s, list(keys))


def macro_series_summary(table: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Median and quartiles of macro series over folds."""
    return quartiles(table.unpivot(["fold", *keys], list(values), "metric", "value"), [*keys, "metric"])


def win_loss(table: DataFrame, keys: Sequence[str] = ("model", "seed"), values: Sequence[str] = ("skill", "da_diff"), tol: float = TOLERANCE) -> DataFrame:
    """C4: wins, zeros and losses of each metric."""
    s = sign(F.col("value"), tol)
    long = table.unpivot(list(keys), list(values), "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), *(F.count_if(s == x).alias(name) for name, x in (("n_win", "positive"), ("n_zero", "zero"), ("n_loss", "negative"))))


def seed_stability(summary: DataFrame, metric: str = "skill") -> DataFrame:
    """Spread of a metric over seeds and whether its sign changes."""
    lo, hi = F.col(f"{metric}_min"), F.col(f"{metric}_max")
    return summary.select("model", "fold", "asset", F.col(f"{metric}_std").alias("std"), (hi - lo).alias("range"), lo.alias("least"), hi.alias("most"), ((lo < -TOLERANCE) & (hi > TOLERANCE)).cast("int").alias("sign_change"))


def fold_ranks(table: DataFrame) -> DataFrame:
    """Ranks by error (least first) and accuracy (most first) within a fold; ties share the least rank."""
    w = Window.partitionBy("fold")
    return table.withColumns({"mae_rank": F.rank().over(w.orderBy("mae")), "da_rank": F.rank().over(w.orderBy(F.col("da").desc()))})


def effort(audit: DataFrame, refits: DataFrame, skills: DataFrame, family: str = "model") -> DataFrame:
    """Fits, refits, seeds and cells of positive skill by family, and the seconds of fits and refits where both tables tell them."""
    timed = "runtime" in audit.columns and "runtime" in refits.columns
    seconds = lambda name: [F.sum("runtime").alias(name)] if timed else []
    a = audit.groupBy(family).agg(F.count("*").alias("n_fits"), F.countDistinct("seed").alias("n_seeds"), *seconds("fit_seconds"))
    r = refits.groupBy(family).agg(F.count("*").alias("n_refits"), *seconds("refit_seconds"))
    s = skills.groupBy(family).agg(F.count_if(F.col("skill") > 0).alias("n_positive_skill"))
    out = a.join(r, family, "left").join(s, family, "left")
    return out.withColumn("seconds", F.col("fit_seconds") + F.coalesce("refit_seconds", F.lit(0.0))).drop("fit_seconds", "refit_seconds") if timed else out


def verify_tables(stored: Mapping[str, DataFrame], made: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """The C8 report of a set of tables, as one."""
    parts = [table_diff(stored[n], made[n], keys[n]).withColumn("table", F.lit(n)) for n in sorted(stored)]
    return reduce(DataFrame.unionByName, parts)


def extremes(table: DataFrame, value: str = "std", keys: Sequence[str] = ("fold", "asset")) -> DataFrame:
    """The rows of largest and smallest dispersion."""
    k = F.concat_ws("|", *keys)
    return table.groupBy("model").agg(F.max_by(k, F.struct(value, k)).alias("largest"), F.max(value).alias("largest_value"), F.min_by(k, F.struct(value, k)).alias("smallest"), F.min(value).alias("smallest_value"))


def chart_series(table: DataFrame, keys: Sequence[str], values: Sequence[str] = ("skill", "da_diff")) -> DataFrame:
    """C11: mean over seeds by the chart's keys: macro series by fold, or cells by fold and asset."""
    return table.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def chart_reportability(levels: Mapping[str, DataFrame]) -> DataFrame:
    """C11: reportable contrasts and all of them by level and model."""
    both = reduce(DataFrame.unionByName, (d.select(F.lit(k).alias("level"), "model", "status") for k, d in levels.items()))
    return both.groupBy("level", "model").agg(F.count_if(F.col("status") == "reportable").alias("n_reportable"), F.count("*").alias("n"))


def chart_contrasts(table: DataFrame, value: str = "skill_change") -> DataFrame:
    """C11: median contrast, negative counts and reportability by model and dimension."""
    good = F.when(F.col("status") == "reportable", F.col(value))
    return table.groupBy("model", "dimension").agg(F.percentile(good, F.lit(0.5)).alias("median"), F.count_if(good < 0).alias("n_negative"), F.count(good).alias("n_reportable"), F.count("*").alias("n_cells"))
