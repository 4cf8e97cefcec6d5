"""Baselines, candidate fits, selection and refits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast import schema as C
from foldcast.functions import direction, finite, require_none, table_diff
from foldcast.operators.folds import assign
from foldcast.operators.moments import fold_fits
from foldcast.sources.artifacts import stored

#: Candidates whose error is within this of the best count as tied.
TIE = 1e-5


def forecast_rows(df: DataFrame, model: Column, config: Column, seed: Column, predicted: Column, predicted_direction: Column | None = None, run_id: str = "run") -> DataFrame:
    """M6: rows of the forecast table; the direction is the sign of the forecast unless given. Provenance is stamped on results."""
    none = F.lit(None).cast("string")
    return df.select(
        model.alias("model"), config.alias("config"), seed.cast("string").alias("seed"), "fold", "partition", "asset", "origin_date", "target_date",
        predicted.cast("double").alias("predicted_return"), F.col("target_return").alias("actual_return"), (direction(predicted) if predicted_direction is None else predicted_direction).cast("int").alias("predicted_direction"), F.col("target_direction").alias("actual_direction"),
        none.alias("trend_regime"), none.alias("volatility_regime"), none.alias("transition_regime"), F.lit(run_id).alias("run_id"),
    )


def zero_return() -> Column:
    """M1."""
    return F.lit(0.0)


def persistence(ret: str = "ret") -> Column:
    """M2: the direction of the origin session; a return that isn't finite is an error when its row is read."""
    return F.when(finite(F.col(ret)), direction(F.col(ret))).otherwise(F.raise_error(F.lit(f"{ret} of the origin session isn't finite")).cast("int"))


def baseline_forecasts(slices: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """M3: zero return and persistent direction on eligible test rows of the development folds.

    With ``assets``, every development fold must have test rows of them all.
    """
    test = slices.where("partition = 'test' AND role = 'development'")
    if assets is not None:
        grid = test.select("fold").distinct().join(F.broadcast(assets.select("asset").distinct().agg(F.collect_set("asset").alias("assets")))).select("fold", F.explode("assets").alias("asset"))
        require_none(grid.join(test, ["fold", "asset"], "left_anti"), "test slices without an asset")
    return forecast_rows(test, F.lit("baseline"), F.lit("zero_persistence"), F.lit(None), zero_return(), persistence())


#: Fits that may be broadcast: a row a cell.
BROADCAST_FITS = 200_000


def ols_predict(rows: DataFrame, fits: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Forecast rows of every fitted cell (fold, asset, config, seed): model 'plain' without a seed, else 'seeded'.

    Fits are a few rows a fold and asset; they are counted, and broadcast if few.
    """
    small = F.broadcast(fits) if fits.count() <= BROADCAST_FITS else fits
    x = F.coalesce(*(F.when(F.col("config") == c, F.col(c)) for c in configs))
    y = rows.join(small.drop("usage", "n_train"), ["fold", "asset"])
    return forecast_rows(y, F.when(F.col("seed").isNull(), "plain").otherwise("seeded"), F.col("config"), F.col("seed"), F.col("intercept") + F.col("slope") * x)


def candidate_audit(validation: DataFrame, fits: DataFrame) -> DataFrame:
    """M7: per cell rows, errors and class counts on validation rows; of the fits also iterations and seconds, where they have them."""
    e = F.col("predicted_return") - F.col("actual_return")
    agg = validation.groupBy("model", "fold", "config", "asset", "seed").agg(
        F.count("*").alias("n_validation"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.col("actual_direction") == F.col("predicted_direction")).cast("double")).alias("da"), F.count_if(F.col("actual_direction") == 1).alias("n_positive"), F.count_if(F.col("actual_direction") != 1).alias("n_other")
    )
    f = fits.select("fold", "asset", "config", F.coalesce("seed", F.lit("")).alias("s"), "n_train", *(c for c in ("best_iteration", "runtime") if c in fits.columns))
    out = agg.withColumn("s", F.coalesce("seed", F.lit(""))).join(f, ["fold", "asset", "config", "s"], "left").drop("s")
    return out.withColumn("status", F.when(finite(F.col("mae")), "completed").otherwise("failed"))


def grid_gaps(audit: DataFrame, expected: DataFrame) -> DataFrame:
    """M8: (cell, problem): cells that are missing, unexpected, repeated or not completed."""
    keys = ["fold", "config", "asset", "seed"]
    a = audit.withColumn("seed", F.coalesce("seed", F.lit("")))
    e = expected.withColumn("seed", F.coalesce("seed", F.lit("")))
    missing = e.join(a, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    extra = a.join(e, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    twice = a.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("problem"))
    failed = a.where("status <> 'completed'").select(*keys, F.lit("failed").alias("problem"))
    return missing.unionByName(extra).unionByName(twice).unionByName(failed)


def key_agreement(validation: DataFrame) -> DataFrame:
    """M8: per fold and asset, how many different key sets the candidates were judged on."""
    h = F.xxhash64("origin_date", "target_date")
    sets = validation.groupBy("fold", "asset", "config", "seed").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h"))
    return sets.groupBy("fold", "asset").agg(F.countDistinct("n", "h").alias("n_key_sets"), F.count("*").alias("n_cells"))


def fold_winner(audit: DataFrame, simplicity: DataFrame, tie: float = TIE, by: Sequence[str] = ("fold",)) -> DataFrame:
    """M9: per fold the config of least equal-weight error; ties go to the simpler, then rmse, then id.

    Only configs with every asset that any of the fold's configs has can win. A config without a simplicity
    is the least simple.
    """
    by_seed = audit.groupBy(*by, "config", "asset").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))
    macro = by_seed.groupBy(*by, "config").agg(F.count("*").alias("n_assets"), F.avg("mae").alias("macro_mae"), F.avg("rmse").alias("macro_rmse"))
    own = Window.partitionBy(*by)
    macro = macro.withColumn("full", F.col("n_assets") == F.max("n_assets").over(own))
    best = F.min(F.when(F.col("full"), F.col("macro_mae"))).over(own)
    out = macro.join(simplicity, "config", "left").withColumn("delta", F.col("macro_mae") - best).withColumn("tied", (F.col("full") & (F.col("delta") <= tie)).cast("int"))
    order = own.orderBy(F.col("tied").desc(), F.when(F.col("tied") == 1, F.coalesce("simplicity", F.lit(1 << 30))).otherwise(F.lit(0)), F.when(F.col("tied") == 1, F.col("macro_rmse")).otherwise(F.col("macro_mae")), "config")
    alone = F.sum("tied").over(own) == 1
    out = out.drop("full").withColumn("selected", (F.row_number().over(order) == 1).cast("int"))
    return out.withColumn("reason", F.when(F.col("selected") == 0, "not_selected").when(alone, "lowest_error").otherwise("tie_break"))


def winner_iterations(winners: DataFrame, audit: DataFrame, iteration: str = "best_iteration", by: Sequence[str] = ("fold",)) -> DataFrame:
    """The iteration counts of the winners' cells."""
    return winners.where("selected = 1").select(*by, "config").join(audit.select(*by, "config", "asset", "seed", iteration), [*by, "config"])


def refit_audit(slices: DataFrame, fits: DataFrame, forecasts: DataFrame, winners: DataFrame, cell: Sequence[str] = ("fold", "asset", "config"), iterations: DataFrame | None = None) -> DataFrame:
    """Per cell, whether counts add up and the forecast is the fold winner's. A null seed is a cell's like any other.

    ``slices`` has a row (fold, asset, partition) for each row that may be fitted on or forecast. With ``iterations`` (M10), the refit's
    iterations (``best_iteration`` of ``fits``) must equal them, and a cell that they lack isn't ok.
    """
    n = slices.groupBy("fold", "asset").agg(*(F.count_if(F.col("partition") == p).alias(f"n_{p}") for p in ("train", "validation", "test")))
    won = winners.where("selected = 1").select("fold", F.col("config").alias("winner"))
    seed = {"seed": F.coalesce("seed", F.lit(""))} if "seed" in cell else {}
    told = forecasts.withColumns(seed).groupBy(*cell).agg(F.count("*").alias("n_forecast"))
    refits = fits.withColumns(seed).select(*cell, F.col("n_train").alias("n_refit"), *([F.col("best_iteration").alias("iterations")] if iterations is not None else []))
    out = refits.join(told, list(cell)).join(n, ["fold", "asset"]).join(won, "fold")
    ok = (F.col("n_train") + F.col("n_validation") == F.col("n_refit")) & (F.col("n_forecast") == F.col("n_test")) & (F.col("config") == F.col("winner"))
    if iterations is not None:
        out = out.join(iterations.withColumns(seed).select(*cell, F.col("best_iteration").alias("frozen")), list(cell), "left")
        ok = ok & F.coalesce(F.col("iterations") == F.col("frozen"), F.lit(False))
    return out.withColumn("ok", ok.cast("int"))


def replay(first: DataFrame, second: DataFrame, keys: Sequence[str] = (*C.FORECAST_KEY, "config")) -> DataFrame:
    """Differences of two runs of the same cell."""
    return table_diff(first.drop("run_id"), second.drop("run_id"), list(keys))


def run_family(rows: DataFrame, folds: DataFrame, configs: Sequence[str], seeds: Sequence[str | None], simplicity: DataFrame) -> dict[str, DataFrame]:
    """Candidates, winners, refits (M11) and forecasts of closed-form families, all development folds at once.

    ``rows`` are the eligible rows (F9). A null in ``seeds`` is the plain model, the others together the seeded one; each has a winner of
    its own. Fits and refits come from one pass over the rows; fits, audit, winners and forecasts are stored.
    """
    dev = folds.where("role = 'development'")
    slices = assign(rows, dev)
    fits = stored(fold_fits(rows, dev, configs, seeds), "fits")
    validation = ols_predict(slices.where("partition = 'validation'"), fits.where("usage = 'selection'"), configs)
    audit = stored(candidate_audit(validation, fits.where("usage = 'selection'")), "audit")
    winners = stored(fold_winner(audit, simplicity, by=("model", "fold")), "winners")
    won = F.broadcast(winners.where("selected = 1").select("model", "fold", "config"))  # a row a model and fold
    refits = fits.where("usage = 'refit'").withColumn("model", F.when(F.col("seed").isNull(), "plain").otherwise("seeded")).join(won, ["model", "fold", "config"])
    forecasts = stored(ols_predict(slices.where("partition = 'test'"), refits.drop("model"), configs), "forecasts")
    return {"fits": fits, "validation": validation, "audit": audit, "winners": winners, "refits": refits, "forecasts": forecasts}


def require_complete(gaps: DataFrame) -> None:
    require_none(gaps, "the candidate grid is not complete")
