"""Moments by range between fold boundaries, merged into every fold's fits, scalers and counts.

Folds overlap and grow, so a row belongs to many of them. The dates between two neighbouring boundaries are a *segment*; a
fold's partition is a set of segments. One pass takes counts, means and central moments by (asset, segment), and the pairwise
formula merges them for any number of folds: rows are never copied once a fold, and a later fold adds only its own segment.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast import schema as C

#: Partitions that a fit may use.
USAGES = {"selection": ("train",), "refit": ("train", "validation")}


def segments(folds: DataFrame) -> tuple[list[dt.date], DataFrame]:
    """The first days of all segments, and (fold, partition, role, segment). The registry has three rows a fold."""
    rows = folds.select("fold", "partition", "role", "start", "end").collect()
    cuts = sorted({r["start"] for r in rows} | {r["end"] + dt.timedelta(1) for r in rows})
    cover = [(r["fold"], r["partition"], r["role"], k) for r in rows for k, day in enumerate(cuts) if r["start"] <= day <= r["end"]]
    return cuts, folds.sparkSession.createDataFrame(cover, "fold string, partition string, role string, segment int")


def segment_of(cuts: Sequence[dt.date], day: str = "target_date") -> Column:
    """The number of the segment that a day falls in; -1 before the first."""
    return sum(((F.col(day) >= F.lit(c)).cast("int") for c in cuts), F.lit(-1))


def usage_cover(cover: DataFrame, usages: Sequence[str] = tuple(USAGES)) -> DataFrame:
    """(fold, usage, segment)."""
    kinds = F.array(*(F.struct(F.lit(u).alias("usage"), F.lit(p).alias("of")) for u in usages for p in USAGES[u]))
    return cover.select("fold", "partition", "segment", F.inline(kinds)).where("partition = of").select("fold", "usage", "segment")


def _merged(parts: DataFrame, keys: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Adds all_n and the overall means all_<name> of parts that have n and the means; one exchange with a later groupBy of the same keys."""
    w = Window.partitionBy(*keys)
    total = F.sum("n").over(w)
    return parts.withColumns({"all_n": total, **{f"all_{m}": F.sum(F.col("n") * F.col(m)).over(w) / F.nullif(total, F.lit(0).cast("long")) for m in means}})


def fold_scalers(rows: DataFrame, folds: DataFrame, features: Sequence[str] = C.FEATURES, usage: str = "selection") -> DataFrame:
    """F15 for all folds in one scan: (fold, asset, usage, feature, mean, var, scale, n).

    ``rows`` are the eligible rows (F9), each once. A constant feature has scale 1.
    """
    cuts, cover = segments(folds)
    wide = rows.withColumn("segment", segment_of(cuts)).groupBy("asset", "segment").agg(*(f(c).alias(f"{name}_{c}") for c in features for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))
    long = wide.select("asset", "segment", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v")) for c in features))))
    keys = ["fold", "asset", "usage", "feature"]
    parts = long.join(F.broadcast(usage_cover(cover, (usage,))), "segment")
    m2 = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("all_m")) ** 2))
    out = _merged(parts, keys, ["m"]).groupBy(*keys).agg(F.first("all_m").alias("mean"), (m2 / F.nullif(F.first("all_n"), F.lit(0).cast("long"))).alias("var"), F.first("all_n").alias("n"))
    scale = F.sqrt("var")
    return out.select(*keys, "mean", "var", F.when((F.col("var") == 0) | (scale < 1e-300), F.lit(1.0)).otherwise(scale).alias("scale"), "n")


def fold_coverage(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """D5 for all folds in one scan: rows and date bounds by fold, partition and asset, with totals by rollup."""
    cuts, cover = segments(folds)
    by = rows.withColumn("segment", segment_of(cuts)).groupBy("asset", "segment").agg(F.count("*").alias("n"), F.min("target_date").alias("lo"), F.max("target_date").alias("hi"))
    return by.join(F.broadcast(cover), "segment").rollup("fold", "partition", "asset").agg(F.sum("n").alias("n_rows"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


def counts_twice(seed: str) -> Column:
    """Whether a sample counts twice in a seed's fits; all samples count once at least."""
    key = F.concat_ws("|", "asset", F.col("origin_date").cast("string"), F.lit(seed))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % 2 == 1


def fold_fits(rows: DataFrame, folds: DataFrame, configs: Sequence[str], seeds: Sequence[str | None], y: str = "target_return") -> DataFrame:
    """Closed-form one-feature fits of all folds, usages, assets, configs and seeds in one scan of ``rows``, each once.

    Returns (fold, usage, asset, config, seed, slope, intercept, n_train). A null seed weighs all rows alike; another counts
    some of them twice (:func:`counts_twice`). A constant feature gives slope 0.
    """
    cuts, cover = segments(folds)
    sets = {"": F.lit(True), **{s: counts_twice(s) for s in seeds if s is not None}}
    marked = rows.select("asset", segment_of(cuts).alias("segment"), F.col(y).alias("y"), *configs, *(c.alias(f"in_{s}") for s, c in sets.items()))
    told = []
    for s in sets:
        own = lambda c, s=s: F.when(F.col(f"in_{s}") & F.col("y").isNotNull(), F.col(c))
        for c in configs:
            told += [F.regr_count(own("y"), F.col(c)).alias(f"n_{s}_{c}"), F.avg(F.when(F.col(c).isNotNull(), own("y"))).alias(f"my_{s}_{c}"), F.avg(own(c)).alias(f"mx_{s}_{c}"), F.var_pop(own(c)).alias(f"vx_{s}_{c}"), F.covar_pop(own(c), own("y")).alias(f"cxy_{s}_{c}")]
    wide = marked.groupBy("asset", "segment").agg(*told)
    cells = [(s, c, x) for s in seeds for c in configs for x in (("",) if s is None else ("", s))]
    structs = [F.struct(F.lit(s).cast("string").alias("seed"), F.lit(c).alias("config"), F.lit(x == "").alias("whole"), *(F.col(f"{v}_{x}_{c}").alias(v) for v in ("n", "my", "mx", "vx", "cxy"))) for s, c, x in cells]
    parts = wide.select("asset", "segment", F.inline(F.array(*structs))).join(F.broadcast(usage_cover(cover)), "segment")
    keys = ["fold", "usage", "asset", "config", "seed"]
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    merged = _merged(parts, keys, ["mx", "my"]).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("vx") + dx * dx)).alias("sxx"), F.sum(F.col("n") * (F.col("cxy") + dx * dy)).alias("sxy"), F.first("all_mx").alias("mx"), F.first("all_my").alias("my"), F.sum(F.when(F.col("whole"), F.col("n"))).alias("n_train"), F.first("all_n").alias("weight"))
    # what rounding leaves of a constant feature's variance isn't one
    slope = F.when(F.col("sxx") > F.col("weight") * F.col("mx") ** 2 * 1e-24, F.try_divide("sxy", "sxx")).otherwise(F.lit(0.0))
    return merged.where("weight > 0").select(*keys, F.coalesce(slope, F.lit(0.0)).alias("slope"), (F.col("my") - F.coalesce(slope, F.lit(0.0)) * F.col("mx")).alias("intercept"), "n_train")
