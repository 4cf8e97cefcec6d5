"""Sequence windows, patches and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast import schema as C
from foldcast.functions import halo, require_none


#: Origins of a block.
BLOCK_ROWS = 2048


def window_blocks(sup: DataFrame, length: int, features: Sequence[str] = C.FEATURES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """blocks of consecutive origins of an asset: (asset, origins, rows), with each row's features once.

    ``rows`` has the features of the block's sessions and of the ``length`` - 1 before them, in order; ``origins`` the block's own
    sessions: key, target, place ``at`` in ``rows`` (from 0), and ``usable``, 1 where a whole window of finite features ends there. A
    window is a slice of ``rows``, so length costs a halo a block and no copies.
    """
    row = F.array(*(F.col(c).cast("float") for c in features))
    kept = halo(sup.select(*C.SAMPLE_KEY, "target_return", row.alias("x")), ["asset"], "origin_date", block_rows, length - 1)
    w = Window.partitionBy("asset", "halo_block").orderBy("origin_date")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).cast("int")
    whole = F.coalesce(F.sum(fine).over(w.rowsBetween(1 - length, 0)) == length, F.lit(False)).cast("int")
    marked = kept.select("*", (F.row_number().over(w) - 1).alias("at"), whole.alias("usable"))
    own = F.when(F.col("halo_own"), F.struct("at", *C.SAMPLE_KEY, "target_return", "usable"))
    made = marked.groupBy("asset", "halo_block").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("rows"), F.collect_list(own).alias("origins"))
    return made.select("asset", "origins", F.col("rows.x").alias("rows"))


def windows(sup: DataFrame, length: int, features: Sequence[str] = C.FEATURES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """per origin the last ``length`` feature rows of its asset as float arrays; may reach before its fold.

    ``usable`` is 1 where the window is full and all finite; unusable windows are null. Windows are cut out of blocks.
    """
    blocks = window_blocks(sup, length, features, block_rows).select("rows", F.explode("origins").alias("o"))
    seq = F.when(F.col("o.usable") == 1, F.slice("rows", F.greatest(F.col("o.at") - length + 2, F.lit(1)), length))
    return blocks.select(*(F.col(f"o.{c}").alias(c) for c in (*C.SAMPLE_KEY, "target_return", "usable")), seq.alias("seq"))


def endpoint_windows(sup: DataFrame, endpoints: DataFrame, length: int, features: Sequence[str] = C.FEATURES, strict: bool = False) -> DataFrame:
    """windows of the given endpoints only; ``strict`` fails if one is unusable."""
    out = endpoints.select("fold", "partition", *C.SAMPLE_KEY).join(windows(sup, length, features), list(C.SAMPLE_KEY))
    if strict:
        require_none(out.where("usable = 0 AND partition <> 'train'").select("fold", "partition", *C.SAMPLE_KEY), "endpoints without a window")
    return out


def usable_endpoints(sup: DataFrame, endpoints: DataFrame, length: int, features: Sequence[str] = C.FEATURES) -> DataFrame:
    """the endpoints (fold, partition, sample key) with a whole window of ``length`` rows; windows aren't made."""
    w = Window.partitionBy("asset").orderBy("origin_date").rowsBetween(1 - length, 0)
    fine = F.forall(F.array(*(F.col(c).cast("float") for c in features)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).cast("int")
    whole = sup.select(*C.SAMPLE_KEY, F.sum(fine).over(w).alias("n_fine")).where(F.col("n_fine") == length).select(*C.SAMPLE_KEY)
    return endpoints.select("fold", "partition", *C.SAMPLE_KEY).join(whole, list(C.SAMPLE_KEY))


def patches(seq: Column, length: int, size: int, stride: int, channels: int) -> Column:
    """[channel][patch][value]; patches are right-aligned, without padding."""
    first = (length - size) % stride
    starts = F.sequence(F.lit(first), F.lit(length - size), F.lit(stride))
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform(starts, lambda s: F.transform(F.slice(seq, s + 1, size), lambda row: F.get(row, c))))


def fit_scaler(slices: DataFrame, features: Sequence[str] = C.FEATURES, usage: str = "selection") -> DataFrame:
    """(fold, asset, usage, feature, mean, var, scale, n) on unique rows of the permitted partitions.

    'selection' may use train rows; 'refit' train and validation rows. A constant feature has scale 1.
    """
    parts = "partition = 'train'" if usage == "selection" else "partition IN ('train', 'validation')"
    rows = slices.where(parts).select("fold", "asset", "origin_date", *features).dropDuplicates(["fold", "asset", "origin_date"])
    wide = rows.groupBy("fold", "asset").agg(*(f(c).alias(f"{name}_{c}") for c in features for name, f in (("mean", F.avg), ("var", F.var_pop), ("n", F.count))))
    out = wide.select("fold", "asset", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{name}_{c}").alias(name) for name in ("mean", "var", "n"))) for c in features))))
    scale = F.sqrt("var")
    return out.select("fold", "asset", F.lit(usage).alias("usage"), "feature", "mean", "var", F.when((F.col("var") == 0) | (scale < 1e-300), F.lit(1.0)).otherwise(scale).alias("scale"), "n")


def scaler_arrays(scaler: DataFrame, features: Sequence[str] = C.FEATURES) -> DataFrame:
    """One row a fold and asset: arrays of means and scales in the order of ``features``."""
    return scaler.groupBy("fold", "asset").agg(*(F.array(*(F.max(F.when(F.col("feature") == f, F.col(v))) for f in features)).alias(f"{v}s") for v in ("mean", "scale")))


def apply_scaler(seqs: DataFrame, scaler: DataFrame, features: Sequence[str] = C.FEATURES, check: bool = False) -> DataFrame:
    """F16: z-scored windows as floats. Scalers have a row a fold and asset."""
    x = seqs.join(scaler_arrays(scaler, features), ["fold", "asset"])
    z = F.transform("seq", lambda row: F.zip_with(F.zip_with(row, "means", lambda v, m: v - m), "scales", lambda v, s: (v / s).cast("float")))
    out = x.withColumn("seq", z).drop("means", "scales")
    if check:
        require_none(out.where(F.exists(F.flatten("seq"), lambda v: v.isNull() | F.isnan(v))).select("fold", *C.SAMPLE_KEY), "scaled values that aren't finite")
    return out


def endpoint_counts(sup: DataFrame, endpoints: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """usable and omitted endpoints by fold, partition, asset and window length, and whether all lengths agree."""
    w = Window.partitionBy("asset").orderBy("origin_date")
    fine = F.forall(F.array(*C.FEATURES), lambda x: x.isNotNull() & ~F.isnan(x)).cast("int")
    flagged = sup.select(*C.SAMPLE_KEY, *(((F.sum(fine).over(w.rowsBetween(1 - n, 0)) == n).cast("int")).alias(f"u{n}") for n in lengths))
    e = endpoints.select("fold", "partition", *C.SAMPLE_KEY).join(flagged, list(C.SAMPLE_KEY))
    long = e.unpivot(["fold", "partition", "asset", "origin_date"], [f"u{n}" for n in lengths], "length", "usable")
    out = long.groupBy("fold", "partition", "asset", "length").agg(F.sum("usable").alias("n_usable"), F.count_if(F.col("usable") == 0).alias("n_omitted"))
    same = Window.partitionBy("fold", "partition", "asset")
    return out.withColumn("length", F.substring("length", 2, 9).cast("int")).withColumn("all_agree", (F.min("n_usable").over(same) == F.max("n_usable").over(same)).cast("int"))
