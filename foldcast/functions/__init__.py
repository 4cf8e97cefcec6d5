"""Small column and table helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ContractError(ValueError):
    """A table breaks the rules that an operator needs."""


def rounded(name: str, places: int = 9) -> Column:
    """A double for reports: rounded, without negative zero."""
    return (F.round(F.col(name), places) + F.lit(0.0)).alias(name)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def direction(c: Column) -> Column:
    """1 where a value is strictly positive, else 0."""
    return F.when(c > 0, 1).otherwise(0)


def rolling(value: str, size: int, keys: Sequence[str], order: str, how: str) -> Column:
    """Mean or population deviation of the last ``size`` rows; null until the window is full of values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    made = F.avg(value) if how == "mean" else F.stddev_pop(value)
    return F.when(F.count(value).over(w) == size, made.over(w))


def halo(df: DataFrame, keys: Sequence[str], order: str, rows: int, before: int) -> DataFrame:
    """Long series in blocks: adds ``halo_block`` and ``halo_own`` to the rows of each key, in the order of the date ``order``.

    A block has ``rows`` consecutive rows of a key and, as its halo, copies of the ``before`` rows that precede them. A window over
    (keys, halo_block) that reaches back no further gives the rows with ``halo_own`` what a window over the keys would, so one long
    series is many tasks. Rows are numbered by spans of days first; only counts of spans meet by key. Dates of a key are unique.
    """
    span = F.floor(F.unix_date(order) / rows)
    numbered = df.withColumn("halo_span", span).withColumn("halo_at", F.row_number().over(Window.partitionBy(*keys, "halo_span").orderBy(order)) - 1)
    upto = Window.partitionBy(*keys).orderBy("halo_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = df.groupBy(*keys, span.alias("halo_span")).agg(F.count("*").alias("halo_n")).withColumn("halo_from", F.coalesce(F.sum("halo_n").over(upto), F.lit(0))).drop("halo_n")
    at = numbered.join(spans, [*keys, "halo_span"]).withColumn("halo_at", F.col("halo_at") + F.col("halo_from"))
    own = F.floor(F.col("halo_at") / rows)
    blocks = at.withColumn("halo_block", F.explode(F.sequence(own, F.floor((F.col("halo_at") + before) / rows))))
    return blocks.withColumn("halo_own", F.col("halo_block") == own).drop("halo_span", "halo_at", "halo_from")


def violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """(rule, keys) for each row and each rule whose predicate holds, in one pass."""
    hit = F.filter(F.array(*(F.when(F.coalesce(p, F.lit(True)), F.lit(name)) for name, p in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(hit).alias("rule"), *keys)


def require_none(found: DataFrame, what: str, most: int = 5) -> None:
    rows = found.limit(most).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    many = df.groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"many_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"many_{k}")) for k in keys]
    return df.join(many, reduce(lambda a, b: a & b, same), "left_semi")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", complete: bool = True) -> DataFrame:
    """A join whose right side has each key once and, if ``complete``, every key of the left."""
    require_none(right.groupBy(*keys).count().where("count > 1"), "keys repeat on the right side")
    if complete:
        require_none(left.join(right, list(keys), "left_anti").select(*keys), "keys without a match")
    return left.join(right, list(keys), how)


def grid_fill(df: DataFrame, grid: DataFrame, keys: Sequence[str], zero: Iterable[str] = ()) -> DataFrame:
    """All rows of ``grid``, with the values of ``df`` where it has them; counts in ``zero`` become 0."""
    out = grid.join(df, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in zero}) if zero else out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def quartiles(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median, quartiles and their distance by exact linear interpolation; null if any value is."""
    whole = F.count(value) == F.count("*")
    p = lambda q: F.when(whole, F.percentile(value, F.lit(q)))
    out = df.groupBy(*keys).agg(F.count("*").alias("n_folds"), p(0.5).alias("median"), p(0.25).alias("q1"), p(0.75).alias("q3"))
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


#: Buckets of keys by whose digests two tables are compared first.
DIFF_BUCKETS = 1024


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], rtol: float = 1e-12, atol: float = 1e-15) -> DataFrame:
    """(column, n_mismatch, max_abs_diff) of two tables by key; null equals null. ``column`` 'key' counts unmatched rows.

    Digests of the rows by bucket of their keys come first, and only buckets that differ are joined: equal tables are compared
    by 1,024 small rows a side. A key that repeats within a bucket that differs is an error when the result is read.
    """
    if set(a.columns) != set(b.columns):
        raise ContractError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    numeric = {f.name for f in a.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")}
    values = [c for c in a.columns if c not in keys]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(DIFF_BUCKETS)).cast("int")
    # rows that are equal in the comparison below have equal text: numbers as doubles, -0.0 as 0.0
    told = [F.coalesce((F.col(c).cast("double") + F.lit(0.0)).cast("string") if c in numeric else F.col(c).cast("string"), F.lit("\0")) for c in values]
    parts = lambda d: d.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), *keys, *told, *(F.col(c).isNull() for c in values)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)))
    both_parts = parts(a).withColumnRenamed("n", "n_a").join(parts(b).select("bucket", F.col("n").alias("n_b"), F.col("h0").alias("g0"), F.col("h1").alias("g1")), "bucket", "full")
    odd = F.broadcast(both_parts.where(~(F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("h0").eqNullSafe(F.col("g0")) & F.col("h1").eqNullSafe(F.col("g1")))).select("bucket"))
    row = lambda d, name: d.withColumn("bucket", bucket).join(odd, "bucket", "left_semi").groupBy(*keys).agg(F.any_value(F.struct(*values) if values else F.struct(F.lit(1).alias("one"))).alias(name), F.count("*").alias(f"n_{name}"))
    once = lambda n: F.when(F.col(n) > 1, F.raise_error(F.lit(f"keys {list(keys)} repeat")).cast("int")).when(F.col(n) == 1, F.lit(1))
    both = row(a, "x").join(row(b, "y"), list(keys), "full").withColumns({"in_x": once("n_x"), "in_y": once("n_y")})
    parts_of = [F.struct(F.lit("key").alias("column"), (F.col("in_x").isNull() | F.col("in_y").isNull()).cast("long").alias("bad"), F.lit(None).cast("double").alias("gap"))]
    for c in values:
        x, y = F.col(f"x.{c}"), F.col(f"y.{c}")
        gap = F.abs(x.cast("double") - y.cast("double")) if c in numeric else F.lit(None).cast("double")
        same = (x.eqNullSafe(y) | F.coalesce(gap <= atol + rtol * F.abs(y.cast("double")), F.lit(False))) if c in numeric else x.eqNullSafe(y)
        parts_of.append(F.struct(F.lit(c).alias("column"), (F.col("in_x").isNotNull() & F.col("in_y").isNotNull() & ~same).cast("long").alias("bad"), gap.alias("gap")))
    # columns of buckets that don't differ: no mismatch
    none = a.sparkSession.createDataFrame([(c, 0, 0.0 if c in numeric else None) for c in ("key", *values)], "column string, bad long, gap double")
    return both.select(F.explode(F.array(*parts_of)).alias("p")).select("p.*").unionByName(none).groupBy("column").agg(F.sum("bad").alias("n_mismatch"), F.max("gap").alias("max_abs_diff"))
