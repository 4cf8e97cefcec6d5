"""Reading, reshaping and normalising price panels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import ContractError, require_none
from foldcast.sources.artifacts import stored


def read_panel(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A panel with exactly the contract's columns in order, and their types; CSV has text alone, whose dates must be ISO and whose numbers
    must be numbers."""
    if form == "csv":
        raw = spark.read.option("header", True).csv(path)
        if tuple(raw.columns) != tuple(C.PANEL.names):
            raise ContractError(f"panel columns are {raw.columns}")
        require_none(raw.where(~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))).select("date"), "dates that aren't ISO text")
        return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in C.PANEL))
    df = spark.read.format(form).load(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in C.PANEL]:
        raise ContractError(f"panel columns are {df.dtypes}")
    return df


def wide_to_long(df: DataFrame, date: str = "date", sep: str = "|", field_first: bool = True) -> DataFrame:
    """One column per (field, ticker) to one row per (date, asset); field names in snake case."""
    fields: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if c != date:
            a, b = c.split(sep, 1)
            field, asset = (a, b) if field_first else (b, a)
            fields.setdefault(asset, {})[re.sub(r"\W+", "_", field.strip().lower())] = c
    names = sorted({f for x in fields.values() for f in x})
    rows = F.array(*(F.struct(F.lit(a).alias("asset"), *((F.col(f"`{x[f]}`") if f in x else F.lit(None)).cast("double").alias(f) for f in names)) for a, x in sorted(fields.items())))
    return df.select(F.col(date).alias("date"), F.inline(rows)).dropna("all", subset=names)


def normalize_panel(df: DataFrame, tz: str | None = None) -> DataFrame:
    """S3: canonical columns, asset trimmed and in upper case, dates in the exchange's zone, strict numbers.

    Text that isn't a number fails (ANSI cast); NaN and infinite values are rejected.
    """
    missing = [c for c in C.PANEL.names if c not in df.columns]
    if missing:
        raise ContractError(f"columns are missing: {missing}")
    date = F.to_date(F.from_utc_timestamp("date", tz)) if tz else F.col("date").cast("date")
    out = df.select(date.alias("date"), F.upper(F.trim("asset")).alias("asset"), *(F.col(c).cast("double").alias(c) for c in C.PANEL.names[2:]))
    bad = F.greatest(*(F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)) for c in C.PANEL.names[2:]))
    require_none(out.where(bad), "values that aren't finite")
    return out


def store_by_year(df: DataFrame, path: str) -> str:
    """A table laid out by the year of target_date, which :func:`read_until` prunes by."""
    df.withColumn("target_year", F.year("target_date")).repartition("target_year").write.partitionBy("target_year").parquet(path)
    return path


def read_until(df: DataFrame, start: str, end: str, columns: Sequence[str]) -> DataFrame:
    """A date firewall. Only rows with target_date in the closed range, and only named columns.

    The range is pushed to the scan; of a table that is laid out by year only the range's years are opened.
    """
    a, b = (F.lit(x).cast("date") for x in (start, end))
    inside = F.col("target_date").between(a, b)
    if "target_year" in df.columns:
        inside = inside & F.col("target_year").between(int(start[:4]), int(end[:4]))
    return df.where(inside).select(*columns)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """A forecast table with exactly the contract's columns and types."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in C.FORECAST]:
        raise ContractError(f"forecast columns are {df.dtypes}")
    return df


#: Rows of a table of days and flags that may be broadcast.
BROADCAST_DAYS = 500_000


def panel_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A daily panel from order lines: return flags are assets, all lines together the reference.

    Within a day lines are ordered by their whole key and price. A first scan finds each day's range of order keys beside plain
    sums, so it holds numbers alone; a second keeps the lines of those two orders, which the whole key then orders. A task's
    memory goes with days and flags, not with lines. A null order key comes first.
    """
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = lineitem.select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("flag"), *key, F.col("l_extendedprice").cast("double").alias("p"), F.col("l_quantity").cast("double").alias("q")).where(F.weekday("date") < 5)
    first = F.when(F.count("l_orderkey") == F.count("*"), F.min("l_orderkey"))
    days = stored(lines.groupBy("date", "flag").agg(first.alias("first"), F.max("l_orderkey").alias("last"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("q").alias("volume")), "days")
    found = days.select(F.col("date").alias("own_date"), F.col("flag").alias("own_flag"), "first", "last")
    found = F.broadcast(found) if days.count() <= BROADCAST_DAYS else found.hint("shuffle_hash")
    same = (F.col("date") == F.col("own_date")) & F.col("flag").eqNullSafe(F.col("own_flag"))
    ends = lines.join(found, same & (F.col("l_orderkey").eqNullSafe(F.col("first")) | F.col("l_orderkey").eqNullSafe(F.col("last"))))

    def by_asset(rows: DataFrame) -> DataFrame:
        return rows.withColumn("asset", F.explode(F.array("flag", F.lit(C.REFERENCE)))).groupBy("date", "asset")

    k = F.struct(*key)
    ordered = by_asset(ends.withColumn("k", k)).agg(F.min_by("p", "k").alias("open"), F.max_by("p", "k").alias("close"))
    sums = by_asset(days).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    other = ordered.select(F.col("date").alias("own_date"), F.col("asset").alias("own_asset"), "open", "close")
    joined = sums.join(other, (F.col("date") == F.col("own_date")) & F.col("asset").eqNullSafe(F.col("own_asset")))
    return joined.select("date", "asset", "open", "high", "low", "close", "volume")


def panel_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """A ragged daily panel: market segments are assets, order totals prices."""
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderdate").cast("date").alias("date"), F.explode(F.array("c_mktsegment", F.lit(C.REFERENCE))).alias("asset"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("p")).where(F.weekday("date") < 5)
    return rows.groupBy("date", "asset").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count("*").cast("double").alias("volume"))
