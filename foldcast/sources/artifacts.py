"""Fingerprints, manifests and immutable writes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.functions import ContractError, require_none


def shared_root(spark: SparkSession) -> str:
    """The folder for stored tables: ``spark.checkpoint.dir``, which all machines share; a temporary one only in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ContractError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="foldcast-")
    return f"{named}/stored"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: the lineage ends there, and a lost executor costs nothing of what came before.

    Small tables are one file. The folder's owner clears it, as with checkpoints.
    """
    path = f"{shared_root(df.sparkSession)}/run-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _text(df: DataFrame, c: str) -> Column:
    """A value as text that no other value of its column's type has; 0 and negative zero are one."""
    kind, col = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.format_string("%.17g", col.cast("double") + F.lit(0.0))
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(col.isNotNull(), F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}))
    return col.cast("string")


def encoded(df: DataFrame, columns: Sequence[str]) -> Column:
    """A row as text that no other row has: names and types of the columns, then for each value its length and text, or N for null."""
    told = "".join(f"{len(x)}:{x}" for c in columns for x in (c, df.schema[c].dataType.simpleString()))
    value = lambda t: F.when(t.isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(t).cast("string"), F.lit(":"), t))
    return F.concat(F.lit(told + "|"), *(value(_text(df, c)) for c in columns))


def digest_sums(row: Column) -> list[Column]:
    """Two independent sums of 60 bits of the MD5 of a row's text, exact at any number of rows."""
    h = F.md5(row.cast("binary"))
    return [F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias(name) for name, at in (("sum_a", 1), ("sum_b", 16))]


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n, sum_a, sum_b) that doesn't depend on row order or partitions, but on names and types of the columns.

    The order of columns doesn't count. An empty table's is its columns' own: sums of no rows beside the hash of the header.
    """
    columns = sorted(columns or df.columns)
    header = df.sparkSession.range(1).select(F.lit("".join(f"{len(x)}:{x}" for c in columns for x in (c, df.schema[c].dataType.simpleString()))).alias("row"), F.lit(0).alias("n"))
    rows = header.unionByName(df.select(encoded(df, columns).alias("row"), F.lit(1).alias("n")))
    return rows.agg(F.sum("n").cast("long").alias("n"), *digest_sums(F.col("row")))


def manifest(df: DataFrame, key: str = "asset", date: str = "date") -> DataFrame:
    """Rows and date bounds by key, with the table's total and column list."""
    by = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    total = df.agg(F.count("*").alias("total_rows"))
    return by.crossJoin(F.broadcast(total)).withColumn("columns", F.lit(",".join(df.columns)))


def verify_manifest(df: DataFrame, stored: DataFrame, key: str = "asset", date: str = "date") -> DataFrame:
    """(key, field, stored, found) for every difference from a stored manifest."""
    fields = ["n_rows", "first_date", "last_date", "total_rows", "columns"]
    a = stored.select(key, *(F.col(c).cast("string").alias(f"s_{c}") for c in fields))
    b = manifest(df, key, date).select(key, *(F.col(c).cast("string").alias(f"f_{c}") for c in fields))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"s_{c}").alias("stored"), F.col(f"f_{c}").alias("found")) for c in fields))
    return a.join(b, key, "full").select(key, F.inline(rows)).where(~F.col("stored").eqNullSafe(F.col("found")))


def write_once(df: DataFrame, root: str, stem: str) -> str:
    """Write to a name made from the content. Equal content is no new write; other content in that place is an error.

    The table is written aside and renamed as a whole, so nobody ever sees a part of it. Of two writers at once
    one wins; the other finds the table and verifies it.
    """
    f = fingerprint(df).first()
    path = f"{root}/{stem}_{f['n']}_{int(f['sum_a']):x}_{int(f['sum_b']):x}"
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{root}/.aside-{uuid.uuid4().hex}")
    fs = place.getFileSystem(conf)
    if not fs.exists(place):
        df.write.parquet(aside.toString())
        try:
            # fails if the place is taken, where FileSystem.rename would move into it
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(place), none)
            return path
        except Py4JJavaError:
            fs.delete(aside, True)
            if not fs.exists(place):
                raise
    if tuple(fingerprint(spark.read.parquet(path)).first()) != tuple(f):
        raise ContractError(f"{path} holds other content")
    return path


#: Bytes of a file that an inventory reads: a file is one row, which holds less than 2 GB.
MOST_BYTES = (1 << 31) - 1024


def inventory(spark, root: str, glob: str = "*") -> DataFrame:
    """(path, length, digest) of each file below a folder; paths are relative to it.

    A file of ``MOST_BYTES`` or more is an error, found before any file is read.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath()
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    require_none(files.where(F.col("length") >= MOST_BYTES).select("path", "length"), "files too large for an inventory")
    at = F.instr("path", base.rstrip("/") + "/") + len(base.rstrip("/")) + 1
    return files.select(F.expr("path").substr(at, F.lit(1 << 20)).alias("path"), "length", F.sha2("content", 256).alias("digest"))


def write_rows(df: DataFrame, path: str, key: str, order: str) -> str:
    """A folder by ``key`` with one file of JSON lines in each, whose bytes follow from its rows alone if (key, order) is unique.

    A Parquet file's don't: its footer lists encodings in an order that differs between JVMs.
    """
    df.repartition(key).sortWithinPartitions(key, order).withColumn("folder", F.col(key)).write.option("compression", "none").partitionBy("folder").json(path)
    return path


def tree(found: DataFrame) -> DataFrame:
    """(folder, n_files, n_bytes, sum_a, sum_b) of an inventory: a node for each folder with all that lies below it; the root is ''.

    Equal nodes hold the same files at the same relative paths. Nodes are sums, so no folder's list is ever in one place.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = found.select(F.explode(above).alias("folder"), "path", "length", "digest")
    inside = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substr(path, length(folder) + 2)"))
    rows = rows.withColumn("row", F.concat(F.length(inside).cast("string"), F.lit(":"), inside, F.col("length").cast("string"), F.lit(":"), F.col("digest")))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), *digest_sums(F.col("row")))


def drift(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, kind): files that are missing, extra or changed against an expected inventory."""
    both = expected.select("path", F.col("digest").alias("old")).join(found.select("path", F.col("digest").alias("new")), "path", "full")
    kind = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", kind.alias("kind")).where("kind is not null")


def stamp(df: DataFrame, provenance: Mapping[str, str]) -> DataFrame:
    """Constant provenance columns."""
    return df.withColumns({k: F.lit(v) for k, v in provenance.items()})
