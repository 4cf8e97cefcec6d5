"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once. Texts may be long, so a batch is short.
ARROW_ROWS = 256

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` excludes it.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: a few hundred texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests on one machine), a new temporary folder is set; on a
    cluster that is an error, as executors don't share the driver's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foldcast-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs no recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of staged tables from which nothing will be read again."""
    for t in tables:
        path = t.__dict__.pop("staged_path", None) if t is not None else None
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """As :func:`staged`, with the number of rows, or another count, taken while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), name)
    return out, int(seen.get["n"] or 0)


def added(parts: DataFrame, kind: type, keys: Sequence[str] = ("key",), fan: int = 16) -> DataFrame:
    """Sums (keys, x) of vectors (keys, part long, x binary) that tasks have made, one of a key for each part.

    They are added in levels, ``fan`` at a time and in the order of their parts, so no task gets more than
    ``fan`` vectors of a key however many tasks there are, and the sums don't depend on timing. Whoever has read the sums may
    :func:`discard` them.
    """
    made = parts = staged(parts, "parts")
    most = parts.agg(F.max("part")).first()[0] or 0

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = None
        for x in t.column("x"):
            own = np.frombuffer(x.as_buffer(), kind)
            total = own.copy() if total is None else total + own
        return t.slice(0, 1).select([*keys, "up"]).append_column("x", pa.array([total.tobytes()], pa.binary())).rename_columns([*keys, "part", "x"])

    while True:
        parts = parts.withColumn("up", F.floor(F.col("part") / fan)).groupBy(*keys, "up").applyInArrow(add, parts.schema)
        most //= fan
        if not most:
            out = parts.drop("part")
            out.staged_path = made.staged_path
            return out


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")


#: Rows of a table of ids or hashes that may be broadcast: some tens of MB at most.
BROADCAST_IDS = 1_000_000


def bounded(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (few narrow columns, cheap to count), broadcast if it is counted to be small.

    A larger table is joined by shuffle.
    """
    return F.broadcast(ids) if ids.count() <= most else ids
