"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

Candidate vectors are sorted along a Hilbert curve and written as Parquet blocks of a fixed number of rows. Each block
has a zone map: the least and largest value of every dimension, and the labels it holds. From these interval
arithmetic bounds any anchor's scores within a block from above and below, and an anchor reads a block only if the block
holds a wanted label, its bounds meet the anchor's window, and its upper bound reaches what the anchor has found so far.

Positives are an anchor's best rows of its own label; each positive's score opens a window of scores, in which the best
rows of other labels are its negatives. Both searches go in two rounds: first the block that promises most to each anchor
(one for each page of zone maps), then all blocks that may still better what these gave.

Anchors go in groups along the same curve. A group meets pages of zone maps, not vectors, to choose its blocks;
only pairs of a group and a chosen block are joined. The vectors of a block are read once for all groups that
chose it. Scores are whole numbers and exact; bounds have a slack for rounding.

Blocks follow the curve through ``CURVE_DIMS`` dimensions, ``CURVE_BITS`` bits each. Where vectors spread evenly in many
dimensions, zone maps are wide and few blocks are left out; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.llm.common import short_batches, staged, table

#: Rows of a block of candidates, blocks of a page of zone maps (about), anchors of a group.
BLOCK, PAGE, GROUP = 512, 64, 128
#: Pages and groups that meet in one task.
PAGES, GROUPS = 16, 64
#: Dimensions and bits a dimension of the curve: 60 bits together.
CURVE_DIMS, CURVE_BITS = 15, 4
#: Positives of an anchor, negatives of a positive, percent of the positive's score from and to.
POSITIVES, NEGATIVES, FROM, TO = 5, 3, 50, 95
SCALE = 256
_LOW, _HIGH = -(1 << 62), 1 << 62


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of whole numbers below 2^bits; rows x dimensions of 62 bits at most."""
    x = x.astype(np.int64).T.copy()
    d, q = len(x), 1 << bits - 1
    while q > 1:  # undo excess rotations, coarse to fine
        low = q - 1
        for i in range(d):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << bits - 1
    while q > 1:
        flip ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | x[i] >> b & 1
    return out


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v array<long>): components as floor(scale * x).

    Rows with a null id, label or vector, an empty vector, or any null or non-finite component are left out.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where("vec_id is not null and label is not null").where(F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def on_curve(vectors: DataFrame) -> DataFrame:
    """Adds d, the length, and place, on the curve through evenly spaced dimensions; the scale is the table's own root mean square."""
    squares = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") ** 2)
    spread = vectors.agg(F.sum(squares / F.size("v")) / F.count("*")).first()[0]
    # a power of two, so that the order of the sum doesn't matter
    reach = 2.0 ** np.ceil(np.log2(2 * np.sqrt(spread))) if spread else 1.0
    schema = vectors.withColumn("d", F.size("v")).withColumn("place", F.lit(0).cast("long")).schema

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, place = batch.column("v"), np.zeros(len(batch), np.int64)
            size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = _matrix(v.take(pa.array(own)))[:, np.unique(np.linspace(0, d - 1, min(d, CURVE_DIMS)).astype(int))]
                cells = np.floor((x / reach + 1) / 2 * (1 << CURVE_BITS)).clip(0, (1 << CURVE_BITS) - 1)
                place[own] = hilbert(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(place)], [*batch.schema.names, "d", "place"])

    return vectors.mapInArrow(locate, schema)


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task, sorted by length, in runs of ``rows`` of one length at most; each with a number that is unique in the job."""
    held, n, length, number = [], 0, None, TaskContext.get().partitionId() << 32
    for batch in batches:
        d, at = batch.column("d").to_numpy(), 0
        while at < len(d):
            if n and d[at] != length:
                yield number, pa.Table.from_batches(held)
                held, n, number = [], 0, number + 1
            length, size = d[at], min(rows - n, int(np.searchsorted(d[at:], d[at], side="right")))
            held.append(batch.slice(at, size))
            n, at = n + size, at + size
            if n == rows:
                yield number, pa.Table.from_batches(held)
                held, n, number = [], 0, number + 1
    if n:
        yield number, pa.Table.from_batches(held)


def _along_curve(vectors: DataFrame, partitions: int) -> DataFrame:
    """Sorted by length and place; equal places are split by id. No more than so many partitions, so that runs aren't cut short."""
    key = ["d", "place", "vec_id"]
    return vectors.repartitionByRange(partitions, *key).sortWithinPartitions(*key).coalesce(partitions)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _wide(data: pa.Scalar, rows: int, d: int) -> np.ndarray:
    raw = data.as_buffer()
    return np.frombuffer(raw, f"<i{raw.size // (rows * d)}").reshape(rows, d).astype(np.int64)


def blocks_of(vectors: DataFrame, partitions: int) -> DataFrame:
    """Candidate blocks, one a row: block, d, the zone map (low, high, kinds), and ids, labels and vectors as bytes.

    ``kinds`` are the distinct labels, as bytes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _runs(batches, BLOCK):
            x = _matrix(t.column("v").combine_chunks())
            ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
            row = [[block], [x.shape[1]], [x.min(0).tobytes()], [x.max(0).tobytes()], [np.unique(labels).tobytes()], [ids.tobytes()], [labels.tobytes()], [_narrow(x)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 6))], ["block", "d", "low", "high", "kinds", "ids", "labels", "x"])

    return _along_curve(vectors, partitions).mapInArrow(pack, "block long, d int, low binary, high binary, kinds binary, ids binary, labels binary, x binary")


def pages_of(blocks: DataFrame) -> DataFrame:
    """The zone maps of the blocks of one range as one row: page, d, and arrays block, low, high and kinds."""
    page = F.shiftright("block", 32).alias("page")
    grouped = blocks.select("block", "d", "low", "high", "kinds").groupBy("d", page).agg(F.collect_list(F.struct("block", "low", "high", "kinds")).alias("z"))
    return grouped.select("d", "page", "z.block", "z.low", "z.high", "z.kinds")


def groups_of(anchors: DataFrame, partitions: int) -> DataFrame:
    """(anchor_id, label, v, d, grp): neighbours on the curve have one group."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, t in _runs(batches, GROUP):
            t = t.combine_chunks().append_column("grp", pa.array(np.full(len(t), grp)))
            yield from t.to_batches()

    numbered = _along_curve(anchors, partitions).mapInArrow(number, anchors.withColumn("grp", F.lit(0).cast("long")).schema)
    return numbered.select(F.col("vec_id").alias("anchor_id"), "label", "v", "d", "grp")


def _ints(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: the least and the largest inner product of each row of ``q`` with any vector in each zone."""
    q, low, high = (x.astype(np.float64) for x in (q, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    top, bottom = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    slack = 1e-9 * (1 + np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return bottom - slack, top + slack


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


#: What a group asks: a row for each anchor and window.
ASKS = "anchor_id long, label long, key long, same boolean, floor long, ceil long"


class Search:
    """Blocks of candidates, pages of their zone maps, and anchors in groups."""

    def __init__(self, vectors: DataFrame, anchors: DataFrame) -> None:
        short_batches(vectors.sparkSession)
        self.blocks = staged(blocks_of(vectors, max(1, -(-vectors.count() // (PAGE * BLOCK)))), "blocks")
        self.pages = staged(pages_of(self.blocks), "pages")
        n = anchors.count()
        self.anchors = staged(groups_of(anchors, max(1, -(-n // (PAGE * GROUP)))), "anchors")
        #: parts of the pages and of the groups
        self.parts = max(1, -(-self.pages.count() // PAGES)), max(1, -(-n // (GROUPS * GROUP)))

    def _packed(self, asks: DataFrame) -> DataFrame:
        """One row a group: its anchors' vectors and what they ask, as bytes (anchor_id, label, key, same, floor, ceil, row of the vector)."""

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by([("anchor_id", "ascending"), ("key", "ascending")])
            ids, first, row = np.unique(t.column("anchor_id").to_numpy(), return_index=True, return_inverse=True)
            q = _matrix(t.column("v").combine_chunks().take(pa.array(first)))
            columns = [t.column(c).to_numpy().astype(np.int64) for c in ("anchor_id", "label", "key", "same", "floor", "ceil")]
            return pa.table({"grp": t.column("grp").slice(0, 1), "d": t.column("d").slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "q": [_narrow(q)], "asks": [np.stack([*columns, row]).tobytes()]})

        return asks.join(self.anchors, "anchor_id").select("grp", "d", "anchor_id", "label", "v", "key", "same", "floor", "ceil").groupBy("grp").applyInArrow(pack, "grp long, d int, n int, q binary, asks binary")

    def _choose(self, packed: DataFrame, first: bool) -> DataFrame:
        """(grp, block, asks): blocks that a group reads, and which of its rows ask there.

        ``first``: of each page the one block that promises each row most; else all that may hold something.
        """
        p, g = self.parts
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        groups = packed.withColumn("g", F.pmod(F.xxhash64("grp"), F.lit(g)).cast("int")).withColumn("p", every(p))
        pages = self.pages.withColumn("p", F.pmod(F.xxhash64("page"), F.lit(p)).cast("int")).withColumn("g", every(g))
        met = groups.join(pages, ["d", "p", "g"]).select("grp", "d", "n", "q", "asks", "block", "low", "high", "kinds")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grp, block, rows = [], [], []
                for i in range(len(batch)):
                    d = batch.column("d")[i].as_py()
                    asks, q = _ints(batch.column("asks"), i).reshape(7, -1), _wide(batch.column("q")[i], batch.column("n")[i].as_py(), d)
                    low, high = (np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(c)[i].values]) for c in ("low", "high"))
                    bottom, top = (x[asks[6]] for x in bounds(q, low, high))
                    holds = np.empty(top.shape, bool)
                    for j, x in enumerate(batch.column("kinds")[i].values):
                        kinds = np.frombuffer(x.as_buffer(), np.int64)
                        holds[:, j] = np.where(asks[3] == 1, np.isin(asks[1], kinds), (len(kinds) > 1) | (kinds[0] != asks[1]))
                    open_ = holds & (top >= asks[4][:, None]) & (bottom <= asks[5][:, None])
                    if first:
                        best = np.where(open_, np.minimum(top, asks[5][:, None]), -np.inf).argmax(1)
                        open_ &= best[:, None] == np.arange(top.shape[1])
                    for j, b in enumerate(batch.column("block")[i].values.to_numpy()):
                        if open_[:, j].any():
                            grp.append(batch.column("grp")[i].as_py())
                            block.append(b)
                            rows.append(np.flatnonzero(open_[:, j]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(block, pa.int64()), pa.array(rows, pa.binary())], ["grp", "block", "rows"])

        return met.mapInArrow(choose, "grp long, block long, rows binary")

    def _read(self, packed: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
        """(anchor_id, key, vec_id, score): the ``k`` best rows of each chosen block in each window."""
        met = chosen.join(packed.drop("d"), "grp").join(self.blocks.select("block", "d", "ids", "labels", "x"), "block")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i in range(len(batch)):
                    asks, d = _ints(batch.column("asks"), i).reshape(7, -1)[:, np.frombuffer(batch.column("rows")[i].as_buffer(), np.int32)], batch.column("d")[i].as_py()
                    ids, labels = _ints(batch.column("ids"), i), _ints(batch.column("labels"), i)
                    used, row = np.unique(asks[6], return_inverse=True)
                    q, x = _wide(batch.column("q")[i], batch.column("n")[i].as_py(), d), _wide(batch.column("x")[i], len(ids), d)
                    score = _exact(q[used], x)[row]
                    fit = ((labels == asks[1][:, None]) == (asks[3] == 1)[:, None]) & (ids != asks[0][:, None]) & (score >= asks[4][:, None]) & (score <= asks[5][:, None])
                    r, c = np.nonzero(fit)
                    s = score[r, c]
                    best = np.lexsort((ids[c], -s, r))
                    r, c, s = r[best], c[best], s[best]
                    top = np.arange(len(r)) - np.searchsorted(r, r) < k
                    out.append((asks[0][r[top]], asks[2][r[top]], ids[c[top]], s[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out]) if out else [], pa.int64()) for j in range(4)], ["anchor_id", "key", "vec_id", "score"])

        return met.mapInArrow(read, "anchor_id long, key long, vec_id long, score long")

    def best(self, asks: DataFrame, k: int) -> DataFrame:
        """(anchor_id, key, vec_id, score, rank): the ``k`` best rows that each ask (``ASKS``) admits."""
        asks = staged(asks, "asks")
        packed = staged(self._packed(asks), "packed")
        early = staged(self._choose(packed, True), "chosen")
        seed = staged(_top(self._read(packed, early, k), k), "seed")
        # whoever has k rows already needs no worse ones; equal scores may still have smaller ids
        reached = seed.where(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("least"))
        raised = asks.join(reached, ["anchor_id", "key"], "left").withColumn("floor", F.greatest("floor", F.coalesce("least", "floor"))).drop("least")
        packed = staged(self._packed(raised), "packed")
        late = self._choose(packed, False)
        # what a group's row has read before isn't read again: all its rows there are in the seed already
        return _top(seed.drop("rank").unionByName(self._read(packed, _less(late, early), k)), k)


def _less(late: DataFrame, early: DataFrame) -> DataFrame:
    """Choices (grp, block, rows) without the rows that ``early`` has for the same group and block."""
    both = late.join(early.withColumnRenamed("rows", "done"), ["grp", "block"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column("rows").to_pylist(), batch.column("done").to_pylist()):
                rows.append(np.setdiff1d(np.frombuffer(a, np.int32), np.frombuffer(b or b"", np.int32)).astype(np.int32).tobytes())
            kept = pa.array([len(x) > 0 for x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(rows, pa.binary())], ["grp", "block", "rows"]).filter(kept)

    return both.select("grp", "block", "rows", "done").mapInArrow(cut, "grp long, block long, rows binary")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of ``anchors`` among ``vectors`` (both vec_id, label, v as :func:`usable` gives them).

    Returns (anchor_id, positive_id, rank int, negative_id, positive_score, negative_score). Vectors of another length
    than an anchor's don't meet it. A row isn't its own candidate, nor are rows that repeat its id; candidate rows that
    share an id are ranked once each. Of anchor rows with one id that with the smallest (length, vector, label) counts.
    Positives of a negative score have no window; those of score 0 take rows of score 0. Ties go to smaller ids.
    Anchors without positives, positives without negatives, and empty tables give no rows.
    """
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct(F.size("v"), "v", "label")).alias("x")).select("vec_id", "x.label", "x.v")
    search = Search(on_curve(vectors), on_curve(anchors))
    own = search.anchors.select("anchor_id", "label", F.lit(0).cast("long").alias("key"), F.lit(True).alias("same"), F.lit(_LOW).alias("floor"), F.lit(_HIGH).alias("ceil"))
    positives = staged(search.best(own.drop("label"), POSITIVES).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    window = {"floor": F.ceil(p.cast("decimal(38,0)") * FROM / 100).cast("long"), "ceil": F.floor(p.cast("decimal(38,0)") * TO / 100).cast("long")}
    asks = positives.where("positive_score >= 0").select("anchor_id", p.alias("key"), F.lit(False).alias("same"), *(v.alias(k) for k, v in window.items())).distinct()
    negatives = search.best(asks, NEGATIVES).select("anchor_id", F.col("key").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every vector whose id is divisible by 50; labels of ids divisible by 7 are moved on by one first."""
    v = usable(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    v = staged(v, "vectors")
    return mine(v, v.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3
"""
