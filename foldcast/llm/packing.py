"""Packing token sequences by best-fit decreasing.

Documents are tokenized once. Full windows of an overlong document become sequences of their
own; the rest of each document is a piece. Pieces are dealt into bins of a constant number
of pieces, and each bin is packed by best-fit decreasing: pieces from the longest, each into
the open window with the tightest room, found in a segment tree over remaining capacity. The
number of bins grows with the input, never their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.llm.common import short_batches, staged, table
from foldcast.llm.wordpieces import WordPieces

LENGTH = 4096
END_ID = 2
#: Pieces that are packed together. More fill the windows no better.
BIN_PIECES = 20_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(texts: list[str], pieces: WordPieces) -> list[np.ndarray]:
    """Ids of whole texts. The vocabulary's tokens never span a space, so these are its words' ids in turn."""
    split = [t.replace("\n", " ").split(" ") for t in texts]
    known = pieces.learn(set().union(*split))
    return [np.frombuffer(b"".join([known[w] for w in ws]), "<u4") for ws in split]


def cut(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of each row: (doc_id, start, length, ids_crc32, doc_tokens[, ids]).

    A null text is empty; it has the end id alone. Repeated rows give their own pieces.
    """
    path = path or vocabulary()
    short_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordPieces.of(path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, x in zip(batch.column(0).to_pylist(), token_ids([t or "" for t in batch.column(1).to_pylist()], known)):
                raw, n = x.tobytes() + np.uint32(end_id).astype("<u4").tobytes(), len(x) + 1
                for at in range(0, n, length):
                    part = raw[4 * at : 4 * (at + length)]
                    for col, v in zip(rows, (doc, at, len(part) // 4, zlib.crc32(part), n, part)):
                        col.append(v)
            arrays = [*(pa.array(c, pa.int64()) for c in rows[:5])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                flat = np.frombuffer(b"".join(rows[5]), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(rows[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, length: int) -> None:
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.held: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.held[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, with that room."""
        count, i = self.count, need + self.base
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.base
        self._add(room, -1)
        return self.held[room].pop(), room


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces come longest first, ties in the given order."""
    order = np.argsort(-lengths, kind="stable")
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, made = OpenWindows(length), 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = open_.take(n)
        if found is None:
            found, made = (made, length), made + 1
        w, room = found
        window[i], offset[i] = w, length - room
        if room > n:
            open_.put(room - n, w)
    return window, offset


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(…, sequence_id, offset) for pieces with ``length``; other columns pass through.

    Columns named bin, sequence_id or offset are replaced.

    Sequence ids are unique, not gapless: the bin's number times 2**32 plus the window's. An
    empty table gives an empty result.
    """
    pieces = pieces.drop("bin", "sequence_id", "offset")
    n = pieces.where(F.col("length") < length).count()
    bins = max(1, -(-n // BIN_PIECES))
    keys = ["doc_id", "start"]
    binned = pieces.withColumn("bin", F.when(F.col("length") < length, F.pmod(F.xxhash64(*keys, F.col("length")), F.lit(bins))).otherwise(F.lit(-1)))
    whole = binned.where("bin < 0").select(*pieces.columns, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in _groups(batches, "bin"):
            w, o = best_fit(t.column("length").to_numpy(), length)
            t = t.drop_columns(["bin"]).append_column("sequence_id", pa.array(w + (number << 32))).append_column("offset", pa.array(o))
            yield from t.to_batches(max_chunksize=10_000)

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest = binned.where("bin >= 0").repartition(bins, "bin").sortWithinPartitions("bin", F.col("length").desc(), *keys).mapInArrow(place, schema)
    return rest.unionByName(whole)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal keys of sorted batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        k = batch.column(key).to_numpy()
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1):
            if not len(part):
                continue
            if now is not None and k[part[0]] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(k[part[0]])
            held.append(batch.slice(part[0], len(part)))
    if held:
        yield now, pa.Table.from_batches(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in sequences of at most 4096 tokens."""
    return pack(staged(cut(table(spark, sf_dir, "documents")), "pieces"))
