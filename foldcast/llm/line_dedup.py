"""Near-duplicate lines: a segment-partition edit join.

Two lines of ``min_chars`` code points or more are near if their edit distance is at most the
threshold t. A line is split into t + 1 segments; a partner within t edits holds at least one of
them unchanged, at a place that the lengths confine. Lines are indexed by (length, segment number,
segment); each line also probes, for partner lengths from its own down to t less, the substrings at
the places a segment may have moved to. Meetings are verified by banded bit-parallel edit
distance. Equal lines are one node throughout. Near lines form classes (connected
components); the first line of a class by (doc_id, line number) stays, the rest go.

Shorter lines that aren't blank repeat only if they are equal. Equal lines are found by two hashes, 128
bits together; in the near join a line goes by the first of them, and its class is told to lines
with both alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm import graph, textkit
from foldcast.llm.common import bounded, discard, short_batches, staged, table

#: Largest edit distance, and the shortest line in code points that takes part.
THRESHOLD, MIN_CHARS = 2, 20
#: Columns of the odd buckets of character pairs.
ODD = ("p1", "p2", "p3", "p4")
#: Lines that a task remembers, so as to index equal ones once.
SEEN = 1_000_000
#: Code points that are hashed together.
CHUNK = 1 << 19
#: Rows of the table of repeated lines that may be broadcast.
BROADCAST_LINES = 300_000


def probes(t: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of all substrings to look up; the index entries first."""
    own = [(0, i, 0) for i in range(1, t + 2)]
    more = [(d, i, s) for d in range(t + 1) for i in range(1, t + 2) for s in range(max(1 - i, d - (t + 1 - i)), min(i - 1, d + (t + 1 - i)) + 1)]
    return own + [x for x in more if x not in own]


def line_keys(lines: list[str], t: int, min_chars: int) -> np.ndarray:
    """Keys of each line by :func:`probes` (0 where a substring doesn't exist), as int64 rows."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.array([len(x) for x in lines], np.int64)
    base = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    sums = textkit.prefix_hash(textkit.mix(codes.astype(np.uint64), 5))
    plan = probes(t)
    out = np.zeros((len(lines), len(plan)), np.int64)
    for col, (d, i, s) in enumerate(plan):
        m = n - d
        short, longer = m // (t + 1), m % (t + 1)
        first_long = t + 1 - longer  # so many short segments come first
        start = (i - 1) * short + np.maximum(0, i - 1 - first_long) + s
        size = short + (i > first_long)
        ok = np.flatnonzero((m >= min_chars) & (start >= 0) & (start + size <= n))
        at = base[ok] + start[ok]
        key = textkit.span_hash(sums, at, at + size[ok])
        with np.errstate(over="ignore"):
            out[ok, col] = textkit.mix(key ^ (m[ok] * 16 + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 6).view(np.int64)
    return out


def odd_pairs(lines: list[str]) -> np.ndarray:
    """Per line which of 256 buckets hold an odd number of its character pairs, as four int64.

    An edit takes and adds two pairs at most, so lines within t edits differ in 4t buckets at most.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.array([len(x) for x in lines], np.int64)
    line = np.repeat(np.arange(len(lines)), n)
    pair = (textkit.mix(codes[:-1] * np.uint64(0x110000) + codes[1:], 8) >> np.uint64(56)).astype(np.int64)
    whole = line[:-1] == line[1:]
    odd = np.bincount(line[:-1][whole] * 256 + pair[whole], minlength=256 * len(lines)).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(len(lines), 4)


def entries(docs: DataFrame, t: int, min_chars: int) -> DataFrame:
    """(id, n, p1 to p4, keys) for the lines of all texts; of equal lines in a task the first only."""
    width = len(probes(t))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, ids, size = [], [], 0
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) >= min_chars and (h := xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)) not in seen:
                        if len(seen) == SEEN:
                            seen.clear()
                        seen.add(h)
                        held.append(line)
                        ids.append(h)
                        size += len(line)
                if size > CHUNK:
                    yield _batch(held, ids, t, min_chars, width)
                    held, ids, size = [], [], 0
            if held:
                yield _batch(held, ids, t, min_chars, width)

    return docs.select("text").mapInArrow(make, "id long, n int, p1 long, p2 long, p3 long, p4 long, keys array<long>")


def _batch(lines: list[str], ids: list[int], t: int, min_chars: int, width: int) -> pa.RecordBatch:
    keys = line_keys(lines, t, min_chars)
    ends = np.arange(0, keys.size + 1, width, dtype=np.int32)
    odd = odd_pairs(lines)
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.array([len(x) for x in lines], np.int32)), *(pa.array(odd[:, k].copy()) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["id", "n", *ODD, "keys"])


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance of two texts is at most ``t``.

    A band of 2t + 1 rows around the diagonal is kept as bits of vertical differences and slides
    down by one row with each column, so a column takes a few word operations.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > t:
        return False
    if a == b or not t:
        return a == b
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << 2 * t + 1) - 1, 1 << 2 * t
    up, down = full >> t << t, 0
    score, most = min(m, t), 2 * t + n - m
    for j in range(1, n + 1):
        mask, shift = where.get(b[j - 1], 0), j - t - 1
        same = (mask >> shift if shift >= 0 else mask << -shift) & full
        diag = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | full & ~(diag | up), diag & up
        if j <= m - t:
            if not diag & top:
                score += 1
                if score > most:
                    return False
        else:
            bit = 1 << m - j + t
            score += bool(right & bit) - bool(left & bit)
        up, down = left | full & ~(diag >> 1 | right), diag >> 1 & right
    return score <= t


def _lines(docs: DataFrame) -> DataFrame:
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return line.withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(1), "line"))


def near_classes(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, id2, component) for the lines that are near another line; id and id2 are the line's hashes."""
    made = staged(entries(docs, t, min_chars), "lines")
    flat = made.select("id", "n", *ODD, F.posexplode_outer("keys").alias("place", "key")).where("key <> 0").select("key", "id", "n", *ODD, (F.col("place") <= t).alias("indexed"))
    shared = flat.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("indexed").alias("x")).where("lo <> hi and x").select("key")
    keys = staged(shared, "keys")
    lists = staged(flat.join(bounded(keys), "key", "left_semi").distinct(), "lists")
    discard(made, keys)
    ids = staged(lists.select("id").distinct(), "ids")
    long = _lines(docs).where(F.char_length("line") >= min_chars)
    texts = staged(long.join(bounded(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct("id2", "line")).alias("x")).select("id", "x.id2", "x.line"), "texts")

    def judge(pairs: DataFrame) -> DataFrame:
        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [within(x, y, t) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, linked boolean")

    def can_link(x: graph.Side, y: graph.Side) -> Column:
        apart = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in ODD), F.lit(0))
        return (F.abs(x("n") - y("n")) <= t) & (apart <= 4 * t)

    labels = graph.link_lists(lists, can_link, judge)
    discard(lists, ids)
    return labels.withColumnRenamed("node", "id").join(texts.select("id", "id2"), "id")


def repeats(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, lines array<int>): the line numbers of each document that repeat an earlier line."""
    lines = _lines(docs.where("doc_id is not null")).where(r"line rlike '\\S'").select("doc_id", "line_no", "id", "id2")
    firsts = staged(lines.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("k")), "firsts")
    near = staged(near_classes(docs, t, min_chars), "near")
    heads = near.join(firsts, ["id", "id2"]).groupBy("component").agg(F.min("first").alias("head"))
    classed = firsts.where("k > 1").select("id", "id2", "first").join(near.select("id", "id2"), ["id", "id2"], "left_anti").unionByName(near.join(heads, "component").select("id", "id2", F.col("head").alias("first")))
    again = lines.join(bounded(staged(classed, "repeated"), BROADCAST_LINES), ["id", "id2"]).where(F.struct("doc_id", "line_no") != F.col("first"))
    return again.groupBy("doc_id").agg(F.collect_set("line_no").alias("lines"))


def clean(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with lines that repeat an earlier line removed; adds n_lines and n_removed.

    Takes doc_id and text; other columns pass through, but for columns named n_lines or n_removed, which are
    replaced. Blank lines are left alone, as are rows without doc_id or text; lines shorter than
    ``min_chars`` go only if they are equal to an earlier line. Rows that repeat a doc_id count as one
    document, so they don't repeat each other at equal line numbers. An empty table gives an
    empty result.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeats(plain, t, min_chars)
    joined = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text").join(gone, "doc_id", "left")
    drop = F.coalesce("lines", F.array().cast("array<int>"))
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("lines"), i)), "\n")
    return joined.select(
        *(F.col(f"row.{c}").alias(c) for c in docs.columns if c != "text"),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents without repeated lines, as counts and digests."""
    done = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))
