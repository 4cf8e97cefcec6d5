"""N-gram Jaccard self-join: a size-aware heavy-light join on exact shingle sets.

A document's set holds its distinct word shingles. Two sets link when
``100 * |A n B| >= percent * |A u B|``. Every pair that can link meets in a *list*:

* **Light** (small sets): a set lists itself under each subset of a fixed size that any
  partner of its size must share with it.
* **Heavy** (large sets): a set is listed under its first tokens in one global order, rare
  tokens first. Two linked sets share one of them, and one of the two has it early enough to
  count as an index entry; lists are then scanned for members that can still reach the
  threshold by size and by place.

The boundary is the size at which enumerating subsets costs less than scanning lists, by the
sizes of the corpus itself.

Within a list members are first compared with one pivot, and components are formed; only
members that are still in different components are compared with each other afterwards. So a
group of near copies costs about its size, yet no link that joins two components is lost.
Texts with equal sets are one class throughout.

The token order comes from a counting sketch of fixed size over the whole corpus. Any order
gives exact results; a better one gives shorter lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.llm import graph, textkit
from foldcast.llm.common import added, bounded, discard, short_batches, staged, table

#: Columns of the odd hash buckets.
ODD = ("p1", "p2", "p3", "p4")
#: log2 of the sketch's counters, and counters in a block of it.
SKETCH_BITS, BLOCK = 22, 1 << 16
#: Sizes that may be light at most.
LIGHT_MOST = 29
#: What scanning one heavy entry's list costs against probing one subset.
LIST_COST = 8.0


def _least_size(n: int, percent: int) -> int:
    """The least overlap of a set of size ``n`` with any partner that is not larger."""
    return -(-percent * n // 100)


def subset_sizes(n: int, percent: int) -> set[int]:
    """Sizes of subsets under which a light set of size ``n`` is listed."""
    return {c for m in range(n, n * 100 // percent + 1) if (c := _least_size(m, percent)) <= n}


def light_boundary(sizes: np.ndarray, percent: int) -> int:
    """The largest light size, chosen by cost. sizes[n]: how many texts have n shingles."""
    subsets = np.array([0] + [sum(comb(n, c) for c in subset_sizes(n, percent)) for n in range(1, len(sizes))], dtype=float)
    prefix = np.array([0] + [n - _least_size(n, percent) + 1 for n in range(1, len(sizes))], dtype=float)

    def cost(b: int) -> float:
        n = np.arange(len(sizes))
        return float((sizes * subsets)[n <= b].sum() + LIST_COST * (sizes * prefix)[n >= percent * (b + 1) / 100].sum())

    return min(range(min(LIGHT_MOST, len(sizes) - 1) + 1), key=cost)


def sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-scaled counts of all shingles of the corpus by hash, and the sizes of small texts.

    The sketch has a fixed number of counters. Tasks count their own texts; the counters are
    added in levels, block by block, on the executors; the driver gets 16 MB at any input size.
    """
    top = np.uint64(64 - SKETCH_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, small, held = np.zeros(1 << SKETCH_BITS, np.uint32), np.zeros(BLOCK, np.uint32), []
        for batch in batches:
            for _, words, ends in textkit.word_hashes(batch.column(0)):
                small[: LIGHT_MOST + 1] += np.bincount(np.clip(np.diff(ends) - size + 1, np.minimum(np.diff(ends), 1), LIGHT_MOST + 1), minlength=LIGHT_MOST + 2)[: LIGHT_MOST + 1].astype(np.uint32)
                held.append((_document_shingles(words, ends, size)[0] >> top).astype(np.int32))
                if sum(map(len, held)) > 1 << 19:
                    np.add.at(total, np.concatenate(held), np.uint32(1))
                    held = []
        if held:
            np.add.at(total, np.concatenate(held), np.uint32(1))
        for k, x in enumerate([*total.reshape(-1, BLOCK), small]):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "part", "x"])

    blocks = (1 << SKETCH_BITS) // BLOCK
    parts = docs.select("text").mapInArrow(count, "block int, part long, x binary")
    sums = added(parts, np.float32, ("block",))
    found = {r["block"]: np.frombuffer(r["x"], np.float32) for r in sums.collect()}
    discard(sums)
    none = np.zeros(BLOCK, np.float32)
    weights = np.concatenate([np.minimum(np.log2(found.get(k, none) + 1) * 8, 255).astype(np.uint8) for k in range(blocks)])
    return weights, found.get(blocks, none)[: LIGHT_MOST + 1].astype(float)


def _document_shingles(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a run of texts, repeats included, and each text's bounds among them."""
    counts = np.diff(ends)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(bounds[-1], np.uint64)
    runs = textkit.shingle_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    whole = counts >= size
    if len(runs):
        text = np.repeat(np.arange(len(counts)), np.where(whole, made, 0))
        out_at = np.arange(len(text)) - np.repeat(np.cumsum(np.where(whole, made, 0)) - np.where(whole, made, 0), np.where(whole, made, 0))
        out[bounds[text] + out_at] = runs[ends[text] + out_at]
    for i in np.flatnonzero(~whole & (counts > 0)):
        out[bounds[i]] = textkit.shingle_hashes(words[ends[i] : ends[i + 1]], size)[0]
    return out, bounds


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, ends in textkit.word_hashes(column):
        made, bounds = _document_shingles(words, ends, size)
        for i in range(len(bounds) - 1):
            yield np.unique(made[bounds[i] : bounds[i + 1]])


def signatures(docs: DataFrame, size: int, percent: int, weights: np.ndarray, boundary: int) -> DataFrame:
    """Per text: set size, a 128-bit hash of the set, and the list entries of the set.

    Columns: doc_id, n, s1, s2, p1 to p4 (which of 256 hash buckets hold an odd number of the
    set's members), keys array<long>, places array<int> (-1: a light entry).
    """
    order = docs.sparkSession.sparkContext.broadcast(weights)
    top = np.uint64(64 - SKETCH_BITS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = order.value
        for batch in batches:
            n, s1, s2, odd, keys, places = [], [], [], [], [], []
            for u in shingle_sets(batch.column(1), size):
                k = len(u)
                n.append(k)
                with np.errstate(over="ignore"):
                    s1.append(textkit.mix(u, 1).sum(dtype=np.uint64).view(np.int64))
                    s2.append(textkit.mix(u, 2).sum(dtype=np.uint64).view(np.int64))
                odd.append(np.packbits(np.bincount((textkit.mix(u, 7) >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64))
                own, at = [], []
                if 0 < k <= boundary:
                    own = [_subset_key(u, c) for c in sorted(subset_sizes(k, percent))]
                    at = [np.full(len(x), -1, np.int32) for x in own]
                if k and k * 100 >= percent * (boundary + 1):
                    first = np.argsort(weight[u >> top], kind="stable")[: k - _least_size(k, percent) + 1]
                    own.append(textkit.mix(u[first], 3))
                    at.append(np.arange(len(first), dtype=np.int32))
                keys.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                places.append(np.concatenate(at) if at else np.zeros(0, np.int32))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x or [np.zeros(0, kind)]), t)) for x, t, kind in ((keys, pa.int64(), np.int64), (places, pa.int32(), np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *(pa.array([x[j] for x in odd], pa.int64()) for j in range(4)), *lists], ["doc_id", "n", "s1", "s2", *ODD, "keys", "places"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, p3 long, p4 long, keys array<long>, places array<int>")


def _subset_key(u: np.ndarray, c: int) -> np.ndarray:
    mixed = textkit.mix(u, 4)
    with np.errstate(over="ignore"):
        whole = mixed.sum(dtype=np.uint64)
        left_out = [sum((mixed[j] for j in out), np.uint64(0)) for out in combinations(range(len(u)), len(u) - c)]
        return textkit.mix(whole - np.array(left_out, np.uint64), 100 + c)


def _can_link(x: graph.Side, y: graph.Side, percent: int) -> Column:
    """Whether two sets that meet in a list may still reach the threshold.

    By their sizes; by what can follow their places in the global order; and by their odd buckets,
    of which two sets differ in no more than in members.
    """
    n, i, m, j = x("n"), x("i"), y("n"), y("i")
    rest = F.lit(1) + F.least(n - i - 1, m - j - 1)
    apart = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in ODD), F.lit(0))
    return (F.greatest(n, m) * percent <= F.least(n, m) * 100) & ((i < 0) | (rest * (100 + percent) >= (n + m) * percent)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Group texts whose shingle sets link, directly or through others.

    Takes any table with ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. A text without words (null, empty or white space) has an empty set and links with
    nothing. Rows that repeat a doc_id count as one document. A row without doc_id keeps
    its row and gets no component. An empty table gives an empty result.

    Returns per row: doc_id, n_shingles, s1, s2 (hash of the set), component_id (smallest
    doc_id of the component).
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights, small = sketch(docs, size)
    sig = staged(signatures(docs, size, percent, weights, light_boundary(small, percent)), "signatures")
    reps = staged(sig.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    chosen = sig.join(reps.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    entries = chosen.select(F.col("doc_id").alias("id"), "n", *ODD, F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("i"))).alias("key", "i"))
    entries = entries.withColumn("indexed", (F.col("i") < 0) | (F.col("i") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / F.lit(100 + percent))))
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("indexed").alias("x")).where("lo <> hi and x").select("key")
    keys, spent = staged(shared, "keys"), []
    live = staged(entries.join(bounded(keys), "key", "left_semi"), "lists")
    discard(keys)
    labels = graph.link_lists(live, lambda x, y: _can_link(x, y, percent), lambda pairs: _judge(pairs, docs, size, percent, spent))
    discard(live, *spent)
    known = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(known, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", "s1", "s2", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [u.view(np.int64) for u in shingle_sets(batch.column(1), size)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made or [np.zeros(0, np.int64)])))], ["id", "shingles"])

    return docs.join(bounded(ids), "doc_id", "left_semi").mapInArrow(make, "id long, shingles array<long>")


def _judge(pairs: DataFrame, docs: DataFrame, size: int, percent: int, spent: list[DataFrame]) -> DataFrame:
    """Exact verification of candidate pairs: only their texts are read into sets again.

    ``spent`` holds the sets of the last call, whose verdicts are written by now.
    """
    discard(*spent)
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = staged(_sets_of(docs, ids, size), "sets")
    discard(ids)
    spent[:] = [sets]
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.groupBy("a", "b").agg(F.max(common * (100 + percent) >= (F.size("x") + F.size("y")) * percent).alias("linked"))


def one_per_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Keep one document of each linked group: the one with the smallest doc_id.

    Documents without words and rows without doc_id stay. Of exact repeats of a whole row's
    doc_id all rows stay, as they are one document.
    """
    kept = link(docs, size, percent).where("doc_id is not null and doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: components of all documents at three-word shingles and 0.9."""
    return link(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
