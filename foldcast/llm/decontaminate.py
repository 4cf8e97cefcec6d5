"""Benchmark decontamination by windows, on DataFrame functions alone.

Word shingles of the benchmark items are looked up in all documents. Where a shingle of an
item stands in a document, the item-sized window that aligns the two is a candidate, and so is the
one that begins there. The latter cover the best window of any order: slid to the right as long as
its first shingle isn't the item's, a window loses nothing, up to the document's end. Windows that hold
fewer places of the item's shingles than the bound needs are left out; the others are verified by the exact weighted similarity of its shingles and the item's (weights:
occurrences; sum of minima over sum of maxima).

No SimHash stands before that. At a weighted similarity of 0.8 two windows' 64-bit SimHashes differ in 9.7
bits on average, with a deviation of 2.9. A radius that loses fewer than one pair in 10,000 is 21 or more, for which
multi-index blocks have 64 / 22, fewer than three bits, so each block's table lets an eighth of all windows through and the
index filters nothing. A radius of 15 was built and lost windows at the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.common import staged, table

SHINGLE, SIMILARITY = 5, 0.8
#: Rows of the benchmark's tables up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased words; a null or blank text has none."""
    parts = F.split(F.trim(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")), " +")
    return F.when(parts[0] == "", F.array().cast("array<string>")).otherwise(parts)


def shingles(w: str) -> Column:
    """Hashes of all runs of five words of the array column ``w``; of fewer words, none."""
    run = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), run)).otherwise(F.array().cast("array<long>"))


def repeated(a: Column) -> Column:
    """The values that an array holds more than once: equal neighbours of the sorted array."""
    s = F.sort_array(a)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.when(x == y, x))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def similarity(a: Column, b: Column, a_more: Column, b_more: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets; ``a_more`` and ``b_more`` are their repeated values.

    A common value counts once, by a hash set; only values that both sides repeat are counted out.
    """
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.array_intersect(a_more, b_more)
    common = F.size(F.array_intersect(a, b)) + F.aggregate(both, F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)) - 1)
    return common / (F.size(a) + F.size(b) - common)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows of documents that repeat a benchmark item: (doc_id, item_id, start, words, similarity).

    Takes doc_id and text, item_id and text; other columns are ignored. Items of fewer than
    five words, null texts and rows without id match nothing. A window is clipped to its
    document; a document shorter than an item is one window. An item found once may have several
    windows, a few words apart. Rows that repeat a doc_id are one
    document only if their texts are equal. Empty tables give an empty result.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).withColumn("item_h", shingles("w"))
    items = items.where("size(item_h) > 0").select("item_id", F.xxhash64("item_h").alias("kind"), F.size("w").alias("n"), "item_h").dropDuplicates(["item_id", "kind"])
    items = staged(items.withColumn("item_more", repeated(F.col("item_h"))), "items")
    # a shingle that an item repeats aligns by its first and its last place: windows that begin at it are all there besides
    places = items.select("item_id", "kind", "n", F.posexplode("item_h").alias("off", "s")).groupBy("item_id", "kind", "n", "s").agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    places = places.select("item_id", "kind", "n", "s", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("off"))
    rows = items.agg(F.coalesce(F.sum(F.size("item_h")), F.lit(0))).first()[0]
    small = F.broadcast if rows <= BROADCAST_ROWS else (lambda df: df)

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = lambda d: d.select("doc_id", F.xxhash64("text").alias("t"), words(F.col("text")).alias("w")).withColumn("h", shingles("w"))
    # posexplode_outer: for posexplode Spark adds a filter that would hash each text again
    hits = hashed(plain).select("doc_id", "t", F.size("w").alias("m"), F.posexplode_outer("h").alias("pos", "s")).join(small(places), "s")
    last = F.greatest(F.col("m") - F.col("n"), F.lit(0))
    aligned = F.greatest(F.least(F.col("pos") - F.col("off"), last), F.lit(0))
    met = hits.groupBy("doc_id", "t", "m", "item_id", "kind", "n").agg(F.array_sort(F.collect_set("pos")).alias("ps"), F.collect_set(aligned).alias("aligned"))
    # of a and g shingles, c in common give similarity c / (a + g - c)
    met = met.withColumn("last", last).withColumn("a", F.least("n", "m") - SHINGLE + 1)
    met = met.withColumn("need", F.ceil((F.col("a") + F.col("n") - SHINGLE + 1) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6).cast("int")).where(F.size("ps") >= F.col("need"))
    begun = F.filter("ps", lambda p, i: (p <= F.col("last")) & (F.get("ps", i + F.col("need") - 1) < p + F.col("a")))
    ending = F.when(F.size(F.filter("ps", lambda p: p >= F.col("last"))) >= F.col("need"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = F.explode(F.array_union(F.array_union("aligned", begun), ending)).alias("start")
    windows = met.select("doc_id", "t", starts, "n", "item_id", "kind").groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "n", "item_id", "kind"))).alias("windows"))
    windows = staged(windows, "windows")
    found = hashed(plain.withColumn("t", F.xxhash64("text")).join(windows.select("doc_id", "t"), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"]))
    cut = found.join(windows, ["doc_id", "t"]).select("doc_id", "h", F.explode("windows").alias("x"))
    cut = cut.select("doc_id", "x.*", F.slice("h", F.col("x.start") + 1, F.col("x.n") - SHINGLE + 1).alias("h")).where("size(h) > 0")
    met = cut.join(small(items.select("item_id", "kind", "item_h", "item_more")), ["item_id", "kind"])
    more = F.when(F.size("item_more") > 0, repeated(F.col("h"))).otherwise(F.array().cast("array<long>"))
    met = met.withColumn("more", more)
    return met.select("doc_id", "item_id", "start", F.col("n").alias("words"), similarity(F.col("h"), F.col("item_h"), F.col("more"), F.col("item_more")).alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match; all columns stay. Rows without doc_id stay."""
    bad = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents against the benchmark."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
