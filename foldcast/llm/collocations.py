"""Phrase collocations from sorted count streams.

Texts are cut into pieces and words; phrases are runs of up to four words within a piece. Counting goes by order,
and a phrase is counted only if the shorter phrases in it are frequent (Apriori): words first, then pairs of frequent words,
then longer runs of frequent pairs. What is known to be frequent is told to the tasks as a filter of fixed size that may let
too much through, never too little; the exact bound comes afterwards, on exact sums.

Frequent phrases then stand in two streams: in **prefix order** (by their words) and in **suffix order** (by their words from
the last to the first). In prefix order all beginnings of a phrase come before it and its extensions to the right
right after it, so one pass with the open beginnings at hand reads off the counts of all its left parts and the largest
extension to the right; in suffix order the same pass gives the right parts and the extensions to the left. No count is looked up by
hash. A stream is dealt out by range into parts of a bounded number of rows; each part also gets the beginnings of its first
phrase, three at most. Both passes are merged by phrase.

A longer extension needs no look: a phrase with more words around it is no more frequent than with one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.llm import textkit
from foldcast.llm.common import short_batches, staged, table

#: Words of a phrase, least count, percent of a phrase's count at which an extension drops it, rows of a report.
MOST_WORDS, LEAST, EXTENDED, TOP = 4, 30, 80, 2000
#: A score of 1 is written as this.
SCALE = 1_000_000
#: Words that a task counts at once, rows of an output batch, bits of the filter (log2), rows of a part of a stream.
WORDS, ROWS, FILTER_BITS, PART_ROWS = 2_000_000, 65_536, 26, 100_000
#: Bytes between words, and between pieces.
GAP, BREAK = b" \t.,;:!?\n\x0b\x0c\r", b".,;:!?\n\x0b\x0c\r"

_IS_GAP, _IS_BREAK = np.zeros(256, bool), np.zeros(256, bool)
_IS_GAP[list(GAP)], _IS_BREAK[list(BREAK)] = True, True


class _Words:
    """Words of one language that a task has gathered: their bytes, lengths, and whether each goes on in a piece."""

    def __init__(self) -> None:
        self.data: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.goes_on: list[np.ndarray] = []
        self.n = 0

    def add(self, column: pa.Array) -> None:
        raw, bounds = textkit.text_bytes(column)
        for at, to in textkit.chunks(bounds):
            part, own = textkit.LOWER[raw[bounds[at] : bounds[to]]], bounds[at : to + 1] - bounds[at]
            start, end = textkit.word_bounds(part, own, _IS_GAP)
            if not len(start):
                continue
            piece = np.cumsum(_IS_BREAK[part])[start] + np.searchsorted(own, start, side="right")
            self.data.append(part[~_IS_GAP[part]])
            self.size.append(end - start)
            self.goes_on.append(np.concatenate([[False], piece[1:] == piece[:-1]]))
            self.n += len(start)

    def take(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Numbers of the words, the distinct words, and whether each follows the one before; the buffer is empty then."""
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.size))]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.concatenate(self.data)))
        coded, goes_on = words.dictionary_encode(), np.concatenate(self.goes_on)
        self.__init__()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary, goes_on


def _hashes(words: pa.Array) -> np.ndarray:
    raw, bounds = textkit.text_bytes(words)
    return textkit.span_hash(textkit.prefix_hash(textkit.BYTE_CODES[raw]), bounds[:-1], bounds[1:])


def _joint(a: np.ndarray, b: np.ndarray | None, lang: str) -> np.ndarray:
    """The filter's hash of words or of pairs of words of a language, from the words' hashes."""
    salt = _hashes(pa.array([lang], pa.large_string()))[0]
    with np.errstate(over="ignore"):
        return textkit.mix((a if b is None else a * np.uint64(0x9E3779B97F4A7C15) + textkit.mix(b, 21)) ^ salt, 20)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter."""
    return tuple((h >> np.uint64(s) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for s in (0, 32))


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter over (lang, phrase): words, or pairs of words. 8 MB, however many there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                phrases = batch.column(1).filter(pc.equal(langs.indices, k))
                parts = pc.split_pattern(phrases.cast(pa.large_string()), " ")
                hs = _hashes(parts.flatten())
                size = len(hs) // len(phrases)
                at = np.concatenate(_bits(_joint(hs[::size], hs[1::size] if size == 2 else None, lang)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.left_shift(np.int64(1), at & 63))], ["slot", "mask"])

    slots = frequent.select("lang", "phrase").mapInArrow(places, "slot int, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("mask").to_numpy()
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    return ((bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1).astype(bool)


def _counted(docs: DataFrame, count: Callable[[np.ndarray, pa.Array, np.ndarray, str], Iterator[tuple[pa.Array, np.ndarray]]]) -> DataFrame:
    """Sums (lang, phrase, f) of what ``count`` finds in a task's words, a few million at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Words] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            for phrases, n in count(*held.pop(lang).take(), lang):
                for at in range(0, len(phrases), ROWS):
                    own = phrases.slice(at, ROWS).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(n[at : at + ROWS], pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(lang, _Words()).add(batch.column(1).filter(pc.equal(langs.indices, k)))
                if not held[lang].n:
                    del held[lang]
            while sum(w.n for w in held.values()) > WORDS:
                yield from out(max(held, key=lambda x: held[x].n))
        for lang in list(held):
            yield from out(lang)

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _tally(codes: np.ndarray, base: int, first: pa.Array, second: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct codes a * base + b: which each one is, how often, and the phrases first[a] + space + second[b]."""
    u, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    return at, n, pc.binary_join_element_wise(first.take(pa.array(u // base)), second.take(pa.array(u % base)), pa.scalar(" ", pa.large_string()))


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, phrase, f) of all phrases of one to four words found ``least`` times or more, and (lang, n).

    Words of a phrase are joined by a space, which no word holds.
    """
    spark = docs.sparkSession

    def words(ids: np.ndarray, dic: pa.Array, goes_on: np.ndarray, lang: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        yield dic, np.bincount(ids, minlength=len(dic))
        yield pa.array([None], pa.large_string()), np.array([len(ids)])

    ones = staged(_counted(docs, words).where(f"phrase is null or f >= {least}"), "words")
    totals, ones = ones.where("phrase is null").select("lang", F.col("f").alias("n")), ones.where("phrase is not null")
    known = spark.sparkContext.broadcast(frequent_filter(ones))

    def joined(ids: np.ndarray, dic: pa.Array, goes_on: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Where two frequent words stand side by side (the first one's place), and the words' hashes."""
        hs = _hashes(dic)
        good = _has(known.value, _joint(hs, None, lang))[ids]
        return np.flatnonzero(goes_on[1:] & good[1:] & good[:-1]), hs

    def pairs(ids: np.ndarray, dic: pa.Array, goes_on: np.ndarray, lang: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        at, _ = joined(ids, dic, goes_on, lang)
        _, n, phrases = _tally(ids[at] * len(dic) + ids[at + 1], len(dic), dic, dic)
        yield phrases, n

    twos = staged(_counted(docs, pairs).where(F.col("f") >= least), "pairs")
    paired = spark.sparkContext.broadcast(frequent_filter(twos))

    def longer(ids: np.ndarray, dic: pa.Array, goes_on: np.ndarray, lang: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        at, hs = joined(ids, dic, goes_on, lang)
        live = np.zeros(len(ids), bool)
        live[at] = _has(paired.value, _joint(hs[ids[at]], hs[ids[at + 1]], lang))
        two = np.flatnonzero(live)
        which, _, phrases = _tally(ids[two] * len(dic) + ids[two + 1], len(dic), dic, dic)
        for k in range(2, MOST_WORDS):
            # places whose run of k words goes on by another live pair
            far = two + k - 1
            on = np.flatnonzero((far < len(ids) - 1) & live[np.minimum(far, len(ids) - 1)])
            two, which = two[on], which[on]
            which, n, phrases = _tally(which * len(dic) + ids[two + k], len(dic), phrases, dic)
            yield phrases, n

    threes = staged(_counted(docs, longer).where(F.col("f") >= least), "longer")
    return ones.unionByName(twos).unionByName(threes), totals


def _walk(lang: list[str], key: list[list[str]], f: list[int], own: list[bool]) -> tuple[list, list, list]:
    """One pass over sorted phrases: (row, counts of its beginnings) and (phrase, its largest extension).

    Beginnings that only stand for what another part holds get no row of their own.
    """
    rows, parts, extended = [], [], {}
    open_: list[tuple[str, list[str], int]] = []
    for i in sorted(range(len(f)), key=lambda i: (lang[i], key[i])):
        words = key[i]
        while open_ and (open_[-1][0] != lang[i] or len(open_[-1][1]) >= len(words) or open_[-1][1] != words[: len(open_[-1][1])]):
            open_.pop()
        if own[i]:
            rows.append(i)
            parts.append([n for _, _, n in open_])
            if open_:
                up = (lang[i], tuple(open_[-1][1]))
                extended[up] = max(extended.get(up, 0), f[i])
        open_.append((lang[i], words, f[i]))
    return rows, parts, list(extended.items())


def _stream(counts: DataFrame, n_rows: int, backwards: bool) -> DataFrame:
    """(lang, phrase, f, parts array<long>, extended): a pass over the phrases in prefix or in suffix order.

    ``parts`` are the counts of a phrase's beginnings (in this order) from one word on. A phrase may have
    several rows; f and parts are null in those that only tell of extensions.
    """
    key = F.split("phrase", " ")
    keyed = counts.select("lang", F.reverse(key).alias("key") if backwards else key.alias("key"), "f")
    dealt = staged(keyed.repartitionByRange(max(1, -(-n_rows // PART_ROWS)), "lang", "key").withColumn("part", F.spark_partition_id()), "stream")
    first = dealt.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("x")).select("part", "x.*")
    begun = first.select("part", "lang", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(MOST_WORDS - 1)), lambda k: F.when(k < F.size("key"), F.slice("key", 1, k))), lambda x: x.isNotNull())).alias("key"))
    # three rows a part at most
    halo = keyed.join(F.broadcast(begun), ["lang", "key"]).select("lang", "key", "f", "part", F.lit(False).alias("own"))
    both = dealt.withColumn("own", F.lit(True)).unionByName(halo)

    def walk(t: pa.Table) -> pa.Table:
        lang, keys, f = (t.column(c).to_pylist() for c in ("lang", "key", "f"))
        rows, parts, extended = _walk(lang, keys, f, t.column("own").to_pylist())
        turn = (lambda k: " ".join(reversed(k))) if backwards else " ".join
        return pa.table(
            {
                "lang": pa.array([*(lang[i] for i in rows), *(k[0] for k, _ in extended)], pa.string()),
                "phrase": pa.array([*(turn(keys[i]) for i in rows), *(turn(k[1]) for k, _ in extended)], pa.string()),
                "f": pa.array([*(f[i] for i in rows), *[None] * len(extended)], pa.int64()),
                "parts": pa.array([*parts, *[None] * len(extended)], pa.list_(pa.int64())),
                "extended": pa.array([*[None] * len(rows), *(n for _, n in extended)], pa.int64()),
            }
        )

    return both.groupBy("part").applyInArrow(walk, "lang string, phrase string, f long, parts array<long>, extended long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    Takes text and, where it exists, lang; other columns are ignored. A null text has no words, a null lang is
    ``und``; repeated rows count as often as they stand. Ties go by count, then by the phrase's bytes. Languages without a candidate,
    and empty tables, have no rows. Sums are 64 bits, products decimals of 38 digits.
    """
    short_batches(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    counts, totals = phrase_counts(docs.where("text is not null").select(lang.alias("lang"), F.col("text").cast("string").alias("text")), least)
    n_rows = counts.count()
    ahead = _stream(counts, n_rows, False).select("*", F.lit(None).cast("array<long>").alias("ends")).withColumnRenamed("parts", "begins")
    back = _stream(counts, n_rows, True).withColumnRenamed("parts", "ends").withColumn("begins", F.lit(None).cast("array<long>"))
    whole = ahead.unionByName(back).groupBy("lang", "phrase").agg(F.max("f").alias("a"), F.max("begins").alias("begins"), F.max("ends").alias("ends"), F.max("extended").alias("extended"))
    big = lambda c, by: F.col(c).cast("decimal(38,0)") * F.lit(by)
    free = whole.where("size(begins) > 0").where(F.col("extended").isNull() | (big("extended", 100) < big("a", EXTENDED)))
    # after k words: the first k, and the last size - k of size = size(begins) + 1
    cuts = free.select("lang", "phrase", "a", F.posexplode("begins").alias("k", "l"), "ends").withColumn("r", F.get("ends", F.size("ends") - 1 - F.col("k")))
    scored = cuts.withColumn("score", F.expr(f"(cast(a as decimal(38,0)) * {2 * SCALE}) div (cast(l as decimal(38,0)) + r)"))
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: collocations of all documents, by language."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS x FROM t)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, size, concat(lang, chr(1), phrase) AS id, string_split(phrase, ' ') AS w, CAST(count(*) AS BIGINT) AS f FROM (
    SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
e AS (SELECT id, max(f) AS longest FROM (
    SELECT f, concat(lang, chr(1), array_to_string(w[i:i + m - 1], ' ')) AS id
    FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < size AND i + m - 1 <= size) GROUP BY id),
x AS (SELECT lang, phrase, id, f AS a, k, concat(lang, chr(1), array_to_string(w[1:k], ' ')) AS l_id, concat(lang, chr(1), array_to_string(w[k + 1:size], ' ')) AS r_id
  FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
s AS (SELECT x.lang, x.phrase, a, l.f AS l, r.f AS r, k, CAST((2000000 * CAST(a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM x JOIN c l ON l.id = x.l_id JOIN c r ON r.id = x.r_id LEFT JOIN e ON e.id = x.id
  WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
