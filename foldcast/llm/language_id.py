"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the hashed 1- to 3-grams are gathered over all labelled training texts; the matrix
of log probabilities (languages x buckets) has a fixed number of buckets and is broadcast.
Texts are scored in batches: each n-gram adds the row of its bucket, texts are summed by
segment. All values of lang are learned. Where there are more than ``LANGUAGES``, the matrix comes in blocks of so many, each
gathered, broadcast and scored in a step of its own; a text carries its best language and the sum of all likelihoods from
step to step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import added, crc_mod, discard, short_batches, table

#: Hash buckets of n-grams, and those that go to one task together.
BUCKET_BITS, BLOCK = 15, 1 << 13
#: Languages of a block: at most 64 MB of log probabilities.
LANGUAGES = 512
#: Characters that are scored together.
CHUNK = 1 << 19
ALPHA = 0.5
_LETTER = regex.compile(r"\p{L}")
_BY_PLACE = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[bool]]]:
    """Texts between two line breaks, in lower case, about ``CHUNK`` characters together, the text each is of, and whether that goes on.

    A longer text comes in parts that overlap by two characters, so that each of its n-grams stands whole in one of them.
    """
    held, own, more, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = "\n" + t.lower() + "\n"
        last = max(len(t) - 2, 1)
        for at in range(0, last, CHUNK):
            held.append(t[at : at + CHUNK + 2])
            own.append(i)
            more.append(at + CHUNK < last)
            size += len(held[-1])
            if size >= CHUNK:
                yield held, own, more
                held, own, more, size = [], [], [], 0
    if held:
        yield held, own, more


def ngrams(texts: list[str], bits: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """By run of parts: the text of each, buckets (orders x characters; -1 where none starts), bounds.

    No n-gram crosses into another text. In the parts of a long text, what the next part begins with
    starts no n-gram here.
    """
    for parts, own, more in _parts(texts):
        ends = np.cumsum([len(t) for t in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.full((3, len(codes)), -1, np.int32)
        h = np.zeros(len(codes), np.uint32)
        for k, p in enumerate(_BY_PLACE):
            h = h[: len(codes) - k] + (codes[k:] + np.uint32(1)) * np.uint32(p)
            out[k, : len(h)] = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
            for j in range(1, k + 1):
                out[k, ends - j] = -1
        for end in ends[more]:
            out[:, end - 2 : end] = -1
        yield own, out, np.concatenate([[0], ends[:-1]])


def learn(labelled: DataFrame, bits: int = BUCKET_BITS, n_docs: float | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities (buckets x languages, the last row the priors, that before 0).

    ``labelled`` has text and lang, neither null. Counts are added on the executors in levels, by
    (language, block of buckets). Repeated rows count each time. ``n_docs``: the texts of all languages, if these are a block of them.
    """
    blocks = max(1, (1 << bits) // BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                x = total.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                x[-1] += len(texts)
                for _, grams, _ in ngrams(list(texts), bits):
                    x[:-1] += np.bincount(grams[grams >= 0], minlength=1 << bits)
        for lang, x in total.items():
            for k, part in enumerate([*x[:-1].reshape(blocks, -1), x[-1:]]):
                yield pa.RecordBatch.from_pydict({"lang": [lang], "block": pa.array([k], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "x": pa.array([part.tobytes()], pa.binary())})

    parts = labelled.select("text", "lang").mapInArrow(count, "lang string, block int, part long, x binary")
    sums = added(parts, np.int64, ("lang", "block"))
    found = sums.collect()
    discard(sums)
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return [], np.zeros(((1 << bits) + 1, 0), np.float32)
    counts = np.zeros((len(langs), blocks + 1), object)
    for r in found:
        counts[langs.index(r["lang"]), r["block"]] = np.frombuffer(r["x"], np.int64)
    grams = np.array([np.concatenate(list(x[:-1])) for x in counts], float) + ALPHA
    docs = np.array([x[-1][0] for x in counts], float)
    log = np.log(grams) - np.log(grams.sum(1, keepdims=True))
    prior = np.log(docs / (n_docs or docs.sum()))
    return langs, np.vstack([log.T, np.zeros(len(langs)), prior]).astype(np.float32)


def learn_all(labelled: DataFrame, bits: int = BUCKET_BITS) -> Iterator[tuple[list[str], np.ndarray]]:
    """:func:`learn` for all languages, a block at a time, in alphabetical order. The driver holds their names and one block."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    for at in range(0, len(names), LANGUAGES):
        own = labelled if len(names) <= LANGUAGES else labelled.where(F.col("lang").isin(names[at : at + LANGUAGES]))
        yield learn(own, bits, float(sum(counts.values())))


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """:func:`predict_all` with one block."""
    return predict_all(docs, [(langs, matrix)])


def predict_all(docs: DataFrame, blocks: Iterable[tuple[list[str], np.ndarray]]) -> DataFrame:
    """(…, lang_pred, score) by row for a table with ``text``; other columns pass through.

    Columns of ``docs`` named lang_pred, score or score_sum are replaced. Repeated rows are predicted one by one, texts
    of any length in parts. An empty table gives an empty result.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. The
    score is the posterior probability of the prediction; ties go to the first language in
    alphabetical order.
    """
    docs = docs.drop("lang_pred", "score", "score_sum")
    keep = [c for c in docs.columns if c != "text"]
    # the best log likelihood so far, and the log of the sum of all
    out = docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(float("-inf")), "score_sum": F.lit(float("-inf"))}).select(*keep, "text", "lang_pred", "score", "score_sum")
    for langs, matrix in blocks:
        if langs:
            out = out.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast((langs, matrix))), out.schema)
    score = F.when(F.col("lang_pred") == "und", F.lit(0.0)).when(F.col("score").isNull(), F.lit(0.0)).otherwise(F.least(F.exp(F.col("score") - F.col("score_sum")), F.lit(1.0)))
    return out.select(*keep, "lang_pred", score.alias("score"))


def _scorer(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step: scores the languages of one block beside what earlier blocks gave."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        names = np.array(names, object)
        bits = (len(m) - 2).bit_length() - 1
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, top, whole = batch.column("lang_pred").to_numpy(zero_copy_only=False).copy(), batch.column("score").to_numpy().copy(), batch.column("score_sum").to_numpy().copy()
            ok = np.array([i for i, t in enumerate(texts) if _LETTER.search(t)], np.int64)
            total = np.tile(m[-1].astype(np.float64), (len(ok), 1))
            for own, grams, starts in ngrams([texts[i] for i in ok], bits):
                np.add.at(total, own, sum(np.add.reduceat(m[g], starts, axis=0, dtype=np.float64) for g in np.where(grams < 0, len(m) - 2, grams)))
            if len(ok):
                most = total.max(1)
                whole[ok] = np.logaddexp(whole[ok], most + np.log(np.exp(total - most[:, None]).sum(1)))
                better = most > top[ok]
                best[ok[better]], top[ok[better]] = names[total.argmax(1)[better]], most[better]
            columns = {"lang_pred": pa.array(best, pa.string()), "score": pa.array(top), "score_sum": pa.array(whole)}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

    return score


def query(spark, sf_dir: str) -> DataFrame:
    """op3: languages of all documents; a fifth of them, by crc32 of the id, is held out."""
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), "lang").withColumn("r", crc_mod("doc_id", 5))
    blocks = learn_all(docs.where("r <> 0 and lang is not null and text is not null"))
    out = predict_all(docs.select("doc_id", (F.coalesce("r", F.lit(1)) == 0).alias("held_out"), "text"), blocks)
    return out.select("doc_id", "held_out", "lang_pred", "score")
