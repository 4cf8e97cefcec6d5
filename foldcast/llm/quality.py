"""Quality classifier: Bradley-Terry pairwise ranking of text features.

A document's utility is linear in features of its whole text. Weights maximise the
likelihood that, of a good and a bad labelled document, the good one ranks higher
(logistic loss on the difference of their features). A quantile of the utilities of labelled
documents becomes the cut; scores are scaled so that the cut is at 0.7.

All labelled rows and all their pairs count: with two classes of n and m rows there are n * m pairs, but
what a pair weighs depends on its difference in utility alone. So each Newton step sums rows, their features
and products of features by class and bin of utility, in Spark, and the bins' pairs stand for the rows' pairs, with
what rows differ by inside a bin to first order. What is collected has a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.llm import textkit
from foldcast.llm.common import added, crc_mod, discard, short_batches, staged, table

#: Bins of utility in a Newton step, and bins in which the cut's quantiles are counted; steps at most, and the change that ends them.
BINS, CUT_BINS, STEPS, CLOSE = 512, 1 << 16, 40, 1e-4
#: The score at the cut.
CUT_SCORE = 0.7
#: The share of good documents that may fall below the cut where the classes overlap.
GOOD_BELOW = 0.005

FEATURES = ("log_words", "symbols", "capitals", "digits", "marks", "shouts", "bars", "non_ascii", "breaks", "same_as_last", "distinct_words", "word_chars", "plain_words", "distinct_pairs")

_KIND = np.zeros((8, 256), bool)
for _i, _chars in enumerate((b"#$%&*+/<=>@[\\]^_`{}~", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", bytes(range(128, 256)), b"\n")):
    _KIND[_i, list(_chars)] = True


def features(column: pa.Array) -> np.ndarray:
    """Features of a batch of texts, one row each; a text without words has zeros but for its bytes."""
    raw, bounds = textkit.text_bytes(column)
    out = np.zeros((len(column), len(FEATURES)))
    for at, to in textkit.chunks(bounds):
        part, own = raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        start, end = textkit.word_bounds(part, own)
        lower = textkit.LOWER[part]
        words = textkit.span_hash(textkit.prefix_hash(textkit.BYTE_CODES[lower]), start, end)
        ends = np.searchsorted(start, own)
        odd = np.concatenate([[0], np.cumsum(_KIND[[0, 2, 4, 5]].any(0)[part])])
        plain = np.concatenate([[0], np.cumsum(odd[end] == odd[start])])
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], words[1:] == words[:-1]]))]) if len(words) else np.zeros(1, int)
        for i in range(to - at):
            n_bytes, a, b = own[i + 1] - own[i], ends[i], ends[i + 1]
            if not n_bytes:
                continue
            hist = np.bincount(part[own[i] : own[i + 1]], minlength=256)
            row, n = out[at + i], b - a
            row[1:9] = _KIND @ hist / n_bytes
            if n:
                w = words[a:b]
                row[0] = np.log1p(n)
                row[9] = (same[b] - same[a + 1]) / n
                row[10] = len(np.unique(w)) / n
                row[11] = np.log1p((end[a:b] - start[a:b]).mean())
                row[12] = (plain[b] - plain[a]) / n
                row[13] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / n
    return out


def featurize(docs: DataFrame) -> DataFrame:
    """(…, features array<double>) for a table with ``text``; other columns pass through.

    A null or empty text has zeros. A column of ``docs`` named features is replaced. Repeated rows and null
    ids are rows like others. An empty table gives an empty result.
    """
    docs = docs.drop("features")
    keep = [c for c in docs.columns if c != "text"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], [*keep, "features"])

    return docs.mapInArrow(make, T.StructType([*docs.drop("text").schema, T.StructField("features", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: utility = (x - mean) / scale . weights; the cut and its slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.cut), -40, 40) - np.log(CUT_SCORE / (1 - CUT_SCORE))))


def _at(u: np.ndarray, reach: float, bins: int) -> np.ndarray:
    """The bin of utilities between -reach and reach."""
    return np.clip(((u + reach) * (bins / (2 * reach))).astype(np.int64), 0, bins - 1)


def _products(x: np.ndarray) -> np.ndarray:
    """Of each row 1, its features, and their products."""
    return np.hstack([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])


def _summed(at: np.ndarray, x: np.ndarray, bins: int) -> np.ndarray:
    """Sums of rows of ``x`` by bin."""
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    out = np.zeros((bins, x.shape[1]))
    if len(found):
        out[found] = np.add.reduceat(x[order], first)
    return out


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((x - mean) / scale).clip(-8, 8)


def _reach(w: np.ndarray) -> float:
    """No utility is beyond this."""
    return 8 * float(np.abs(w).sum()) + 1e-9


def _binned(z: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Standardised rows of classes ``q`` (0, 1), as sums by class and bin of utility; bins are narrow in the middle."""
    share = 0.5 + np.arctan(z @ w / (2 * np.linalg.norm(w) + 1e-9)) / np.pi
    return _summed(q * BINS + np.clip((share * BINS).astype(np.int64), 0, BINS - 1), _products(z), 2 * BINS)


def _newton(sums: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    """A Newton step on all pairs of :func:`_binned` rows."""
    d = len(w)
    b, g = (x for x in sums.reshape(2, BINS, -1))
    (nb, xb, qb), (ng, xg, qg) = ((s[:, 0], s[:, 1 : d + 1], s[:, d + 1 :]) for s in (b, g))
    ub, ug = (x @ w / np.maximum(n, 1) for n, x in ((nb, xb), (ng, xg)))
    pairs = ng.sum() * nb.sum()
    p = 1 / (1 + np.exp(np.clip(ug[:, None] - ub[None], -40, 40)))
    v = p * (1 - p)
    within = lambda x, q, u: q.reshape(-1, d, d) @ w - u[:, None] * x
    grad = xg.T @ (p @ nb) - xb.T @ (p.T @ ng) - within(xg, qg, ug).T @ (v @ nb) - within(xb, qb, ub).T @ (v.T @ ng)
    grad = grad / pairs - l2 * w
    cross = xg.T @ v @ xb
    hess = (((v @ nb) @ qg + (v.T @ ng) @ qb).reshape(d, d) - cross - cross.T) / pairs + l2 * np.eye(d)
    return np.linalg.solve(hess, grad)


def _quantile(counts: np.ndarray, share: float, reach: float) -> float:
    """The middle of the bin that holds a quantile of all counted utilities."""
    k = int(np.searchsorted(np.cumsum(counts), share * max(counts.sum() - 1, 0), side="right"))
    return (min(k, len(counts) - 1) + 0.5) * 2 * reach / len(counts) - reach


def _fitted(moments: np.ndarray, step: Callable[..., np.ndarray], tally: Callable[..., np.ndarray], l2: float) -> Ranking:
    """Fit on rows told by sums: moments (by class rows, features, squares), :func:`_binned` rows for weights, counts of utilities."""
    d = len(FEATURES)
    if not moments[0, 0] or not moments[1, 0]:
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    n, total, squares = moments[:, 0].sum(), moments[:, 1 : d + 1].sum(0), moments[:, d + 1 :].sum(0)
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1)
    w = np.zeros(d)
    for _ in range(STEPS):
        by = _newton(step(mean, scale, w), w, l2)
        w = w + by
        if np.abs(by).max() < CLOSE * max(np.abs(w).max(), 1):
            break
    bad, good = tally(mean, scale, w)
    reach = _reach(w)
    low, high = _quantile(good, GOOD_BELOW, reach), _quantile(bad, 1 - GOOD_BELOW, reach)
    cut = (low + high) / 2 if high < low else low
    return Ranking(mean, scale, w, float(cut), float(4 / max(_quantile(good, 0.5, reach) - cut, 1e-6)))


def _moments(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _summed(q, np.hstack([np.ones((len(x), 1)), x, x**2]), 2)


def _tally(x: np.ndarray, q: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Counts of rows by class and fine bin of utility."""
    at = q * CUT_BINS + _at(_standard(x, mean, scale) @ w, _reach(w), CUT_BINS)
    return np.bincount(at, minlength=2 * CUT_BINS).reshape(2, -1)


def fit(good: np.ndarray, bad: np.ndarray, l2: float = 1e-3) -> Ranking:
    """Fit on feature rows of good and bad documents, all held here; :func:`learn` fits a table.

    Without rows of either class nothing can be ranked: all documents get the cut's score.
    """
    x, q = np.concatenate([bad, good]), np.repeat([0, 1], [len(bad), len(good)])
    return _fitted(_moments(x, q), lambda mean, scale, w: _binned(_standard(x, mean, scale), q, w), lambda *told: _tally(x, q, *told), l2)


def learn(featured: DataFrame, labels: DataFrame, l2: float = 1e-3) -> Ranking:
    """Fit on all rows of ``featured`` (doc_id, features) that ``labels`` (doc_id, quality) marks 0 or 1.

    Labels without a document, null labels and other values are ignored; rows that repeat count once a
    distinct (id, label). Without labels of both classes all documents get the cut's score.
    """
    marks = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    marked = staged(featured.join(marks, "doc_id").select("features", "quality"), "marked")

    def sums(make: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sums of what ``make`` makes of batches of (features, class): one array a task, added in levels."""

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    own = make(batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)), batch.column("quality").to_numpy().astype(np.int64)).astype(float)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["key", "part", "x"])

        parts = added(marked.mapInArrow(tell, "key int, part long, x binary"), np.float64)
        rows = parts.collect()
        discard(parts)
        return np.frombuffer(rows[0]["x"]).reshape(shape) if rows else np.zeros(shape)

    d = len(FEATURES)
    made = _fitted(
        sums(_moments, (2, 1 + 2 * d)),
        lambda mean, scale, w: sums(lambda x, q: _binned(_standard(x, mean, scale), q, w), (2 * BINS, 1 + d + d * d)),
        lambda mean, scale, w: sums(lambda x, q: _tally(x, q, mean, scale, w), (2, CUT_BINS)),
        l2,
    )
    discard(marked)
    return made


def score(featured: DataFrame, ranking: Ranking) -> DataFrame:
    """(…, score double, predicted int) in place of ``features``; columns of those names are replaced."""
    featured = featured.drop("score", "predicted")
    keep = [c for c in featured.columns if c != "features"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = ranking.scores(batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= CUT_SCORE).astype(np.int32))], [*keep, "score", "predicted"])

    return featured.mapInArrow(make, featured.drop("features").schema.add("score", "double").add("predicted", "integer"))


def _training(spark, sf_dir: str, featured: DataFrame) -> Ranking:
    return learn(featured.where("not held_out").select("doc_id", "features"), table(spark, sf_dir, "labels").select("doc_id", "quality").where((crc_mod("doc_id", 4) != 2)))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: quality of all documents; those with crc32 of the id mod 4 = 2 are held out."""
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    featured = staged(featurize(docs), "features")
    return score(featured, _training(spark, sf_dir, featured)).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs`` whose text reaches the cut; all columns stay as they are."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(ranking.scores(features(batch.column("text"))) >= CUT_SCORE)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(good)], ["row"])

    return row.mapInArrow(judge, row.select("row").schema).select("row.*")
