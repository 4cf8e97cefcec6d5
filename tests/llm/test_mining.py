"""Hard negatives, collocations and robust outliers against brute force, with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.llm import collocations, hard_negatives, robust_quality

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("d", T.StringType())])


def _negatives(rows, anchors):
    """(anchor, positive, rank, negative, scores) by all pairs; rows (id, label, whole numbers)."""
    out = []
    for a, la, va in anchors:
        met = [(sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va)]
        met.sort(key=lambda m: (-m[0], m[1]))
        for p, pid, _ in [m for m in met if m[2] == la][:5]:
            fit = [m for m in met if m[2] != la and 50 * p <= 100 * m[0] <= 95 * p][:3]
            out += [(a, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_hard_negatives(spark, monkeypatch, clustered):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "PAGE", 3)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    monkeypatch.setattr(hard_negatives, "PAGES", 2)
    monkeypatch.setattr(hard_negatives, "GROUPS", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 10))
    x = (centres[rng.integers(6, size=400)] + 0.1 * rng.normal(size=(400, 10))) if clustered else rng.normal(size=(400, 10)) / 3
    rows = [(i, x[i].tolist(), int(rng.integers(4)), "clash", "clash") for i in range(400)]
    rows += [(400 + i, x[0].tolist(), i % 3, None, None) for i in range(60)]  # one vector many times
    rows += [(500, None, 1, None, None), (501, [1.0, None], 1, None, None), (502, [float("nan")] * 10, 1, None, None), (503, x[1].tolist(), None, None, None), (504, [0.5, 0.25], 1, None, None), (520, [0.5, 0.25], 1, None, None), (505, [], 2, None, None), (None, x[2].tolist(), 1, None, None), (540, [0.0] * 10, 2, None, None), (560, [1e3] * 10, 2, None, None)]
    df = hard_negatives.usable(spark.createDataFrame(rows, VECTORS))
    whole = [(i, lab, [int(np.floor(256 * c)) for c in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    got = hard_negatives.mine(df, df.where("vec_id % 20 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.collect()) == _negatives(whole, [r for r in whole if r[0] % 20 == 0])
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0


def test_hilbert_neighbours_and_bounds():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = hard_negatives.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()
    rng = np.random.default_rng(0)
    q, x = rng.integers(-50, 50, (9, 5)), rng.integers(-50, 50, (40, 5))
    bottom, top = hard_negatives.bounds(q, x.min(0)[None], x.max(0)[None])
    assert (bottom[:, 0] <= (q @ x.T).min(1)).all() and (top[:, 0] >= (q @ x.T).max(1)).all()


def _phrases(rows, least, top):
    """The contract of collocations, by counting every phrase."""
    by = {}
    for lang, text in rows:
        by.setdefault("und" if lang is None else lang, []).append(text or "")
    out = []
    for lang, texts in by.items():
        f, n = Counter(), 0
        for t in texts:
            t = t.translate({65 + i: 97 + i for i in range(26)})
            for piece in re.split(r"[.,;:!?\n-\r]", t):
                w = re.findall(r"[^ \t]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        candidates = {p for p, c in f.items() if c >= least and len(p) > 1}
        found = []
        for p in candidates:
            if any(len(q) > len(p) and 100 * f[q] >= 80 * f[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates):
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def test_collocations(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_ROWS", 9)
    monkeypatch.setattr(collocations, "WORDS", 500)
    r = random.Random(5)
    words = ["the", "The", "cat", "sat", "é\x01", "\U0001f600", "the\x01", "a"]
    piece = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))
    rows = [(r.choice(["en", "fr", None]), r.choice([". ", "\n", "?", ",\t "]).join(piece() for _ in range(r.randrange(6)))) for _ in range(300)]
    rows += [("en", "new york city hall"), ("en", "new york city hall.") ] * 20 + [("en", None), ("en", ""), (None, "  \t "), ("de", "one word"), ("xx", "w " * 40_000), ("", "a b " * 30)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumn("phrase", F.lit("clash")).withColumn("f", F.lit(1))
    for least, top in ((5, 12), (30, 2000)):
        got = sorted(tuple(x) for x in collocations.collocations(df, least, top).collect())
        assert got == _phrases(rows, least, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_filter_of_frequent_phrases_loses_none(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 7)  # so full that it lets nearly all through
    rows = [("en", "a b c d. e f g h i. j k l m n o. " * 6)] * 6
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(x) for x in collocations.collocations(df).collect()) == _phrases(rows, 30, 2000)


def _statistics(text):
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    g = list(zip(w, w[1:], w[2:]))
    n = Counter(g)
    covered = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_texts(spark):
    r = random.Random(2)
    bits = ["a", "b", "é\U0001f600", "#", "|x|", "\n", "\n\n", "\t", " ", "\r\n", "\x0b", " ", "a b c", "\x01"]
    texts = [None, "", " ", "\n", "a a a a", "a b c a b c", "x\nx\nx\n\n \n", "a b\ra b\ra b"] + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(80))) for _ in range(150)] + ["w v u t " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "n n n")], "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("places", F.lit(2))
    got = {x["doc_id"]: x for x in robust_quality.statistics(df).collect()}
    for i, t in enumerate(texts):
        want = _statistics(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, repr(t[:80] if t else t)
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def _least_determinant(x, starts=200, seed=0):
    """The determinant (least deviations added) that random starts find for half of the rows."""
    rng, best, h = np.random.default_rng(seed), np.inf, -(-len(x) // 2)
    floor = np.diag(np.square(list(robust_quality.LEAST.values())))
    factor = robust_quality.consistency(0.5, 4)
    for _ in range(starts):
        own = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(15):
            m, s = own.mean(0), np.cov(own.T, bias=True) * factor + floor
            z = np.linalg.solve(np.linalg.cholesky(s), (x - m).T)
            own = x[np.argsort((z**2).sum(0), kind="stable")[:h]]
        best = min(best, np.linalg.det(np.cov(own.T, bias=True) * factor + floor))
    return best


def test_robust_estimates_against_random_starts(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4, 4)) * 0.2
    clean = rng.normal(size=(700, 4)) @ a + [1.6, 1.0, 1.5, 1.2]
    bad = rng.normal(size=(250, 4)) * 0.1 + [3.5, 2.5, 0.5, 2.5]
    x = np.round(np.concatenate([clean, bad]) * 1024)
    rows = spark.createDataFrame([("=en", "=s", *map(int, r)) for r in x], "g_lang string, g_source string, " + ", ".join(f"{c} long" for c in robust_quality.X)).repartition(5)
    now = robust_quality._starts(rows)
    for _ in range(robust_quality.STEPS):
        now = robust_quality.staged(robust_quality._concentrate(rows, now), "step")
    got = np.exp(min(r["log_det"] for r in now.collect()))
    assert got <= 1.15 * _least_determinant(x / 1024)
    model = robust_quality.fit(rows).first()
    low = np.zeros((4, 4))
    for j, b in enumerate(robust_quality.X):
        for i, c in enumerate(robust_quality.X[j:], j):
            low[i, j] = model[f"l_{c}_{b}"]
    centre = np.array([model[f"m_{c}"] for c in robust_quality.X])
    floor = np.diag(np.square(list(robust_quality.LEAST.values())))
    want = a.T @ a + floor
    assert np.abs(centre - [1.6, 1.0, 1.5, 1.2]).max() < 0.05 and np.abs(low @ low.T - want).max() < 0.25 * np.abs(want).max()
    d2 = (np.linalg.solve(low, (x / 1024 - centre).T) ** 2).sum(0)
    cut = robust_quality.chi2_quantile(robust_quality.REJECT, 4)
    assert (d2[:700] <= cut).all() and (d2[700:] > cut).all()
    assert abs(robust_quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    clean = lambda: " ".join(word() for _ in range(r.randrange(60, 400)))
    rows = [(i, clean(), "en", "hot" if i % 2 else f"s{i % 7}") for i in range(500)]
    rows += [(1000 + i, " ".join(word() + "#$%"[i % 3] for _ in range(80)), "en", "hot") for i in range(60)]
    rows += [(2000, None, "en", None), (2001, "", None, "hot"), (2002, "short", None, None), (2003, clean(), None, None), (None, clean(), "en", "hot"), (7, clean(), "en", "hot"), (2004, "same words again " * 50, "en", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("distance", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(6)
    got = robust_quality.judge(df).collect()
    assert len(got) == len(rows)
    kept = {x["doc_id"] for x in got if x["kept"]}
    assert {i for i in range(500)} <= kept and None in kept and 2003 in kept
    assert not kept & {*range(1000, 1060), 2000, 2001, 2002, 2004}
    assert sum(x["doc_id"] == 7 for x in got) == 2
    # another partitioning, the same verdicts and distances
    again = robust_quality.judge(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert robust_quality.judge(df.limit(0)).count() == 0
    assert robust_quality.judge(df.where("doc_id = 3")).first()["kept"]
