"""Joins on pairs against brute force."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldcast.llm import decontaminate, graph, jaccard_join, line_dedup, textkit


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(n, links):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def corpus(seed, n=140):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice((2, 3, 5, 8, 11, 14, 21, 25, 33, 60, 150)))] for _ in range(18)]
    common = " ".join(r.choice(vocab) for _ in range(30))
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            k = r.randrange(len(w) + 1)
            w[k : k + r.choice((0, 1))] = [r.choice(vocab)]
        text = " ".join(w).replace("w1 ", "W1\t")
        out.append((i, text + (" " + common if r.random() < 0.3 else "")))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One"), (n + 4, "one"), (n + 5, "x " * 60_000)]


@pytest.mark.parametrize("size,percent,seed", [(3, 90, 1), (3, 90, 2), (5, 80, 3)])
def test_components_equal_brute_force(spark, size, percent, seed):
    docs = corpus(seed)
    sets = {i: sets_of(t, size) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard_join.link(df, size, percent).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in sets}


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    words = ["v%d" % i for i in range(150)]
    docs = []
    for i in range(120):
        w = list(words)
        for _ in range(r.choice((0, 1, 2, 4))):
            w[r.randrange(150)] = "z%d" % r.randrange(9)
        docs.append((i, " ".join(w)))
    sets = {i: sets_of(t, 3) for i, t in docs}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()}
    assert got == want


def test_long_lists_of_other_components_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST_PART", 7)
    r = random.Random(3)
    lists = [(k, i, r.random() < 0.6) for k in range(3) for i in r.sample(range(90), 60)]
    near = lambda a, b: (a * 7 + b * 7) % 11 == 3 and abs(a - b) < 30
    seen = []

    def judge(pairs):
        rows = [tuple(x) for x in pairs.collect()]
        seen.extend(rows)
        return spark.createDataFrame([(a, b, near(a, b)) for a, b in rows], "a long, b long, linked boolean")

    got = {x["node"]: x["component"] for x in graph.link_lists(spark.createDataFrame(lists, "key long, id long, indexed boolean"), lambda x, y: F.lit(True), judge).collect()}
    by = {}
    for k, i, x in lists:
        by.setdefault(k, []).append((i, x))
    links = {(a, b) for m in by.values() for a, x in m for b, y in m if a < b and (x or y) and near(a, b)}
    want = components(range(90), links)
    assert got == {i: want[i] for i in {i for e in links for i in e}} and len(seen) == len(set(seen))


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (None, None)]
    out = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert len(out) == 5 and {r["component_id"] for r in out if r["doc_id"]} == {1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.link(empty, 3, 90).count() == 0
    kept = jaccard_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 1]


def test_light_boundary_depends_on_sizes():
    import numpy as np

    small = np.zeros(30)
    small[12] = 1000
    assert jaccard_join.light_boundary(small, 90) >= 12
    large = np.zeros(30)
    large[29] = 1000
    assert jaccard_join.light_boundary(large, 90) < 29


def test_word_hashes_split_on_ascii_space_only():
    import pyarrow as pa

    (_, h, ends), = textkit.word_hashes(pa.array(["A\x0bb\u00a0c a", None, "", "b\u00a0C"]))
    assert list(ends) == [0, 3, 3, 3, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_graph(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, None)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_banded_distance():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 14)))
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(["", "a", "b"])
        b = "".join(b)
        for t in (0, 1, 2, 3):
            assert line_dedup.within(a, b, t) == (distance(a, b) <= t), (a, b, t)


def test_line_classes_equal_brute_force(spark):
    r = random.Random(9)
    seeds = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((20, 22, 30, 47)))) for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(r.randrange(1, 6)):
            s = list(r.choice(seeds))
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                k = r.randrange(len(s) + 1)
                s[k : k + r.randrange(2)] = r.choice(["", "x", "é"])
            lines.append("".join(s))
        docs.append((i, "\n".join([*lines, "", r.choice(["short", "Short", "%d" % i])])))
    where, first = {}, {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if len(x) >= 20:
                where.setdefault(x, (i, k))
            first.setdefault(x, (i, k))
    names = sorted(where)
    comp = components(range(len(names)), [(a, b) for a in range(len(names)) for b in range(a) if distance(names[a], names[b]) <= 2])
    head = {}
    for k, x in enumerate(names):
        head[comp[k]] = min(head.get(comp[k], (99, 99)), where[x])
    want = {}
    for i, t in docs:
        keep = [x for k, x in enumerate(t.split("\n")) if not x or (first[x] if len(x) < 20 else head[comp[names.index(x)]]) == (i, k)]
        want[i] = "\n".join(keep)
    df = spark.createDataFrame([(*d, "c") for d in docs] + [(None, "short\n" * 3, "c"), (77, None, "c"), (78, "", "c")], "doc_id long, text string, lines string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.clean(df.withColumnRenamed("lines", "n").withColumn("n_lines", F.lit("clash"))).collect()}
    assert got == {**want, None: "short\n" * 3, 77: None, 78: ""}
    assert line_dedup.clean(df.limit(0).drop("lines")).count() == 0


def test_leaks(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(r.choice((6, 20, 40))))) for k in range(12)] + [(50, "two words"), (51, None), (None, "a b c d e f")]
    docs, want = [], set()
    for i in range(60):
        pre, post = (" ".join(word() for _ in range(r.randrange(0, 30))) for _ in range(2))
        k = r.randrange(12)
        w = items[k][1].split()
        if i % 3 == 0:
            want.add((i, k))
        elif i % 3 == 1:
            w = [x if j % 4 else word() for j, x in enumerate(w)]
        else:
            w = []
        docs.append((i, f"{pre} {' '.join(w).upper()}\t{post}", 1))
    docs += [(90, None, 1), (91, "", 1), (None, items[0][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["similarity"] >= 0.8 for r in got)
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == {x[0] for x in docs} - {i for i, _ in want}
    assert decontaminate.matches(d.limit(0), b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0


def test_leaks_just_above_the_bound(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(k, [word() for _ in range(49 + k % 9)]) for k in range(600)]
    docs = [(k, " ".join([word(), *w[:20], word(), *w[21:], word()])) for k, w in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(d, b).collect()}
    assert got == {(k, k) for k, _ in items}


def test_leaks_in_another_order_equal_all_windows(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = {k: [word() for _ in range(r.choice((12, 25, 50, 51)))] for k in range(8)}
    items[8] = [word() for _ in range(50)]
    docs = {0: [word() for _ in range(7)] + items[8][25:] + items[8][:25] + [word()], 1: items[8][25:] + items[8][:25]}
    for i in range(2, 60):
        w = list(items[r.randrange(9)])
        at = r.randrange(len(w))
        if r.random() < 0.6:
            w = w[at:] + w[:at]
        if r.random() < 0.4:
            w[r.randrange(len(w))] = word()
        docs[i] = [word() for _ in range(r.choice((0, 3)))] + w[: r.choice((60, 60, len(w) - 2))] + [word() for _ in range(r.choice((0, 0, 9)))]
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for i, w in docs.items():
        for k, x in items.items():
            b = runs(x)
            for s in range(max(len(w) - len(x), 0) + 1):
                a = runs(w[s : s + len(x)])
                if 5 * (a & b).total() >= 4 * (a | b).total():
                    want.add((i, k))
    assert {(0, 8), (1, 8)} <= want
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(d, b).collect()} == want


def test_weighted_similarity_of_repeated_shingles(spark):
    r = random.Random(3)
    rows = [([r.randrange(6) for _ in range(r.randrange(1, 14))], [r.randrange(6) for _ in range(r.randrange(1, 14))]) for _ in range(200)] + [([1] * 40, [1] * 30), ([], [1]), ([1, 2], [3])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = df.select("a", "b", decontaminate.similarity(F.col("a"), F.col("b"), decontaminate.repeated(F.col("a")), decontaminate.repeated(F.col("b"))).alias("s")).collect()
    for a, b, s in got:
        x, y = Counter(a), Counter(b)
        assert s == (x & y).total() / (x | y).total()


def test_a_long_item_of_one_word_is_quick(spark):
    import time

    items = spark.createDataFrame([(1, "spam " * 1500), (2, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(k, "spam " * 4000 + "x " * k) for k in range(4)] + [(9, "q " * 3000), (10, "z a b c d e f g z")], "doc_id long, text string")
    decontaminate.matches(docs.limit(1), items).count()  # compiled
    began = time.time()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (10, 2)} and time.time() - began < 40


def test_crc(spark):
    from foldcast.llm.common import crc_mod

    got = [r[0] for r in spark.range(5).select(crc_mod("id", 7)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 7 for i in range(5)]
