"""Per-text operators: round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldcast.llm import attention_lm, chat, language_id, lm_score, packing, quality, topk, warc
from foldcast.llm.common import table
from foldcast.llm.wordpieces import WordPieces

NASTY = ["</s>", "<\\/s>", "<\\\\/s>", "[INST] x [/INST]", "[\\/INST]", "", " ", "\n", "[", "<", "a</s", "[ROLE]q[/ROLE] ", "é\U0001f600", "[INST", "[[INST]]", "<s><s>", "\\"]


def test_chat_round_trip(spark):
    r = random.Random(1)
    rows = []
    for c in range(60):
        for k in range(r.randrange(1, 6)):
            rows.append((c, k, r.choice(["user", "assistant", "system", "[ROLE]", "</s>", "", "a\nb"]), "".join(r.choice(NASTY) for _ in range(r.randrange(4)))))
    rows += [(70, 0, None, None), (None, 0, "user", "x"), (71, 0, "user", "same"), (71, 0, "user", "same"), (72, None, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("v", F.lit("clash"))
    done = chat.render(chat.canonical_turns(chat.table_records(df))).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = {}
    for c, k, role, text in rows:
        want.setdefault(c, []).append((k if k is not None else -1, role or "", text or ""))
    for x in done.collect():
        own = [(a, b) for _, a, b in sorted(want[x["conv_id"]])]
        assert [tuple(t) for t in x["t"]] == own
        assert x["loss"] == "".join(b for a, b in own if a == "assistant")
    assert done.count() == len(want)
    assert chat.render(chat.canonical_turns(chat.table_records(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"prompt": "q", "response": "a"}'),
        (4, '{"prompt": "q", "completion": "a"}'),
        (5, '{"instruction": "q", "output": "a"}'),
        (6, '{"instruction": "q", "input": "i", "output": "a"}'),
        (7, '{"nothing": 1}'),
        (8, None),
        (9, '{"role": "user", "text": null}'),
        (10, '{"prompt": "q", "response": "a", "output": "z"}'),
        (11, '{"prompt": "q", "response": "a", "role": "z"}'),
        (12, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "prompt": "z"}'),
        (13, '{"messages": []}'),
        (14, "[1]"),
        (15, "null"),
    ]
    df = spark.createDataFrame(records, "conv_id long, j string").select("conv_id", F.lit(None).cast("long").alias("turn"), F.parse_json("j").alias("record"))
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    plain = [("user", "q"), ("assistant", "a")]
    assert got == {1: plain, 2: plain, 3: plain, 4: plain, 5: plain, 6: [("user", "q\ni"), ("assistant", "a")], 9: [("user", "")], 10: plain, 11: plain, 12: plain}
    lost = {r["conv_id"]: r["reason"] for r in chat.unmatched(df).collect()}
    assert lost == {7: "no known layout", 8: "null record", 13: "no known layout", 14: "no known layout", 15: "no known layout"}


def test_chat_main_path_is_native(spark, sf):
    plan = chat.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language(spark, sf):
    docs = table(spark, sf, "documents")
    langs, m = language_id.learn(docs.where("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").select("text", "lang"))
    odd = spark.createDataFrame([(None, "x"), ("", "x"), ("12 !?", "x"), ("the and that " * 40_000, "x")], "text string, lang_hint string")
    assert [r["lang_pred"] for r in language_id.predict(odd, langs, m).collect()] == ["und", "und", "und", "en"]
    got = language_id.predict(docs.select("text", F.col("lang").alias("true")), langs, m).collect()
    assert sum(r["true"] == r["lang_pred"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    none, empty = language_id.learn(docs.limit(0).select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(odd, none, empty).collect()} == {"und"}


def test_language_scores_don_t_depend_on_neighbours():
    a = [g.copy() for _, g, _ in language_id.ngrams(["ab cd"], 15)][0]
    b = [g.copy() for _, g, _ in language_id.ngrams(["zz", "ab cd"], 15)][0]
    assert (a == b[:, 4:]).all()


def test_language_equals_brute_force_in_parts(spark, monkeypatch):
    r = random.Random(7)
    say = lambda chars: "".join(r.choice(chars) for _ in range(r.choice((3, 40, 200))))
    rows = [(say("abc de"), "x") for _ in range(20)] + [(say("cdeé f"), "y") for _ in range(15)] + [("abc", "x")] * 3
    monkeypatch.setattr(language_id, "CHUNK", 50)
    langs, m = language_id.learn(spark.createDataFrame(rows, "text string, lang string"), 15)

    def bucket(g):
        h = 0
        for c, p in zip(g, language_id._BY_PLACE):
            h = (h + (ord(c) + 1) * p) % 2**32
        return ((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> 17

    grams = lambda t: [bucket(x[i : i + k]) for x in ["\n" + t.lower() + "\n"] for k in (1, 2, 3) for i in range(len(x) - k + 1)]
    count = {k: Counter() for k in "xy"}
    for t, k in rows:
        count[k].update(grams(t))
    n = Counter(k for _, k in rows)
    assert langs == ["x", "y"]
    asked = [say("abcdeé f") for _ in range(20)] + [say("ab") * 9]
    got = language_id.predict(spark.createDataFrame([(t, "s") for t in asked], "text string, score string"), langs, m).collect()
    for t, g in zip(asked, got):
        logs = {k: math.log(n[k] / len(rows)) + sum(math.log((count[k][b] + 0.5) / (sum(count[k].values()) + 0.5 * 2**15)) for b in grams(t)) for k in "xy"}
        best = max(logs, key=logs.get)
        assert g["lang_pred"] == best and g["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)
    assert language_id.predict(spark.createDataFrame([], "text string"), langs, m).count() == 0


def test_more_languages_than_a_block_holds(spark, monkeypatch):
    rows = [(f"{c}{c}{d} {d}{c} {c}{d}", f"l{c}{d}") for c in "abcdefg" for d in "xyz"] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    asked = spark.createDataFrame([*rows[:21], (None, None), ("12 3", None)], "text string, true string").withColumn("score_sum", F.lit("clash"))
    told = lambda: {r["text"]: (r["true"], r["lang_pred"], r["score"]) for r in language_id.predict_all(asked.withColumn("text", F.col("text")).select("true", "text", F.col("text").alias("t2"), "score_sum"), language_id.learn_all(df)).select("true", F.col("t2").alias("text"), "lang_pred", "score").collect()}
    whole = told()
    monkeypatch.setattr(language_id, "LANGUAGES", 4)
    parts = told()
    assert set(whole) == set(parts) and len(whole) == 23
    for t, (true, pred, score) in whole.items():
        assert parts[t][1] == pred and parts[t][2] == pytest.approx(score, abs=1e-9)
        assert pred == (true or "und")


def test_quality_weights_equal_a_fit_on_all_pairs():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    good, bad = rng.normal(0.3, 1, (60, d)), rng.normal(-0.3, 1.2, (50, d))
    made = quality.fit(good, bad)
    both = np.concatenate([good, bad])
    z = lambda x: ((x - both.mean(0)) / both.std(0)).clip(-8, 8)
    diff = (z(good)[:, None] - z(bad)[None]).reshape(-1, d)
    w = np.zeros(d)
    for _ in range(60):  # Newton's steps on all 3,000 pairs, the same penalty
        p = 1 / (1 + np.exp(diff @ w))
        w = w + np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(d), diff.T @ p / len(diff) - 1e-3 * w)
    assert np.abs(made.weights - w).max() < 0.03 * np.abs(w).max()
    assert np.corrcoef(both @ w, both @ made.weights)[0, 1] > 0.999
    assert (made.scores(good) > made.scores(bad).mean()).mean() > 0.9


def test_quality_learns_from_every_labelled_row(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0.3, 1, (30_000, len(quality.FEATURES))), rng.normal(-0.3, 1.2, (400, len(quality.FEATURES)))])
    q = np.repeat([1, 0], [30_000, 400])
    at = pa.table({"doc_id": np.arange(len(x)), "features": list(x)})
    rows, labels = spark.createDataFrame(at).repartition(3), spark.createDataFrame(pa.table({"doc_id": np.arange(len(x)), "quality": q}))
    made, want = quality.learn(rows, labels), quality.fit(x[q == 1], x[q == 0])
    assert np.allclose(made.mean, x.mean(0)) and np.allclose(made.scale, x.std(0))
    assert np.allclose(made.weights, want.weights, atol=1e-6) and made.cut == pytest.approx(want.cut, abs=1e-6)
    z = ((x - x.mean(0)) / x.std(0)).clip(-8, 8)
    u = z[q == 1] @ made.weights
    assert made.cut == pytest.approx(np.quantile(u, quality.GOOD_BELOW), abs=5e-3)
    g, b, w = z[q == 1], z[q == 0], made.weights
    p = 1 / (1 + np.exp((g @ w)[:, None] - (b @ w)[None]))  # at the weights the gradient over all 12 million pairs is nothing
    assert np.abs((g.T @ p.sum(1) - b.T @ p.sum(0)) / p.size - 1e-3 * w).max() < 1e-4


def test_quality(spark, sf):
    out = quality.query(spark, sf)
    labels = table(spark, sf, "labels")
    got = out.where("held_out").join(labels, "doc_id").collect()
    assert got and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    x = quality.features(pa.array([None, "", "  ", "a", "w " * 100_000]))
    assert np.isfinite(x).all()
    clash = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, None, 9)], "doc_id long, text string, score int")
    made = quality.featurize(clash)
    told = spark.createDataFrame([(1, 1), (1, None), (5, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(made, quality.learn(made, told)).collect()} == {quality.CUT_SCORE}
    assert quality.score(made.limit(0), quality.learn(made.limit(0), told.limit(0))).count() == 0
    blank = quality.fit(np.zeros((0, len(quality.FEATURES))), x)
    assert np.allclose(blank.scores(x), quality.CUT_SCORE)


def test_packing(spark, sf):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world"), (4, "word " * 9_000), (5, "<|endoftext|> Don't!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(9))
    assert packing.pack(packing.cut(docs).withColumn("offset", F.lit("clash"))).columns.count("offset") == 1
    check(packing.pack(packing.cut(docs)).collect(), rows)
    small = table(spark, sf, "documents").select("doc_id", "text")
    out = packing.pack(packing.cut(small)).collect()
    check(out, [tuple(r) for r in small.collect()])
    total, n = sum(r["length"] for r in out), len({r["sequence_id"] for r in out})
    assert n <= math.ceil(total / 4096) * 1.03 + 1
    assert packing.pack(packing.cut(small.limit(0))).count() == 0


def check(out, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096


def test_best_fit_takes_the_tightest_window():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 65, 500)
    w, o = packing.best_fit(lengths, 64)
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(64 - n)
    assert w.max() + 1 == len(room)


def test_word_ids_equal_the_tokenizer(sf, spark):
    p = WordPieces(packing.vocabulary())
    words = {w for r in table(spark, sf, "documents").select("text").collect() for w in r[0].split()} | {"don't", "ß.", "À,", "µ", "a1", "İ", "x|y", "", "éa"}
    known = p.learn(words)
    for w in words:
        assert known[w] == np.array(p.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w


def test_word_ids_are_remembered_once(monkeypatch):
    p = WordPieces(packing.vocabulary())
    want = lambda w: np.array(p.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    p.learn({"Zebra,", "\xc9tude!"})
    assert p.known == {"": b""} | {w: want(w) for w in ("Zebra,", "zebra", ",", "\xc9tude!", "\xe9tude", "!")}
    monkeypatch.setattr("foldcast.llm.wordpieces.HELD", 50)
    for k in range(20):
        words = {f"{a}{'abcdefghij'[k % 10]}q" for a in "abcdefg"} | {"Zebra,"}
        assert all(p.learn(words)[w] == want(w) for w in words) and len(p.known) <= 50 + 3


def test_top_k(spark):
    r = np.random.default_rng(0)
    v = r.normal(0, 0.2, (300, 24))
    v[50:90] = v[50]
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (920, [1.0, None]), (940, [float("nan")] * 24), (960, []), (980, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = topk.whole_vectors(df)
    ints = {i: np.floor(64 * np.array(e)).astype(int) for i, e in rows if e and None not in e and all(map(math.isfinite, e))}
    want = set()
    for q in ints:
        if q % 20 == 0:
            best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q and len(ints[i]) == len(ints[q]))[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(t) for t in topk.top_k(x, x.where("vec_id % 20 = 0"), 20).collect()} == want
    assert topk.top_k(x.limit(0), x.limit(0), 20).count() == 0
    twice = spark.createDataFrame([(20, [1, 0]), (20, [0, 1]), (1, [5, 7]), (2, [9, 1])], "vec_id long, v array<long>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(twice, twice.where("vec_id = 20"), 2).orderBy("rank").collect()] == [(1, 1, 7), (2, 2, 1)]


def test_top_k_beyond_exact_floats():
    x = np.array([[2**31, 1], [2**31, 3], [5, 5]])
    r, c, s = topk.block_top(x, np.array([0, 1, 2]), x, np.array([0, 1, 2]), 1)
    assert sorted(zip(r, c, s)) == [(0, 1, 2**62 + 3), (1, 0, 2**62 + 3), (2, 1, 5 * 2**31 + 15)]


def test_lm_base_and_probabilities(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [(1000, None), (1001, ""), (1002, "Zzz\x0bzzz"), (None, "a"), (1004, "same"), (1004, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))).withColumn("ids", F.lit("clash")).withColumn("row", F.lit(1))
    got = lm_score.score(df).collect()
    assert len(got) == len(rows)
    out = {r["doc_id"]: r for r in got}
    c = Counter()
    for i, t in rows:
        if i is None or i % 2 == 0:
            c.update((t or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        ws = (t or "").encode().lower().split() + [b""]
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    nothing = lm_score.score(df.limit(3).withColumn("held_out", F.lit(True))).collect()
    assert len(nothing) == 3 and {r["n_known"] for r in nothing} == {0}
    assert lm_score.score(df.limit(0)).count() == 0


def test_lm_rare_words_are_joined(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("held_out")).limit(40)
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm_score.score(docs).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 50)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm_score.score(docs).collect()} == want


def speller():
    return lm_score.Speller(packing.vocabulary("byte_bpe_multi_50k.tiktoken"))


def test_lm_tokens_tell_texts_apart():
    s = speller()
    ids = lambda t: b"".join(s.ids(ws) for ws in lm_score._words(t.encode()))
    texts = ["bar,", "bar ,", "a.b", "a . b", "É", "é", "a\u00a0b", "a b", "ab", "x" * 5_000, "x" * 5_001, "'s", "' s", "\U0001f600 \u2028y"]
    assert len({ids(t) for t in texts}) == len(texts)
    assert ids("A \t b") == ids("a\x0bB\r")
    for t in texts:
        assert b"".join(map(s.spell, t.encode().lower().split())) == ids(t)
    import base64

    with open(packing.vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        piece = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    for t in texts:
        assert b"".join(piece[i] for i in np.frombuffer(ids(t), "<u2").tolist()) == b"".join(b" " + w for w in t.encode().lower().split())


def test_lm_reads_long_texts_in_parts(monkeypatch):
    text = (" ".join("w%d" % (i % 97) for i in range(3_000)) + "\n").encode()
    whole = [w for ws in lm_score._words(text) for w in ws]
    monkeypatch.setattr(lm_score, "SLICE", 100)
    parts = list(lm_score._words(text))
    assert len(parts) > 50 and [w for ws in parts for w in ws] == whole


def tiny():
    r = np.random.default_rng(1)
    ranks = [r.integers(0, 300, n).astype(np.int32) for n in (1, 5, 32, 33, 64, 200, 700)]
    body = attention_lm.Attention.start()
    body.w = {k: (x + r.standard_normal(x.shape) * 0.2).astype(np.float32) for k, x in body.w.items()}
    x, before, _, weight = attention_lm.layout(ranks, 7)
    z = np.concatenate([body.body(x[lo : at + attention_lm.BATCH], own)["z"][at - lo :][weight[at : at + attention_lm.BATCH] > 0] for lo, at, own in attention_lm.windows(before)])
    return ranks, body, z, attention_lm.States.fit(body, z)


def test_lm_states_equal_a_direct_computation():
    ranks, body, z, states = tiny()
    w = {k: x.astype(np.float64) for k, x in body.w.items()}
    size, block, same, total = attention_lm.WIDTH, attention_lm.BLOCK, 0, 0
    metric = np.linalg.cholesky(w["out"] @ w["out"].T + 1e-6 * np.eye(size))
    y = z.astype(np.float64) @ metric
    coarse = attention_lm._means(y, attention_lm.COARSE, 5)
    fine = attention_lm._means(y - coarse[attention_lm._nearest(y, coarse)], attention_lm.FINE, 6)
    got = np.split(attention_lm.follow_all(states, ranks, 7), np.cumsum([len(t) for t in ranks])[:-1])
    for t, own in zip(ranks, got):
        said = [7, *t.tolist()[:-1]]
        for i in range(len(t)):
            h = w["emb"][said]
            keys = range(max(0, i // block * block - block), i + 1)
            a = np.array([h[i] @ w["wq"] @ (h[j] @ w["wk"]) * size**-0.5 + w["rel"][i - j] for j in keys])
            a = np.exp(a - a.max())
            v = (a / a.sum()) @ (h[list(keys)] @ w["wv"])
            p = (h[i] + v @ w["wo"]) @ metric
            k = int(((coarse - p) ** 2).sum(1).argmin())
            f = int(((fine - (p - coarse[k])) ** 2).sum(1).argmin())
            same, total = same + (own[i] == k * attention_lm.FINE + f), total + 1
    assert same >= total - 2  # two codes may be equally near to the last digit


def test_lm_parts_batches_and_neighbours_don_t_matter(monkeypatch):
    ranks, _, _, states = tiny()
    together = attention_lm.follow_all(states, ranks, 7)
    alone = np.concatenate([attention_lm.follow(states, t, 7) for t in ranks])
    parts = np.concatenate([attention_lm.follow(states, t, 7, 3 * attention_lm.BLOCK) for t in ranks])
    monkeypatch.setattr(attention_lm, "BATCH", 3)
    small = attention_lm.follow_all(states, ranks, 7)
    assert all((x != together).mean() < 0.003 for x in (alone, parts, small))


def test_lm_probabilities_sum_to_one():
    _, _, _, states = tiny()
    r = np.random.default_rng(3)
    counts = r.integers(0, 9, 50_257)
    v, wide = attention_lm.Vocabulary.of(counts), attention_lm.KNOWN + 1
    alone = np.bincount(v.rank, counts, wide) + 0.5
    own = r.integers(0, 3, (attention_lm.FINE, wide)) * (r.random((attention_lm.FINE, wide)) < 0.01)
    own[3] = 0
    for cells in (own, np.zeros_like(own)):
        table = attention_lm.output_layer(cells, alone / alone.sum(), states.told[: attention_lm.FINE])
        whole = 10.0 ** (table[:, v.rank] + v.inner)  # of every id, after each state
        assert np.allclose(whole.sum(1), 1, atol=1e-4)


def test_lm_output_counts_every_token(spark, monkeypatch):
    s = speller()
    texts = [" ".join("w%d x%d" % (i * k % 31, i % 7) for i in range(40 * k)) for k in range(1, 12)]
    ids = [np.append(np.frombuffer(b"".join(s.ids(ws) for ws in lm_score._words(t.encode())), "<u2"), np.uint16(s.end)) for t in texts]
    df = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(ids)], "row long, ids binary").repartition(3)
    counts = lm_score.token_counts(df, s.size)
    assert (counts == np.bincount(np.concatenate(ids), minlength=s.size)).all()
    v = attention_lm.Vocabulary.of(counts)
    states, wide = lm_score.train(df, v, s.end), attention_lm.KNOWN + 1
    coded = lm_score.with_states(df, states, v, s.end)
    layer = lm_score.output_table(coded, states, v, counts)
    alone = np.bincount(v.rank, counts, wide) + 0.5
    seen = np.zeros((attention_lm.COARSE * attention_lm.FINE, wide))
    told = {}
    for k, x in enumerate(ids):
        told[k] = attention_lm.follow(states, v.rank[x], int(v.rank[s.end]))
        np.add.at(seen, (told[k].astype(int), v.rank[x]), 1)
    want = np.concatenate([attention_lm.output_layer(seen[at : at + attention_lm.FINE], alone / alone.sum(), states.told[at : at + attention_lm.FINE]) for at in range(0, len(seen), attention_lm.FINE)])
    assert np.allclose(layer, want, atol=2e-2) and np.abs(layer - want).mean() < 1e-4
    for r in lm_score.judge(coded, layer, v).collect():
        x = ids[r["row"]]
        assert r["score"] == pytest.approx(float(sum(layer[a, v.rank[b]] + v.inner[b] for a, b in zip(told[r["row"]].tolist(), x.tolist()))), rel=1e-2)


def test_lm_runs_cover_each_token_once_with_its_context(monkeypatch):
    ranks, body, _, _ = tiny()
    ranks = ranks + [np.arange(3_000, dtype=np.int32) % 300]
    got, want, seen = [], Counter(), Counter()
    monkeypatch.setattr(attention_lm.Attention, "train", lambda self, x, before, target, weight, rate: got.append((x, before, target, weight)))
    runs = [r for t in ranks for r in lm_score.runs_of(t, 7)]
    assert lm_score.fit_runs(body, runs, np.arange(300), 0.1, 1) == sum(map(len, ranks))

    def tell(into, x, before, target, weight):
        for k in range(len(x)):
            if weight[k].any():
                into[x[k].tobytes(), target[k].tobytes(), weight[k].tobytes(), x[before[k]].tobytes() if before[k] >= 0 else b""] += 1

    tell(want, *attention_lm.layout(ranks, 7))
    for step in got:
        tell(seen, *step)
    assert seen == want
    long = np.random.default_rng(2).integers(0, 300, 400_000).astype("<u2")
    assert 0.04 < len(list(lm_score.runs_of(long, 7, lm_score.SHARE))) / len(list(lm_score.runs_of(long, 7))) < 0.09


def test_lm_learns_from_all_tokens(spark, monkeypatch):
    r = np.random.default_rng(8)
    end = 50_256
    ids = [np.append(r.integers(0, 40, n), end).astype("<u2") for n in (0, 1, 15, 16, 17, 90, 300, *r.integers(1, 60, 60))]
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in ids], "ids binary")
    v = attention_lm.Vocabulary.of(lm_score.token_counts(df, end + 1))
    want = np.zeros((attention_lm.KNOWN + 1, attention_lm.CLASSES), int)
    for x in ids:
        np.add.at(want, (v.rank[[end, *x[:-1]]], np.minimum(v.rank[x], attention_lm.CLASSES - 1)), 1)
    counts = lm_score.pair_counts(df, v, end)
    assert (counts == want).all()
    pairs = attention_lm.Pairs.fit(counts)
    query, (asked, had), side = pairs.queries(), pairs.wanted(), attention_lm.Moments.SIDE
    sums = np.zeros((attention_lm.QUERIES, side, side + attention_lm.WIDTH))
    for x in ids:
        said = v.rank[[end, *x[:-1]]]
        for i in range(len(x)):
            first = max(0, i // attention_lm.BLOCK * attention_lm.BLOCK - attention_lm.BLOCK)
            near = [[pairs.emb[said[i - d]] for d in range(lo, hi + 1) if i - d >= first] for lo, hi in attention_lm.RANGES]
            f = np.concatenate([np.mean(k, 0) if k else np.zeros(attention_lm.WIDTH) for k in near])
            sums[query[said[i]]] += np.outer(f, [*f, *(asked[min(v.rank[x[i]], attention_lm.CLASSES - 1)] - had[said[i]])])
    for held in (lm_score.HELD_TOKENS, 48):
        monkeypatch.setattr(lm_score, "HELD_TOKENS", held)
        m = attention_lm.Moments(pairs.emb, (asked, had), query)
        for batch in df.toArrow().to_batches():
            for part in lm_score.contexts(batch, v.rank, end):
                m.add(*part)
        assert m.n.sum() == sum(map(len, ids))
        assert np.allclose(m.sums, sums, rtol=1e-3, atol=1e-3 * np.abs(sums).max())


def test_lm_splits_words_at_ascii_space_alone(monkeypatch):
    texts = ["", None, " ", "\t\n a  B ", "Z\xc9z\x0bq\x1cr\xa0s t\u2028u", "x" * 300, ("y" * 70 + " ") * 9, "w " * 500, " " * 400, " " * 300 + "A b" + " " * 300, "a a", "end"]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    for size in (lm_score.SLICE, 1_000, 100, 3):
        monkeypatch.setattr(lm_score, "SLICE", size)
        for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
            got, over = [[] for _ in texts], Counter()
            for first, ends, n, index, told in lm_score.split_words(column):
                assert told.to_pylist() == lm_score._values(told) and len(set(told.to_pylist())) == len(told)
                for k, own in enumerate(np.split(index, np.cumsum(n)[:-1]), first):
                    got[k] += told.take(pa.array(own)).to_pylist()
                    over[k] += ends
            assert got == want and set(over.values()) == {1} and len(over) == len(texts)


def test_lm_looks_up_and_spells_each_different_word_once():
    looked, alone = Counter(), []

    class Seen(dict):
        def get(self, key):
            looked[key] += 1
            return super().get(key)

        def __getitem__(self, key):
            looked[key] += 1
            return super().__getitem__(key)

    s = speller()
    words = [b"w%d" % (i % 300) for i in range(3_000)] + ["odd\xa0word".encode(), b"x" * 400]
    want = b"".join(map(s.spell, words))
    plain = s.spell
    s.known, s.spell = Seen(), lambda w: alone.append(w) or plain(w)
    assert s.ids(words) == want
    assert max(looked.values()) == 1 and len(alone) <= 20  # two odd words don't slow the others down
    looked.clear()
    assert s.ids(words) == want and max(looked.values()) == 1


def test_lm_solved_states_equal_a_direct_computation():
    r = np.random.default_rng(12)
    ranks = [r.integers(0, 300, n).astype(np.int32) for n in (1, 5, 16, 17, 32, 33, 64, 200, 700)]
    counts = np.zeros((attention_lm.KNOWN + 1, attention_lm.CLASSES), int)
    for t in ranks:
        np.add.at(counts, (np.append(7, t[:-1]), np.minimum(t, attention_lm.CLASSES - 1)), 1)
    pairs = attention_lm.Pairs.fit(counts)
    query, block, ranges = pairs.queries(), attention_lm.BLOCK, attention_lm.RANGES
    m = attention_lm.Moments(pairs.emb, pairs.wanted(), query)
    m.add(*attention_lm.layout(ranks, 7))
    states = attention_lm.Placed.fit(pairs, query, m.flat())
    weigh = states.weigh.astype(float).reshape(2, block, attention_lm.QUERIES, len(ranges))
    v, own, books = states.v.astype(float), states.own.astype(float), states.books.astype(float)
    same = total = 0
    for t, got in zip(ranks, np.split(attention_lm.follow_all(states, ranks, 7), np.cumsum([len(t) for t in ranks])[:-1])):
        said = [7, *t.tolist()[:-1]]
        for i in range(len(t)):
            first, z, held = max(0, i // block * block - block), own[said[i]].copy(), 0
            for k, (lo, hi) in enumerate(ranges):
                near, w = [v[said[i - d]] for d in range(lo, hi + 1) if i - d >= first], weigh[int(i >= block), i % block, query[said[i]], k]
                z, held = z + w * sum(near), held + w * len(near)
            assert held < 1  # the sink has the rest
            p = z @ books - (books**2).sum(0) / 2
            coarse = int(p[: attention_lm.COARSE].argmax())
            fine = int((p[attention_lm.COARSE :] - books[:, coarse] @ books[:, attention_lm.COARSE :]).argmax())
            same, total = same + (got[i] == coarse * attention_lm.FINE + fine), total + 1
    assert same >= total - 2  # two codes may be equally near to the last digit


def test_lm_gradients():
    ranks, m, _, _ = tiny()
    x, before, target, weight = attention_lm.layout(ranks, 7)
    m.w = {k: a.astype(np.float64) for k, a in m.w.items()}
    copy = {k: a.copy() for k, a in m.w.items()}
    m.train(x, before, target, weight, 0.0)
    loss = lambda: attention_lm.Attention({k: a.copy() for k, a in copy.items()}).train(x, before, target, weight, 0.0)
    for name in copy:
        g = m.m[name] / 0.1
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        copy[name][k] += 1e-3
        up = loss()
        copy[name][k] -= 2e-3
        down = loss()
        copy[name][k] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(g[k]), rel=0.03, abs=2e-5), name


def test_lm_beats_the_base_on_held_out_texts_of_its_kind(spark):
    r = random.Random(2)
    parts = {k: ["%s%s" % (k, x) for x in ("ra", "no", "ti", "mel", "su")] for k in "bdkp"}
    say = lambda k: "".join(r.choice(parts[k]) for _ in range(r.choice((2, 3))))
    rows = [(i, " ".join(say("bdkp"[i % 4]) for _ in range(300)), i % 7 == 2) for i in range(280)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_revisits(spark):
    h = "map<string,string>"
    rows = [
        (1, "response", "http://A.com/x/", 10, 200, {"etag": '"a"', "content-length": "9", "age": "1"}),
        (2, "response", "http://a.com/x", 20, 200, {"etag": '"b"'}),
        (3, "response", "http://a.com/x", 25, 404, {"etag": '"c"'}),
        (10, "revisit", "https://a.com:443/x?utm_source=q#f", 15, 304, {"etag": 'W/"a"', "content-length": "0", "date": "d"}),
        (11, "revisit", "a.com/x", 20, 304, {"etag": '"a"'}),
        (12, "revisit", "a.com/x", 10**6, 304, {"etag": '"a"'}),
        (13, "revisit", "a.com/y", 30, 304, None),
        (14, "revisit", None, 30, 304, {}),
        (15, "revisit", "a.com/x", 30, 304, {"last-modified": "z"}),
        (10, "revisit", "a.com/x", 5, 304, {}),
        (16, "revisit", "a.com/x", 22, 304, {"etag": '"b"'}),
        (16, "revisit", "a.com/y", 22, 304, {"etag": '"b"'}),
        (16, "revisit", "a.com/x", 22, 304, {"etag": '"b"'}),
    ]
    df = spark.createDataFrame([(a, b, c, d, e, f, "clash") for a, b, c, d, e, f in rows], f"record_id long, kind string, url string, s long, status int, headers {h}, slice string").withColumn("at", F.timestamp_seconds("s"))
    got = sorted(((r["record_id"], r["source_id"], r["outcome"]) for r in warc.resolve(df).collect()), key=str)
    assert got == sorted([(10, 1, "resolved"), (11, 1, "resolved"), (12, 2, "changed"), (13, None, "unmatched"), (14, None, "unmatched"), (15, 2, "unverified"), (10, None, "unmatched"), (16, 2, "resolved"), (16, None, "unmatched"), (16, 2, "resolved")], key=str)
    merged = next(r["headers"] for r in warc.resolve(df).collect() if r["record_id"] == 10 and r["source_id"] == 1)
    assert merged == {"etag": 'W/"a"', "content-length": "9", "age": "1", "date": "d"}
    assert warc.resolve(df.limit(0)).count() == 0
    block = spark.range(1).select(warc.parse_headers(F.lit("HTTP/1.1 304\r\nETag: \"x\"\r\nA: 1\r\na:2 \r\n")).alias("m")).first()["m"]
    assert block == {"etag": '"x"', "a": "2"}


def test_digest_of_chat_query(spark, sf):
    r = chat.query(spark, sf).where("conv_id = -1").first()
    say = "</s>[INST] ok [/INST]"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(say.encode()).hexdigest() and r["loss_chars"] == len(say) and r["n_turns"] == 2
