"""Quality rules: robust multivariate outliers of text statistics, on DataFrame functions alone.

Simple rules come first (too few words, too much repetition). What passes is judged by four statistics, transformed so
that typical texts lie near a common centre: the log of the mean word length, and square roots of the
shares of symbols, of repeated lines and of words in repeated windows. Each language and source has its own
centre and covariance, those of the half of its rows whose covariance determinant is least (minimum covariance
determinant); a text is rejected if its Mahalanobis distance from there passes a high chi-square quantile.

The subset is found by concentration steps from two starts, the medians with robust deviations and the
plain moments: measure all rows by the present estimate, keep the nearer half, estimate again. A step is one pass:
rows are added up by (group, start, distance bin) with their moments, and the bins that hold the nearer half give the next
estimate. So a group of any size is partial sums, never rows in one place. Statistics are whole 1/1024ths
and their sums whole numbers, so estimates don't depend on how the table is partitioned. After the steps the
estimate is reweighted once: moments of the rows within the 0.975 quantile.

Most texts have no symbols and repeat nothing, so a covariance may be singular. Each statistic therefore has a least
deviation (``LEAST``), whose square is added to its variance.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.llm.common import bounded, staged, table

#: The rules before: fewest words, most percent of words in repeated windows.
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Statistics and the least deviation of each.
LEAST = {"x_length": 0.1, "x_symbols": 0.1, "x_lines": 0.1, "x_repeats": 0.15}
X = tuple(LEAST)
UNIT = 1024
#: Rows of a group that has an estimate of its own; smaller ones share one by language, then one of all.
GROUP_ROWS = 100
#: The share of rows in the subset, concentration steps, bins of squared distance an octave.
HALF, STEPS, BINS = 0.5, 6, 8
#: Quantiles of the chi-square distribution: of reweighting and of rejection.
REWEIGHT, REJECT = 0.975, 0.9999
#: Groups whose estimates may be broadcast.
BROADCAST_GROUPS = 50_000
KEYS = ["g_lang", "g_source"]


def chi2_cdf(x: float, d: int) -> float:
    """Of an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return hi


def consistency(p: float, d: int) -> float:
    """What the covariance of the nearest share ``p`` of normal rows is multiplied by."""
    return p / chi2_cdf(chi2_quantile(p, d), d + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts.

    Takes doc_id and text, and lang and source where they exist; other columns are ignored. A null text
    has no words. A row is a text of its own, whatever its doc_id. Windows are compared by a 64-bit hash of three words.
    """
    of = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    plain = docs.select("doc_id", of("lang"), of("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    flat = F.col("text")
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    less = lambda x, chars: sum((F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit(""))) for c in chars), F.lit(0))
    one = plain.select("doc_id", "lang", "source", "text", flat.alias("flat"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = one.select("doc_id", "lang", "source", F.array_remove(F.split("flat", " "), "").alias("w"), F.char_length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"), less(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), F.when(F.contains("text", F.lit("\n")), lines).alias("lines"))
    h = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>"))
    two = one.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"), h.alias("h"))
    # (hash, place) in order: equal neighbours stand at repeated places
    by_hash = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("h")) < F.size("h")
    three = two.withColumn("s", F.when(some, by_hash)).drop("h")
    pairs = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.when(F.col("s").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    four = three.withColumn("places", places).drop("s")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("places", start, lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + 3 - F.greatest(acc["end"] - p, F.lit(0))).cast("long").alias("n")))["n"]
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")
    return five.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))


def _vectors(stats: DataFrame) -> DataFrame:
    """Transformed statistics as whole 1/1024ths; null where the rules before failed."""
    n = F.nullif(F.col("n_words"), F.lit(0).cast("long"))
    share = lambda c: F.sqrt(F.least(F.col(c) / n, F.lit(1.0)))
    values = {"x_length": F.ln(F.col("word_chars") / n), "x_symbols": share("n_symbols"), "x_lines": share("n_dup_lines"), "x_repeats": share("n_repeat_words")}
    return stats.withColumns({k: F.when(~F.col("base_failed"), F.round(v * UNIT).cast("long")) for k, v in values.items()})


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds the group of each row: its language and source, or what stands in for a small one.

    A null language or source is a group like any other. Small groups of a language are one group together, and
    small ones of these again.
    """
    own = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")).alias(g) for c, g in zip(("lang", "source"), KEYS)]
    sizes = staged(rows.where("not base_failed").select(*own).groupBy(*KEYS).count(), "groups")
    rest = sizes.where(F.col("count") < GROUP_ROWS)
    whole = rest.groupBy("g_lang").agg(F.sum("count").alias("n")).where(F.col("n") >= GROUP_ROWS).select("g_lang", F.lit(True).alias("by_lang"))
    place = sizes.join(whole, "g_lang", "left").select(*(F.col(k).alias(f"own_{k}") for k in KEYS), F.when((F.col("count") >= GROUP_ROWS) | F.col("by_lang"), F.col("g_lang")).otherwise("rest").alias("g_lang"), F.when(F.col("count") >= GROUP_ROWS, F.col("g_source")).otherwise("rest").alias("g_source"))
    keyed = rows.withColumns({f"own_{k}": c for k, c in zip(KEYS, own)})
    return keyed.join(bounded(staged(place, "places"), BROADCAST_GROUPS), [f"own_{k}" for k in KEYS], "left").drop(*(f"own_{k}" for k in KEYS))


def _products(x: dict[str, Column]) -> dict[str, Column]:
    """The moments of a row by name: each value, each product of two."""
    return x | {f"{a}*{b}": x[a] * x[b] for i, a in enumerate(X) for b in X[i:]}


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Centre, lower factor of the covariance and its log determinant from sums of moments and ``n``.

    All in units of 1; ``factor`` multiplies the covariance before the least deviations are added.
    """
    mean = {a: F.col(a) / F.col("n") for a in X}
    out = sums.select(*KEYS, "start", "n", *((mean[a] / UNIT).cast("double").alias(f"m_{a}") for a in X), *((F.col(f"`{a}*{b}`") / F.col("n")).cast("double").alias(f"p_{a}_{b}") for i, a in enumerate(X) for b in X[i:]))
    for j, b in enumerate(X):
        for i, a in enumerate(X[j:], j):
            v = (F.col(f"p_{b}_{a}") / UNIT**2 - F.col(f"m_{a}") * F.col(f"m_{b}")) * factor + (LEAST[a] ** 2 if a == b else 0)
            for c in X[:j]:
                v = v - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            # rounding can leave a little less than the least deviation, never less than half of it
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(v, F.lit(LEAST[a] ** 2 / 2))) if i == j else v / F.col(f"l_{b}_{b}"))
    det = sum((F.ln(F.col(f"l_{a}_{a}")) * 2 for a in X), F.lit(0.0))
    return out.select(*KEYS, "start", "n", *(f"m_{a}" for a in X), *(f"l_{a}_{b}" for j, b in enumerate(X) for a in X[j:]), det.alias("log_det"))


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """Adds the squared Mahalanobis distance by the estimate that stands in each row."""
    for i, a in enumerate(X):
        v = F.col(a) / UNIT - F.col(f"m_{a}")
        for c in X[:i]:
            v = v - F.col(f"l_{a}_{c}") * F.col(f"y_{c}")
        rows = rows.withColumn(f"y_{a}", v / F.col(f"l_{a}_{a}"))
    return rows.withColumn(name, sum((F.col(f"y_{a}") ** 2 for a in X), F.lit(0.0))).drop(*(f"y_{a}" for a in X))


def _near(estimates: DataFrame) -> DataFrame:
    return bounded(staged(estimates, "estimates"), BROADCAST_GROUPS)


def _add_up(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*KEYS, *keys).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in _products({a: F.col(a) for a in X}).items()))


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates a group: of medians and median deviations, and of the moments.

    Medians are taken from exact counts by value, in bins of 8 units.
    """
    names = F.array(*(F.struct(F.lit(a).alias("x"), F.floor(F.col(a) / 8).alias("bin")) for a in X))
    counts = staged(rows.select(*KEYS, F.inline(names)).groupBy(*KEYS, "x", "bin").count(), "values")

    def median(counts: DataFrame, value: str) -> DataFrame:
        w = Window.partitionBy(*KEYS, "x").orderBy(value)
        upto = counts.groupBy(*KEYS, "x", value).agg(F.sum("count").alias("count")).withColumn("upto", F.sum("count").over(w)).withColumn("all", F.sum("count").over(Window.partitionBy(*KEYS, "x")))
        return upto.where(F.col("upto") * 2 >= F.col("all")).groupBy(*KEYS, "x").agg(F.min(value).alias("mid"), F.max("all").alias("all"))

    mid = median(counts, "bin").select(*KEYS, "x", F.col("mid").alias("centre"))
    away = median(counts.join(mid, [*KEYS, "x"]).withColumn("away", F.abs(F.col("bin") - F.col("centre"))), "away").join(mid, [*KEYS, "x"])
    side = {a: F.max(F.when(F.col("x") == a, F.struct("centre", "mid"))) for a in X}
    robust = away.groupBy(*KEYS).agg(F.max("all").alias("n"), *(side[a].alias(a) for a in X))
    sd = {a: F.sqrt((F.col(f"{a}.mid") * 8 / UNIT * 1.4826) ** 2 + LEAST[a] ** 2) for a in X}
    robust = robust.select(*KEYS, F.lit(0).alias("start"), "n", *(((F.col(f"{a}.centre") * 8 + 4) / UNIT).alias(f"m_{a}") for a in X), *((sd[a] if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for j, b in enumerate(X) for a in X[j:]), sum((F.ln(sd[a]) * 2 for a in X), F.lit(0.0)).alias("log_det"))
    moments = _estimate(_add_up(rows.withColumn("start", F.lit(1)), "start"), 1.0)
    return robust.unionByName(moments)


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of all groups and starts."""
    met = _distance(rows.join(_near(estimates.drop("n", "log_det")), KEYS), "d2")
    bin_ = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**-20))) * BINS)
    added = _add_up(met.withColumn("bin", bin_), "start", "bin")
    upto = Window.partitionBy(*KEYS, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    marked = added.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*KEYS, "start")))
    inner = marked.where(F.col("before") < F.ceil(F.col("all") * HALF))
    sums = inner.groupBy(*KEYS, "start").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"`{k}`").cast("decimal(30,0)")).cast("double").alias(k) for k in _products({a: F.col(a) for a in X})))
    return _estimate(sums, consistency(HALF, len(X)))


def fit(rows: DataFrame) -> DataFrame:
    """The reweighted estimate of each group (g_lang, g_source) of rows with statistics.

    Of the two starts the one with the smaller determinant counts; ties go to the medians.
    """
    now = _starts(rows)
    for _ in range(STEPS):
        now = staged(_concentrate(rows, now), "step")
    best = now.groupBy(*KEYS).agg(F.min_by(F.struct(*(c for c in now.columns if c not in KEYS)), F.struct("log_det", "start")).alias("x")).select(*KEYS, "x.*")
    inner = _distance(rows.join(_near(best.drop("n", "log_det")), KEYS), "d2").where(F.col("d2") <= chi2_quantile(REWEIGHT, len(X)))
    return _estimate(_add_up(inner, "start"), consistency(REWEIGHT, len(X)))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept of every row of ``docs``; see :func:`statistics` for its columns.

    Adds ``distance``, the squared distance that was judged (null where the rules before failed). A text that fails the
    rules isn't kept and has no part in the estimates. Repeated rows count once each; ties at the bound stay. A group
    of few rows shares an estimate with others; where the whole table has few, they are one
    group, and the least deviations alone keep a single row. An empty table gives an empty result.
    """
    rows = staged(_grouped(staged(_vectors(statistics(docs)), "statistics")), "grouped")
    model = fit(rows.where("not base_failed").select(*KEYS, *X))
    met = _distance(rows.join(_near(model.drop("n", "log_det", "start")), KEYS, "left"), "distance")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(REJECT, len(X)))
    return met.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the rules and the outliers of all documents."""
    done = judge(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
