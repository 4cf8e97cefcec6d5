"""The registered queries: each applies operators to the given tables. ``ORACLES`` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast import schema as C
from foldcast.functions import table_diff
from foldcast.operators import features, folds, forecast, metrics, moments, quality, regime_metrics, regimes, reports, sequences, train
from foldcast.plans.oracle import CONFIGS, LEAST, METRICS, SEEDS, four, sign, sql
from foldcast.sources import artifacts, panel as sources

ASSETS = ("A", "N", "R")
#: Contexts of the sequence family in sessions, the simpler first.
CONTEXTS = {"L5": 5, "L21": 21}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one run, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        """A row a day and asset, far smaller than the order lines; queries read it more than once."""
        return sources.panel_from_lineitem(self.read("lineitem")).cache()

    @cached_property
    def ragged(self) -> DataFrame:
        return sources.panel_from_orders(self.read("orders"), self.read("customer"))

    @cached_property
    def sup(self) -> DataFrame:
        return features.build_supervised(self.panel)

    @cached_property
    def ref(self) -> DataFrame:
        return features.reference_features(self.panel)

    @cached_property
    def folds(self) -> DataFrame:
        return folds.registry(self.spark, folds.DEFAULT)

    @cached_property
    def assigned(self) -> DataFrame:
        return folds.assign(self.sup, self.folds)

    @cached_property
    def slices(self) -> DataFrame:
        return folds.eligible_slices(self.sup, self.folds)

    @cached_property
    def eligible(self) -> DataFrame:
        """Eligible rows, each once; families read them several times."""
        return artifacts.stored(self.sup.where("eligible = 1"), "eligible")

    @cached_property
    def dev(self) -> DataFrame:
        return folds.assign(self.eligible, self.folds.where("role = 'development'"))

    @cached_property
    def base(self) -> DataFrame:
        return forecast.baseline_forecasts(self.slices)

    @cached_property
    def dev_base(self) -> DataFrame:
        """As ``base``, from the stored rows."""
        return forecast.baseline_forecasts(self.dev)

    @cached_property
    def simplicity(self) -> DataFrame:
        return self.spark.createDataFrame([(c, k + 1) for k, c in enumerate(CONFIGS)], "config string, simplicity int")

    @cached_property
    def family(self) -> dict[str, DataFrame]:
        """The plain and the seeded closed-form family, in one walk."""
        return forecast.run_family(self.eligible, self.folds, CONFIGS, [None, *SEEDS], self.simplicity)

    @cached_property
    def matched(self) -> DataFrame:
        return metrics.match_baseline(self.family["forecasts"], self.dev_base)

    @cached_property
    def states(self) -> DataFrame:
        """Metric states by model, seed, fold, asset and the three labels, stored: all metrics that follow are sums of these."""
        labelled = regimes.attach(self.matched, self.regime[2])
        return artifacts.stored(regime_metrics.finest(labelled, ["model", "seed", "fold", "asset"]), "states")

    @cached_property
    def cells(self) -> DataFrame:
        return metrics.skill_metrics(self.matched)

    @cached_property
    def macro(self) -> DataFrame:
        return metrics.macro_metrics(self.cells, len(ASSETS))

    @cached_property
    def regime(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return regimes.regimes(artifacts.stored(self.ref, "reference"), self.folds, [self.dev_base])

    @cached_property
    def base_labelled(self) -> DataFrame:
        return regimes.attach(self.dev_base, self.regime[2])

    @cached_property
    def matched_labelled(self) -> DataFrame:
        """Every metric by regime reads it more than once."""
        return regimes.attach(self.matched, self.regime[2]).cache()

    @cached_property
    def rcells(self) -> DataFrame:
        return regime_metrics.learned_cells(self.states, LEAST)

    @cached_property
    def contrasts(self) -> DataFrame:
        return regime_metrics.contrasts(self.rcells)

    @cached_property
    def rmacro(self) -> DataFrame:
        return regime_metrics.macro_cells(self.rcells, len(ASSETS))

    @cached_property
    def mcontrasts(self) -> DataFrame:
        return regime_metrics.contrasts(self.rmacro, ("model", "seed", "fold"))


def query(name: str, oracle: str | None = None, doubles: str = "", places: int = 9):
    """Register a query of (tables) under a name; its doubles are rounded for comparison."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = sql(oracle, doubles, places)
        return f

    return add


_PANEL = "open high low close volume"
_ERR = "mae rmse da"
_FIVE = " ".join(METRICS)
_FOURS = " ".join(f"{m}_{x}" for m in METRICS for x in ("mean", "std", "min", "max"))


# sources
@query("s3_panel", "SELECT * FROM panel", _PANEL)
def _(t):
    return sources.normalize_panel(t.panel)


@query("s2_wide_to_long", "SELECT date, asset, open, close FROM panel", "open close")
def _(t):
    wide = t.panel.groupBy("date").pivot("asset", [*ASSETS, C.REFERENCE]).agg(F.max("open").alias("Open"), F.max("close").alias("Close"))
    named = wide.select("date", *(F.col(f"{a}_{f}").alias(f"{f}|{a}") for a in (*ASSETS, C.REFERENCE) for f in ("Open", "Close")))
    return sources.wide_to_long(named).select("date", "asset", "open", "close")


@query("s4_read_until", "SELECT asset, target_date, target_return FROM targets WHERE target_date BETWEEN '1996-01-01' AND '1997-12-31'", "target_return")
def _(t):
    """Of a stored table by year: two years are opened."""
    path = sources.store_by_year(features.next_session_target(t.panel.where("asset <> 'MKT'")), f"{artifacts.shared_root(t.spark)}/targets-{uuid.uuid4().hex}")
    return sources.read_until(t.spark.read.parquet(path), "1996-01-01", "1997-12-31", ["asset", "target_date", "target_return"])


@query("s1_read_panel", "SELECT * FROM panel", _PANEL)
def _(t):
    return sources.read_panel(t.spark, artifacts.write_once(t.panel, artifacts.shared_root(t.spark), "panel"))


@query("s5_read_forecasts", "SELECT fold, asset, origin_date, target_date, actual_return, predicted_return, actual_direction, predicted_direction FROM base", "actual_return predicted_return")
def _(t):
    stored = sources.read_forecasts(t.spark, artifacts.write_once(t.base, artifacts.shared_root(t.spark), "forecasts"))
    return stored.select(*C.FORECAST_KEY, "actual_return", "predicted_return", "actual_direction", "predicted_direction")


@query("s6_write_once", "SELECT 1 AS same_place, count(*) AS n, count(*) FILTER (asset <> 'MKT') AS n_other FROM panel")
def _(t):
    root = artifacts.shared_root(t.spark)
    a, b, c = (artifacts.write_once(d, root, "once") for d in (t.panel, t.panel.repartition(3), t.panel.where("asset <> 'MKT'")))
    n = lambda p, name: t.spark.read.parquet(p).agg(F.count("*").alias(name))
    return n(a, "n").crossJoin(n(c, "n_other")).select(F.lit(int(a == b and a != c)).alias("same_place"), "n", "n_other")


@query("s10_drift", "SELECT asset || '/' || 'part' AS path, CASE asset WHEN 'A' THEN 'changed' WHEN 'N' THEN 'missing' ELSE 'extra' END AS kind FROM (SELECT DISTINCT asset FROM panel WHERE asset <> 'MKT')")
def _(t):
    """A folder by asset, with files of one name in each: A's content changes, N's file goes, R's comes."""
    root, panel = artifacts.shared_root(t.spark), artifacts.stored(t.panel.where("asset <> 'MKT'"), "panel")

    def files(rows: DataFrame, name: str) -> DataFrame:
        place = artifacts.write_rows(rows, f"{root}/{name}-{uuid.uuid4().hex}", "asset", "date")
        found = artifacts.inventory(t.spark, place, "part-*")
        return found.withColumn("path", F.regexp_replace("path", "^folder=(.*)/part-.*$", "$1/part"))

    before = files(panel.where("asset <> 'R'"), "before")
    after = files(panel.where("asset <> 'N'").withColumn("close", F.when(F.col("asset") == "A", F.col("close") + 1).otherwise(F.col("close"))), "after")
    return artifacts.drift(after, before)


@query("s10_tree", "SELECT 'folder=' || asset AS folder, 1::BIGINT AS n_files, CASE WHEN asset = 'A' THEN 0 ELSE 1 END AS same FROM (SELECT DISTINCT asset FROM panel WHERE asset <> 'MKT') UNION ALL SELECT '', count(DISTINCT asset), 0 FROM panel WHERE asset <> 'MKT'")
def _(t):
    """The digest tree of a folder by asset against that of the same with one asset changed: its node and the root differ."""
    root, panel = artifacts.shared_root(t.spark), artifacts.stored(t.panel.where("asset <> 'MKT'"), "panel")

    def node(rows: DataFrame) -> DataFrame:
        place = artifacts.write_rows(rows, f"{root}/tree-{uuid.uuid4().hex}", "asset", "date")
        # Spark names files at random: only their folders are told here
        found = artifacts.inventory(t.spark, place, "part-*").withColumn("path", F.regexp_replace("path", "/part-.*$", "/part"))
        return artifacts.tree(found)

    a, b = node(panel), node(panel.withColumn("close", F.when(F.col("asset") == "A", F.col("close") + 1).otherwise(F.col("close"))))
    other = b.select("folder", F.struct("n_files", "sum_a", "sum_b").alias("y"))
    return a.join(other, "folder").select("folder", "n_files", (F.struct("n_files", "sum_a", "sum_b") == F.col("y")).cast("int").alias("same"))


_HEADER = "9:o_custkey6:bigint10:o_orderkey6:bigint"
_ENCODE = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE 'V' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("o_custkey", "o_orderkey"))


@query("s7_fingerprint", f"SELECT (SELECT count(*) FROM orders) AS n, CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR) AS sum_a, CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR) AS sum_b FROM (SELECT md5('{_HEADER}|' || {_ENCODE}) AS h FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_orderkey FROM orders) UNION ALL SELECT md5('{_HEADER}'))")
def _(t):
    holes = t.read("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return artifacts.fingerprint(holes, ["o_orderkey", "o_custkey"])


@query("s8_manifest", "SELECT asset, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, (SELECT count(*) FROM panel) AS total_rows, 'date,asset,open,high,low,close,volume' AS columns FROM panel GROUP BY asset")
def _(t):
    return artifacts.manifest(t.panel)


@query("s9_verify_manifest", "SELECT asset, 'n_rows' AS field, CAST(count(*) AS VARCHAR) AS stored, CAST(count(*) FILTER (date < '2001-01-01') AS VARCHAR) AS found FROM panel GROUP BY asset UNION ALL SELECT asset, 'last_date', CAST(max(date) AS VARCHAR), CAST(max(date) FILTER (date < '2001-01-01') AS VARCHAR) FROM panel GROUP BY asset UNION ALL SELECT DISTINCT asset, 'total_rows', CAST((SELECT count(*) FROM panel) AS VARCHAR), CAST((SELECT count(*) FROM panel WHERE date < '2001-01-01') AS VARCHAR) FROM panel")
def _(t):
    return artifacts.verify_manifest(t.panel.where("date < '2001-01-01'"), artifacts.manifest(t.panel))


@query("s11_stamp", "SELECT fold, asset, count(*) AS n, 'r1' AS run_id, '1' AS version FROM base GROUP BY fold, asset")
def _(t):
    return artifacts.stamp(t.base.groupBy("fold", "asset").agg(F.count("*").alias("n")), {"run_id": "r1", "version": "1"})


# rules
_Q1 = """SELECT unnest(list_filter([CASE WHEN asset NOT IN ('A', 'N', 'MKT') THEN 'unknown_asset' END, CASE WHEN date NOT BETWEEN '1995-06-01' AND '2001-06-30' THEN 'date_out_of_range' END,
  CASE WHEN high < open THEN 'high_below_open' END, CASE WHEN high < close THEN 'high_below_close' END, CASE WHEN high < low THEN 'high_below_low' END], lambda x: x IS NOT NULL)) AS rule, asset, date
  FROM (SELECT * REPLACE (CASE WHEN day(date) = 13 THEN open * 0.5 ELSE high END AS high) FROM panel)"""


def _broken(t: Tables) -> DataFrame:
    tampered = t.panel.withColumn("high", F.when(F.dayofmonth("date") == 13, F.col("open") * 0.5).otherwise(F.col("high")))
    return quality.panel_violations(tampered, ("A", "N", "MKT"), "1995-06-01", "2001-06-30")


@query("q1_panel_violations", _Q1)
def _(t):
    return _broken(t)


@query("q10_examples", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule ORDER BY asset, date) AS INT) AS rn FROM ({_Q1})) WHERE rn <= 5")
def _(t):
    return quality.examples(_broken(t), ["asset", "date"])


@query("q3_duplicate_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_linenumber)")
def _(t):
    return quality.duplicate_keys(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("q4_missing_assets", "SELECT DISTINCT n_name AS asset FROM nation WHERE n_name NOT IN (SELECT c_mktsegment FROM customer)")
def _(t):
    return quality.missing_assets(t.read("customer").select(F.col("c_mktsegment").alias("asset")), t.read("nation").select(F.col("n_name").alias("asset")).distinct())


def _calendar(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    sessions = t.panel.where("asset = 'MKT'").select("date")
    return t.ragged, sessions, t.ragged.select("asset").distinct()


_GAPS = """SELECT a.asset, s.date, 'missing' AS kind FROM (SELECT DISTINCT asset FROM ragged) a, (SELECT date FROM panel WHERE asset = 'MKT') s WHERE NOT EXISTS (SELECT 1 FROM ragged r WHERE r.asset = a.asset AND r.date = s.date)
  UNION ALL SELECT asset, date, 'unexpected' FROM ragged WHERE date NOT IN (SELECT date FROM panel WHERE asset = 'MKT')"""


@query("q5_calendar_gaps", _GAPS)
def _(t):
    return quality.calendar_gaps(*_calendar(t))


@query("q5_gap_runs", "SELECT asset, CAST(min(k) AS INT) AS first, CAST(max(k) AS INT) AS last, count(*) AS n FROM (SELECT asset, k, k - row_number() OVER (PARTITION BY asset ORDER BY k) AS run FROM (SELECT asset, date FROM (" + _GAPS + ") WHERE kind = 'missing') JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM panel WHERE asset = 'MKT') USING (date)) GROUP BY asset, run")
def _(t):
    return quality.gap_runs(*_calendar(t))


@query("q7_calendar_audit", f"SELECT r.asset, (SELECT count(*) FROM panel WHERE asset = 'MKT') AS expected, count(DISTINCT r.date) AS observed, coalesce(any_value(m), 0) AS missing, coalesce(any_value(u), 0) AS unexpected, CASE WHEN coalesce(any_value(m), 0) = 0 AND coalesce(any_value(u), 0) = 0 THEN 1 ELSE 0 END AS is_clean FROM ragged r LEFT JOIN (SELECT asset, count(*) FILTER (kind = 'missing') AS m, count(*) FILTER (kind = 'unexpected') AS u FROM ({_GAPS}) GROUP BY asset) g ON r.asset = g.asset GROUP BY r.asset")
def _(t):
    return quality.calendar_audit(*_calendar(t))


@query("q6_date_difference", "SELECT DISTINCT date, 'target_only' AS side FROM ragged WHERE asset <> 'MKT' AND NOT (asset = 'BUILDING' AND day(date) = 7) AND date NOT IN (SELECT date FROM ragged WHERE asset = 'MKT' AND day(date) <> 15) UNION ALL SELECT date, 'reference_only' FROM ragged WHERE asset = 'MKT' AND day(date) <> 15 AND date NOT IN (SELECT date FROM ragged WHERE asset <> 'MKT' AND NOT (asset = 'BUILDING' AND day(date) = 7))")
def _(t):
    cut = t.ragged.where("NOT (asset = 'MKT' AND day(date) = 15) AND NOT (asset = 'BUILDING' AND day(date) = 7)")
    return quality.date_difference(cut)


@query("q8_supervised_violations", "SELECT 'date_out_of_range' AS rule, asset, origin_date, target_date FROM sup WHERE NOT (origin_date BETWEEN '1996-01-01' AND '2001-06-30' AND target_date BETWEEN '1996-01-01' AND '2001-06-30') UNION ALL SELECT 'direction_differs', asset, origin_date, target_date FROM sup WHERE day(origin_date) = 3")
def _(t):
    flipped = t.sup.withColumn("target_direction", F.when(F.dayofmonth("origin_date") == 3, 1 - F.col("target_direction")).otherwise(F.col("target_direction")))
    return quality.supervised_violations(flipped, "1996-01-01", "2001-06-30")


@query("q9_forecast_violations", "SELECT 'unknown_asset' AS rule, fold, asset, origin_date, target_date, CAST(NULL AS VARCHAR) AS seed FROM base WHERE asset = 'R' UNION ALL SELECT 'baseline_not_zero', fold, asset, origin_date, target_date, NULL FROM base WHERE day(target_date) = 9 UNION ALL SELECT 'duplicate_key', fold, asset, origin_date, target_date, NULL FROM base, (VALUES (1), (2)) WHERE day(target_date) = 10 UNION ALL SELECT 'unknown_asset', fold, asset, origin_date, target_date, NULL FROM base WHERE asset = 'R' AND day(target_date) = 10")
def _(t):
    moved = t.base.withColumn("predicted_return", F.when(F.dayofmonth("target_date") == 9, 0.1).otherwise(F.col("predicted_return")))
    return quality.forecast_violations(moved.unionByName(moved.where("day(target_date) = 10")), t.folds, ("A", "N"), zero_baseline=True)


# targets and features
@query("f1_targets", "SELECT * FROM targets", "target_return")
def _(t):
    return features.next_session_target(t.panel.where("asset <> 'MKT'"))


@query("f4_asset_features", "SELECT * FROM own", " ".join(C.OWN_FEATURES), 6)
def _(t):
    return features.asset_features(t.panel.where("asset <> 'MKT'"))


@query("f4_features_in_blocks", "SELECT * FROM own", " ".join(C.OWN_FEATURES), 6)
def _(t):
    """As f4, each asset in blocks of 256 rows with a halo."""
    return features.asset_features(t.panel.where("asset <> 'MKT'"), block_rows=256)


@query("f5_reference_features", "SELECT * FROM ref", " ".join(C.REF_FEATURES))
def _(t):
    return t.ref


@query("f6_reference_join", "SELECT asset, o.origin_date, ret, ref_ret, coalesce(ref_observed, 0) AS ref_observed FROM own o LEFT JOIN (SELECT * FROM ref WHERE day(origin_date) <> 15) r USING (origin_date)", "ret ref_ret")
def _(t):
    own = features.asset_features(t.panel.where("asset <> 'MKT'"))
    return features.join_reference(own, t.ref.where("day(origin_date) <> 15")).select("asset", "origin_date", "ret", "ref_ret", "ref_observed")


@query("f9_supervised", "SELECT * FROM sup", "target_return " + " ".join(C.FEATURES), 6)
def _(t):
    return t.sup


_STAT = "count(*) AS n_rows, CAST(sum(eligible) AS BIGINT) AS n_eligible, CAST(sum(prefix) AS BIGINT) AS n_prefix, count(*) FILTER (ref_observed = 0) AS n_no_reference, min(origin_date) AS first_date, max(origin_date) AS last_date"
_NUM = "(SELECT *, CASE WHEN coalesce(rn < min(CASE WHEN eligible = 1 THEN rn END) OVER (PARTITION BY asset), true) THEN 1 ELSE 0 END AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY origin_date) AS rn FROM sup))"


@query("f9_supervised_checked", "SELECT * FROM sup", "target_return " + " ".join(C.FEATURES), 6)
def _(t):
    return features.build_supervised(t.panel, check=True)


@query("f10_eligibility_stats", f"SELECT CAST(NULL AS VARCHAR) AS fold, CAST(NULL AS VARCHAR) AS partition, asset, {_STAT} FROM {_NUM} GROUP BY GROUPING SETS ((asset), ()) UNION ALL SELECT fold, partition, asset, {_STAT} FROM (SELECT fold, partition, n.* FROM assigned a JOIN {_NUM} n USING (asset, origin_date, target_date)) GROUP BY GROUPING SETS ((fold, partition), (fold, partition, asset))")
def _(t):
    return features.eligibility_stats(t.sup, t.assigned)


@query("f11_reference_view", "SELECT origin_date, count(*) AS n_assets, count(DISTINCT asset) AS n_distinct, count(DISTINCT target_date) AS n_targets, max(ref_ret + CASE WHEN asset = 'A' AND day(origin_date) = 4 THEN 1 ELSE 0 END) AS ref_ret, max(CASE WHEN asset <> 'N' OR day(origin_date) <> 5 THEN ref_std_21 END) AS ref_std_21, max(ref_trend_63) AS ref_trend_63, CASE WHEN day(origin_date) = 4 AND bool_or(asset = 'A') AND count(*) > 1 AND max(ref_ret) IS NOT NULL THEN 0 ELSE 1 END AS ref_ret_same, CASE WHEN day(origin_date) = 5 AND bool_or(asset = 'N') AND count(*) > 1 AND max(ref_std_21) IS NOT NULL THEN 0 ELSE 1 END AS ref_std_21_same, 1 AS ref_trend_63_same FROM sup GROUP BY origin_date", "ref_ret ref_std_21 ref_trend_63")
def _(t):
    moved = t.sup.withColumns({"ref_ret": F.when(F.expr("asset = 'A' AND day(origin_date) = 4"), F.col("ref_ret") + 1).otherwise(F.col("ref_ret")), "ref_std_21": F.when(F.expr("asset <> 'N' OR day(origin_date) <> 5"), F.col("ref_std_21"))})
    return features.reference_view(moved)


@query("f12_reconstruct", "SELECT count(ref_std_21) FILTER (day(origin_date) <> 4) AS n_std, 0::BIGINT AS bad_std, count(ref_std_21) FILTER (day(origin_date) = 4) AS null_std, count(ref_trend_63) AS n_trend, count(ref_trend_63) FILTER (day(origin_date) = 5) AS bad_trend, 0::BIGINT AS null_trend FROM ref")
def _(t):
    moved = t.ref.withColumns({"ref_std_21": F.when(F.dayofmonth("origin_date") != 4, F.col("ref_std_21")), "ref_trend_63": F.col("ref_trend_63") + (F.dayofmonth("origin_date") == 5).cast("int")})
    return features.reconstruct(moved)


# folds
@query("d2_assign", "SELECT fold, partition, role, asset, origin_date, target_date FROM assigned")
def _(t):
    return t.assigned.select("fold", "partition", "role", *C.SAMPLE_KEY)


@query("d4_eligible_slices", "SELECT fold, partition, role, asset, origin_date, target_date, target_return FROM slices", "target_return")
def _(t):
    """Every partition must have all assets of the panel."""
    assets = t.panel.where("asset <> 'MKT'").select("asset").distinct()
    return folds.eligible_slices(t.sup, t.folds, assets).select("fold", "partition", "role", *C.SAMPLE_KEY, "target_return")


@query("d5_coverage", "SELECT fold, partition, asset, count(*) AS n_rows, min(target_date) AS first_date, max(target_date) AS last_date FROM slices GROUP BY ROLLUP (fold, partition, asset)")
def _(t):
    return moments.fold_coverage(t.sup.where("eligible = 1"), folds.guarded(t.folds))


# forecasts
@query("m3_baseline", "SELECT fold, partition, asset, origin_date, target_date, actual_return, predicted_return, actual_direction, predicted_direction FROM base", "actual_return predicted_return")
def _(t):
    whole = forecast.baseline_forecasts(t.dev, t.eligible.select("asset").distinct())
    return whole.select("fold", "partition", *C.SAMPLE_KEY, "actual_return", "predicted_return", "actual_direction", "predicted_direction")


@query("m6_candidate_forecasts", "SELECT model, config, seed, fold, partition, asset, origin_date, target_date, actual_return, predicted_return, actual_direction, predicted_direction FROM val", "actual_return predicted_return")
def _(t):
    return t.family["validation"].select("model", "config", "seed", "fold", "partition", *C.SAMPLE_KEY, "actual_return", "predicted_return", "actual_direction", "predicted_direction")


@query("m7_candidate_audit", "SELECT model, fold, config, asset, seed, n_validation, mae, rmse, da, n_positive, n_validation - n_positive AS n_other, n_train, status FROM audit", _ERR)
def _(t):
    return t.family["audit"]


@query("m8_grid_gaps", "SELECT fold, config, asset, '' AS seed, 'missing' AS problem FROM audit WHERE model = 'plain' AND asset = 'N' AND config = 'ret' UNION ALL SELECT fold, config, asset, '', 'repeated' FROM audit WHERE model = 'plain' AND asset = 'A' AND config = 'ref_ret' UNION ALL SELECT fold, config, asset, '', 'unexpected' FROM audit, (VALUES (1), (2)) WHERE model = 'plain' AND asset = 'R' AND config = 'ret_mean_5' AND fold = 'D2' AND false")
def _(t):
    audit = t.family["audit"].where("model = 'plain'").drop("model")
    grid = audit.select("fold", "config", "asset", "seed").distinct()
    return forecast.grid_gaps(audit.where("NOT (asset = 'N' AND config = 'ret')").unionByName(audit.where("asset = 'A' AND config = 'ref_ret'")), grid)


@query("m8_key_agreement", "SELECT fold, asset, 1::BIGINT AS n_key_sets, count(DISTINCT (config, coalesce(seed, ''), model)) AS n_cells FROM val WHERE model = 'seeded' GROUP BY fold, asset")
def _(t):
    return forecast.key_agreement(t.family["validation"].where("model = 'seeded'"))


@query("m9_fold_winner", "SELECT model, fold, config, n_assets, macro_mae, macro_rmse, simplicity, delta, tied, selected, reason FROM winners", "macro_mae macro_rmse delta")
def _(t):
    return t.family["winners"]


@query("m10_winner_cells", "SELECT model, fold, config, asset, seed, n_train FROM won JOIN audit USING (model, fold, config)")
def _(t):
    return forecast.winner_iterations(t.family["winners"], t.family["audit"], "n_train", ("model", "fold"))


@query("m11_refit_forecasts", "SELECT model, config, seed, fold, asset, origin_date, target_date, actual_return, predicted_return, predicted_direction FROM learned", "actual_return predicted_return")
def _(t):
    return t.family["forecasts"].select("model", "config", "seed", "fold", *C.SAMPLE_KEY, "actual_return", "predicted_return", "predicted_direction")


@query("m12_refit_audit", "SELECT fold, asset, config, r.n_train AS n_refit, n_forecast, n.n_train, n_validation, n_test, config AS winner, CASE WHEN n.n_train + n_validation = r.n_train AND n_forecast = n_test THEN 1 ELSE 0 END AS ok FROM (SELECT * FROM refits WHERE seed IS NULL) r JOIN (SELECT fold, config FROM won WHERE model = 'plain') w USING (fold, config) JOIN (SELECT fold, asset, count(*) AS n_forecast FROM learned WHERE model = 'plain' GROUP BY fold, asset) USING (fold, asset) JOIN (SELECT fold, asset, count(*) FILTER (partition = 'train') AS n_train, count(*) FILTER (partition = 'validation') AS n_validation, count(*) FILTER (partition = 'test') AS n_test FROM dev GROUP BY fold, asset) n USING (fold, asset)")
def _(t):
    f = {k: v.where("model = 'plain'") for k, v in t.family.items() if "model" in v.columns}
    return forecast.refit_audit(t.dev, f["refits"], f["forecasts"], f["winners"])


@query("m13_replay", "SELECT unnest(['key', 'model', 'seed', 'partition', 'actual_return', 'predicted_return', 'actual_direction', 'predicted_direction', 'trend_regime', 'volatility_regime', 'transition_regime']) AS \"column\", unnest([k, 0, 0, 0, 0, p, 0, 0, 0, 0, 0]) AS n_mismatch FROM (SELECT count(*) FILTER (day(target_date) = 6) AS k, count(*) FILTER (day(target_date) = 5 AND asset = 'A') AS p FROM learned WHERE model = 'plain')")
def _(t):
    """A second run over other partitions, with planted differences: rows that are gone, and forecasts that moved."""
    again = forecast.run_family(t.eligible.repartition(3, "origin_date"), t.folds, CONFIGS, [None], t.simplicity)["forecasts"].where("day(target_date) <> 6")
    moved = again.withColumn("predicted_return", F.when(F.expr("day(target_date) = 5 AND asset = 'A'"), F.col("predicted_return") + 0.001).otherwise(F.col("predicted_return")))
    return forecast.replay(t.family["forecasts"].where("model = 'plain'"), moved).select("column", "n_mismatch")


def _replayed(t: Tables, walk: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
    """Two runs of a family over differently partitioned slices, with one asset's forecasts and another's iterations moved in the second."""
    first, second = (train.cell_digests(walk(d)) for d in (t.dev, t.dev.repartition(5, "target_date")))
    moved = second.withColumns({"forecasts": F.when(F.expr("fold = 'D1' AND asset = 'A'"), F.col("forecasts") + 1).otherwise(F.col("forecasts")), "iterations": F.when(F.expr("fold = 'D2' AND asset = 'N'"), F.col("iterations") + 1).otherwise(F.col("iterations"))})
    flags = [f"same_{x}" for x in ("keys", "iterations", "forecasts", "metrics")]
    return train.replay(first, moved).groupBy("fold", "asset").agg(F.count("*").alias("n_cells"), *(F.min(x).alias(x) for x in flags))


def _replay_sql(n: int) -> str:
    return f"SELECT fold, asset, {n}::BIGINT AS n_cells, 1 AS same_keys, CASE WHEN fold = 'D2' AND asset = 'N' THEN 0 ELSE 1 END AS same_iterations, CASE WHEN fold = 'D1' AND asset = 'A' THEN 0 ELSE 1 END AS same_forecasts, 1 AS same_metrics FROM dev GROUP BY fold, asset"


@query("m13_replay_trees", _replay_sql(1))
def _(t):
    return _replayed(t, train.tree_family)


@query("m13_replay_sequences", _replay_sql(len(SEEDS)))
def _(t):
    return _replayed(t, lambda d: train.sequence_family(t.sup, d, CONTEXTS, SEEDS))


@query("m4_tree_family")
def _(t):
    return train.tree_family(t.dev)["scores"]


@query("m5_sequence_family")
def _(t):
    return train.sequence_family(t.sup, t.dev, CONTEXTS, SEEDS)["scores"]


@query("m7_tree_audit", "SELECT fold, config, asset, n_validation, n_positive, n_validation - n_positive AS n_other, n_train, 'completed' AS status, 1 AS stops_in_range FROM (SELECT fold, asset, count(*) FILTER (partition = 'validation') AS n_validation, count(*) FILTER (partition = 'validation' AND target_return > 0) AS n_positive, count(*) FILTER (partition = 'train') AS n_train FROM dev GROUP BY fold, asset), (SELECT unnest(['leaves15_least20', 'leaves15_least50', 'leaves31_least20', 'leaves31_least50']) AS config)")
def _(t):
    audit = train.tree_family(t.dev)["audit"]
    within = F.col("best_iteration").between(1, train.TREES["leaves15_least20"].most) & (F.col("runtime") >= 0)
    return audit.select("fold", "config", "asset", "n_validation", "n_positive", "n_other", "n_train", "status", within.cast("int").alias("stops_in_range"))


@query("m12_tree_refits", "SELECT fold, asset, count(*) FILTER (partition <> 'test') AS n_refit, count(*) FILTER (partition = 'test') AS n_forecast, 1 AS ok FROM dev GROUP BY fold, asset")
def _(t):
    return train.tree_family(t.dev)["refit_audit"].select("fold", "asset", "n_refit", "n_forecast", "ok")


# comparison and metrics
@query("g1_key_difference", "SELECT count(*) FILTER (day(target_date) = 5) AS n_missing, 0::BIGINT AS n_extra, count(*) FILTER (day(target_date) <> 5) AS n_common FROM base")
def _(t):
    return metrics.key_difference(t.base, t.family["forecasts"].where("day(target_date) <> 5"))


@query("g2_actual_agreement", "SELECT 0::BIGINT AS n_unmatched, count(*) FILTER (day(target_date) = 5 AND actual_return <> 0) AS n_return, 0::BIGINT AS n_direction, max(CASE WHEN day(target_date) = 5 THEN abs(actual_return) * 0.5 ELSE 0 END) AS max_abs_diff FROM base", "max_abs_diff")
def _(t):
    moved = t.base.withColumn("actual_return", F.when(F.dayofmonth("target_date") == 5, F.col("actual_return") * 1.5).otherwise(F.col("actual_return")))
    return metrics.actual_agreement(moved, t.base)


@query("g3_matched", "SELECT model, seed, fold, asset, origin_date, predicted_return, baseline_return, baseline_direction FROM matched", "predicted_return baseline_return")
def _(t):
    return t.matched.select("model", "seed", "fold", "asset", "origin_date", "predicted_return", "baseline_return", "baseline_direction")


@query("g3_matched_checked", "SELECT model, seed, fold, asset, origin_date, baseline_return, baseline_direction FROM matched", "baseline_return")
def _(t):
    """As g3, with an error for a baseline key that repeats or is missing."""
    whole = metrics.match_baseline(t.family["forecasts"], t.dev_base, check=True)
    return whole.select("model", "seed", "fold", "asset", "origin_date", "baseline_return", "baseline_direction")


@query("g4_error_metrics", "SELECT fold, asset, count(*) AS n, avg(abs(predicted_return - actual_return)) AS mae, sqrt(avg((predicted_return - actual_return) ** 2)) AS rmse, avg(CAST(predicted_direction = actual_direction AS INT)) AS da FROM base GROUP BY fold, asset", _ERR)
def _(t):
    return metrics.error_metrics(t.base)


@query("g5_class_balance", "SELECT fold, asset, count(*) AS n, count(*) FILTER (actual_direction = 1) AS n_positive, count(*) FILTER (actual_direction = 0) AS n_other, avg(actual_direction) AS positive_rate, 1 - avg(actual_direction) AS other_rate FROM base GROUP BY fold, asset", "positive_rate other_rate")
def _(t):
    return metrics.class_balance(t.base)


@query("g6_skill", "SELECT model, seed, fold, asset, n, mae, rmse, da, baseline_mae, baseline_rmse, baseline_da, skill, da_diff FROM cells", "mae rmse da baseline_mae baseline_rmse baseline_da skill da_diff")
def _(t):
    return t.cells


@query("g7_macro", "SELECT * FROM macro", _FIVE)
def _(t):
    return t.macro


@query("g8_seed_summary", "SELECT * FROM seed_cells", _FOURS)
def _(t):
    return metrics.seed_summary(t.cells.where("seed IS NOT NULL"), SEEDS)


def _quart(rows: str, keys: str) -> str:
    return f"SELECT *, q3 - q1 AS iqr FROM (SELECT {keys}, count(*) AS n_folds, CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.5) END AS median, CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.25) END AS q1, CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.75) END AS q3 FROM ({rows}) GROUP BY {keys})"


def _melt(rows: str, ids: str, values) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{v}' AS metric, {v} AS value FROM {rows}" for v in values)


_Q = "median q1 q3 iqr"


@query("g9_development", _quart(_melt("cells", "model, seed, asset", METRICS), "model, seed, asset, metric"), _Q)
def _(t):
    return metrics.development_summary(t.cells, ("model", "seed", "asset"))


@query("g10_seed_macro", f"SELECT model, fold, count(*) AS n_seeds, 1 AS seeds_ok, max(n) AS n, {four(METRICS)} FROM macro WHERE seed IS NOT NULL GROUP BY model, fold", _FOURS)
def _(t):
    return metrics.all_metrics(t.matched, len(ASSETS), SEEDS)["seed_macro"]


@query("g10_levels", "SELECT 'cells' AS level, count(*) AS n, sum(skill) AS skill FROM cells UNION ALL SELECT 'macro', count(*), sum(skill) FROM macro UNION ALL SELECT 'seed_cells', count(*), sum(skill_mean) FROM seed_cells UNION ALL SELECT 'seed_macro', count(DISTINCT fold), sum(skill) / 2 FROM macro WHERE seed IS NOT NULL UNION ALL SELECT 'development', 5 * count(*), sum(skill) FROM (SELECT quantile_cont(skill, 0.5) AS skill FROM cells WHERE seed IS NULL GROUP BY asset)", "skill", 8)
def _(t):
    """Rows of all five tables, and the sum of the skill that each tells."""
    done = metrics.all_metrics(t.matched, len(ASSETS), SEEDS)
    value = {"cells": F.col("skill"), "macro": F.col("skill"), "seed_cells": F.col("skill_mean"), "seed_macro": F.col("skill_mean"), "development": F.when(F.col("metric") == "skill", F.col("median"))}
    parts = [done[k].agg(F.count("*").alias("n"), F.sum(v).alias("skill")).select(F.lit(k).alias("level"), "n", "skill") for k, v in value.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("skill", F.round("skill", 8))


# regimes
@query("r1_volatility_inputs", "SELECT origin_date, target_date, trend, vol, abs_ret, vol_lag, jump FROM inputs", "trend vol abs_ret vol_lag jump")
def _(t):
    return t.regime[0]


@query("r2_thresholds", "SELECT * FROM limits", "vol_median ret_q95")
def _(t):
    return t.regime[1]


@query("r3_label_keys", "SELECT fold, origin_date, count(DISTINCT asset) AS n_assets, min(target_date) AS target_date FROM base GROUP BY fold, origin_date")
def _(t):
    return regimes.label_keys(t.base)


@query("r7_labels", "SELECT * FROM labels", "trend vol vol_lag jump abs_ret vol_median ret_q95")
def _(t):
    return t.regime[2]


@query("r7_label_gaps", "SELECT DISTINCT 'no_reference' AS problem, fold, origin_date FROM base WHERE day(origin_date) = 4 UNION ALL SELECT DISTINCT 'no_thresholds', fold, origin_date FROM base WHERE fold = 'D2' UNION ALL SELECT DISTINCT 'unused_thresholds', fold, CAST(NULL AS DATE) FROM limits WHERE fold NOT IN (SELECT fold FROM base)")
def _(t):
    return regimes.label_gaps(t.base, t.regime[0].where("day(origin_date) <> 4"), t.regime[1].where("fold <> 'D2'"))


@query("r8_label_counts", """SELECT fold, dimension, label, coalesce(n, 0) AS n FROM (SELECT DISTINCT fold FROM labels) CROSS JOIN (VALUES ('trend_regime', 'positive'), ('trend_regime', 'negative'), ('trend_regime', 'unavailable'), ('volatility_regime', 'low'), ('volatility_regime', 'high'), ('volatility_regime', 'unavailable'), ('transition_regime', 'stable'), ('transition_regime', 'stressed'), ('transition_regime', 'unavailable')) d(dimension, label)
  LEFT JOIN (SELECT fold, 'trend_regime' AS dimension, trend_regime AS label, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT fold, 'volatility_regime', volatility_regime, count(*) FROM labels GROUP BY ALL UNION ALL SELECT fold, 'transition_regime', transition_regime, count(*) FROM labels GROUP BY ALL) USING (fold, dimension, label)""")
def _(t):
    return regimes.label_counts(t.regime[2])


@query("r9_attach", "SELECT fold, asset, origin_date, target_date, trend_regime, volatility_regime, transition_regime FROM base_labelled")
def _(t):
    return t.base_labelled.select(*C.FORECAST_KEY, *C.DIMENSIONS)


@query("r9_attach_check", "SELECT count(*) FILTER (day(origin_date) <> 5) AS n_before, count(*) FILTER (day(origin_date) <> 5) AS n_after, count(DISTINCT CASE WHEN day(origin_date) = 4 THEN fold || origin_date END) AS n_unlabelled, count(DISTINCT CASE WHEN day(origin_date) = 5 THEN fold || origin_date END) AS n_unused FROM base")
def _(t):
    before, table = t.base.where("day(origin_date) <> 5"), t.regime[2].where("day(origin_date) <> 4")
    return regimes.attach_check(before, regimes.attach(before, table), table)


@query("r10_inconsistent", "SELECT fold, origin_date, 1 + CAST(count(DISTINCT trend_regime = 'positive') > 0 AS BIGINT) AS trend_regime, 1::BIGINT AS volatility_regime, 1::BIGINT AS transition_regime FROM base_labelled WHERE day(origin_date) = 4 GROUP BY fold, origin_date HAVING count(*) > 1")
def _(t):
    moved = t.base_labelled.withColumn("trend_regime", F.when((F.dayofmonth("origin_date") == 4) & (F.col("asset") == F.min("asset").over(features.Window.partitionBy("fold", "origin_date"))), "other").otherwise(F.col("trend_regime")))
    return regimes.inconsistent(moved)


@query("r11_label_mismatches", "SELECT fold, origin_date, 'volatility_regime' AS dimension FROM labels WHERE day(origin_date) = 4 AND volatility_regime <> 'high'")
def _(t):
    moved = t.regime[2].withColumn("volatility_regime", F.when(F.dayofmonth("origin_date") == 4, "high").otherwise(F.col("volatility_regime")))
    return regimes.label_mismatches(moved)


# metrics by regime
@query("x2_baseline_cells", "SELECT * FROM base_cells", _ERR)
def _(t):
    return regime_metrics.baseline_cells(t.base_labelled, LEAST)


@query("x3_learned_cells", "SELECT * FROM rcells", "mae rmse da baseline_mae baseline_rmse baseline_da skill da_diff")
def _(t):
    return t.rcells


@query("x4_cell_seeds", f"SELECT model, fold, asset, dimension, label, count(*) AS n_seeds, max(n) AS n, CASE WHEN bool_and(status = 'reportable') THEN 'reportable' ELSE 'suppressed' END AS status, 0 AS mixed, {four(METRICS)} FROM rcells GROUP BY model, fold, asset, dimension, label", _FOURS)
def _(t):
    return regime_metrics.cell_seed_summary(t.rcells)


_CON = "skill_change mae_change rmse_change da_change stability_loss"


@query("x6_contrasts", "SELECT * FROM contrasts", _CON)
def _(t):
    return t.contrasts


def _signs(rows: str, keys: str) -> str:
    s = sign("mae_change")
    return f"SELECT {keys}, dimension, count(*) AS n_seeds, avg(mae_change) AS mean, string_agg(seed || ':' || coalesce({s}, 'undefined'), ',' ORDER BY seed) AS signs, CASE WHEN count(DISTINCT {s}) > 1 THEN 1 ELSE 0 END AS disagree FROM {rows} GROUP BY {keys}, dimension"


@query("x6_seed_signs", _signs("contrasts", "model, fold, asset"), "mean")
def _(t):
    return regime_metrics.seed_signs(t.contrasts)


@query("x7_macro_cells", f"SELECT model, seed, fold, dimension, label, n_reportable, n, status, {', '.join(METRICS)} FROM rmacro UNION ALL SELECT model, 'mean', fold, dimension, label, min(n_reportable), max(n), CASE WHEN bool_and(status = 'reportable') THEN 'reportable' ELSE 'suppressed' END, {', '.join(f'''CASE WHEN bool_and(status = 'reportable') THEN avg({m}) END''' for m in METRICS)} FROM rmacro GROUP BY model, fold, dimension, label", _FIVE)
def _(t):
    return regime_metrics.macro_with_seed_mean(t.rcells, len(ASSETS))


@query("x8_macro_contrasts", "SELECT * FROM mcontrasts", _CON)
def _(t):
    return t.mcontrasts


@query("x8_macro_signs", _signs("mcontrasts", "model, fold"), "mean")
def _(t):
    return regime_metrics.seed_signs(t.mcontrasts, ("model", "fold"))


_NAMES = _CON.split()
_LONG = " UNION ALL ".join(f"SELECT model, seed, asset, dimension, fold, status, '{v}' AS metric, {v} AS value FROM contrasts" for v in _NAMES)


@query("x9_contrast_summary", f"SELECT model, seed, asset, dimension, metric, n_expected, coalesce(n_folds, 0) AS n_folds, median, q1, q3, iqr, least, most, CASE WHEN coalesce(n_folds, 0) = 0 THEN 'empty' WHEN n_folds < n_expected THEN 'partial' ELSE 'complete' END AS completeness FROM (SELECT model, seed, asset, dimension, metric, count(DISTINCT fold) AS n_expected FROM ({_LONG}) GROUP BY ALL) LEFT JOIN ({_quart('SELECT * FROM (' + _LONG + ') WHERE status = ' + chr(39) + 'reportable' + chr(39), 'model, seed, asset, dimension, metric')}) USING (model, seed, asset, dimension, metric) LEFT JOIN (SELECT model, seed, asset, dimension, metric, min(value) AS least, max(value) AS most FROM ({_LONG}) WHERE status = 'reportable' GROUP BY ALL) USING (model, seed, asset, dimension, metric)", _Q + " least most")
def _(t):
    return regime_metrics.contrast_summary(t.contrasts)


_DIS = f"(SELECT level, model, dimension, count(*) AS n_seed_disagree FROM (SELECT 'asset' AS level, model, dimension, fold, asset, count(DISTINCT CASE WHEN status = 'reportable' THEN {sign('skill_change')} END) AS k FROM contrasts GROUP BY ALL UNION ALL SELECT 'macro', model, dimension, fold, 'ALL', count(DISTINCT CASE WHEN status = 'reportable' THEN {sign('skill_change')} END) FROM mcontrasts GROUP BY ALL) WHERE k > 1 GROUP BY level, model, dimension)"
_PAT = ", ".join(f"count(*) FILTER (status = 'reportable' AND {sign('skill_change')} = '{x}') AS n_{x}" for x in ("negative", "zero", "positive"))


@query("x10_failure_patterns", f"SELECT p.*, coalesce(n_seed_disagree, 0) AS n_seed_disagree FROM (SELECT level, model, dimension, count(*) AS n, count(*) FILTER (status = 'reportable') AS n_reportable, count(*) FILTER (status <> 'reportable') AS n_suppressed, {_PAT} FROM (SELECT 'asset' AS level, model, dimension, status, skill_change FROM contrasts UNION ALL SELECT 'macro', model, dimension, status, skill_change FROM mcontrasts) GROUP BY level, model, dimension) p LEFT JOIN {_DIS} USING (level, model, dimension)")
def _(t):
    return regime_metrics.failure_patterns(t.contrasts, t.mcontrasts)


@query("x11_disagreement", "SELECT *, CASE WHEN mae_change > 1e-12 AND stability_loss > 1e-12 THEN 'both_worse' WHEN mae_change > 1e-12 THEN 'error_only' WHEN stability_loss > 1e-12 THEN 'direction_only' ELSE 'neither' END AS kind FROM contrasts WHERE status = 'reportable'", _CON)
def _(t):
    return regime_metrics.disagreement(t.contrasts)


@query("x12_run_regimes", "SELECT model, status, count(*) AS n FROM contrasts GROUP BY model, status UNION ALL SELECT 'macro ' || model, status, count(*) FROM mcontrasts GROUP BY model, status")
def _(t):
    done = regime_metrics.run_regimes(t.base_labelled, t.matched_labelled, len(ASSETS), LEAST)
    n = lambda d, p: d.groupBy("model", "status").agg(F.count("*").alias("n")).select(F.concat(F.lit(p), "model").alias("model"), "status", "n")
    return n(done["contrasts"], "").unionByName(n(done["macro_contrasts"], "macro "))


# reports
def _sides(keys: str, base: str, cells: str) -> str:
    return f"SELECT {keys}, b.mae AS baseline_mae, b.rmse AS baseline_rmse, b.da AS baseline_da, p.mae AS plain_mae, p.rmse AS plain_rmse, p.da AS plain_da, p.skill AS plain_skill, s.mae AS seeded_mae, s.rmse AS seeded_rmse, s.da AS seeded_da, s.skill AS seeded_skill, s.std AS seeded_skill_std FROM ({base}) b JOIN (SELECT * FROM {cells} WHERE model = 'plain') p USING ({keys}) JOIN (SELECT {keys}, avg(mae) AS mae, avg(rmse) AS rmse, avg(da) AS da, avg(skill) AS skill, stddev_pop(skill) AS std FROM {cells} WHERE model = 'seeded' GROUP BY {keys}) s USING ({keys})"


_BASE_BY = "SELECT fold, asset, avg(abs(actual_return)) AS mae, sqrt(avg(actual_return * actual_return)) AS rmse, avg(CAST(predicted_direction = actual_direction AS INT)) AS da FROM base GROUP BY fold, asset"
_SIDE = "baseline_mae baseline_rmse baseline_da plain_mae plain_rmse plain_da plain_skill seeded_mae seeded_rmse seeded_da seeded_skill seeded_skill_std"


@query("c1_asset_comparison", _sides("fold, asset", _BASE_BY, "cells"), _SIDE)
def _(t):
    return reports.side_by_side(metrics.error_metrics(t.dev_base), t.cells.where("model = 'plain'"), metrics.seed_summary(t.cells.where("model = 'seeded'"), SEEDS))


def _macro_sides(t: Tables) -> DataFrame:
    base = metrics.macro_metrics(metrics.error_metrics(t.dev_base), len(ASSETS), ("fold",), ("mae", "rmse", "da"))
    return reports.side_by_side(base, t.macro.where("model = 'plain'"), metrics.seed_summary(t.macro.where("model = 'seeded'"), SEEDS, ("fold",)), ("fold",))


_MACRO = _sides("fold", f"SELECT fold, avg(mae) AS mae, avg(rmse) AS rmse, avg(da) AS da FROM ({_BASE_BY}) GROUP BY fold", "macro")


@query("c2_macro_comparison", _MACRO, _SIDE)
def _(t):
    return _macro_sides(t)


@query("c3_macro_summary", _quart(_melt(f"({_MACRO})", "fold", ("plain_skill", "seeded_skill", "baseline_mae")), "metric"), _Q)
def _(t):
    return reports.macro_series_summary(_macro_sides(t), ("plain_skill", "seeded_skill", "baseline_mae"))


@query("c4_win_loss", "SELECT model, seed, metric, count(value) AS n, count(*) FILTER (value > 1e-12) AS n_win, count(*) FILTER (value BETWEEN -1e-12 AND 1e-12) AS n_zero, count(*) FILTER (value < -1e-12) AS n_loss FROM (" + _melt("cells", "model, seed", ("skill", "da_diff")) + ") GROUP BY model, seed, metric")
def _(t):
    return reports.win_loss(t.cells)


@query("c5_seed_stability", "SELECT model, fold, asset, skill_std AS std, skill_max - skill_min AS range, skill_min AS least, skill_max AS most, CASE WHEN skill_min < -1e-12 AND skill_max > 1e-12 THEN 1 ELSE 0 END AS sign_change FROM seed_cells", "std range least most")
def _(t):
    return reports.seed_stability(metrics.seed_summary(t.cells.where("seed IS NOT NULL"), SEEDS))


@query("c6_fold_ranks", "SELECT model, seed, fold, mae, da, CAST(rank() OVER (PARTITION BY fold ORDER BY mae) AS INT) AS mae_rank, CAST(rank() OVER (PARTITION BY fold ORDER BY da DESC) AS INT) AS da_rank FROM macro", "mae da")
def _(t):
    return reports.fold_ranks(t.macro.select("model", "seed", "fold", "mae", "da"))


@query("c7_effort", "SELECT model, count(*) AS n_fits, count(DISTINCT seed) AS n_seeds, any_value(n_refits) AS n_refits, any_value(n_positive_skill) AS n_positive_skill FROM audit JOIN (SELECT model, count(*) AS n_refits FROM (SELECT CASE WHEN seed IS NULL THEN 'plain' ELSE 'seeded' END AS model, * FROM refits) JOIN won USING (model, fold, config) GROUP BY model) USING (model) JOIN (SELECT model, count(*) FILTER (skill > 0) AS n_positive_skill FROM cells GROUP BY model) USING (model) GROUP BY model")
def _(t):
    return reports.effort(t.family["audit"], t.family["refits"], t.cells)


@query("c7_tree_effort", "SELECT 'tree' AS model, 4 * count(*) AS n_fits, 0::BIGINT AS n_seeds, count(*) AS n_refits, 1 AS timed FROM (SELECT DISTINCT fold, asset FROM dev)")
def _(t):
    done = train.tree_family(t.dev)
    named = lambda d: d.withColumn("model", F.lit("tree"))
    skills = metrics.skill_metrics(metrics.match_baseline(done["forecasts"], t.dev_base))
    told = reports.effort(named(done["audit"]), named(done["refits"]), skills)
    return told.select("model", "n_fits", "n_seeds", "n_refits", (F.col("seconds") > 0).cast("int").alias("timed"))


@query("c8_table_diff", "SELECT unnest(['key', 'partition', 'actual_return', 'predicted_return', 'actual_direction', 'predicted_direction']) AS \"column\", unnest([0, 0, n, 0, 0, 0]) AS n_mismatch FROM (SELECT count(*) FILTER (day(target_date) = 5 AND actual_return <> 0) AS n FROM base)")
def _(t):
    cols = ["fold", "partition", *C.SAMPLE_KEY, "actual_return", "predicted_return", "actual_direction", "predicted_direction"]
    moved = t.base.withColumn("actual_return", F.when(F.dayofmonth("target_date") == 5, F.col("actual_return") * 1.5).otherwise(F.col("actual_return")))
    return table_diff(moved.select(*cols), t.base.select(*cols), list(C.FORECAST_KEY)).select("column", "n_mismatch")


@query("c9_verify_tables", "SELECT 'base' AS \"table\", unnest(['key', 'actual_return']) AS \"column\", unnest([k, v]) AS n_mismatch FROM (SELECT count(*) FILTER (day(target_date) = 6) AS k, count(*) FILTER (day(target_date) = 5 AND actual_return <> 0) AS v FROM base) UNION ALL SELECT 'macro', unnest(['key', 'mae', 'skill']), unnest([0, 0, count(*) FILTER (fold = 'D1' AND skill IS NOT NULL)]) FROM macro WHERE model = 'plain'")
def _(t):
    made = {"base": t.base.select(*C.FORECAST_KEY, "actual_return"), "macro": t.macro.where("model = 'plain'").select("fold", "mae", "skill")}
    root = artifacts.shared_root(t.spark)
    stored = {k: t.spark.read.parquet(artifacts.write_once(v, root, k)) for k, v in made.items()}
    moved = {
        "base": stored["base"].where("day(target_date) <> 6").withColumn("actual_return", F.when(F.dayofmonth("target_date") == 5, F.col("actual_return") * 1.5).otherwise(F.col("actual_return"))),
        "macro": stored["macro"].withColumn("skill", F.when(F.col("fold") == "D1", F.col("skill") + 1).otherwise(F.col("skill"))),
    }
    return reports.verify_tables(moved, made, {"base": C.FORECAST_KEY, "macro": ["fold"]}).select("table", "column", "n_mismatch")


@query("c10_extremes", "SELECT model, arg_max(fold || '|' || asset, (skill_std, fold || '|' || asset)) AS largest, max(skill_std) AS largest_value, arg_min(fold || '|' || asset, (skill_std, fold || '|' || asset)) AS smallest, min(skill_std) AS smallest_value FROM seed_cells GROUP BY model", "largest_value smallest_value")
def _(t):
    return reports.extremes(reports.seed_stability(metrics.seed_summary(t.cells.where("seed IS NOT NULL"), SEEDS)))


@query("c11_chart_contrasts", "SELECT model, dimension, quantile_cont(CASE WHEN status = 'reportable' THEN skill_change END, 0.5) AS median, count(*) FILTER (status = 'reportable' AND skill_change < 0) AS n_negative, count(skill_change) FILTER (status = 'reportable') AS n_reportable, count(*) AS n_cells FROM contrasts GROUP BY model, dimension", "median")
def _(t):
    return reports.chart_contrasts(t.contrasts)


@query("c11_macro_series", "SELECT model, fold, avg(skill) AS skill, avg(da_diff) AS da_diff FROM macro GROUP BY model, fold", "skill da_diff")
def _(t):
    return reports.chart_series(t.macro, ("model", "fold"))


@query("c11_asset_cells", "SELECT model, fold, asset, avg(skill) AS skill, avg(da_diff) AS da_diff FROM cells GROUP BY model, fold, asset", "skill da_diff")
def _(t):
    return reports.chart_series(t.cells, ("model", "fold", "asset"))


@query("c11_reportability", "SELECT level, model, count(*) FILTER (status = 'reportable') AS n_reportable, count(*) AS n FROM (SELECT 'asset' AS level, model, status FROM contrasts UNION ALL SELECT 'macro', model, status FROM mcontrasts) GROUP BY level, model")
def _(t):
    return reports.chart_reportability({"asset": t.contrasts, "macro": t.mcontrasts})


# sequences
@query("f13_windows", "SELECT asset, origin_date, CASE WHEN count(*) OVER w = 5 AND sum(fine) OVER w = 5 THEN 1 ELSE 0 END AS usable, CASE WHEN count(*) OVER w = 5 AND sum(fine) OVER w = 5 THEN round(sum(CAST(CAST(ret AS FLOAT) AS DOUBLE)) OVER w, 6) + 0.0 END AS total FROM (SELECT *, CASE WHEN " + " AND ".join(f"{f} IS NOT NULL" for f in C.FEATURES) + " THEN 1 ELSE 0 END AS fine FROM sup) WINDOW w AS (PARTITION BY asset ORDER BY origin_date ROWS 4 PRECEDING)")
def _(t):
    total = F.aggregate("seq", F.lit(0.0), lambda a, row: a + row[0].cast("double"))
    return sequences.windows(t.sup, 5).select("asset", "origin_date", "usable", F.round(total, 6).alias("total"))


@query("f14_patches", "SELECT asset, origin_date, 3 AS n_patches, round(CAST(CAST(lag(ret, 5) OVER w AS FLOAT) AS DOUBLE), 6) + 0.0 AS first_value, round(CAST(CAST(ref_trend_63 AS FLOAT) AS DOUBLE), 6) + 0.0 AS last_value FROM (SELECT *, count(*) OVER v AS k, sum(CASE WHEN " + " AND ".join(f"{f} IS NOT NULL" for f in C.FEATURES) + " THEN 1 ELSE 0 END) OVER v AS fine FROM sup WINDOW v AS (PARTITION BY asset ORDER BY origin_date ROWS 7 PRECEDING)) WINDOW w AS (PARTITION BY asset ORDER BY origin_date) QUALIFY k = 8 AND fine = 8")
def _(t):
    p = sequences.patches(F.col("seq"), 8, 4, 2, len(C.FEATURES))
    made = sequences.windows(t.sup, 8).where("usable = 1").select("asset", "origin_date", p.alias("p"))
    made = made.select("asset", "origin_date", F.size(F.col("p")[0]).alias("n_patches"), F.col("p")[0][1][0].cast("double").alias("first_value"), F.element_at(F.element_at(F.element_at("p", -1), -1), -1).cast("double").alias("last_value"))
    return made.withColumns({c: F.round(c, 6) for c in ("first_value", "last_value")})


@query("f15_scaler", "SELECT fold, asset, 'selection' AS usage, feature, avg(x) AS mean, var_pop(x) AS var, CASE WHEN var_pop(x) = 0 THEN 1 ELSE sqrt(var_pop(x)) END AS scale, count(x) AS n FROM (" + " UNION ALL ".join(f"SELECT fold, asset, '{f}' AS feature, {f} AS x FROM slices WHERE partition = 'train'" for f in C.FEATURES) + ") GROUP BY fold, asset, feature", "mean var scale", 6)
def _(t):
    return moments.fold_scalers(t.sup.where("eligible = 1"), t.folds)


@query("f16_scaled", "SELECT fold, asset, count(*) AS n, round(avg((ret - m) / s), 4) + 0.0 AS mean_z FROM (SELECT fold, asset, ret FROM dev WHERE partition = 'validation') JOIN (SELECT fold, asset, avg(ret) AS m, stddev_pop(ret) AS s FROM dev WHERE partition = 'train' GROUP BY fold, asset) USING (fold, asset) GROUP BY fold, asset")
def _(t):
    ends = t.dev.where("partition = 'validation'").select("fold", "partition", *C.SAMPLE_KEY)
    z = sequences.apply_scaler(sequences.endpoint_windows(t.sup, ends, 5).where("usable = 1"), sequences.fit_scaler(t.dev))
    last = F.element_at(F.element_at("seq", -1), 1).cast("double")
    return z.groupBy("fold", "asset").agg(F.count("*").alias("n"), F.avg(last).alias("z")).select("fold", "asset", "n", F.round("z", 4).alias("mean_z"))


@query("f17_endpoints", "SELECT fold, partition, asset, length, CAST(sum(u) AS BIGINT) AS n_usable, count(*) FILTER (u = 0) AS n_omitted, CASE WHEN min(sum(u)) OVER (PARTITION BY fold, partition, asset) = max(sum(u)) OVER (PARTITION BY fold, partition, asset) THEN 1 ELSE 0 END AS all_agree FROM (SELECT a.fold, a.partition, asset, length, CASE WHEN length = 5 THEN u5 ELSE u21 END AS u FROM slices a JOIN (SELECT asset, origin_date, CASE WHEN sum(fine) OVER (PARTITION BY asset ORDER BY origin_date ROWS 4 PRECEDING) = 5 THEN 1 ELSE 0 END AS u5, CASE WHEN sum(fine) OVER (PARTITION BY asset ORDER BY origin_date ROWS 20 PRECEDING) = 21 THEN 1 ELSE 0 END AS u21 FROM (SELECT *, CASE WHEN " + " AND ".join(f"{f} IS NOT NULL" for f in C.FEATURES) + " THEN 1 ELSE 0 END AS fine FROM sup)) USING (asset, origin_date), (VALUES (5), (21)) l(length)) GROUP BY fold, partition, asset, length")
def _(t):
    return sequences.endpoint_counts(t.sup, t.slices, (5, 21))


# the flagship: naive forecasts, scored by fold and asset with equal weight over assets
_FLAG = "SELECT fold, asset, count(*) AS n, avg(abs(predicted_return - actual_return)) AS mae, sqrt(avg((predicted_return - actual_return) ** 2)) AS rmse, avg(CAST(predicted_direction = actual_direction AS INT)) AS da FROM base GROUP BY fold, asset"


@query("flagship", f"SELECT * FROM ({_FLAG}) UNION ALL SELECT fold, 'ALL', CAST(sum(n) AS BIGINT), avg(mae), avg(rmse), avg(da) FROM ({_FLAG}) GROUP BY fold HAVING count(*) = 3", _ERR)
def flagship(t: Tables) -> DataFrame:
    by = metrics.error_metrics(t.base)
    macro = metrics.macro_metrics(by, len(ASSETS), ("fold",), ("mae", "rmse", "da"))
    return by.unionByName(macro.where("n_assets = 3").select("fold", F.lit("ALL").alias("asset"), "n", "mae", "rmse", "da"))
