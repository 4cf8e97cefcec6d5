import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["flagship", "s10_drift", "q5_calendar_gaps", "f9_supervised_checked", "f10_eligibility_stats", "f14_patches", "g7_macro", "r2_thresholds", "x6_contrasts", "x10_failure_patterns", "c9_verify_tables", "s7_fingerprint", "s10_tree"]


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else f"{float(r[i])!r}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), [c[0] for c in cur.description])


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["fold", "asset", "n", "mae", "rmse", "da"]
