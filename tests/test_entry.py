import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.6g}")
    return v


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["detect_email_spans", "detect_ipv4_values", "select_spans", "findings", "session_tokens", "highlight_segments", "bayes_scores", "check_china_id", "stream_tokens", "leak_rates"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    out = entry.queries()[name](spark, SMALL)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=str)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(x) for x in r) for r in con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()), key=str)
    assert got == want
