"""The driver's contract: names, columns and a sample of queries against their SQL twins."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ("bars_h1", "atr_rma", "session_levels", "confluence_impact", "roc_auc", "run_labels")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_twin_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_agree_with_sql(spark, database, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = database.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    text = lambda rows: sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(map(tuple, df.select(columns).collect())) == text(want.select(*columns).fetchall())
