"""The driver's entry module: it imports without a session, and its queries match their SQL on the smallest tables."""

import subprocess
import sys

import duckdb
import pytest

from lumenfold.plans import catalog, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not set(e.oracle_sql()) - set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def plain(value):
    return None if value is None or value != value else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    show = lambda df: sorted(tuple(map(str, map(plain, row))) for row in df[columns].astype(object).itertuples(index=False))
    assert show(got) == show(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_gives_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_step_up_on_the_bound(spark, tmp_path):
    """Values that equal the bound but for its rounding, and null values, are placed as SQL places them."""
    rows = [(13, 1, 100.0), (20, 1, 100.0), (27, 1, 100.0), (6, 2, None), (13, 2, 1.0), (20, 2, 250.0), (34, 3, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["fdr_step_up"]).fetchall()
    found = registry.queries()["fdr_step_up"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(want) == [(1, None, 0), (2, 0.002, 1), (3, None, 0)]
