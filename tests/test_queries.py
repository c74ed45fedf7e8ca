"""Every query with SQL against DuckDB on the smallest tables, and the others for rows."""

import duckdb
import pytest

from cadenza.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(name, spark, sf_dir, duck):
    own, other = QUERIES[name].run(spark, sf_dir).toPandas(), duck.execute(QUERIES[name].sql).fetch_df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_has_rows(name, spark, sf_dir):
    assert QUERIES[name].run(spark, sf_dir).limit(1).count() == 1
