"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest
from surveyloom.plans import queries as q
from surveyloom.plans import crawl_queries, file_queries, survey_queries  # noqa: F401  (these add their queries)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canon(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(spark, small, con, name):
    df = q.QUERIES[name](spark, small)
    got = con.execute(q.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(tuple(r[c] for c in sorted(names)) for r in df.collect()) == canon(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in got.fetchall())


def test_flagship(spark, small):
    rows = q.flagship(spark, small).collect()
    assert len(rows) == 5
    assert abs(sum(r.share for r in rows) - 1) < 1e-9
    assert all(r.low <= r.high and r.se > 0 for r in rows)


def test_share_guarded_takes_all_levels(spark, tmp_path):
    rows = [(k, "FOP"[k % 3], f"level {k % 150}") for k in range(900)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = q.QUERIES["share_guarded"](spark, str(tmp_path))
    got = c.execute(q.ORACLE["share_guarded"])
    names = [d[0] for d in got.description]
    assert df.count() == 600
    assert canon(tuple(r[n] for n in names) for r in df.collect()) == canon(got.fetchall())
