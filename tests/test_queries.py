import duckdb
import pytest

from larkspur import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = q.queries()[name](spark, DATA), con.sql(q.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_name", "o_totalprice"]
    assert set(q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_join_int_float_takes_whole_tables(spark):
    con = duckdb.connect()
    orders = dict(con.sql(f"SELECT o_custkey, count(*) FROM '{DATA}/orders.parquet' GROUP BY 1").fetchall())
    lines = con.sql(f"SELECT l_quantity, count(*) FROM '{DATA}/lineitem.parquet' GROUP BY 1").fetchall()
    assert q.queries()["join_int_float"](spark, DATA).count() == sum(n * orders.get(int(x), 0) for x, n in lines if x == int(x)) > 0


def test_join_project_takes_whole_tables(spark):
    orders = {i: c for i, c in duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{DATA}/orders.parquet'").fetchall()}
    names = dict(duckdb.sql(f"SELECT c_custkey, c_name FROM '{DATA}/customer.parquet'").fetchall())
    got = {r.order_id: r.customer_name for r in q.queries()["join_project"](spark, DATA).collect()}
    assert got == {i: names[c] for i, c in orders.items() if c in names} and len(got) > 1000
