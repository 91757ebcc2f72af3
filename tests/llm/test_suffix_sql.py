"""Operator 4 against SQL on the smallest tables; on larger ones the SQL takes minutes, so it is not registered."""

import duckdb

from larkspur.llm import suffix_dedup

DATA = "/root/testdata/sf0.001"
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM w JOIN d USING (doc_id)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING count(*) > 1),
l AS (SELECT doc_id, i FROM s JOIN f USING (g) WHERE doc_id > first),
b AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM l),
r AS (SELECT b.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p.i IS NULL) AS n_spans FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.i = b.i - 1 GROUP BY b.doc_id),
k AS (SELECT x.doc_id, string_agg(substr(h, 2 * x.i + 1, 2), '' ORDER BY x.i) AS kept FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d JOIN r USING (doc_id)) x ANTI JOIN b ON b.doc_id = x.doc_id AND b.i = x.i GROUP BY x.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT), CAST(coalesce(n_removed, 0) AS BIGINT), CAST(coalesce(n_spans, 0) AS BIGINT), sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(kept, '') END))
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(SQL).fetchall()
    assert sum(w[2] for w in want) > 1000
    assert sorted(map(tuple, suffix_dedup.op4_suffix_array_dedup(spark, DATA).collect())) == sorted(want)
