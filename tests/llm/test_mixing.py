import duckdb
import pytest

from larkspur.llm import mixing


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_against_sql_and_near_the_targets(spark, size):
    data = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = [tuple(r) for r in mixing.op3_mixing(spark, data).collect()]
    assert sorted(got) == sorted(con.sql(mixing.SQL).fetchall())
    source = dict(con.sql("SELECT doc_id, source FROM documents").fetchall())
    taken, largest, target = {}, {}, {}
    for i, words, _, goal, n, _ in got:
        s = source[i]
        taken[s], largest[s], target[s] = taken.get(s, 0) + n, max(largest.get(s, 0), words), goal
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s]) for s in taken)


def test_draws_take_each_document_with_the_fraction_as_probability(spark, monkeypatch):
    """Over many seeds, a document is taken as often as its source's rate says, whatever its size."""
    rows = [(i, "w " * (1 + i * i % 37), "a" if i % 3 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    scratch = mixing.Scratch(spark, "seeds")
    total: dict = {}
    for seed in range(6):
        sized = mixing.sizes(docs, seed=seed).cache()
        for r in mixing.with_plan(sized, mixing.plan_mix(sized, scratch, seed=seed)).collect():
            at = total.setdefault(r.doc_id, [0, r.rate])
            at[0] += r.copies
    assert all(int(rate) * 6 <= n <= -(-rate // 1) * 6 for n, rate in total.values())
    for part in (sorted(total)[:20], sorted(total)[20:]):
        assert abs(sum(total[i][0] / 6 - total[i][1] for i in part)) < 0.15 * len(part)


def test_mixed_rows_keep_all_columns_whatever_their_names(spark):
    names = ["doc_id", "text", "source", "row", "copy", "copies", "skey", "bin", "draw", "size", "rate", "last", "salt", "_mix_copies"]
    rows = [(i if i % 4 else None, None if i == 3 else "w " * (i % 5), None if i % 7 == 0 else "s", *range(i, i + len(names) - 3)) for i in range(30)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in names[3:]))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == names and mixed.dtypes == docs.dtypes
    assert {tuple(r) for r in mixed.collect()} <= set(rows)
    assert mixed.count() == sum(r.copies for r in mixing.mix_sizes(docs).collect()) > 0
