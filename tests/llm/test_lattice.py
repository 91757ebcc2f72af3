import duckdb
import numpy as np
import pytest

from larkspur.llm import lattice


def near_pairs(dim, cosine, count, seed=8):
    """Unit vectors and, for each, one at exactly this cosine."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, w = unit(r.standard_normal((count, dim))), r.standard_normal((count, dim))
    w = unit(w - (w * a).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * w


@pytest.mark.parametrize("dim", [16, 64, 768])
@pytest.mark.parametrize("step", range(len(lattice.STEPS)))
def test_recall_of_each_step(dim, step):
    """The share of pairs at the threshold itself that meet in some cell, for every number of rows."""
    a, b = near_pairs(dim, lattice.COSINE, 1000)
    t = lattice.Tables(dim, *lattice.STEPS[step][1:])
    label = np.zeros(len(a), np.int64)
    ka, kb = t.keys(a, label), t.keys(b, label)
    met = ((ka[:, :, :1] == kb) | (kb[:, :, :1] == ka)).any(axis=(1, 2))
    assert met.mean() >= 0.97


def test_candidates_grow_with_the_rows():
    """Meetings of unrelated vectors per vector stay few at the most rows of the first step."""
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = lattice.Tables(64, *lattice.STEPS[0][1:]).keys(x, np.zeros(len(x), np.int64)).reshape(len(x), -1)
    _, n = np.unique(keys, return_counts=True)
    share = (n * (n - 1) / 2).sum() / (len(x) * (len(x) - 1) / 2)
    assert share * lattice.STEPS[0][0] < 100


@pytest.mark.parametrize("step", [0, 1])
def test_against_sql_on_vectors_that_link(spark, tmp_path, step):
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 32))
    x = np.concatenate([centres[i % 40 : i % 40 + 1] + 0.12 * r.standard_normal((1, 32)) for i in range(400)]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 40 % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(lattice.SQL).fetchall()
    assert sum(w[1] for w in want) > 1000 and len({w[2] for w in want}) < 300
    got = lattice.near_vectors(df, steps=((1 << 62, *lattice.STEPS[step][1:]),))
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(want)


def test_rows_that_repeat_or_lack_an_id(spark):
    a, b = near_pairs(8, 0.99, 4)
    v = lambda x, i: [float(c) for c in x[i]]
    rows = [(None, v(a, 0), 1), (None, v(a, 1), 1), (5, v(b, 0), 1), (None, v(a, 2), 1), (7, v(a, 3), 1), (7, v(b, 2), 1), (6, v(b, 3), 1), (8, v(a, 3), 2)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, class long")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in lattice.near_vectors(df).collect())
    assert got == sorted([("None", 1, "5"), ("None", 0, "None"), ("5", 1, "5"), ("None", 1, "7"), ("7", 1, "6"), ("7", 1, "7"), ("6", 1, "6"), ("8", 0, "8")])
