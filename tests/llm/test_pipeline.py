import pytest

import corpus_pipeline
from larkspur.llm import bpe, exact_dedup, jaccard, mixing, toxicity

DATA = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHES = ["row", "i", "s", "l", "n", "k", "copy", "copies", "skey", "bin", "draw", "size", "last", "salt", "body", "several", "stays", "kept", "keep_id", "digest", "_mix_copies", "_stay_id", "_norm", "score", "label"]


def test_pipeline_is_its_operators_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in toxicity.score_documents(docs, toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect() if r.score < 0.5}
    pdf = docs.where(docs.doc_id.isin(list(kept)))
    kept = {r.doc_id for r in exact_dedup.dedup(pdf).collect() if r.kept}
    pdf = pdf.where(docs.doc_id.isin(list(kept)))
    kept = {r.doc_id for r in jaccard.near_components(pdf).collect() if r.doc_id == r.component_id}
    pdf = pdf.where(docs.doc_id.isin(list(kept)))
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(pdf).collect()}
    want = sorted(tuple(r) for r in bpe.encode_documents(pdf).collect() for _ in range(copies[r.doc_id]))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """documents with null, blank and long texts, repeated and near rows, ids that repeat or are null, clashing columns."""
    long = " ".join(f"word{i}" for i in range(300_000))
    texts = [None, "", " \n", "one two three four five six seven", "one two three four five six  seven", "One two three four five six seven", long, long + " more", "ab", "you idiot", "plain words here"]
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all", "s"), (None, "no id at all", "s"), (None, None, None), (8, "another text of that id", "s")]
    folder = tmp_path_factory.mktemp("odd")
    names = ["doc_id", "text", "source", *CLASHES]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows], schema)
    docs.write.parquet(f"{folder}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    labels = spark.createDataFrame([(i, int(i == 9), 1) for i in range(11)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{folder}/some/labels.parquet")
    labels.limit(0).write.parquet(f"{folder}/none/labels.parquet")
    return folder, names, rows


def test_stages_on_odd_rows(spark, odd):
    folder, names, rows = odd
    docs = spark.read.parquet(f"{folder}/some/documents.parquet")
    known = {(r[0], r[1]) for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, f"{folder}/some")
        got = docs.collect()
        assert docs.columns == names and {(r["doc_id"], r["text"]) for r in got} <= known
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES)
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    assert (5, rows[5][1]) in kept["toxicity"] and len(kept["toxicity"]) >= len(rows) - 1
    short = [(i, t if t is None or len(t) < 100 else len(t)) for i, t in kept["exact_dedup"]]
    # 2: the longest of the blank ones; 4 has the longer original; no row twice
    assert sorted(short, key=str) == sorted([(2, " \n"), (4, rows[4][1]), (5, rows[5][1]), (6, len(rows[6][1])), (7, len(rows[7][1])), (8, "ab"), (8, rows[-1][1]), (10, rows[10][1]), (None, "no id at all"), *[x for x in short if x[0] == 9]], key=str)
    assert [i for i, t in kept["ngram_jaccard"] if t and t[:3].lower() in ("one", "wor")] in ([4, 6], [6, 4])
    assert (2, " \n") in kept["ngram_jaccard"]
    assert all(kept["mixing"].count(x) <= 2 for x in kept["mixing"])
    tokens = corpus_pipeline.STAGES[4][1](spark, docs, f"{folder}/some").collect()
    assert len(tokens) == len(kept["mixing"])


def test_pipeline_on_an_empty_table(spark, odd):
    folder, names, _ = odd
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    docs = spark.read.parquet(f"{folder}/none/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, f"{folder}/none").columns == names


def test_operators_on_odd_rows(spark, odd):
    """Every operator of texts on the same rows: one row per document, and no column of theirs is touched."""
    from larkspur.llm import quality, substring_dedup, suffix_dedup, token_counts

    folder, _, rows = odd
    docs, labels = (spark.read.parquet(f"{folder}/some/{t}.parquet") for t in ("documents", "labels"))
    assert token_counts.suffix_sums(token_counts.lengths(docs)).agg({"n_docs": "sum"}).first()[0] == len(rows)
    for got in (suffix_dedup.remove_repeats(docs), substring_dedup.remove_repeats(docs), quality.score_documents(docs, quality.train(docs, labels)), bpe.encode_documents(docs), mixing.mix_sizes(docs)):
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in rows)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed[6] == 0 and removed[7] == 300_000
    size = len(rows[6][1])
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}[7] == size
