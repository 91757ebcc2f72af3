import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from larkspur.llm import bpe, exact_dedup, jaccard, lattice, mixing, quality, substring_dedup, suffix_dedup, token_counts, toxicity

DOCS = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("n", T.LongType()), ("k", T.StringType()), ("size", T.LongType()), ("score", T.LongType()), ("_norm", T.StringType()))])
sha = lambda b: hashlib.sha256(b).hexdigest()


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None, str | None]]:
    """Copies, near copies, shared passages, white space variants, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé🙂Z") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(40))
    out: list = [(1000, None, None), (1001, "", "a"), (1002, " \n\t", None), (1003, "One two", "b"), (1004, "one TWO", "b"), (1005, "z " * 30_000, "c"), (1006, "y" * 3000, "c"), (1007, "\u0085 x y", "c")]
    for i in range(n):
        text = " ".join(word() for _ in range(r.choice((3, 25, 60, 200))))
        out.append((i, text + (" " + passage + "\n" + word() if i % 3 == 0 else ""), r.choice("abc")))
    for i in range(n // 2):
        words = out[8 + r.randrange(n)][1].split(" ")
        if r.random() < 0.6:
            words[r.randrange(len(words))] = word()
        out.append((n + i, r.choice((" ", " ", "  ")).join(words), r.choice(("a", None))))
    return [*out, out[9], (None, out[10][1], "a")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, 7, "clash", 8, 9, "clash") for x in rows], DOCS).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


last = lambda i: (i is None, i or 0)


def key(r):
    return [(x is None, str(x)) for x in r]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    extra = [(2000, "a<|endoftext|> b 's'LL  　x\x1c 123\n\n"), (2001, "ab" * 50_000)]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))).collect()}
    want = set()
    for i, x in [*((r[0], r[1]) for r in rows), *extra]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert got == want and bpe.encode_documents(empty).count() == 0
    e = bpe.encoder(bpe.default_tokenizer())
    texts = [b.decode() for b in e.tokens if b == b.decode("utf-8", "ignore").encode()]
    assert len(texts) > 40_000 and all(e.encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)
    one = bpe.token_ids(docs).where("doc_id = 1003").first()
    assert bpe.encoder(bpe.default_tokenizer()).decode(np.array(one.ids)) == b"One two"


def test_token_counts(docs, rows, empty):
    e = bpe.encoder(bpe.default_tokenizer())
    lens = sorted(len(e.encode(r[1] or "")) for r in rows)
    sums = token_counts.suffix_sums(token_counts.lengths(docs)).cache()
    for r in sums.collect():
        assert r.n_docs == lens.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in lens) and r.tokens_at_least == sum(x for x in lens if x >= r.n_tokens)
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in lens) and r.docs_below == sum(x < r.n_tokens for x in lens) and r.tokens_total == sum(lens)
    for limit in (0, 17, 10**6):
        assert token_counts.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lens)
    assert token_counts.quantile(sums, 0.5).first().n_tokens == lens[-(-len(lens) // 2) - 1]
    assert token_counts.suffix_sums(token_counts.lengths(empty)).count() == 0


def test_mixing(docs, rows, empty, monkeypatch):
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free, left = free - over, left - sum(2.0 * sizes[s] for s in over)
    source = {(r[0], len(words(r[1]))): r[2] for r in rows}
    got = sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=key)
    for i, size, source_size, goal, taken, _ in got:
        s = source[i, size]
        assert source_size == sizes[s] and goal == pytest.approx(target[s]) and taken <= 2 * size
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert size * int(rate) <= taken <= size * -(-rate // 1)
    assert got == sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=key)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # the salted join
    assert got == sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=key)
    assert mixing.mix_documents(docs).columns == docs.columns and mixing.mix_documents(docs).count() == sum(r[5] for r in got)
    assert mixing.mix_sizes(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    ids = sorted({last(r[0]) for r in rows})
    first: dict = {}
    for i, t, _ in sorted(rows, key=lambda r: last(r[0])):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], ids.index(last(i)))
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < ids.index(last(i)):
                gone[s : s + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=key) == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_columns_order():
    """The column rounds give the order and common prefixes that sorting gives."""
    table = np.random.default_rng(3).integers(97, 99, (200, 30)).astype(np.uint8)
    for column, order, common in suffix_dedup.columns(table, 10, 20):
        suffix = [table[i, column:].tobytes() for i in order]
        assert suffix == sorted(suffix)
        for i in range(1, 200):
            same = next((k for k, (a, b) in enumerate(zip(suffix[i - 1], suffix[i], strict=True)) if a != b), len(suffix[i]))
            assert common[i] == min(same, 20)


def test_substring_dedup(docs, rows, empty):
    order = sorted(range(len(rows)), key=lambda j: (last(rows[j][0]), (rows[j][1] or "").encode()))
    first: dict = {}
    for j in order:
        w = words(rows[j][1])
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (j, s))
    want = []
    for j, (i, t, _) in enumerate(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (j, s):
                gone[s : s + 20] = [True] * 20
        want.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=key) == sorted(want, key=key)
    assert substring_dedup.remove_repeats(empty).count() == 0


def exact_want(rows):
    groups: dict = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), last(i), i))
    out = []
    for t, g in groups.items():
        keep = min(g)[2]
        out += [(i, keep, len(g), i == keep, sha(t.encode())) for _, _, i in g]
    return sorted(out, key=key)


def test_exact_dedup(docs, rows, empty):
    assert sorted(map(tuple, exact_dedup.dedup(docs, memtable=7).collect()), key=key) == exact_want(rows)
    assert exact_dedup.dedup(empty).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[4] for r in exact_want(rows)})


def test_exact_dedup_with_index_too_large_to_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, exact_dedup.dedup(docs).collect()), key=key) == exact_want(rows)


def test_exact_dedup_with_colliding_digests(docs, rows):
    one = F.unhex(F.lpad(F.hex(F.length("_norm") % 3), 64, "0"))
    assert sorted(map(tuple, exact_dedup.dedup(docs, digest=one).collect()), key=key) == exact_want(rows)


def test_jaccard(docs, rows, empty):
    sets: dict = {}
    listed = []
    for i, t, _ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        listed.append((i, len(s)))
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = sorted((find(a), find(b)), key=last)
            root[y] = x
    assert sorted(map(tuple, jaccard.near_components(docs).collect()), key=key) == sorted(((i, n, find(i)) for i, n in listed), key=key)
    assert jaccard.near_components(empty).count() == 0


def test_lattice(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * r.standard_normal((30, 16)), base[:10] * 3, base[:5], base[:5]])
    data = [(i, [float(v) for v in np.float32(x[i])], int(i % 30 % 3)) for i in range(len(x))]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, data[0][1], None), (905, [], 1), (906, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in data + bad], "vec_id long, embedding array<float>, label int, id long, class string")
    v = np.array([d[1] for d in data], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.array([d[2] for d in data])[:, None] == np.array([d[2] for d in data])[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(data))
    for _ in data:
        comp = np.minimum(comp, np.where(near, comp[None, :], len(data)).min(axis=1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(data))} | {b[0]: (0, b[0], True) for b in bad}
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_lattice_decodes_to_the_nearest_point():
    r = np.random.default_rng(6)
    x = r.standard_normal((300, 8)) * 2
    p = lattice.nearest_e8(x)
    assert ((2 * p).round() == 2 * p).all() and (p.sum(axis=1) % 2 == 0).all() and len(lattice.neighbours()) == 240
    around = ((x[:, None, :] - p[:, None, :] - lattice.neighbours()[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - p) ** 2).sum(axis=1) <= around + 1e-12).all()


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity.op6_toxicity, "toxic", 0.93), (quality.op8_quality, "quality", 0.97)])
def test_classifiers(spark, op, label, least):
    data = "/root/testdata/sf0.01"
    got = op(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    assert len(got) > 40 and sum(r[0] == r[1] for r in got) / len(got) >= least


def test_classifiers_on_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for known in (labels, labels.limit(0)):
            scored = module.score_documents(docs, module.train(docs, known)).collect()
            assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
        assert module.score_documents(empty, module.train(empty, labels)).count() == 0
