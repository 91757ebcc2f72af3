"""What the hashes and the splitting of long texts must not do."""

import numpy as np
import pytest

from larkspur.llm import blocks as B, bpe, jaccard, substring_dedup, suffix_dedup


def parity_words(n=1024):
    """Two words that every power series modulo 2**64 hashes alike."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[o] for o in odd), "".join("ba"[o] for o in odd)


def test_parity_words_differ(spark):
    one, two = parity_words()
    common = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {common}"), (2, f"{two} {common}"), (3, f"{one} {common}")], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 20}
    short = spark.createDataFrame([(1, f"{one} a b c d"), (2, f"{two} a b c d"), (3, f"{one} A b c d")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_components(short).collect()} == {1: 1, 2: 2, 3: 1}
    strings = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    starts = {one.encode()[i : i + 50] for i in range(len(one) - 49)}
    gone = bytearray(len(two))
    for i in range(len(two) - 49):
        if two.encode()[i : i + 50] in starts:
            gone[i : i + 50] = b"\1" * 50
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(strings).collect()} == {1: 0, 2: sum(gone), 3: len(one)}


def block(*texts):
    bodies = [t.encode() for t in texts]
    return B.Block.unpack(B.Block.pack(list(range(len(bodies))), bodies))


def test_words_of_equal_bytes_and_length_only():
    r = np.random.default_rng(2)
    words = sorted({bytes(r.choice([97, 98, 0xC3, 1], r.integers(1, 40))).replace(b"\xc3", b"\xc3\xa9").decode() for _ in range(4000)} | {"a" * n for n in range(1, 40)})
    x, y, edges = B.words_of(block(" ".join(words)), second=True)
    assert len(x) == len(words) == edges[1] and len(set(zip(x.tolist(), y.tolist(), strict=True))) == len(words) == len(set(x.tolist()))
    lower, _, _ = B.words_of(block("ÀB ab AB", "Ab"), lower=True)
    assert lower[1] == lower[2] == lower[3] != lower[0]


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_long_texts_in_parts(monkeypatch, chunk):
    """Texts beyond the limits give what they give as a whole."""
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ab é\n日"), n)) for n in (3000, 0, 5, 700, 2500)] + ["x" * 900]
    whole = block(*texts)
    words, pieces = B.words_of(whole, second=True), suffix_dedup.Pieces(whole, 50, 20)
    monkeypatch.setattr(B, "CHUNK", chunk)
    for a, b in zip(words, B.words_of(whole, second=True), strict=True):
        assert (a == b).all()
    if chunk >= 64:
        split = suffix_dedup.Pieces(whole, 50, 20)
        windows = lambda p: {(s, p.at[i]) for i in range(len(p.at)) for s in range(p.lo[i], p.hi[i] + 1)}
        assert windows(split) == windows(pieces)
    monkeypatch.setattr(bpe, "SLICE", chunk)
    e = bpe.encoder(bpe.default_tokenizer())
    for t in texts:
        n, _, decoded = bpe.digests(e, t)
        assert n == len(e.encode(t)) and decoded == __import__("hashlib").sha256(t.encode()).hexdigest()


def test_pieces_of_one_hash_are_told_apart_by_their_bytes():
    b = block("a" * 60, "a" * 59 + "b", "a" * 60, "c" * 60, "a" * 59 + "b")
    p = suffix_dedup.Pieces.__new__(suffix_dedup.Pieces)
    p.lo, p.hi, p.at = (np.arange(5) * 60 for _ in range(3))
    p.hi = p.lo + 10
    p.hash, p.piece, p.doc = np.zeros(5, np.uint64), np.zeros(5, np.uint64), np.arange(5)
    chosen, unique, inverse = suffix_dedup._distinct(b.buf, p, np.ones(5, bool), 50)
    assert chosen.tolist() == [0, 1, 2, 3, 4] and sorted(unique.tolist()) == [0, 1, 3]
    assert [unique[i] for i in inverse] == [0, 1, 0, 3, 1]


def test_shingles_of_one_first_hash():
    one, two = np.array([5, 5, 5, 2], np.uint64), np.array([1, 2, 1, 9], np.uint64)
    a = jaccard.distinct_hashes(one, two)
    assert a[0].tolist() == [2, 5, 5] and a[1].tolist() == [9, 1, 2]
    assert jaccard.shared_hashes(a, a) == 3 and jaccard.shared_hashes(a, (np.array([5], np.uint64), np.array([2], np.uint64))) == 1
    assert jaccard.shared_hashes((one[:1], two[:1]), (one[1:2], two[1:2])) == 0
