"""The chain against enumerating all paths, and its offsets."""

import itertools
import pickle

import numpy as np
import pytest

from larkspur.llm import quality, toxicity


def by_paths(e, move):
    """Marginals and expected steps of one chain by its 2**n paths."""
    n, total, marginal, pairs = len(e), 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(e[i] for i in range(n) if path[i]) + sum(move[a, b] for a, b in itertools.pairwise(path)))
        total += weight
        marginal += weight * np.array(path)
        for a, b in itertools.pairwise(path):
            pairs[a, b] += weight
    return marginal / total, pairs / total


@pytest.mark.parametrize("stretch", [3, 64])
def test_forward_backward_gives_what_all_paths_give(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    monkeypatch.setattr(toxicity, "STRETCHES", 2)
    r = np.random.default_rng(1)
    lens, move = [1, 7, 2, 11, 1, 5], r.standard_normal((2, 2)) * 2
    chains = [r.standard_normal(n) * 3 for n in lens]
    begins = np.concatenate([np.arange(n) == 0 for n in lens])
    marginal, pairs = toxicity.forward_backward(np.concatenate(chains), begins, move)
    want = [by_paths(c, move) for c in chains]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))


def test_gradient_is_that_of_the_likelihood():
    """Seen minus expected counts are the slope of the log likelihood over all paths."""
    m = toxicity.Chain.over({"bad": 0, "worse": 1})
    r = np.random.default_rng(2)
    for w in [*m.weights(), m.move]:
        w += r.standard_normal(w.shape) * 0.5
    texts, toxic = ["a bad day and worse", "bad is not so bad", "plain"], np.array([True, False, True])
    codes = [m.codes(t) for t in texts]

    def likelihood():
        out = 0.0
        for c, y in zip(codes, toxic, strict=True):
            used, _ = m.features([c])
            e = sum(w[u] for w, u in zip(m.weights(), used, strict=True))
            score = lambda p: sum(e[i] for i in range(len(p)) if p[i]) + sum(m.move[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            state = ((used[0] > 0) & y).astype(int)
            out += score(state) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=len(c))))
        return out

    sums, at = m.sums(codes, toxic), 0
    for w in [*m.weights(), m.move.reshape(-1)]:
        for i in range(len(w)):
            w[i] += 1e-5
            up = likelihood()
            w[i] -= 2e-5
            down = likelihood()
            w[i] += 1e-5
            assert sums[at + i] == pytest.approx((up - down) / 2e-5, abs=1e-5)
        at += 2 * len(w)


def spans_model():
    m = toxicity.Chain.over({"bad": 0, "i̇day": 1})
    m.emit[:] = -4.0, 6.0, 6.0, 0.0
    return m


def test_spans_where_lower_case_changes_the_length():
    m = pickle.loads(pickle.dumps(spans_model()))
    texts = ["É a Bad, word", "", "bad İday", "İ bad", "xbadx İx Bad", "bad day"]
    found = [[t[a:b] for a, b in s] for t, (_, _, s) in zip(texts, m.read(texts, True), strict=True)]
    assert found == [["Bad"], [], ["bad", "İday"], ["bad"], ["Bad"], ["bad"]]
    assert m.read([]) == [] and m.read([""]) == [(0.0, 0.0, [])]


def test_long_text_is_one_chain_however_it_is_split(monkeypatch):
    m = spans_model()
    m.move[:] = [[0.0, -1.0], [-0.5, 1.0]]
    text = " ".join(["some", "bad", "words", "İday", "here"] * 700)
    whole = m.read([text, "bad", text], True)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    monkeypatch.setattr(toxicity, "STRETCHES", 2)
    parts = m.read([text, "bad", text], True)
    for a, b in zip(whole, parts, strict=True):
        assert a[2] == b[2] and a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


def test_pair_loss_against_a_plain_gradient():
    """Bradley-Terry weights are where the slope of the ridged loss of all pairs vanishes."""
    r = np.random.default_rng(3)
    x = r.standard_normal((40, 3))
    better, worse = r.integers(0, 40, 300), r.integers(0, 40, 300)
    d = x[better] - x[worse]
    w = toxicity.logistic(d, np.ones(300), np.ones(300), ridge=2.0)
    loss = lambda v: np.log1p(np.exp(-(d @ v))).sum() + v @ v
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert (loss(w + step) - loss(w - step)) / 2e-5 == pytest.approx(0, abs=1e-4)
    plain = np.zeros(3)
    for _ in range(5000):
        plain -= 0.002 * (-(d * (1 / (1 + np.exp(d @ plain)))[:, None]).sum(axis=0) + 2 * plain)
    assert np.allclose(plain, w, atol=1e-3)


def test_scores_that_tie_at_the_quantile_fall_on_one_side():
    texts = ["good words of many kinds here", "good words of many kinds here", "| | | |", "| | | |"]
    x = np.array([quality.statistics(t) for t in texts])
    model = quality.fit(x, np.array([1, 1, 0, 0]), 200)
    s = model.score(x)
    assert s[0] == s[1] >= quality.THRESHOLD > s[2] == s[3]
