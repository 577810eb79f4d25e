"""The fast forms of the two models against plain ones."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import langid as L
from tidemark.llm import toxicity as T


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(5)
    return {n: a.astype(np.float32) + rng.normal(0, 0.3, a.shape).astype(np.float32) for n, a in L.init(3, 8, rng).items()}


def test_fast_states_equal_the_forward_pass(network):
    x = np.random.default_rng(1).integers(0, 256, (L.STEPS, 37)).astype(np.uint8)
    for e, u in (("ef", "uf"), ("eb", "ub")):
        plain, _ = L.forward(network[e], network[u], x)
        assert np.abs(L.states_of(network[e], network[u], x) - plain.transpose(0, 2, 1)).max() < 1e-5


def plain_label(text, p):
    """Mean probabilities and the language of each byte, segment by segment and byte by byte."""
    total, best = np.zeros(3), []
    for i in range(0, len(text), L.STEPS):
        x = np.frombuffer(text[i:i + L.STEPS].ljust(L.STEPS), np.uint8)[:, None]
        hf, hb = L.forward(p["ef"], p["uf"], x)[0], L.forward(p["eb"], p["ub"], x[::-1])[0][::-1]
        for t in range(min(L.STEPS, len(text) - i)):
            q = L.softmax(hf[t, 0] @ p["of"] + hb[t, 0] @ p["ob"] + p["c"])
            total += q
            best.append(int(q.argmax()))
    return total / max(1, len(text)), best


def test_labels_equal_plain_ones(network):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc \xc3\xa9xyz") for _ in range(n)) for n in (0, 1, 63, 64, 65, 200, 1000, 3)]
    for batch in (3, 2048):
        prob, labels = L.label(texts, network, True, batch)
        for text, p, own in zip(texts, prob, labels, strict=True):
            want, best = plain_label(text, network)
            assert np.abs(p - want).max() < 1e-4
            assert len(own) == len(best) and sum(a != b for a, b in zip(own.tolist(), best, strict=True)) <= 0.01 * len(best)


@pytest.mark.parametrize("size", [1, 300, T.SLICE])
def test_scores_equal_a_plain_sum(spark, monkeypatch, size):
    """A score is the logistic of the bias and the weights of the text's distinct features, one by one."""
    monkeypatch.setattr(T, "SLICE", size)
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(40)] + [None, "", " \n", "unknown words only"]
    _, hashes = T.distinct_words([" ".join(words[:30]).encode()])
    vocabulary = np.unique(hashes)
    weights = np.random.default_rng(4).normal(size=len(vocabulary))
    table = dict(zip(vocabulary.tolist(), weights.tolist(), strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.score(df, (vocabulary, weights, -0.5)).collect():
        own = set(T.distinct_words([(texts[r.doc_id] or "").encode()])[1].tolist())
        want = 1 / (1 + math.exp(0.5 - sum(table.get(h, 0.0) for h in own)))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(want >= 0.5)


def test_linear_classifier_equals_gradient_descent():
    """Without words left out, the fit has the gradient of a plain logistic loss near zero."""
    rng = np.random.default_rng(6)
    present = rng.random((200, 5)) < 0.4
    q = 1 / (1 + np.exp(-(present @ np.array([2.0, -1.0, 0.5, 0.0, 1.0]) - 1)))
    owner, column = np.nonzero(present)
    before, T.KEPT = T.KEPT, 1.1
    try:
        w, b = T.linear(owner, column, 200, 5, q, np.ones(200), rounds=3000, penalty=0.0)
    finally:
        T.KEPT = before
    p = 1 / (1 + np.exp(-(present @ w + b)))
    assert np.abs(present.T @ (p - q) / 200).max() < 2e-3 and abs((p - q).mean()) < 2e-3 and np.abs(p - q).max() < 0.05
