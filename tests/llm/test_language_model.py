"""The conditional random field against sums over all sequences of labels."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_id


def all_sequences(emit, move):
    """Shares of all label sequences of one text, whose first label follows any label alike."""
    n, k = emit.shape
    ways = list(itertools.product(range(k), repeat=n))
    size = np.array([
        np.exp(sum(emit[t, y[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:]))) * np.mean(np.exp(move[:, y[0]]))
        for y in ways
    ])
    return ways, size / size.sum()


def expectations(emit, move):
    n, k = emit.shape
    label, pair = np.zeros((n, k)), np.zeros((k, k))
    for y, p in zip(*all_sequences(emit, move)):
        for t in range(n):
            label[t, y[t]] += p
        for a, b in zip(y, y[1:]):
            pair[a, b] += p
    return label, pair


def plain_training(pieces, rounds):
    """The same steps, with each word's features one by one and all sequences summed up."""
    labels = sorted({lang for _, lang in pieces})
    k, step = len(labels), {}
    weights, seen = {}, {}
    move, seen_move = np.zeros((k, k)), np.full((k, k), 1e-6)
    uses = {w: Counter(language_id.features([w], {})[0].tolist()) for words, _ in pieces for w in words}
    for _ in range(rounds):
        grad, grad_move = {f: -0.02 * weights[f] for f in weights}, -0.02 * move
        for words, lang in pieces:
            gold = labels.index(lang)
            emit = np.array([sum((c * weights.get(f, np.zeros(k)) for f, c in uses[w].items()), np.zeros(k)) for w in words])
            label, pair = expectations(emit, move)
            for t, w in enumerate(words):
                for f, c in uses[w].items():
                    grad[f] = grad.get(f, np.zeros(k)) + c * (np.eye(k)[gold] - label[t])
            grad_move = grad_move - pair
            grad_move[gold, gold] += len(words) - 1
        for f, g in grad.items():
            seen[f] = seen.get(f, np.full(k, 1e-6)) + g**2
            weights[f] = weights.get(f, np.zeros(k)) + 0.3 * g / np.sqrt(seen[f])
        seen_move += grad_move**2
        move = move + 0.1 * grad_move / np.sqrt(seen_move)
    return labels, weights, move


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_training_steps_against_all_sequences(monkeypatch, rounds):
    monkeypatch.setattr(language_id, "ROUNDS", rounds)
    monkeypatch.setattr(language_id, "LEXICON_LEAST", 100)  # three pieces: no lexicon, and none inside another
    pieces = [("the cat sat on it".split(), "en"), ("die katze saß".split(), "de"), ("le chat est là".split(), "fr")]
    model = language_id.train(pieces)
    labels, weights, move = plain_training(pieces, rounds)
    assert model.labels == labels and not model.lexicon
    assert np.allclose(model.move, move, atol=1e-6)
    met = sorted(weights)
    assert np.allclose(model.weights[met], [weights[f] for f in met], atol=1e-5)
    rest = np.delete(model.weights, met, axis=0)
    assert not rest.any() and len(met) > 50


def test_predictions_against_all_sequences(spark):
    r = np.random.default_rng(11)
    k = 3
    model = language_id.Model(["a", "b", "c"], r.normal(size=(language_id.BUCKETS, k)).astype(np.float32) * 0.4, r.normal(size=(k, k)), {"cat": 1, "chat": 4, "katze": 3})
    texts = ["the cat", "Katze, chat & cat", "l'été 3x", "日本 語", "one", "a b c d e f g", "the cat sat on the chat", "42 !", "", None, "cat cat cat"]
    got = {x["doc_id"]: x for x in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()}
    for i, text in enumerate(texts):
        words = language_id.WORD.findall((text or "").lower())
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["n_words"]) == ("und", 0.0, 0)
            continue
        emit = np.array([language_id.summed(model.weights, *language_id.features([w], model.lexicon), 1)[0] for w in words])
        label, _ = expectations(emit, model.move)
        share = np.array([len(w) for w in words]) @ label / sum(map(len, words))
        best = label.argmax(1)
        assert np.allclose(got[i]["mix"], share, atol=1e-5) and got[i]["lang_pred"] == "abc"[share.argmax()] and abs(got[i]["score"] - share.max()) < 1e-5
        assert (got[i]["n_words"], got[i]["n_switches"]) == (len(words), int((best[1:] != best[:-1]).sum()))
