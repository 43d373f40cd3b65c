"""The classifiers against plain versions of themselves."""

import math
import random

import numpy as np
import pytest

from pagelore.llm import language_id, ngrams, toxicity


def plain_ftrl(rows, labels, k, alpha, beta, l1, l2, epochs, seed):
    z, n = {}, {}

    def weight(key):
        lasso = 0.0 if key[0] == "bias" else l1
        a = z.get(key, 0.0)
        return 0.0 if abs(a) <= lasso else -(a - math.copysign(lasso, a)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = {**dict(zip(*(v.tolist() for v in rows[i]), strict=True)), "bias": 1.0}
            w = {(f, c): weight((f, c)) for f in x for c in range(k)}
            e = [math.exp(sum(v * w[f, c] for f, v in x.items())) for c in range(k)]
            for c in range(k):
                d = e[c] / sum(e) - (labels[i] == c)
                for f, v in x.items():
                    g, key = d * v, (f, c)
                    sigma = (math.sqrt(n.get(key, 0.0) + g * g) - math.sqrt(n.get(key, 0.0))) / alpha
                    z[key] = z.get(key, 0.0) + g - sigma * w[key]
                    n[key] = n.get(key, 0.0) + g * g
    return weight


def test_ftrl_weights():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(30):
        at = sorted(rng.sample(range(40), 6))
        rows.append((np.array(at), np.array([rng.random() for _ in at])))
        labels.append(i % 3)
    setup = dict(alpha=0.7, beta=1.0, l1=0.05, l2=0.01, epochs=3, seed=4)
    w, bias = language_id.train_ftrl(rows, np.array(labels), 3, **setup)
    weight = plain_ftrl(rows, labels, 3, **setup)
    assert np.allclose(w[:40], [[weight((f, c)) for c in range(3)] for f in range(40)])
    assert np.allclose(bias, [weight(("bias", c)) for c in range(3)])
    assert (w[40:] == 0).all() and 0 < (w[:40] == 0).sum() < 120  # the elastic net leaves some out


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(300, 4)) * 5
    p = np.exp(logits / 2.5)
    labels = np.array([rng.choice(4, p=r / r.sum()) for r in p])
    nll = lambda t: -np.mean([(x / t)[y] - np.log(np.exp(x / t - (x / t).max()).sum()) - (x / t).max() for x, y in zip(logits, labels, strict=True)])
    assert abs(math.log(language_id.fit_temperature(logits, labels)) - math.log(min(np.geomspace(0.05, 20, 2000), key=nll))) < 0.01
    assert language_id.fit_temperature(logits[:0], labels[:0]) == 1.0


def test_language_scores_are_softmax_of_tfidf():
    rng = np.random.default_rng(3)
    table, bias = rng.normal(size=(1 << language_id.BITS, 2)), np.array([0.3, -0.3])
    m = language_id.Model(["a", "b"], table, bias, 1.7)
    text = "Uno dos, uno: tres!"
    _, b = ngrams.ngram_buckets(["uno", "dos", "uno", "tres"], language_id.SIZES, language_id.BITS)
    x = (table[b].mean(axis=0) + bias) / 1.7
    p = np.exp(x) / np.exp(x).sum()
    (lang, score), blank = m.predict([text, "12 --"])
    assert lang == "ab"[int(p.argmax())] and abs(score - p.max()) < 1e-12 and blank == ("und", 0.0)


def test_ngrams_of_a_word():
    """All runs of 1 to 4 characters of <word>, hashed alike wherever they stand."""
    at, b = ngrams.ngram_buckets(["abc", "zabc"], range(1, 5), 15)
    assert (at == 0).sum() == 5 + 4 + 3 + 2 and (at == 1).sum() == 6 + 5 + 4 + 3
    assert len(set(b[at == 0].tolist()) & set(b[at == 1].tolist())) >= 9  # <, >, a, b, c, ab, bc, c>, abc, bc>, abc>


def plain_toxic(embed, layer, bias, words, window):
    """The most toxic passage's probability: means of embeddings of words, each counted once in a passage."""
    def vector(w):
        _, b = toxicity.subwords([w])
        return embed[b].mean(axis=0)

    best = -math.inf
    for shift in (0, window // 2):
        starts = range(-shift, len(words), window)
        parts = [words[max(0, s) : s + window] for s in starts if words[max(0, s) : s + window]]
        if len(parts) > 1 and len(parts[-1]) < window:  # the rest belongs to the passage before
            parts[-2:] = [parts[-2] + parts[-1]]
        if shift and len(words) < 2 * window:
            continue
        for p in parts:
            x = sum(vector(w) for w in dict.fromkeys(p)) / len(p) @ layer + bias
            best = max(best, x[1] - x[0])
    return 1 / (1 + math.exp(-best))


@pytest.mark.parametrize("n", [1, 7, 8, 15, 16, 37, 40, 64])
def test_toxicity_scores(n):
    rng = np.random.default_rng(n)
    embed, layer, bias = rng.normal(size=(1 << toxicity.BITS, toxicity.DIM)), rng.normal(size=(toxicity.DIM, 2)), np.array([0.4, -0.4])
    m = toxicity.Model(embed, layer, bias, window=8)
    words = [rng.choice(["alpha", "beta", "gam", "d3lta", "ep_s", "zeta", "eta"]) for _ in range(n)]
    assert abs(m.scores([" ".join(words)])[0] - plain_toxic(embed, layer, bias, words, 8)) < 1e-12


def test_toxicity_trains_both_parts_and_the_bias():
    """Loss on the training set falls, a word's misspelling scores as the word does, an unknown word as none."""
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(["river", "table", "green", "window", "paper", "stone"]) for _ in range(20)]
        if i % 2:
            w[rng.randrange(20)] = rng.choice(["grobnak", "grobnaks", "grobnakky"])
        texts.append(" ".join(w))
        labels.append(i % 2)
    m = toxicity.train(texts, np.array(labels))
    assert m.bias != -2.0
    seen, misspelt, digit, none = m.scores(["green paper grobnak", "green paper grobnakk", "green paper gr0bnak", "green paper xyxyxy"])
    assert seen > 0.5 and misspelt > 0.5 and digit > none and none < 0.5
    assert toxicity.tokens_of("Sh1t a_b 12 __ x2") == ["sh1t", "a_b", "x2"]
