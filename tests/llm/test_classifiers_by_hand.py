"""The two classifiers' fits against plain loops over the same examples."""

import math

import numpy as np

from memlake.llm import language_id, quality


def test_follow_the_leader_by_hand(monkeypatch):
    """FTRL-proximal written out for each weight: z, n, and the closed form with both penalties."""
    monkeypatch.setattr(language_id, "BUCKETS", 12)
    draw = np.random.default_rng(3)
    examples = []
    for _ in range(60):
        at = np.sort(draw.choice(12, size=4, replace=False))
        label = int(at[0] % 3)
        examples.append((np.append(at, 12), np.append(draw.random(4), 1.0), label))
    alpha, beta, l1, l2, epochs, seed = 0.4, 1.0, 0.8, 0.02, 2, 9
    got = language_id.follow_the_leader(examples, 3, alpha, beta, l1, l2, epochs, seed)
    z = [[0.0] * 3 for _ in range(13)]
    n = [[0.0] * 3 for _ in range(13)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, x, label = examples[k]
            w = {(i, c): weight(i, c) for i in at for c in range(3)}
            logits = [sum(w[i, c] * v for i, v in zip(at, x, strict=True)) for c in range(3)]
            top = max(logits)
            p = [math.exp(v - top) for v in logits]
            p = [v / sum(p) for v in p]
            for i, v in zip(at, x, strict=True):
                for c in range(3):
                    g = (p[c] - (c == label)) * v
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    expected = np.array([[weight(i, c) for c in range(3)] for i in range(13)])
    assert np.allclose(got, expected) and (expected == 0).any()


def test_temperature_by_grid():
    draw = np.random.default_rng(1)
    logits = draw.standard_normal((400, 3)) * 4
    p = np.exp(logits / 2.5)
    labels = np.array([draw.choice(3, p=row / row.sum()) for row in p])
    loss = lambda t: -np.mean([row[k] / t - math.log(sum(math.exp(v / t) for v in row)) for row, k in zip(logits, labels, strict=True)])
    t = language_id.temperature(logits, labels)
    assert abs(t - 2.5) < 0.6 and all(loss(t) <= loss(t * f) + 1e-4 for f in (0.5, 0.9, 1.1, 2.0))


def test_bradley_terry_by_hand():
    """The same pairs, one logistic gradient at a time."""
    draw = np.random.default_rng(5)
    x = draw.standard_normal((40, 6))
    better, worse = np.arange(0, 20), np.arange(20, 40)
    x[better, 0] += 3.0
    rate, l2, seed = 0.1, 1e-3, 4
    got = quality.bradley_terry(x, better, worse, 256 * 30, rate, l2, seed)
    w, seen = [0.0] * 6, [1e-8] * 6
    pick = np.random.default_rng(seed)
    for _ in range(30):
        first, second = pick.choice(better, 256), pick.choice(worse, 256)
        g = [l2 * v for v in w]
        for i, j in zip(first, second, strict=True):
            d = x[i] - x[j]
            chance = 1.0 / (1.0 + math.exp(-sum(a * b for a, b in zip(w, d, strict=True))))
            for k in range(6):
                g[k] -= (1.0 - chance) * d[k] / 256
        for k in range(6):
            seen[k] += g[k] ** 2
            w[k] -= rate * g[k] / math.sqrt(seen[k])
    assert np.allclose(got, w) and got[0] > max(abs(got[1:]))


def test_best_quantile_by_trying_all():
    draw = np.random.default_rng(6)
    for _ in range(20):
        scores, labels = draw.standard_normal(30), draw.integers(0, 2, 30)
        weight = np.where(labels == 1, 0.7, 1.9)
        errors = lambda cut: weight[(scores >= cut) != (labels == 1)].sum()
        cut = quality.best_quantile(scores, labels, weight)
        assert errors(cut) <= min(errors(c) for c in [*scores, scores.max() + 1, scores.min() - 1]) + 1e-9
