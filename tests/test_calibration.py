"""Detectors on data without a change fire at their level, and on a change they fire."""

import math

import numpy as np
import pytest

from sparkvane.functions import kernels as K

RNG = np.random.default_rng(11)


def rate(test, n=1000):
    return sum(test() <= 0.05 for _ in range(n)) / n


def g_test(a, b):
    pool = (a + b) / (a.sum() + b.sum())
    g = 2 * sum(x * math.log(x / v.sum() / q) for v in (a, b) for x, q in zip(v, pool) if x)
    return K.chi2_sf(g, len(a) - 1)


def psi_test(a, b):
    m = len(a)
    p, q = (a + 0.5) / (a.sum() + 0.5 * m), (b + 0.5) / (b.sum() + 0.5 * m)
    psi = float(((p - q) * np.log(p / q)).sum())
    return K.chi2_sf(psi / (1 / a.sum() + 1 / b.sum()), m - 1)


def welch(x, y):
    return K.normal_two_sided((x.mean() - y.mean()) / math.sqrt(x.var(ddof=1) / len(x) + y.var(ddof=1) / len(y)))


def fisher(x, y):
    z = (np.arctanh(np.corrcoef(*x)[0, 1]) - np.arctanh(np.corrcoef(*y)[0, 1])) / math.sqrt(1 / (x.shape[1] - 3) + 1 / (y.shape[1] - 3))
    return K.normal_two_sided(float(z))


def prediction(k):
    x = RNG.normal(size=k + 1)
    h = x[:k]
    t = (x[k] - h.mean()) / (h.std(ddof=1) * math.sqrt(1 + 1 / k))
    return K.student_two_sided(float(t), k - 1)


def ks(n, m, edges=19):
    a, b = np.sort(RNG.normal(size=n)), np.sort(RNG.normal(size=m))
    e = np.quantile(b, np.linspace(0, 1, edges + 2)[1:-1])
    gap = np.abs(np.searchsorted(a, e, side="right") / n - np.searchsorted(b, e, side="right") / m).max()
    return K.kolmogorov_sf(gap * math.sqrt(n * m / (n + m)))


MIX = np.array([0.5, 0.2, 0.15, 0.1, 0.05])


@pytest.mark.parametrize(
    "test, low, high",
    [
        (lambda: g_test(RNG.multinomial(500, MIX), RNG.multinomial(3000, MIX)), 0.03, 0.075),
        (lambda: psi_test(RNG.multinomial(500, MIX), RNG.multinomial(3000, MIX)), 0.03, 0.075),
        (lambda: welch(RNG.normal(size=200), RNG.normal(size=900)), 0.03, 0.075),
        (lambda: fisher(RNG.normal(size=(2, 120)), RNG.normal(size=(2, 150))), 0.03, 0.075),
        (lambda: prediction(6), 0.03, 0.075),
        (lambda: ks(400, 2000), 0.0, 0.06),  # on a grid the test is conservative
    ],
)
def test_level(test, low, high):
    assert low <= rate(test) <= high


def test_power():
    moved = MIX + np.array([-0.1, 0.1, 0, 0, 0])
    assert rate(lambda: g_test(RNG.multinomial(1000, moved), RNG.multinomial(5000, MIX)), 100) > 0.95
    assert rate(lambda: welch(RNG.normal(0.33, 1, 200), RNG.normal(size=900)), 100) > 0.9
