import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.functions import kernels as K


def test_known_values():
    assert K.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert K.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert K.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert K.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert K.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, rel=1e-6)
    assert K.fisher_combine([0.05]) == pytest.approx(0.05, rel=1e-9)
    assert K.neg_log10_two_sided(50) == pytest.approx(544.66, abs=0.1)


@settings(max_examples=100, deadline=None)
@given(st.floats(0.01, 200), st.floats(0.5, 80))
def test_gamma_is_a_tail(x, a):
    q = K.gamma_q(a, x)
    assert 0 <= q <= 1 and K.gamma_q(a, x + 1) <= q + 1e-12


def test_dispersion():
    rng = np.random.default_rng(1)
    assert K.dispersion([(1.0, 2)]) == 1.0
    assert K.dispersion([(float(x), 5) for x in rng.chisquare(5, 400)]) == pytest.approx(1.0, abs=0.15)
    assert K.dispersion([(3 * float(x), 5) for x in rng.chisquare(5, 400)]) == pytest.approx(3.0, abs=0.4)


def test_columns(spark):
    d = spark.createDataFrame([(1.96, 4.0), (None, 1.0)], "z double, df double")
    r = d.select(K.normal_p(F.col("z")).alias("p"), K.chi2_p(F.col("z"), F.col("df")).alias("c"), K.student_p(F.col("z"), F.col("df")).alias("t")).collect()
    assert r[0].p == pytest.approx(0.05, abs=1e-4) and r[0].c == pytest.approx(K.chi2_sf(1.96, 4)) and r[0].t == pytest.approx(K.student_two_sided(1.96, 4))
    assert r[1].p is None


def test_null_calibration_of_category_drift():
    """G of draws from one mix keeps its level: the rate near 5 %."""
    rng = np.random.default_rng(3)
    p = np.array([0.5, 0.2, 0.15, 0.1, 0.05])
    fired = 0
    for _ in range(1000):
        a, b = rng.multinomial(400, p), rng.multinomial(2800, p)
        pool = (a + b) / 3200
        g = 2 * sum(n * math.log(n / t / q) for x, t in ((a, 400), (b, 2800)) for n, q in zip(x, pool) if n)
        fired += K.chi2_sf(g, 4) <= 0.05
    assert 0.03 <= fired / 1000 <= 0.075
