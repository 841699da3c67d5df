import math

import numpy as np
import pytest

from helixframe.functions import special
from helixframe.functions.sequences import GENETIC_CODE, dot_bracket
from helixframe.functions.information import ksg
from helixframe.operators.ranking import loocv


def test_tails_against_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.1, 3), (2.0, 10), (7.5, 78)):
        assert special.t_two_sided(t, df) == pytest.approx(2 * d.TDistribution(float(df)).cumulativeProbability(-t), rel=1e-9)
    for f, a, b in ((0.3, 2, 50), (3.2, 2, 50), (30.0, 4, 170)):
        assert special.f_tail(f, a, b) == pytest.approx(1 - d.FDistribution(float(a), float(b)).cumulativeProbability(f), rel=1e-6, abs=1e-14)
    for x, k in ((0.5, 3), (5.99, 2), (40.0, 4)):
        assert special.chi2_tail(x, k) == pytest.approx(1 - d.ChiSquaredDistribution(float(k)).cumulativeProbability(x), rel=1e-6)
    assert 0 < special.t_two_sided(60.0, 300) < 1e-150


def test_closed_forms():
    assert special.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert special.ks_two_sample(1.0, 3, 3) == pytest.approx(0.1)
    rng = np.random.default_rng(0)
    a = rng.standard_normal(1500)
    b = 0.8 * a + 0.6 * rng.standard_normal(1500)
    assert ksg(a, b) == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.08)
    x, y = rng.standard_normal((30, 2)), rng.standard_normal(30)
    errors = []
    for i in range(30):
        keep = np.arange(30) != i
        w = np.linalg.lstsq(np.column_stack([np.ones(29), x[keep]]), y[keep], rcond=None)[0]
        errors.append(y[i] - w[0] - x[i] @ w[1:])
    assert loocv(x, y)[1] == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_code_and_pairing():
    assert len(GENETIC_CODE) == 64 and GENETIC_CODE["ATG"] == "M" and [k for k, v in GENETIC_CODE.items() if v == "*"] == ["TAA", "TAG", "TGA"]
    assert dot_bracket("GGGAAAACCC") == "(((....)))"


def test_two_sample_and_rank_tests_against_the_jvm(spark):
    ks = spark._jvm.org.apache.commons.math3.stat.inference.KolmogorovSmirnovTest()
    for d, m, n in ((0.5, 10, 12), (0.3, 20, 25), (0.2, 60, 40)):
        assert special.ks_two_sample(d, m, n) == pytest.approx(ks.exactP(float(d), m, n, False), abs=1e-9)
    for x in (0.1, 0.9, 3.7, 12.5, 250.0):
        assert special.lgamma(x) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
    # three pairs in order of 3! orders: S = 3 has two-sided p 2/6
    assert special.kendall_exact(3, 3) == pytest.approx(2 / 6)


def test_pairs_by_definition():
    import random

    mate = {"A": "U", "U": "A", "G": "C", "C": "G"}
    rnd = random.Random(1)
    for _ in range(200):
        seq = "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 40)))
        rna, free, want = seq.replace("T", "U"), set(range(len(seq))), ["."] * len(seq)
        for i in range(len(rna)):
            able = [j for j in free if i in free and j - i > 3 and mate.get(rna[i]) == rna[j]]
            if able:
                want[i], want[max(able)] = "(", ")"
                free -= {i, max(able)}
        assert dot_bracket(seq) == "".join(want)
