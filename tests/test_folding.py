import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import folding as fo
from helixframe.operators import sequence as Q


def structures(s, i, j):
    """All nested pairings of s[i:j], as tuples of pairs."""
    if j - i <= 0:
        yield ()
        return
    yield from structures(s, i + 1, j)
    for k in range(i + fo.LEAST_LOOP + 1, j):
        if s[i] + s[k] in fo.PAIRS:
            for a in structures(s, i + 1, k):
                for b in structures(s, k + 1, j):
                    yield ((i, k), *a, *b)


def energy(s, pairs):
    total = 0
    weak = lambda p: s[p[0]] + s[p[1]] not in ("CG", "GC")
    inside = lambda p, q: p[0] < q[0] and q[1] < p[1]
    for p in pairs:
        kids = [q for q in pairs if inside(p, q) and not any(inside(p, r) and inside(r, q) for r in pairs)]
        if not any(inside(r, p) for r in pairs):
            total += fo.WEAK_END * weak(p)
        if not kids:
            total += fo.initiation(fo.HAIRPIN, p[1] - p[0] - 1) + fo.WEAK_END * weak(p)
        elif len(kids) == 1:
            (q,) = kids
            a, b = q[0] - p[0] - 1, p[1] - q[1] - 1
            stacked = fo.STACK[fo.PAIRS.index(s[p[0]] + s[p[1]]), fo.PAIRS.index(s[q[1]] + s[q[0]])]
            if a + b == 0:
                total += stacked
            elif a == 0 or b == 0:
                total += fo.initiation(fo.BULGE, a + b) + (stacked if a + b == 1 else fo.WEAK_END * (weak(p) + weak(q)))
            else:
                total += fo.initiation(fo.INTERIOR, a + b) + fo.ASYMMETRY * abs(a - b) + fo.WEAK_INTERIOR * (weak(p) + weak(q))
        else:
            free = p[1] - p[0] - 1 - sum(q[1] - q[0] + 1 for q in kids)
            total += fo.MULTI + fo.MULTI_BASE * free + fo.MULTI_HELIX * (len(kids) + 1) + fo.WEAK_END * (weak(p) + sum(map(weak, kids)))
    return int(total)


def sequences(n, seed, letters="GGCCAU", lengths=(1, 19)):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(*lengths))) for _ in range(n)]


@pytest.mark.parametrize("span", (200, 9))
@pytest.mark.parametrize("cheap", (None, "multi", "interior"))
def test_energies_equal_those_of_all_structures(monkeypatch, span, cheap):
    if cheap == "multi":  # multiple loops win
        monkeypatch.setattr(fo, "MULTI", -900)
        monkeypatch.setattr(fo, "MULTI_BASE", -30)
        monkeypatch.setattr(fo, "HAIRPIN", (3, (100, 90, 120)))
    if cheap == "interior":  # unequal loops of all sizes win
        monkeypatch.setattr(fo, "INTERIOR", (2, (-300, -310, -420, -350)))
        monkeypatch.setattr(fo, "BULGE", (1, (-280, -290, -100)))
        monkeypatch.setattr(fo, "HAIRPIN", (3, (-100, 90, 120)))
    seqs = sequences(50, 3)
    want = [min(energy(s, p) for p in structures(s, 0, len(s)) if all(j - i <= span for i, j in p)) / 100 for s in seqs]
    assert fo.least_energies(seqs, span) == want
    assert min(want) < 0


def test_parts_and_blocks_change_nothing(monkeypatch):
    seqs = sequences(12, 4, lengths=(40, 160)) + ["", "A", "ACGT" * 30]
    want = fo.least_energies(seqs, 25)
    monkeypatch.setattr(fo, "BLOCK_CELLS", 700)
    assert fo.least_energies(seqs, 25) == want
    assert [fo.least_energies([s], 25)[0] for s in seqs] == want


def test_known_hairpin():
    # GGGG AAAA CCCC: three stacks of GG on CC and a loop of four
    assert fo.least_energies(["GGGGAAAACCCC", "ggggaaaacccc", "AAAAAAAA", "GGGGANNACCCC"]) == [-4.3, -4.3, 0.0, -4.3]


def test_structures_of_all_sequences(spark):
    seqs = sequences(130, 5, lengths=(5, 40))
    d = spark.createDataFrame([(i, s, i) for i, s in enumerate(seqs)] + [(900, None, 1), (901, "", 1)], "id long, utr5 string, seq long").repartition(3)
    got = {r.id: r for r in Q.rna_structures(d, "utr5").collect()}
    assert set(got) == {i for i, s in enumerate(seqs) if len(s) >= 10}
    assert all(r.mfe == pytest.approx(fo.least_energies([seqs[i]])[0]) and r.normalized_mfe == pytest.approx(r.mfe / len(seqs[i])) for i, r in got.items())
    assert set(x.id for x in Q.rna_structures(d, "utr5", most=7).collect()) == set(sorted(got)[:7])


def test_energy_by_region(spark):
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(sequences(20, 6, lengths=(5, 30)), sequences(20, 7, lengths=(5, 30))))], "id long, utr5 string, utr3 string")
    got = {r.region: r for r in Q.energy_by_region(d, {"5'UTR": "utr5", "3'UTR": "utr3"}).collect()}
    for region, c in (("5'UTR", "utr5"), ("3'UTR", "utr3")):
        own = [r[c] for r in d.select(c).collect() if len(r[c]) >= 10]
        per = [e / len(s) for e, s in zip(fo.least_energies(own), own)]
        assert got[region].n == len(own) and got[region].min == pytest.approx(min(per)) and got[region].mean == pytest.approx(sum(per) / len(per))
    assert Q.energy_by_region(d.filter(F.lit(False)), {"5'UTR": "utr5"}).count() == 0


def test_short_numbers_give_the_energies_of_long_ones():
    rng = np.random.default_rng(9)
    for _ in range(20):
        codes = rng.choice(5, size=(3, int(rng.integers(2, 90))), p=[0.2, 0.3, 0.3, 0.15, 0.05]).astype(np.int8)
        own, long = fo._closed(codes, 60), fo._closed(codes, 60, short=False)
        assert own.dtype == np.int16
        pairs = long < fo.INF // 2
        assert (own[pairs] == long[pairs]).all() and (own[~pairs] >= fo.SHORT_INF).all()


def test_helices_too_low_for_short_numbers():
    deep = "G" * 95 + "AAAA" + "C" * 95  # 94 stacks of -330 and a hairpin loop of four
    with pytest.raises(fo._TooLow):
        fo._closed(fo.CODES[np.frombuffer(deep.encode(), np.uint8)][None], 200)
    assert fo.least_energies([deep]) == [-304.6]
