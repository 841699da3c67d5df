"""Greedy panels against the choice over all pairs, and leaf order against plain agglomeration."""

import numpy as np
import pytest

from helixframe.functions.information import ksg
from helixframe.functions.linkage import average_linkage, leaf_order
from helixframe.operators import ranking


def greedy(values, score, size):
    """Every gene's information with every chosen one, no bound."""
    order, chosen = sorted(score, key=lambda g: (-score[g], g)), []
    while len(chosen) < min(size, len(order)):
        left = [g for g in order if g not in chosen]
        worth = [score[g] - (np.mean([ksg(values[c], values[g]) for c in chosen]) if chosen else 0.0) for g in left]
        chosen.append(left[int(np.argmax(np.round(worth, 12)))])
    return chosen


def test_lazy_choice_is_the_greedy_one(spark, monkeypatch):
    rng = np.random.default_rng(0)
    n, genes = 60, 300  # more than any cap before
    base = rng.normal(size=(6, n))
    values = {f"g{i:03d}": base[i % 6] + rng.normal(0, 0.3 + i % 5, n) for i in range(genes)}
    score = {g: float(np.round(rng.uniform(0.2, 1), 2)) for g in values}
    vectors = spark.createDataFrame([(g, [float(x) for x in v]) for g, v in values.items()] + [("lost", [0.0] * n)], "gene_id string, values array<double>")
    cand = spark.createDataFrame([(g, s, -s) for g, s in score.items()] + [("absent", 9.0, 9.0)], "gene_id string, score double, correlation double")
    rows = {(r.panel_type, r["size"]): r for r in ranking.panels(vectors, cand, list(base[0] + base[1]), (3, 6)).collect()}
    want = greedy(values, score, 6)
    assert rows["minimal_redundancy", 6].genes == want and rows["minimal_redundancy", 3].genes == want[:3]
    best = sorted(score, key=lambda g: (-score[g], g))[:6]
    assert rows["max_score", 6].genes == rows["max_correlation", 6].genes == best
    shared = [ksg(values[a], values[b]) for i, a in enumerate(want) for b in want[i + 1 :]]
    assert rows["minimal_redundancy", 6].mean_information == pytest.approx(np.mean(shared), abs=1e-9)
    pairs = ranking.pair_information(vectors, cand.limit(5)).collect()
    assert len(pairs) == 10 and all(r.mi == pytest.approx(ksg(values[r.a], values[r.b]), abs=1e-9) for r in pairs)
    assert ranking.panels(vectors, cand.limit(0), list(base[0]), (2,)).count() == 0


def agglomerated(d):
    """Merged groups and heights, by the least mean distance between members at every step."""
    groups, out = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        out.append((sorted(groups[i] + groups[j]), h))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 12, 40])
def test_linkage_equals_plain_agglomeration(n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    want, merges = agglomerated(d), average_linkage(d)
    assert np.allclose([m[2] for m in merges], [h for _, h in want])
    order = leaf_order(d)
    assert sorted(order) == list(range(n))
    place = {i: k for k, i in enumerate(order)}
    for group, _ in want:  # every cluster stands together
        at = sorted(place[i] for i in group)
        assert at == list(range(at[0], at[0] + len(group)))


def test_ties_end():
    assert sorted(leaf_order(np.ones((9, 9)))) == list(range(9)) and leaf_order(np.zeros((0, 0))) == []


def test_matrix_in_leaf_order(spark):
    df = spark.createDataFrame([(f"g{i}", c) for i, c in enumerate([0.9, -0.8, 0.1, 0.95, None, float("nan"), 0.05])], "gene_id string, coefficient double")
    rows = ranking.co_matrix(df, 4).collect()
    assert len(rows) == 16 and {r.gene_i for r in rows} == {"g0", "g1", "g2", "g3"}
    by = {(r.gene_i, r.gene_j): r for r in rows}
    assert by["g0", "g1"].value == pytest.approx(-0.72) and by["g2", "g2"].value == 1
    places = {r.gene_i: r.place_i for r in rows}
    assert sorted(places.values()) == [0, 1, 2, 3] and abs(places["g0"] - places["g3"]) == 1 and places["g2"] in (0, 3)
