import random
import re

import numpy as np

from helixframe.llm import near_dup
from helixframe.llm.common import text_bytes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(rows[i][0]), find(rows[j][0])
                label[max(a, b)] = min(a, b)
    return {(d, len(s), find(d)) for (d, _), s in zip(rows, sets)}


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    rows, n = [], 0
    for size in (3, 7, 12, 60, 200, 400):
        for _ in range(4):
            base = make(size)
            for _ in range(9):
                x = list(base)
                for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
                    x[r.randrange(len(x))] = r.choice(words)
                rows.append((n, r.choice((" ", "\n", "  ")).join(x).upper() if r.random() < 0.2 else " ".join(x)))
                n += 1
    drift = make(150)
    for _ in range(40):  # a chain whose ends are not alike
        drift[r.randrange(150)] = r.choice(words)
        rows.append((n, " ".join(drift)))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b É"), (n + 4, "a b É"), (n + 5, "É a")]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE", 4)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, rep string")
    got = near_dup.near_duplicates(df).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a  b C")], "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(df).collect(), key=repr)
    assert [(r.doc_id, r.component_id, r.kept) for r in got].count((1, 1, True)) == 2
    assert (2, 1, False) in [(r.doc_id, r.component_id, r.kept) for r in got]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_near_the_similarity():
    import pyarrow as pa

    r = random.Random(1)
    base = [str(r.random()) for _ in range(500)]
    other = base[:450] + [str(r.random()) for _ in range(50)]
    data, offsets = text_bytes(pa.array([" ".join(base), " ".join(other)]))
    sets = near_dup.shingle_sets(data, offsets)
    a, b = near_dup.sketch(sets)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    guess, count = near_dup.estimate(a[None], b[None])
    assert abs(guess[0] - true) < 0.12 and 100 < count[0] <= near_dup.REGISTERS


def test_empty_registers_take_full_ones_alike():
    E = near_dup.EMPTY
    row = np.full((3, near_dup.REGISTERS), E)
    row[0, 7], row[0, 100], row[1, 0] = 5, 6, 9
    row[2] = np.arange(near_dup.REGISTERS)
    out = near_dup.filled(row)
    assert set(out[0]) == {5, 6} and out[0, 7] == 5 and out[0, 100] == 6 and set(out[1]) == {9} and (out[2] == row[2]).all()


def test_bands_find_pairs_at_the_threshold():
    """Recall at similarity .8 and .85 for small and large sets: by theory 7e-6 and less is missed."""
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.85):
        for n in (7, 20, 60, 150, 600):
            apart = int(n * (1 - similarity) + 1e-9)
            missed = 0
            for _ in range(150):
                x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
                k = rng.integers(0, apart + 1)
                sets = [np.sort(np.concatenate([x[apart:], part])) for part in (x[:k], x[k:apart])]
                missed += not (near_dup.band_keys(near_dup.sketch(sets))[0] == near_dup.band_keys(near_dup.sketch(sets))[1]).any()
            assert missed == 0, (similarity, n)
