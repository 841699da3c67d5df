import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(2 * q, least):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def search(texts):
    x, starts = [], []
    for k, t in enumerate(texts):
        starts.append(len(x))
        x += t + [10**6 + k]
    start, length, period = runs.runs(np.array(x, np.int64), np.array(starts, np.int64))
    own = np.searchsorted(starts, start, side="right") - 1
    out = [[] for _ in texts]
    for s, m, q, d in zip(start.tolist(), length.tolist(), period.tolist(), own.tolist()):
        out[d].append((s - starts[d], m, q))
    return out


def strings(rng):
    """Texts that are hard for the method: little alphabets, blocks of small periods, Fibonacci and Thue-Morse words, nested copies."""
    some = lambda n, k=2: [rng.randrange(k) for _ in range(n)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    block = some(rng.randint(1, 6), 3)
    block = (block * 200)[: rng.randint(10, 150)] + some(rng.randint(0, 2), 3)
    root = some(rng.randint(1, 8), 3) * 100
    nested = some(4)
    while len(nested) < 400:
        nested = nested * 2 + some(1) if rng.random() < 0.5 else nested + nested[: len(nested) // 2] + nested
    unit = some(rng.randint(1, 130))
    return [
        [], some(1), some(rng.randint(2, 400)), some(300, 5), (unit * 40)[: rng.randint(50, 500)], some(9) + block * 3 + block[: rng.randint(0, 9)] + some(9),
        root[: rng.randint(20, 250)] + root[: rng.randint(20, 250)], fib[-1], [bin(i).count("1") % 2 for i in range(500)], nested, [0] * 400,
        [x for _ in range(12) for x in some(rng.randint(1, 60)) * rng.randint(1, 4)],
    ]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = strings(random.Random(seed))
    for t, got in zip(texts, search(texts)):
        assert got == brute(t)
    assert [search([t])[0] for t in texts] == search(texts)


def test_linear_on_nested_runs():
    # two phases of one small period: a run for every other period
    half = [0, 1] * 20_000
    got = search([half + [0] + half])[0]
    assert len(got) > 15_000 and (0, 40_001, 2) in got
    assert search([[0] * 300_000])[0] == [(0, 300_000, 1)]


def expected(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (doc_id, len(found), *(best + (1000 * best[1] // best[2],) if best else [None] * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "x " * 50, "\ta b\x0bc\x0cd\re\x1cf  g" * 9, "né ô " * 8 + "\U0001f600"]
    texts += [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(1, 400))) for _ in range(80)]
    texts += [" ".join(map(str, t)) for t in strings(rng)]
    rows = [(3 * i, t, 1) for i, t in enumerate(texts)] + [(None, "a b " * 10, 2), (0, "c " * 20, 3), (3, "", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got = sorted((tuple(r) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 12
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert runs.op12_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_without_planting(spark):
    df = spark.createDataFrame([(i, "a b c d e f g " * (i % 4)) for i in range(40)], "doc_id long, text string")
    got = sorted(tuple(r) for r in runs.periodic_runs(df).collect())
    assert got == sorted(expected(r.doc_id, r.text, False) for r in df.collect())
