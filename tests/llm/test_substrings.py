import hashlib
import random

import numpy as np
import pyarrow as pa

from helixframe.llm.substrings import anchors, remove_repeats


def brute(rows, depth=50):
    """(n_bytes, removed, spans, digest) of every row."""
    first = {}
    texts = [(2**63 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - depth + 1):
            w = t[i : i + depth]
            first[w] = min(first.get(w, 2**64), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - depth + 1):
            if first[t[i : i + depth]] < d:
                gone[i : i + depth] = True
        flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), [tuple(x) for x in flips.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    words = ["the", "of", "été", "and", "ing", "tion", "er", "x"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = make(120), make(25)
    rows = [(i, make(r.randrange(1, 90))) for i in range(40)]
    rows += [(100 + i, make(r.randrange(0, 12)) + passage[r.randrange(0, 20) :] + make(3)) for i in range(30)]
    rows += [(200 + i, base) for i in range(5)] + [(300 + i, base[: r.randrange(40, 300)] + "!" + base[r.randrange(60) :]) for i in range(15)]
    rows += [(400, "a" * 500), (401, "a" * 49), (402, "a" * 50), (403, "b" + "a" * 300), (404, None), (405, ""), (406, base[:49]), (407, base[:50]), (None, base), (200, base), (5, passage + passage)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    want = sorted(zip([repr(d) for d, _ in rows], brute(rows)))
    for packet, bucket in ((1 << 20, 1 << 20), (600, 1500)):
        got = remove_repeats(df, packet_bytes=packet, bucket_bytes=bucket).collect()
        have = sorted((repr(r.doc_id), (r.n_bytes, sum(s.end - s.start for s in r.spans), [(s.start, s.end) for s in r.spans], r.kept_sha256)) for r in got)
        assert have == want
    assert remove_repeats(df.limit(0)).count() == 0
    assert {r.kept for r in remove_repeats(df.filter("doc_id in (401, 404)"), keep_text=True).collect()} == {b"a" * 49, b""}


def test_other_depths(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (20, 100):
        got = remove_repeats(df, depth=depth, packet_bytes=2000, bucket_bytes=4000).collect()
        assert sorted((repr(r.doc_id), r.kept_sha256) for r in got) == sorted((repr(d), b[3]) for (d, _), b in zip(rows, brute(rows, depth)))


def test_every_window_has_an_anchor():
    data = np.random.default_rng(0).integers(97, 100, 100_000).astype(np.uint8)
    data[40_000:41_000] = 97
    offsets = np.array([0, 30, 80, 80, 70_000, 100_000])
    place, _ = anchors(data, offsets)
    assert (np.diff(place) > 0).all()
    for a, b in zip(offsets[:-1], offsets[1:]):
        starts = np.arange(a, b - 49)
        assert (np.searchsorted(place, starts + 30, side="right") > np.searchsorted(place, starts)).all()


def test_runs_of_one_byte_take_little_memory(spark):
    import resource

    n = 1_500_000
    df = spark.createDataFrame([(1, "-" * n), (2, "x" + "-" * n)], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert got[1].spans == [] and [(s.start, s.end) for s in got[2].spans] == [(1, n + 1)]
    from helixframe.llm.substrings import Packet

    packet = Packet(pa.table({"pid": [0], "doc_id": [1], "text": ["-" * n]}), 4, 50)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(packet.distinct(np.arange(len(packet.place)))[0]) < 100
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800_000  # kB
