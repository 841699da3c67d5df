import itertools
import random
import re

import pytest

from helixframe.llm import decontaminate as dc


def shingles(text):
    ws = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def corpus():
    r = random.Random(2)
    pool = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 10
    make = lambda n: [r.choice(pool) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate((14, 18, 25, 40, 59, 100, 13, 7, 5, 4, 30))] + [(50, None), (51, "")]
    docs, n, exact = [], 0, set()
    for i, text in items[:11]:
        for _ in range(6):
            ws = make(r.randrange(0, 200))
            at = r.randrange(len(ws) + 1)
            body = text.upper() if r.random() < 0.3 else text.replace(" ", r.choice((" ", ", ", "\n")))
            docs.append((n, " ".join(ws[:at]) + " " + body + ". " + " ".join(ws[at:])))
            if len(text.split()) >= 5:
                exact.add((n, i))
            n += 1
    for i, text in items[2:6]:  # one word changed
        ws = text.split()
        ws[1 if len(ws) < 40 else len(ws) // 2] = "changed"
        docs.append((n, " ".join(make(20) + ws + make(31))))
        n += 1
    docs += [(n + k, " ".join(make(300))) for k in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "short")]
    return docs, items, exact


@pytest.mark.parametrize("bound", (200_000, 0))
def test_planted_items_are_found_and_clean_documents_left(spark, monkeypatch, bound):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", bound)
    docs, items, exact = corpus()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, word int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(d, b).collect()}
    assert exact <= set(got)
    texts, wanted = dict(docs), dict(items)
    for (doc, item), r in got.items():
        have, want = shingles(texts[doc]), shingles(wanted[item])
        assert sum(map(len, have & want)) / sum(map(len, want)) >= 0.8 and r.similarity >= 0.8
    edited = [i for i, _ in docs[66:70]]
    assert {x for x, _ in got} >= set(edited)
    clean = {r.doc_id for r in dc.decontaminate(d, b).collect()}
    assert clean == set(texts) - {x for x, _ in got}


def test_copies_with_spread_edits_are_found(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 11)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 15, 19, 24, 30, 56, 100, 200))]
    wanted, docs = dict(items), []
    for i, text in items:
        for k in range(150):
            ws, edits = text.split(), r.randrange(1, 2 + len(text.split()) // 20)
            places = r.sample(range(len(ws)), edits) if k % 2 else [(j + 1) * len(ws) // (edits + 1) for j in range(edits)]
            for at in sorted(places, reverse=True):  # a changed, a deleted or up to four new words
                ws[at : at + r.randrange(2)] = [word() + "x" for _ in range(r.randrange(5))]
            text_ = " ".join([word() for _ in range(r.randrange(40))] + ws + [word() for _ in range(r.randrange(40))])
            want = shingles(text)
            if sum(map(len, want & shingles(text_))) >= 0.8 * sum(map(len, want)):
                docs.append((len(docs), text_, i, edits))
    assert {(5, 2), (6, 3), (7, 7)} <= {(i, n) for _, _, i, n in docs}
    got = {(x.doc_id, x.item_id): x.similarity for x in dc.contaminated(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [(i, n) for d, _, i, n in docs if (d, i) not in got] == []
    assert all(sum(map(len, shingles(wanted[i]) & shingles(docs[d][1]))) >= 0.8 * sum(map(len, shingles(wanted[i]))) for d, i in got)


@pytest.mark.parametrize("bound", (200_000, 0))
def test_place_and_texts_of_one_id(spark, monkeypatch, bound):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", bound)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((9, 14, 30, 56, 100, 200))]
    docs, places = [], {}
    for i, text in items:
        for before in (0, 1, 3, 4, 17):
            places[(len(docs), i)] = before
            docs.append((len(docs), " ".join([word() for _ in range(before)] + [text] + [word() for _ in range(before % 5)])))
    # other texts of an id that is null or there already, the passage at the same place in each
    other = lambda i: " ".join([word() for _ in range(5)] + [items[i][1]])
    clean = lambda: " ".join(word() for _ in range(60))
    docs += [(900, clean()), (900, other(3)), (900, clean()), (None, other(4)), (None, other(2)), (None, clean())]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.word for x in dc.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == places | {(900, 3): 5, (None, 4): 5, (None, 2): 5}


def test_weight_that_breaks_all_runs(spark):
    r = random.Random(8)
    rows = [([r.randrange(1, 9) for _ in range(r.randrange(1, 15))],) for _ in range(60)]

    def brute(c, run):
        best = sum(c)
        for bits in range(1 << len(c)):
            runs = [(v, len(list(g))) for v, g in itertools.groupby(bits >> k & 1 for k in range(len(c)))]
            inner = runs[1:-1]
            if all(v or n < run for v, n in runs) and all(n >= 4 for v, n in inner if v):
                best = min(best, sum(x for k, x in enumerate(c) if bits >> k & 1))
        return best

    df = spark.createDataFrame(rows, "c array<long>")
    for run in (8, 4):
        assert [(x.c, x.b) for x in df.selectExpr("c", dc.breaking("c", run) + " b").collect()] == [(c, brute(c, run)) for c, in rows]


def test_fingerprint_is_the_majority_of_bits(spark):
    from pyspark.sql import functions as F

    ws = [f"q{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(ws))], "doc_id long, text string").select("doc_id", dc.words(F.col("text")).alias("ws"))
    rows = [r for b in (3, 6, 12) for r in dc.document_windows(df, b).drop("ws").collect()]
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in ws], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert sorted((r.block, r["at"]) for r in rows) == [(3, 3 * i) for i in range(11)] + [(6, 6 * i) for i in range(4)] + [(12, 0)]
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    pairs = [a ^ wrap(b << 3) for a, b in zip(hashes, hashes[1:])]
    for r in rows:
        own = pairs[r["at"] : r["at"] + 3 * r.block]
        want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))
        assert r.fp == wrap(want)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(d, b).count() == 0
    assert dc.contaminated(d.limit(0), spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")).count() == 0
