import zlib

import numpy as np

from helixframe.llm import langid

WORDS = {"en": "the of and that with there", "de": "der und nicht für schön auch", "fr": "le été dans vous être où"}


def docs(spark, n=360):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(30, 200)))), lang, "s"))
    return rows


def test_learns_languages_and_ignores_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 12)
    rows = docs(spark) + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 !? ৩", "en", "s"), (1003, "le été dans vous " * 5000, None, "s"), (1003, "der und nicht", "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df)
    out = langid.predict(df, model).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.lang): r for r in out}
    held = [r for r in out if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    for i in (1000, 1001, 1002):
        assert (by[i, "en"].lang_pred, by[i, "en"].score) == ("und", 0)
    assert by[1003, None].lang_pred == "fr" and by[1003, "fr"].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out)


def test_tables_give_the_convolution():
    rng = np.random.default_rng(0)
    model = langid.fit([bytes(rng.integers(97, 123, 300, np.uint8)) for _ in range(20)], ["a", "b"] * 10)
    data = rng.integers(32, 255, 700).astype(np.uint8)
    x, owner, weight = langid.windows(data, np.array([0, 0, 300, 700]))
    assert list(owner) == [1, 1, 2, 2] and list(weight) == [256, 44, 256, 144]
    act = langid._pooled(x, *model.tables())
    e = model.embed[x]
    for k, w in enumerate(langid.WIDTHS):
        want = sum(e[:, j : j + langid.WINDOW - 3] @ model.filters[w][j] for j in range(w))
        assert np.allclose(act[:, :, k * 16 : (k + 1) * 16], want, atol=1e-4)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert [(r.lang_pred, r.score) for r in langid.predict(df, None).collect()] == [("und", 0)]
    assert langid.predict(df.limit(0), None).count() == 0


def test_rates_of_any_count():
    assert langid.sampling_rate(1500, 10) == 1.0
    assert langid.sampling_rate(1500, 10**12) == 1.5e-9  # as a double, so no language vanishes


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 12)
    rows = docs(spark, 240)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in langid.op10_language_id(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for doc_id, _, lang, _ in rows:
        assert out[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and out[doc_id].lang_pred == lang
