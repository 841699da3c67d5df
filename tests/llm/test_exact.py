import hashlib
import unicodedata

from pyspark.sql import functions as F

from helixframe.llm import exact

TEXTS = ["Hello  World", "hello world ", "HELLO\tWORLD", "Straße", "STRASSE", "café", "café", "CAFÉ　x", None, "", " ", "ＡＢＣ", "abc", "İ", "x y", "x y", "ﬁn", "FIN", "a" * 9000, "\U0001d400b", "ᾳͅ", "한", "한"]


def canon(text):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(x.split())


def test_canonical_is_nfkc_and_case_folding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    got = {r.i: r.c for r in df.select("i", exact.canonical(F.col("text")).alias("c")).collect()}
    assert got == {i: canon(t) for i, t in enumerate(TEXTS)}


def test_groups(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "abc", "y")], "doc_id long, text string, class string")
    rows = exact.duplicate_groups(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.first_id == TEXTS.index("ＡＢＣ")
        else:
            assert r.first_id == min(i for i, t in enumerate(TEXTS) if canon(t) == canon(TEXTS[r.doc_id]))
    assert exact.duplicate_groups(df.limit(0)).count() == 0


def test_bytes_decide_where_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(exact, "wide_hash", lambda c: F.substring(F.md5(c), 1, 1))
    rows = [(i, f"text {i % 40}") for i in range(120)]
    out = exact.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 120 and len({r.fingerprint for r in out}) == 40
    assert len({(r.fingerprint, r.doc_id % 40) for r in out}) == 40


def test_query(spark, tmp_path):
    texts = [None, "abcd", "ABCD", "héllo wörld " * 40, "x", "", "abcdefgh", "y\U0001f600" * 30]
    ids = [3, 10, 11, 12, 500, 501, 10**12, 10**12 + 5]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in exact.op6_fingerprints(spark, str(tmp_path)).collect()}
    assert sorted(got) == ids
    for k, (i, t) in enumerate(zip(ids, texts)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == float(canon(t) == canon(edited)) and got[i].near_next == float(canon(t) == canon(after))
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (canon(t) == canon(edited))
    assert got[10].fingerprint == got[11].fingerprint


def test_query_keeps_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "abcdefgh", "a"), (1, "abcdefgh", "b"), (1, "other text", "a"), (2, "Tail", "a"), (None, "null id", "a"), (None, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, th string").write.parquet(f"{tmp_path}/documents.parquet")
    got = exact.op6_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 1, 8), (False, 1, 8), (False, 1, 10), (False, 2, 4), (True, 0, 0), (True, 0, 7)]
    assert len({r.fingerprint for r in got}) == 5
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert exact.op6_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_edited_texts_join_numbered_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "wide_hash", lambda c: F.substring(F.md5(c), 1, 1))
    # the edited text of document 0 is document 2's text, whatever class that has
    texts = ["aaaabbbb", "cc", "aaaabbcc"] + [f"text {i}" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in exact.op6_fingerprints(spark, str(tmp_path)).collect()}
    assert got[0].edited_fingerprint == got[2].fingerprint != got[0].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len(texts)
