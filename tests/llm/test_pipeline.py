import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import langid

from test_decontaminate import shingles as item_shingles
from test_langid import WORDS, docs as language_docs
from test_lines import brute as brute_lines
from test_near_dup import brute as brute_near


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 12)
    rows = [(d, t, lang, "s", len(t)) for d, t, lang, _ in language_docs(spark, 150)]
    item = "quick brown foxes jumped over lazy dogs while seven grey cats slept near warm stone walls"
    shared = "der und nicht für schön auch das ist eine lange zeile\n"
    text = rows[4][1]
    rows += [
        (1000, text.replace("der", "dem", 1), "de", "s", 1), (1001, text, "de", "s", 1), (1002, None, "en", "s", None), (1003, "12 34", "en", "s", 5),
        (1004, shared + rows[7][1], "de", "s", 1), (1005, shared + rows[10][1] + " x", "de", "s", 1), (1006, rows[0][1] + " " + item + " the of and", "en", "s", 1), (1007, shared, "de", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [(d, t) for d, t, *_ in rows if t and re.search("[a-z]", t)]
    changed = dict(zip([d for d, _ in sorted(docs, key=lambda r: repr(r[0]))], [eval(t) for _, t, _ in sorted(brute_lines(docs, 8))], strict=True))
    docs = [(d, changed[d]) for d, _ in docs if changed[d]]
    heads = {c for _, _, c in brute_near(docs)}
    docs = [(d, t) for d, t in docs if d in heads]
    want = item_shingles(item)
    docs = [(d, t) for d, t in docs if len(item_shingles(t) & want) < 0.8 * len(want)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in docs}
    assert {r.doc_id: r.length for r in got} == expected
    assert not {1002, 1003, 1006, 1007} & set(expected) and 1004 in expected
    assert len({r.sequence_id for r in got}) == -(-sum(expected.values()) // 4096)
    assert WORDS


def test_stages_keep_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns


def test_near_dedup_takes_pairs_from_80_per_cent_on(spark):
    from test_near_dup import near_dup

    words = [f"w{i}" for i in range(300)]
    changed = lambda n: " ".join("new" + w if i % (300 // n) == 20 else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, changed(6)), (3, changed(10))]
    own = lambda n: (296 - 5 * n) / (296 + 5 * n)
    assert 0.8 <= own(6) < 0.85 and own(10) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3}
    assert {r.doc_id for r in near_dup.near_duplicates(df).filter("kept").collect()} == {1, 2, 3}
