import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm.packing import assemble, pack, plan, tokenise
from helixframe.llm.common import materialise

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "a", "Hello, World. Foo.\nbar", "É é don't I'LL x.,y 12 3.5.", "<|endoftext|> tail <|ENDOFTEXT|>", "\t\r\n  ",
    "日本語 text.   x y", "word " * 9000, "Hello, World. Foo.\nbar", "a." * 50, "İstanbul ΣΑΣ. ΟΔΟΣ,",
]


def brute(text, cap=4096):
    t = Tokenizer.from_file(PATH)
    ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(p, at, len(ids[at : at + cap]), zlib.crc32(ids[at : at + cap].tobytes())) for p, at in enumerate(range(0, len(ids), cap))]


def test_ids_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    got = {(r.doc_id, r.piece): (r.piece, r.start, r.length, r.ids_crc32) for r in tokenise(df, PATH).collect()}
    want = {(i, x[0]): x for i, t in enumerate(TEXTS) for x in brute(t)}
    assert got == want


def test_places_are_gapless_and_sequences_few(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 101, 3000)] + [7] * 2000 + [100] * 5
    pieces = materialise(spark.createDataFrame([(i, 0, n, "c") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, count string"), "t")
    rows = pack(pieces, 100).collect()
    assert len(rows) == len(lengths) and {r["count"] for r in rows} == {"c"}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by) <= 1.02 * -(-sum(lengths) // 100) + 1


def test_plan_places_each_rank_once():
    counts = Counter({100: 3, 60: 5, 40: 9, 33: 7, 1: 250})
    p = plan(counts, 100)
    assert p["sequences"] >= -(-sum(k * v for k, v in counts.items()) // 100)
    assert plan({}, 100)["sequences"] == 0


def test_empty_table_and_assembled_sequences(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(materialise(tokenise(empty, PATH), "t")).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (2, "d")], "doc_id long, text string")
    out = assemble(pack(materialise(tokenise(df, PATH, keep_ids=True), "t"))).collect()
    assert len(out) == 1 and len(out[0].ids) == 8 and sorted(out[0].doc_ids) == [1, 2, 2]


def test_hostile_strings_have_the_tokenizers_ids():
    import random

    import pyarrow as pa

    from helixframe.llm.packing import WordIds

    words = WordIds(PATH)
    assert words.fits
    rnd = random.Random(5)
    texts = ["it's", "ΑΣ. b", "e\u0301. x", "क़.", "İ. x", "''t", "5'll.", "x…. y", "日本語。 a.", "한글. 하", "a\u200b b c.", "#'s 's.", "<|endoftext|> a.", "º.", ""]
    for letters in ("aZé\u0301Σσ.,'!5²\u0338 \n\t…|st<>％İǅ한ᅡ", "abcé. ,'-%1", "शक़.Å, ΣА а.я"):
        texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    ids, offsets = words.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t
    words.fits = False
    whole, ends = words.encode(pa.array(texts[:200]))
    assert (whole == ids[: ends[-1]]).all()


def test_other_tokenizers_are_encoded_whole():
    from helixframe.llm.packing import WordIds

    assert not WordIds(public_tokenizers.path("byte_bpe_50k.json")).fits
