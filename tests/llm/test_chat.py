import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "n", "\n", "<", "|", "a", "[/INST", "é"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_round_trip(role, text):
    segment, start, end = chat.format_turn(role, text)
    assert chat.parse_turn(segment) == (role, text)
    assert chat.unescape(segment[start:end]) == text
    assert not any(c in segment[start:end] for c in chat.CONTROL)


def test_digest_against_brute_force(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (1, 3, "assistant", ""), (2, 1, "system", "s\\"), (1, 2, "assistant", "b</s>"), (3, None, None, "x"), (4, 0, "assistant", "y" * 5000)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(600)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example long")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv])
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = sorted((r.example, r.formatted, r.target_start, r.target_end) for r in chat.examples(chat.training_examples(df.filter("conv_id = 1"))).collect())
    assert [chat.unescape(f[s:e]) for _, f, s, e in out] == ["b</s>", "b</s>", ""]
    assert all(f.endswith("<|end|>\n") and e == len(f) - 8 for _, f, s, e in out) and out[2][1].startswith(out[1][1])
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_query_reads_examples_of_all_assistant_turns(spark, tmp_path, monkeypatch):
    rows = [(5, i, ("user", "assistant")[i % 2], f"té{i}</s>" * (i % 7)) for i in range(300)] + [(6, 0, "user", "x"), (8, 1, "assistant", None), (8, 2, "user", "after"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "CHUNK_BYTES", 101)
    monkeypatch.setattr(chat, "SPOOL_BYTES", 500)
    parts = chat.training_examples(df.coalesce(1)).collect()
    for conv in (5, 8, None):
        own, text = [r for r in rows if r[0] == conv], ""
        for n, k in enumerate(k for k, r in enumerate(own) if r[2] == "assistant"):
            chunks = [p for p in parts if p.conv_id == conv and p.example == n]
            text = "".join(p.text for p in chunks)
            assert text == "".join(chat.format_turn(r[2], r[3] or "")[0] for r in own[: k + 1])
            assert chat.unescape(text[chunks[0].target_start : chunks[0].target_end]) == (own[k][3] or "")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    made = []
    monkeypatch.setattr(chat, "training_examples", lambda t, f=chat.training_examples: made.append(1) or f(t))
    got = {r.conv_id: r for r in chat.op2_chat_formatting(spark, str(tmp_path)).collect()}
    extra, said = got.pop(-7), "</s>[INST] ok [/INST]"
    assert got == want and made == [1]
    assert (extra.n_turns, extra.loss_chars, extra.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert extra.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
