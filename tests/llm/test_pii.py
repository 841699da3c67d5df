import re

from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import pii
from helixframe.llm.pii import all_spans, find_personal_data, plain_spans, redacted

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in d][::-1]
    return sum(x[::2] + [sum(divmod(2 * v, 10)) for v in x[1::2]]) % 10 == 0


def brute(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    out = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0])]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789(%Zé", max_size=60))
def test_plain_spans_are_those_of_the_patterns(text):
    assert plain_spans(text) == brute(text)


def of(text):
    return [(k, text[s:e]) for k, s, e in all_spans(text)[1]]


def test_disguises_map_back_to_the_source():
    assert of("write bob [at] mail (dot) org now") == [("email", "bob [at] mail (dot) org")]
    assert of("write bob at mail dot org now") == [("email", "bob at mail dot org")]
    assert of("аnnа@mаil.org") == [("email", "аnnа@mаil.org")]
    assert of("call plus four nine three zero one two three four five six ok") == [("phone", "plus four nine three zero one two three four five six")]
    assert of("ip １２７.0.0.1!") == [("ip", "１２７.0.0.1")]
    assert of("x@y.zz​z.com") == [("email", "x@y.zz")]
    assert of("card four one one one one one one one one one one one one one one one.")[0][0] == "card"
    assert of("look at that thing, dot it on the one two three") == []


def test_long_texts_take_linear_time():
    for piece in ("a", "1", "1.", "+1 ", "@", "a@", "one ", " at ", "а", "  "):
        all_spans(piece * 200_000)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "a@b.cc +1 222 333 444", "x"), (None, "1.2.3.4", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_personal_data(df, redact=True).collect()
    assert sorted((r.doc_id or 0, len(r.spans), r.redacted) for r in got) == [(0, 1, "[IP]"), (1, 0, ""), (2, 0, ""), (2, 2, "[EMAIL] [PHONE]")]
    assert find_personal_data(df.limit(0)).count() == 0
    assert redacted("abcdef", [("ip", 0, 3), ("card", 2, 4)]) == "[IP]ef"


def test_query_digest(spark, tmp_path):
    from helixframe.llm.pii import base_digest, op4_personal_data

    texts = ["mail a@b.cc or c [at] d [dot] ee, +1 222 333 444", None, "1.2.3.4; 4111 1111 1111 1111"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_personal_data(spark, str(tmp_path)).collect()}
    assert all(got[i].base_sha256 == base_digest(t or "") for i, t in enumerate(texts))
    assert (got[0].n_email, got[0].n_phone, got[1].spans, got[2].spans) == (2, 1, "", "ip:0:7,card:9:28")


def test_partly_disguised_identifiers():
    assert of("write john@example dot com now") == [("email", "john@example dot com")]
    assert of("write john at example.com now") == [("email", "john at example.com")]
    assert of("host 192 dot 168 dot 0 dot 1!") == [("ip", "192 dot 168 dot 0 dot 1")]
    assert of("host one nine two dot one six eight dot one dot one ok") == [("ip", "one nine two dot one six eight dot one dot one")]
    assert of("call +49 five five five 0199 123 ok") == [("phone", "+49 five five five 0199 123")]
    assert of("１９２ dot 168 dot 0 dot 1") == [("ip", "１９２ dot 168 dot 0 dot 1")]
    assert of("999 dot 168 dot 0 dot 1, one two of the 3 at home. I dot it") == []


def test_composed_disguises_and_the_batch_test():
    import pyarrow as pa
    import pyarrow.compute as pc

    cases = {
        "bob [аt] mail [dot] org": "email", "10[.]0[.]0[.]1": "ip", "10 dot 0 dot 0 dot 1": "ip", "one two seven dot zero dot zero dot one": "ip",
        "bob[@]mail[.]com": "email", "bob @ mail . org": "email", "bob at mail.com": "email", "john@example dot com": "email", "１９２.168.0.1": "ip",
        "one nine two dot one six eight dot one dot one": "ip", "+49 five five five 0199 123": "phone", "bоb (at) mаil (dot) com": "email",
    }
    for text, kind in cases.items():
        for before, after in (("", ""), ("Čau ", " ok"), ("x" * 2000 + " ", "\n" + "y" * 2000)):
            spans = pii.all_spans(before + text + after)[1]
            assert (kind, len(before), len(before) + len(text)) in spans, (text, spans)
        if text.isascii():
            assert any(pc.match_substring_regex(pa.array([text]), x)[0].as_py() for x in (pii.MAYBE_NUMBER, pii.MAYBE_MAIL, pii.MAYBE_BRACKETED)), text
    for clean in ("see you @ home . then we go", "one of the two", "he is at home. dot", "a (.) b", "[at] noon"):
        assert pii.all_spans(clean) == ([], [])


CLEAN = """look at google.com please
we met at example.com yesterday
Join us at stackoverflow.com or at github.com/x
he studies at uni.edu
See more at wikipedia.org today
Find us at shop.example.com
I work at openai.com
She works at ibm.com
They are hosted at github.com
an engineer at google.com said
the team at mozilla.org wrote it
our friends at archive.org helped
available at python.org for free
published at arxiv.org last week
Visit us at nature.com
my professor at mit.edu left
is it at npm.com?
It is at pypi.org
Everything at amazon.com is cheap
read it at bbc.co.uk
Read about it at nytimes.com
I bought it at ebay.com
he was at slack.com then
you can order at pizza.de
Sign up at spotify.com
Log in at paypal.com
Looking at reddit.com all day
posted at medium.com
a researcher at cern.ch
the server at ftp.gnu.org is down
Documentation at docs.rs is good
Slides at slideshare.net help
videos at youtube.com are long
the code lives at gitlab.com
Shopping at ikea.com again
People at twitter.com complain
check it out at kaggle.com
stay at booking.com houses
Students at stanford.edu protest
the article at wired.com is old
We are at fosdem.org now
Get help at gnome.org
her blog at wordpress.com
your profile at linkedin.com
this page at w3.org
Those files at kernel.org
they meet at meetup.com
sold at etsy.com
What happened at yahoo.com
nothing changed at aol.com
some nurse at nhs.uk
developers at apache.org agree
look at google dot com please""".split("\n")


def test_prose_is_not_a_mail_address():
    assert len(CLEAN) > 50
    for line in CLEAN:
        for text in (line, line.lower(), "Well. " + line + " Indeed."):
            assert [x for x in pii.all_spans(text)[1] if x[0] == "email"] == [], text
    for text in ("write to j.doe at example.com", "anna2 at mail.de", "mail bob (at) work.com", "contact maria at uni dot edu"):
        assert [k for k, *_ in pii.all_spans(text)[1]] == ["email"], text


def test_many_identifiers_take_linear_time():
    import time

    text = "".join(f"u{i}@mail{i}.org c{i} [at] d{i} [dot] com 10.0.{i % 256}.1 +1 222 333 {i % 9000 + 1000}, one two seven dot zero dot zero dot one; " for i in range(25_000))
    assert len(text) > 2_500_000
    began = time.process_time()
    plain, every = all_spans(text)
    assert len(plain) == 75_000 and len(every) == 125_000
    assert time.process_time() - began < 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(1, 5))), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(1, 5))))
def test_without_equals_all_pairs(spans, known):
    spans, known = ([(k, s, s + n) for k, s, n in x] for x in (spans, known))
    assert pii._without(spans, known) == [x for x in spans if not any(k == x[0] and a < x[2] and x[1] < b for k, a, b in known)]
