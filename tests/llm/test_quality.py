import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixframe.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup, lines = set(), 0, [x for x in text.split("\n") if WORDS.search(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    small = {w for x in quality.STOP_WORDS.values() for w in x}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_exclamations": text.count("!"),
        "n_digits": sum(c in "0123456789" for c in text), "n_stop_words": sum(w in small or w in {x.capitalize() for x in small} for w in words),
        "n_lines": len(lines), "n_dup_lines": dup, "n_repeat_words": len(many),
    }


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\nx\n", "x \nx\n", "a\x0bb\x0cc\rd\x1ce f", "# ! %5 ÄÖ\U0001f600 The the THE", "a b c d a b c", "\x00 \x00 \x00 \x00"]


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    return {r.doc_id: r.asDict() for r in quality.measures(df).collect()}


def test_measures_equal_brute_force(spark):
    got = rows(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        assert {k: got[i][k] for k in plain(t)} == plain(t), t
    assert got[11]["n_capitals"] == 6


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#!3É", max_size=60), min_size=1, max_size=30))
def test_random_texts(spark, texts):
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        assert {k: got[i][k] for k in plain(t)} == plain(t)


def test_rules_and_query(spark, tmp_path):
    good = " ".join(f"the word{i} of" for i in range(30))
    texts = [good, "the of " * 40, " ".join(f"Xy{i}" for i in range(60)), good + " ####" * 9, good.upper(), good + "\n" + "\nsame old line here" * 9, "one two", None]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(None, good, "y"), (0, good, "z")]
    spark.createDataFrame(data, "doc_id long, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op11_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert [by[i].kept for i in range(8)] == [True] + [False] * 7
    assert [by[i].base_failed for i in range(8)] == [False, True, False, False, False, False, True, True]
    assert by[None].kept and by[2].failed_rules == "digits,stop_words" and by[3].failed_rules == "symbols" and by[4].failed_rules == "capitals,stop_words" and by[5].failed_rules == "repeated_lines"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert quality.op11_quality_rules(spark, f"{tmp_path}/none").count() == 0


def test_rules_are_data(spark):
    df = quality.measures(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), ["b"])
    rules = [quality.Rule("few", "n_words", None, 2), quality.Rule("stop", "n_stop_words", 1), quality.Rule("none", "cast(null as double)", 0)]
    row = quality.judge(df, rules).first()
    assert row.failed_rules == "few,none" and not row.passed
    assert quality.judge(df, rules[1:2]).first().passed


def test_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(150_000))
    assert rows(spark, [text])[0]["n_repeat_words"] == 150_000
    assert rows(spark, ["a " * 300_000])[0]["n_repeat_words"] == 300_000


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").coalesce(1)
    plan = quality.judge(quality.measures(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
