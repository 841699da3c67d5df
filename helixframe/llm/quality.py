"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure (lengths, symbols, stop words, lines, repeats) is a number of the row's own text, made of built-in
functions row by row, so nothing is shuffled and nothing grows with the corpus. The rules are data: a name, an
expression over the measures and the range that passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space between words: U+0020 and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have he in is it its of on or that the this to was were which with".split(),
    "de": "auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sich sie sind und von war wie zu zum".split(),
    "fr": "au aux ce dans de des du elle en est et il la le les mais ne ou par pas pour qui que se sur un une".split(),
    "es": "al como con de del el en es ha la las lo los más no para pero por que se su sus un una y".split(),
}


@dataclass(frozen=True)
class Rule:
    """A text passes if ``measure`` (SQL over the columns of ``measures``) is within [low, high]; None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        """Whether the rule rejects the row, as a column that is never null."""
        value = F.expr(self.measure)
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < F.lit(self.low))
        if self.high is not None:
            bad = bad | (value > F.lit(self.high))
        return F.coalesce(bad, F.lit(True))


#: Shares are of words, of characters in words, or of lines with a word; a text without words has shares of 0.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.5, 12.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", None, 0.1),
    Rule("exclamations", "n_exclamations / greatest(n_words, 1)", None, 0.2),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", None, 0.3),
    Rule("digits", "n_digits / greatest(word_chars, 1)", None, 0.2),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.06, None),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", None, 0.5),
)


#: Classes of characters that are counted (the insides of square brackets).
CLASSES = {"n_symbols": "#*$%&|<>", "n_exclamations": "!", "n_capitals": "\\p{Lu}", "n_digits": "0-9"}


def _only(column: str, kept: str) -> Column:
    """The characters of ``column`` that are of the class ``kept``."""
    return F.regexp_replace(column, f"[^{kept}]+", "")


def measures(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """doc_id and the measures of every row of ``docs`` (doc_id, text; others ignored), whole texts of any length.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_exclamations, n_capitals (Unicode Lu),
    n_digits (0-9), n_stop_words (words that are one as written in lower case or capitalised), n_lines (\\n-split, with a word), n_dup_lines (those
    equal to an earlier one), n_repeat_words (words in 3-word windows that the text has twice or more). Windows are
    compared by 64 bits of hash. Null counts as empty and has zeros. Null and repeated doc_ids are rows like others; an
    empty table gives no rows.
    """
    small = {w for x in STOP_WORDS.values() for w in x} if stop_words is None else set(stop_words)
    stop = sorted(small | {w.capitalize() for w in small})
    counted = ["n_words", "word_chars", *CLASSES, "n_stop_words", "n_lines", "n_dup_lines"]
    size = lambda c: F.size(c).cast("long")
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = text.select(
        "doc_id", _only("text", "".join(CLASSES.values())).alias("marks"), F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    # the hash of the window that begins at each word; words is read at several places, so it is made once
    following = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    windows = split.select(
        "doc_id", size("words").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[F.length(_only("marks", kept)).cast("long").alias(name) for name, kept in CLASSES.items()],
        size(F.filter("words", lambda w: w.isin(stop))).alias("n_stop_words"),
        size("lines").alias("n_lines"), (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.slice(F.transform("words", following), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"),
    )
    place = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windows.select("doc_id", *counted, F.when(some, F.sort_array(place)).otherwise(F.slice(place, 1, 0)).alias("ordered"))
    # equal windows stand side by side
    same = lambda x, j: F.coalesce(F.get("ordered", j)["h"] == x["h"], F.lit(False))
    shared = F.filter("ordered", lambda x, j: same(x, j - 1) | same(x, j + 1))
    starts = ordered.select("doc_id", *counted, F.sort_array(F.transform(shared, lambda x: x["i"])).alias("starts"))
    # a window adds three words, or as many as it stands behind the one before
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last"))
    covered = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])
    return starts.select("doc_id", *counted, covered.alias("n_repeat_words"))


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``measured`` with failed_rules (names, comma-joined, in order of the table) and passed, in one projection."""
    failed = F.concat_ws(",", *[F.when(r.failed(), F.lit(r.name)) for r in rules])
    return measured.select("*", failed.alias("failed_rules"), (failed == "").alias("passed"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document, whether the base rule fails it, and the verdict of RULES where it doesn't."""
    judged = judge(measures(table(spark, sf_dir, "documents")))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("passed")).alias("kept"),
        "n_exclamations", "n_capitals", "n_digits", "n_stop_words", "n_lines", "failed_rules",
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({v for x in STOP_WORDS.values() for w in x for v in (w, w.capitalize())}))
_FAILED_SQL = ", ".join(
    f"CASE WHEN {' OR '.join(f'{r.measure} {sign} {bound}' for sign, bound in (('<', r.low), ('>', r.high)) if bound is not None)} THEN '{r.name}' END" for r in RULES
)

#: The same for DuckDB, window by window.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '{SPACE}'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
t AS (SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
s AS (SELECT r, least(3, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -3)) AS more FROM c WHERE n > 1),
k AS (SELECT r, sum(more) AS n FROM s GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    {", ".join(f"CAST(length(regexp_replace(text, '[^{kept}]+', '', 'g')) AS BIGINT) AS {name}" for name, kept in CLASSES.items())},
    CAST(len(list_filter(words, lambda x: x IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN k ON k.r = w.r),
f AS (SELECT *, concat_ws(',', {_FAILED_SQL}) AS failed_rules, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept,
    n_exclamations, n_capitals, n_digits, n_stop_words, n_lines, failed_rules FROM f
"""
