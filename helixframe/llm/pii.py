"""Offset-preserving search for personal data, plain and disguised.

Plain identifiers are found in the text itself. For disguised ones transducers rewrite the text, one on the other's output:
first look-alike letters, digits of other scripts and invisible characters, then spelled digits and "at"/"dot". Each keeps,
for every rewritten character, the characters it came from; identifiers found in the rewritten text are mapped back
through both. Which texts can hold a disguise at all is tested for a batch at once.

All offsets are code points, ends exclusive. Each detector needs time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}

# Spelled digits, the letters that look like ASCII ones, invisible characters.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve", "+": "plus",
}
LOOK_ALIKE = dict(zip("аеорсхуіѕјһԁԛԝкмтвнАВЕКМНОРСТХІЅЈοανικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyisjhdqwkmtbhABEKMHOPCTXISJoavikptuABEZHIKMNOPTYX", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
#: Spelled digits in a row that are read as a number.
LEAST_SPELLED = 7

DIGIT_OF = {w: d for d, words in SPELLED.items() for w in words.split()}
_WORD = "(?:" + "|".join(sorted(map(re.escape, DIGIT_OF), key=len, reverse=True)) + ")"


def _one_to_one() -> dict[str, str]:
    out = dict(LOOK_ALIKE)
    out |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
    for c in map(chr, range(0x80, min(sys.maxunicode, 0x1FFFF))):
        if unicodedata.decimal(c, None) is not None:
            out.setdefault(c, str(unicodedata.decimal(c)))
    return out | dict.fromkeys(INVISIBLE, "")


CHARS = _one_to_one()
_FOREIGN = frozenset(CHARS)
_SPELLED_RUN = re.compile(rf"(?<![^\W_]){_WORD}(?:[ ,.-]{{1,2}}{_WORD}){{{LEAST_SPELLED - 1},}}(?![^\W_])", re.I)
_WORDS = re.compile(_WORD, re.I)
_SIGN = r"[ ]?(at|dot|@|\.)[ ]?"
_BRACKETED = re.compile(rf"[ ]{{0,2}}(?:\[{_SIGN}\]|\({_SIGN}\)|\{{{_SIGN}\}}|<{_SIGN}>)[ ]{{0,2}}", re.I)
_BARE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+", re.I)
_BARE = re.compile(r" (at|dot) ", re.I)

_AT = r"(?: at |@|[ ]{0,2}[\[({<][ ]?at[ ]?[\])}>][ ]{0,2})"
_DOT = r"(?: dot |\.|[ ]{0,2}[\[({<][ ]?dot[ ]?[\])}>][ ]{0,2})"
# Fixed value: endings that are taken for a mail's where blanks stand around its signs.
ENDINGS = "com|org|net|edu|gov|info|biz|io|eu|de|fr|es|uk|at|ch|it"
_SPACED_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} @ [A-Za-z0-9-]{{1,63}}(?: \. [A-Za-z0-9-]{{1,63}})* \. (?:{ENDINGS})(?![A-Za-z0-9-])", re.I)
_MIXED_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I)
_TOKEN = rf"(?:{_WORD}(?![^\W_])|[+(]{{0,2}}[0-9][0-9().]*+|dot(?![^\W_]))"
_NUMBER_RUN = re.compile(rf"(?<![\w.()+]){_TOKEN}(?:[ ,.-]{{1,2}}{_TOKEN})++", re.I)
_TOKENS = re.compile(_TOKEN, re.I)

# Tests, in Arrow's syntax, that every text with a disguise of the second kind passes.
_SEP = r"[ ,.-]{1,2}"
_NAMED = f"(?:{_WORD[3:-1]}|dot)"
MAYBE_NUMBER = rf"(?i)(?:^|[^a-z]){_NAMED}{_SEP}(?:{_NAMED}(?:$|[^a-z])|[0-9+(])|[0-9().]{_SEP}{_NAMED}(?:$|[^a-z])"
MAYBE_MAIL = r"(?i)[a-z0-9._%+-](?: at | ?@ ?| {0,2}[\[({<] ?(?:at|@) ?[\])}>] {0,2})[a-z0-9-]+(?: dot | ?\. ?| {0,2}[\[({<] ?(?:dot|\.) ?[\])}>] {0,2})[a-z0-9]"
MAYBE_BRACKETED = r"(?i)[\[({<] ?(?:at|dot|@|\.) ?[\])}>]"

# Words before "at <site>" in ordinary prose, endings of such words, and words before a common noun.
PROSE = frozenset((
    "account accounts am and answer answers anything app apps are arrive arrived article articles as author available back be because been best blog book books browse but buy by call "
    "came check code codes come company course courses data deals docs doctor document documents down each engineer everyone everything file files find found free friend friends from "
    "games get go goes got guide had hang has have he help her here him home host i if im images in info information is it its job jobs join lecturer letter life link links list live "
    "lives look looks made many maps me meet meets met money more much music news not now nurse of off offer office officer on one online only open or order orders out over page pages "
    "papers people photo photos pictures post posts prices prize products professor profile project read reads release report research researcher reviews sale school see seen sell sells "
    "server service shop shops sign since sit site slides so sold some something songs source staff start starts stay stays stop store stories story student students studied studies "
    "study support talk talks teacher team tests text than that them then there these they things this those though tickets times to today tools tutorial until up us users video videos "
    "visit was watch way we website went were what when where which while who with work works worse wrote year years you yours"
).split())
PROSE_ENDINGS = ("ing", "ed", "able", "ible", "ly", "ness", "tion", "ions", "ment", "ments", "ists", "ers")
ARTICLES = frozenset("a an the my your his her our their its this that these those some any every each no another new former senior".split())
_BEFORE = re.compile(r"([A-Za-z]+) +$")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, per kind leftmost and non-overlapping; matches that fail their check are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *x) for x in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _is_prose(text: str, start: int, end: int) -> bool:
    """Whether "<word> at <site>" from ``start`` is a sentence rather than a mail address: the at is a bare word, and the
    word before it is an ordinary one that could stand there, or a noun with its article."""
    head, at, _ = re.split(r"( at )", text[start:end], maxsplit=1, flags=re.I) if re.search(" at ", text[start:end], re.I) else ("", "", "")
    word = head.lower()
    if not at or not word.isalpha():
        return False
    if word in PROSE or len(word) > 4 and word.endswith(PROSE_ENDINGS):
        return True
    before = _BEFORE.search(text, max(0, start - 40), start)
    return bool(before) and before[1].lower() in ARTICLES


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of every spelled sign or digit, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    for m in _BRACKETED.finditer(text):
        found.append((*m.span(), "@" if "@" in m[0] or "at" in m[0].lower() else "."))
    if " dot " in low and " at " in low:
        for m in _BARE_MAIL.finditer(text):
            if _is_prose(text, *m.span()):
                continue
            found += [(m.start() + b.start(), m.start() + b.end(), "@" if b[1].lower() == "at" else ".") for b in _BARE.finditer(m[0])]
    for m in _SPELLED_RUN.finditer(text):
        at = m.start()
        for w in _WORDS.finditer(text, m.start(), m.end()):
            found.append((at, w.end(), DIGIT_OF[w[0].lower()]))
            at = w.end()
    found.sort()
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def one_to_one(text: str) -> tuple[str, list[int]] | None:
    """The text with look-alikes, other scripts' digits and invisible characters replaced, and where each character was;
    None if there are none of those."""
    there = set(text) & _FOREIGN
    if not there:
        return None
    out, place = [], []
    for i, c in enumerate(text):
        if c in there:
            c = CHARS[c]
        if c:
            out.append(c)
            place.append(i)
    return "".join(out), place


def _mixed_spans(text: str) -> Iterator[Span]:
    """Mail with at or dot as words, and numbers with any of their digits or dots as words: complete identifiers only."""
    low = text.lower()
    if " at " in low or " dot " in low:
        yield from (("email", *m.span()) for m in _MIXED_MAIL.finditer(text) if not _is_prose(text, *m.span()))
    if " @ " in text and " . " in text:
        yield from (("email", *m.span()) for m in _SPACED_MAIL.finditer(text))
    for m in _NUMBER_RUN.finditer(text):
        chars: list[tuple[str, int, int]] = []
        words, before, at = 0, None, m.start()
        for t in _TOKENS.finditer(text, m.start(), m.end()):
            word = t[0].lower()
            kind = "dot" if word == "dot" else "digit" if word in DIGIT_OF else None
            between = text[at : t.start()]
            if "dot" not in (before, kind) and (between == "." or not before == kind == "digit"):
                chars += [(c, at + i, at + i + 1) for i, c in enumerate(between)]
            chars += [(c, t.start() + i, t.start() + i + 1) for i, c in enumerate(t[0])] if kind is None else [("." if kind == "dot" else DIGIT_OF[word], *t.span())]
            words, before, at = words + (kind is not None), kind, t.end()
        if words and sum(c[0].isdigit() for c in chars) >= 4:  # the shortest identifier, an IP, has four
            yield from ((k, chars[s][1], chars[e - 1][2]) for k, s, e in plain_spans("".join(c[0] for c in chars)))


def disguised_spans(text: str, plain: list[Span], maybe: bool = True) -> list[Span]:
    """Disguised identifiers that overlap no plain one of their kind. ``maybe`` false says that the text as it stands has
    no spelled signs or digits."""
    mapped = None if text.isascii() else one_to_one(text)
    if mapped is None:
        return _spelled_spans(text, plain, ()) if maybe else []
    inner, place = mapped
    back = lambda spans: [(k, place[a], place[b - 1] + 1) for k, a, b in spans]
    found = _without(back(plain_spans(inner)), plain)
    return found + _without(back(_spelled_spans(inner, (), ())), plain + found)


def _spelled_spans(text: str, plain: Iterable[Span], known: Iterable[Span]) -> list[Span]:
    """What spelled signs and digits hide in ``text``."""
    plain = [*plain, *known]
    changes = rewrites(text)
    if not changes:
        return _without(_mixed_spans(text), plain)
    parts: list[str] = []
    anchors: list[tuple[int, int, int]] = []  # (place in the rewritten text, start, end in the source), for changes
    at = length = 0
    for start, end, new in changes:
        parts += (text[at:start], new)
        length += start - at
        anchors.append((length, start, end))
        length += len(new)
        at = end
    parts.append(text[at:])
    places = [a[0] for a in anchors]
    def source(i: int) -> tuple[int, int]:
        """The source characters of rewritten character i."""
        k = bisect_right(places, i) - 1
        while k > 0 and not changes[k][2] and places[k] == i and k + 1 < len(places) and places[k + 1] == i:
            k -= 1
        if k < 0:
            return i, i + 1
        place, start, end = anchors[k]
        if i < place + len(changes[k][2]):
            return start, end
        shift = i - place - len(changes[k][2])
        return end + shift, end + shift + 1

    out = []
    mapped = "".join(parts)
    for found in (plain_spans(mapped), _mixed_spans(mapped)):
        out += _without(((kind, source(s)[0], source(e - 1)[1]) for kind, s, e in found), plain + out)
    return out


def _without(spans: Iterable[Span], known: Iterable[Span]) -> list[Span]:
    """Those that overlap no known span of their kind."""
    ends: dict[str, list[int]] = {}  # per kind, the largest end up to each known span, by start
    starts: dict[str, list[int]] = {}
    for k, a, b in sorted(known, key=lambda s: s[1]):
        starts.setdefault(k, []).append(a)
        own = ends.setdefault(k, [])
        own.append(max(b, own[-1]) if own else b)
    out = []
    for x in spans:
        i = bisect_left(starts.get(x[0], []), x[2])
        if not i or ends[x[0]][i - 1] <= x[1]:
            out.append(x)
    return out


def all_spans(text: str, maybe: bool = True) -> tuple[list[Span], list[Span]]:
    """(plain spans, plain and disguised spans), each by start and kind."""
    plain = plain_spans(text)
    more = disguised_spans(text, plain, maybe)
    return plain, sorted(plain + more, key=lambda s: (s[1], ORDER[s[0]])) if more else plain


def redacted(text: str, spans: list[Span]) -> str:
    """Spans replaced by [KIND]; of overlapping spans the first is named and the cover is joined."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += (text[at:s], f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: the id, its spans array<struct<kind,start,end,plain>>, and with ``redact`` the cleaned text.

    Null text counts as empty (no spans, cleaned text ''). Ids may be null or repeated and repeated rows stay; other
    columns are ignored, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, spans array<struct<kind:string,start:long,end:long,plain:boolean>>" + ", redacted string" * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            texts = pc.fill_null(batch.column(1), "")
            maybe = [np.asarray(pc.match_substring_regex(texts, x)) for x in (MAYBE_NUMBER, MAYBE_MAIL, MAYBE_BRACKETED)]
            for text, able in zip(texts.to_pylist(), np.logical_or.reduce(maybe), strict=True):
                plain, every = all_spans(text, bool(able))
                first = set(plain)
                spans.append([{"kind": k, "start": s, "end": e, "plain": (k, s, e) in first} for k, s, e in every])
                if redact:
                    clean.append(redacted(text, every))
            cols = [batch.column(0), pa.array(spans, SPAN_TYPE)] + ([pa.array(clean, pa.string())] if redact else [])
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "spans"] + ["redacted"] * redact)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of find_personal_data over all documents; counts are of all spans, plain and disguised."""
    small_batches(spark)
    found = find_personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["plain"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text)).encode()).hexdigest()
