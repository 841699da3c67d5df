"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q and at least two periods that no neighbouring word extends. Per
batch, the words of all texts are numbers in one array, texts apart by numbers of their own. Runs of small periods are
read off directly. For periods from 3t up to 6t, at dyadic scales t, a synchronising set takes the positions whose
window of t words has the least hash within t, so copies of a text of 2t words hold them at the same places; windows
with a period of at most t/3 don't count. Two members with equal contexts of 2t words propose their distance as a
period. Where windows don't count, members can be absent: there the ends of regions with so small a period, known from
the scales before, propose every period of the scale. Each proposal is extended both ways by prefix hashes; an interval
found with several periods keeps the smallest. A text is never cut: its memory is some hundred bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: A run has at least so many words.
LEAST_LENGTH = 12
#: The first scale; periods under 3 times this are read off directly.
FIRST = 8
#: Words of the texts that are searched together; a longer text is searched alone.
TOGETHER = 1 << 19

_PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _PRIME
_LOW = np.uint64((1 << 32) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, both under it."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    middle = a1 * b0 + a0 * b1  # under 2^62
    # 2^64 is 8, and 2^32 times the middle is split at its bit 29
    x = (a1 * b1 << np.uint64(3)) + (middle >> np.uint64(29)) + _reduced((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _reduced(_reduced(x) + _reduced(a0 * b0))


class _Prefixes:
    """Hashes of any stretch of a sequence, for the longest common extension of two places."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.powers = np.ones(n + 1, np.uint64)
        done, step = 1, _BASE
        while done < n + 1:
            more = min(done, n + 1 - done)
            self.powers[done : done + more] = _times(self.powers[:more], np.full(1, step, np.uint64))
            done, step = done + more, step * step % _PRIME
        terms = _times(x.astype(np.uint64) + np.uint64(1), self.powers[:n])
        high, low = np.cumsum(terms >> np.uint64(32), dtype=np.uint64), np.cumsum(terms & _LOW, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _reduced(_times(_reduced(high), np.full(1, 1 << 32, np.uint64)) + _reduced(low))

    def equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` at i and at i + q are equal."""
        s, m = self.sums, np.uint64(_PRIME)
        left, right = _reduced(s[i + length] + m - s[i]), _reduced(s[i + q + length] + m - s[i + q])
        return _times(left, self.powers[q]) == right

    def extend(self, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end): the longest stretch with i in it whose words equal those q on; i's own does."""
        n = len(self.sums) - 1
        ahead, back = np.ones(len(i), np.int64), np.zeros(len(i), np.int64)
        step = 1 << max(0, n.bit_length() - 1)
        while step:
            fits = i + q + ahead + step <= n
            ok = np.zeros(len(i), bool)
            ok[fits] = self.equal((i + ahead)[fits], q[fits], np.full(fits.sum(), step))
            ahead += ok * step
            fits = i - back - step >= 0
            ok[:] = False
            ok[fits] = self.equal((i - back - step)[fits], q[fits], np.full(fits.sum(), step))
            back += ok * step
            step >>= 1
        return i - back, i + ahead


def _direct(x: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal stretches of ``x`` with period q and at least ``least`` words."""
    same = np.flatnonzero(x[:-q] == x[q:])
    if len(same) < least - q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.append(0, cut + 1)], same[np.append(cut, len(same) - 1)]
    length = last - first + 1 + q
    long = length >= least
    return first[long], length[long]


def _window_least(h: np.ndarray, t: int) -> np.ndarray:
    """The least of h over [i, i + t] for every i up to len(h) - t - 1; t is a power of two."""
    least, width = h, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:-1], h[t:])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _synchronised(hashes: np.ndarray, contexts: np.ndarray, periodic: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q): members of the synchronising set with equal contexts, q apart, 3t <= q < 6t. ``periodic`` marks windows
    that don't count. Equal contexts are at least t/3 apart, so each meets at most 18 others."""
    h = np.where(periodic, np.uint64(0xFFFFFFFFFFFFFFFF), hashes)
    least = _window_least(h, t)
    m = min(len(least), len(contexts))
    member = np.flatnonzero(((h[:m] == least[:m]) | (h[t : t + m] == least[:m])) & (least[:m] != np.uint64(0xFFFFFFFFFFFFFFFF)))
    context = contexts[member]
    order = np.argsort(context, kind="stable")
    at, context = member[order], context[order]
    found_i, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_, k = np.arange(len(at) - 1), 1
    while len(open_):
        open_ = open_[open_ + k < len(at)]
        gap = at[open_ + k] - at[open_]
        near = (context[open_ + k] == context[open_]) & (gap < 6 * t)
        open_, gap = open_[near], gap[near]
        far = gap >= 3 * t
        found_i.append(at[open_[far]])
        found_q.append(gap[far])
        k += 1
    i, q = np.concatenate(found_i), np.concatenate(found_q)
    # contexts that overlap at one distance are of one stretch
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    if len(i):
        new = np.append(True, (q[1:] != q[:-1]) | (i[1:] - i[:-1] > 2 * t))
        i, q = i[new], q[new]
    return i, q


def runs(x: np.ndarray, starts: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``x`` with at least ``least`` words, by start, then period.

    ``x`` holds texts one after another from ``starts``, numbers from 0 on; each text ends with a number that occurs
    nowhere else.
    """
    lengths = np.diff(np.append(starts, len(x)))
    longest = int(lengths.max(initial=0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> None:
        """Proposals become runs: of one interval the smallest period counts."""
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
        found.append((start[new], length[new], period[new]))

    def known() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    direct = [(q, *_direct(x, q, max(2 * q, FIRST if 3 * q <= FIRST else least))) for q in range(1, min(3 * FIRST, longest // 2 + 1))]
    if direct:
        keep(np.concatenate([d[1] for d in direct]), np.concatenate([d[2] for d in direct]), np.concatenate([np.full(len(d[1]), d[0]) for d in direct]))
    prefixes, hashes, t = None, None, FIRST
    while 6 * t < longest:
        # texts too short for two such periods go
        if hashes is None:
            hashes, width = _mixed(x.astype(np.uint64) + np.uint64(12345), np.uint64(77)), 1
            own, begins, total = np.arange(len(starts)), starts, len(x)
        size = np.diff(np.append(begins, total))
        long = size > 6 * t
        if not long.all():
            hashes, own, total = hashes[np.repeat(long, size)[: len(hashes)]], own[long], int(size[long].sum())
            begins = np.append(0, np.cumsum(size[long]))[:-1]
        while width < t:
            hashes = _mixed(hashes[:-width], hashes[width:])
            width *= 2
        contexts = _mixed(hashes[:-t], hashes[t:])
        shift = starts[own] - begins  # from places here to places in x
        start, length, period = known()
        small = (3 * period <= t) & (length >= t)
        start, length, period = start[small], length[small], period[small]
        doc = np.searchsorted(starts, start, side="right") - 1
        here = np.searchsorted(own, doc)
        inside = (here < len(own)) & (own[np.minimum(here, len(own) - 1)] == doc)
        s, e = (start - shift[np.minimum(here, len(own) - 1)])[inside], length[inside]
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, np.minimum(s + e - t + 1, len(hashes)), -1)
        i, q = _synchronised(hashes, contexts, np.cumsum(edge)[:-1] > 0, t)
        to = shift[np.searchsorted(begins, i, side="right") - 1] if len(i) else i
        proposals = [(i + to, q)]
        wide = inside & (length >= 3 * t - 1)
        if wide.any():
            end, p = (start + length)[wide], period[wide]
            q = np.tile(np.arange(3 * t, 6 * t), len(end))
            i, p = np.repeat(end, 3 * t) - q + 1, np.repeat(p, 3 * t)
            ok = (i >= 0) & (i + q + q - p <= len(x))
            i, q, p = i[ok], q[ok], p[ok]
            ok = x[i] == x[i + q]
            i, q, p = i[ok], q[ok], p[ok]
            prefixes = prefixes or _Prefixes(x)
            ok = prefixes.equal(i, q, q - p)
            proposals.append((i[ok], q[ok]))
        i, q = np.concatenate([a for a, _ in proposals]), np.concatenate([b for _, b in proposals])
        ok = x[i] == x[i + q]
        i, q = i[ok], q[ok]
        if len(i):
            prefixes = prefixes or _Prefixes(x)
            first, end = prefixes.extend(i, q)
            ok = end - first >= q
            keep(first[ok], (end - first + q)[ok], q[ok])
        t *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, length, period = known()
    found.clear()
    keep(start, length, period)
    start, length, period = found[0]
    enough = length >= least
    start, length, period = start[enough], length[enough], period[enough]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, offsets, one more than texts). A word has no U+0020 and no U+0009 to U+000D; null has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    flat = split.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = np.append(0, np.cumsum(filled))
    return flat.filter(pa.array(filled)), counts[offsets]


def planted(ids: list[int | None], offsets: np.ndarray) -> np.ndarray:
    """Where each word comes from: one document in ten (by crc32 of its id) is made periodic from some word on."""
    source = np.arange(offsets[-1])
    for k, i in enumerate(ids):
        h = 1 if i is None else zlib.crc32(str(i).encode())
        start, n = int(offsets[k]), int(offsets[k + 1] - offsets[k])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[start + a : start + n] = start + a + np.arange(n - a) % p
    return source


def _joined(words: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, words), pa.scalar(" ", pa.large_string()))


_FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _search(ids: list[int | None], texts: pa.Array, plant: bool) -> dict[str, list]:
    """The columns of the result for some texts. With ``plant``, by the rule of ``planted``."""
    words, offsets = words_of(texts)
    if plant:
        words = words.take(pa.array(planted(ids, offsets)))
    n = np.diff(offsets)
    # numbers of words, and behind each text a number of its own
    encoded = words.dictionary_encode()
    x = np.empty(len(words) + len(n), np.int64)
    begins = offsets[:-1] + np.arange(len(n))
    own = np.zeros(len(x), bool)
    own[begins + n] = True
    x[~own] = encoded.indices.to_numpy(zero_copy_only=False)
    x[own] = len(encoded.dictionary) + np.arange(len(n))
    start, length, period = runs(x, begins)
    doc = np.searchsorted(begins, start, side="right") - 1
    # a run's words go, but for its first period
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    stay = (np.cumsum(edge)[:-1] == 0)[~own]
    collapsed = _joined(words.filter(pa.array(stay)), np.add.reduceat(np.append(stay, False).astype(np.int64), np.minimum(offsets[:-1], len(stay))) * (n > 0)) if len(n) else []
    lines = [f"{s},{m},{q}\n" for s, m, q in zip((start - begins[doc]).tolist(), length.tolist(), period.tolist())]
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    out: dict[str, list] = {f.split()[0]: [] for f in _FIELDS.split(", ")}
    out["doc_id"] = ids
    out["collapsed_sha256"] = [hashlib.sha256(c.as_buffer() or b"").hexdigest() for c in collapsed]
    for k in range(len(n)):
        a, b = int(bounds[k]), int(bounds[k + 1])
        out["n_runs"].append(b - a)
        out["runs_sha256"].append(hashlib.sha256("".join(lines[a:b]).encode()).hexdigest())
        best = a + int(np.argmax(length[a:b])) if b > a else None  # the first of equal lengths has the least start, then period
        values = [None] * 4 if best is None else [int(start[best] - begins[k]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best])]
        for name, v in zip(("start", "length", "period", "exponent_milli"), values):
            out[name].append(v)
    return out


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period; null without one) and digests of all runs and of
    the words that stay when every run keeps its first period only.

    Whole texts of any length; null and empty texts have no runs and the digests of nothing. Null and repeated doc_ids
    are rows like others, other columns are ignored, an empty table gives no rows. ``plant`` makes one document in ten
    periodic, by its doc_id; those with a null doc_id stay as they are.
    """
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in _FIELDS.split(", ")])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < b.num_rows:
                before = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, before + 6 * TOGETHER, side="right")))
                yield pa.RecordBatch.from_pydict(_search(ids[i:j], texts.slice(i, j - i), plant), schema=schema)
                i = j

    return docs.select("doc_id", "text").mapInArrow(tasks, _FIELDS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, one document in ten made periodic first; see ``periodic_runs``."""
    small_batches(spark)
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
