"""Minimum free energy of nested secondary structures, for many sequences at a time.

The interval recurrences are filled by diagonals: all intervals of a length, of all sequences of a block, at once. An
interior loop (a, b) inside (i, j) is (a - 1, b - 1) inside (i + 1, j - 1) unless a or b is 1, so its least energy by
size comes from the diagonal before the last and two edges; loops of any size are covered in cubic time. Tables are kept
by first and by last place, which makes each step one sum and one minimum of slices.

Energies are whole hundredths of a kcal/mol. Dangling ends, terminal mismatches and special loops have none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published nearest-neighbour energies of RNA at 37 degrees, in hundredths of a kcal/mol.
#: Pairs in the order of STACK.
PAIRS = ("CG", "GC", "GU", "UG", "AU", "UA")
#: Row: the outer pair; column: the inner pair read from its 3' end.
STACK = np.array(
    [
        [-240, -330, -210, -140, -210, -210],
        [-330, -340, -250, -150, -220, -240],
        [-210, -250, 130, -50, -140, -130],
        [-140, -150, -50, 30, -60, -100],
        [-210, -220, -140, -60, -110, -90],
        [-210, -240, -130, -100, -90, -130],
    ],
    dtype=np.int32,
)
#: Initiation by size, from the least; larger loops grow by GROWTH times the logarithm of the ratio to the last size.
HAIRPIN, BULGE, INTERIOR = (3, (540, 560, 570, 540, 600, 550, 640)), (1, (380, 280, 320, 360, 400, 440)), (2, (100, 100, 110, 200, 200))
GROWTH = 107.856
ASYMMETRY, WEAK_END, WEAK_INTERIOR = 60, 50, 70
#: A multiple loop, a free base in it, a helix in it.
MULTI, MULTI_BASE, MULTI_HELIX = 340, 0, 40

INF = 1 << 28
#: The same in short numbers, which are used while no part of a structure is below LOWEST: two INF fit, and an INF less
#: LOWEST stays above DEAREST, what a helix with its hairpin loop costs at most (twice for two).
SHORT_INF, LOWEST, DEAREST = 16_000, -10_000, 1_500
LEAST_LOOP = 3
#: Cells of one table of a block: sequences x places x span.
BLOCK_CELLS = 500_000
#: The code of each letter, 4 for all others, and the pair of two codes, -1 for none.
CODES = np.full(256, 4, dtype=np.int8)
for _i, _c in enumerate("ACGU"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i
CODES[ord("T")] = CODES[ord("t")] = 3
PAIR_OF = np.full((5, 5), -1, dtype=np.int8)
for _i, _p in enumerate(PAIRS):
    PAIR_OF["ACGU".index(_p[0]), "ACGU".index(_p[1])] = _i
#: Stacks by four letters: a pair's first one, the inner pair's, the pair's last one, the inner pair's; INF for no pair.
STACKED = np.full((5, 5, 5, 5), INF, dtype=np.int32)
for _i, _p in enumerate(PAIRS):
    for _j, _q in enumerate(PAIRS):
        STACKED["ACGU".index(_p[0]), "ACGU".index(_q[1]), "ACGU".index(_p[1]), "ACGU".index(_q[0])] = STACK[_i, _j]
STACKED = STACKED.ravel()


def initiation(table: tuple[int, tuple[int, ...]], size: int) -> int:
    first, values = table
    if size < first + len(values):
        return values[size - first]
    last = first + len(values) - 1
    return values[-1] + round(GROWTH * float(np.log(size / last)))


class _TooLow(Exception):
    """An energy that short numbers may not hold."""


def _closed(codes: np.ndarray, span: int, short: bool = True) -> np.ndarray:
    """(span + 1, places, sequences): the least energy of what a pair of places i and i + d closes, with its weak end as
    seen from outside; INF (of its kind of number) or more where they do not pair.

    Tables have a row per distance, in it place by place the sequences side by side, so that a step runs over long rows.
    Short numbers hold all energies down to LOWEST; below it _TooLow is raised, and ``short=False`` takes long ones.
    """
    kind_of, inf = (np.int16, SHORT_INF) if short else (np.int32, INF)
    count, n = codes.shape
    codes = np.ascontiguousarray(codes.T).ravel()
    span, w = min(span, n - 1), n * count
    table = lambda: np.full((span + 1, w), inf, dtype=kind_of)
    by_first = table()  # closed by a pair
    weak_first, weak_last = table(), table()  # the same with the inner pair's part of an interior loop
    end_first, end_last = table(), table()  # the same with the penalty of a weak end
    many, many_last, two = table(), table(), table()  # one helix or more of a multiple loop, two or more
    inside = {}  # least interior loop by size (from 2 on), of the last two diagonals
    bulge = np.array([0] + [initiation(BULGE, s) for s in range(1, span + 1)], dtype=kind_of)
    interior = np.array([0, 0] + [initiation(INTERIOR, s) for s in range(2, span + 1)], dtype=kind_of)
    stacked = STACKED.astype(kind_of)
    stacked[STACKED == INF] = inf
    # two letters in one number: of a place and the next or the next but one; of a place and the one or two before it
    codes = codes.astype(np.intp)
    after, before_it = {}, {}
    for gap in (1, 2):
        after[gap], before_it[gap] = np.zeros(w, np.intp), np.zeros(w, np.intp)
        after[gap][: w - gap * count] = 25 * (codes[: w - gap * count] * 5 + codes[gap * count :])
        before_it[gap][gap * count :] = codes[gap * count :] * 5 + codes[: w - gap * count]
    pair_of = PAIR_OF.ravel()
    work, spare = np.empty((span + 1) * w, dtype=kind_of), [np.empty((span + 1) * w, dtype=kind_of) for _ in range(3)]
    constant = lambda x: kind_of(x)
    for d in range(1, span + 1):
        m = (n - d) * count

        def at(row, first: int, m: int = m):
            """``m`` entries of rows from the place ``first`` on."""
            return row[..., first * count : first * count + m]

        def stacks(left: int, right: int):
            """Stacks of (i, i + d) on (i + left, i + d - right)."""
            return stacked.take(at(after[left], 0) + at(before_it[right], d), mode="clip")

        kind = pair_of.take(at(codes, 0) * 5 + at(codes, d), mode="clip")
        weak = (kind >= 2).astype(kind_of)
        best = np.full(m, inf, dtype=kind_of)
        inner = d - 2  # the distance of the next pair inside
        if d > LEAST_LOOP:
            best = constant(initiation(HAIRPIN, d - 1)) + constant(WEAK_END) * weak
            if inner > LEAST_LOOP:
                np.minimum(best, at(by_first[inner], 1) + stacks(1, 1), out=best)
            if inner - 1 > LEAST_LOOP:  # one free base on either side: stacked all the same
                np.minimum(best, bulge[1] + (at(by_first[inner - 1], 2) + stacks(2, 1)), out=best)
                np.minimum(best, bulge[1] + (at(by_first[inner - 1], 1) + stacks(1, 2)), out=best)
            top = inner - LEAST_LOOP - 1  # the most free bases
            if top >= 2:
                rows, sizes = slice(inner - top, inner - 1), np.arange(top, 1, -1)  # inner distances upwards
                init = bulge[sizes][:, None]
                sums = work[: (top - 1) * m].reshape(top - 1, m)
                ends = np.add(at(end_last[rows], d - 1), init, out=sums).min(0)
                np.minimum(ends, np.add(at(end_first[rows], 1), init, out=sums).min(0), out=ends)
                np.minimum(best, ends + constant(WEAK_END) * weak, out=best)
                # by size from 2 on
                own = spare[d % 3][: (top - 1) * m].reshape(top - 1, m)
                np.minimum(at(weak_first[rows], 2)[::-1], at(weak_last[rows], d - 2)[::-1], out=own)
                own += (ASYMMETRY * np.arange(top - 1)).astype(kind_of)[:, None]
                if d - 2 in inside and top >= 4:
                    before = inside[d - 2]
                    np.minimum(own[2 : 2 + len(before)], at(before, 1), out=own[2 : 2 + len(before)])
                inside[d] = own
                loops = np.add(own, interior[2 : top + 1][:, None], out=sums).min(0)
                np.minimum(best, loops + constant(WEAK_INTERIOR) * weak, out=best)
            inside.pop(d - 2, None)
            if inner > 0:
                np.minimum(best, constant(MULTI + MULTI_HELIX) + constant(WEAK_END) * weak + at(two[inner], 1), out=best)
            best[kind < 0] = inf
            np.minimum(best, constant(inf), out=best)
        at(by_first[d], 0)[:] = best
        at(weak_first[d], 0)[:] = at(weak_last[d], d)[:] = best + constant(WEAK_INTERIOR) * weak
        end = best + constant(WEAK_END) * weak
        at(end_first[d], 0)[:] = at(end_last[d], d)[:] = end
        pairs = np.full(m, inf, dtype=kind_of)
        least = LEAST_LOOP + 1  # the distance in a helix; either part has one
        if d > 2 * least:
            sums = work[: (d - 2 * least) * m].reshape(-1, m)
            np.add(at(many[least : d - least], 0), at(many_last[least : d - least], d)[::-1], out=sums).min(0, out=pairs)
        pairs[pairs > 2 * DEAREST] = inf  # one of the parts has no helix
        at(two[d], 0)[:] = np.minimum(pairs, np.minimum(at(two[d - 1], 1), at(two[d - 1], 0)) + constant(MULTI_BASE))
        one = np.minimum(end + constant(MULTI_HELIX), np.minimum(at(many[d - 1], 1), at(many[d - 1], 0)) + constant(MULTI_BASE))
        some = np.minimum(np.minimum(one, pairs), constant(inf))
        if short and some.size and some.min() < LOWEST:
            raise _TooLow
        at(many[d], 0)[:] = at(many_last[d], d)[:] = some
    return end_first.reshape(span + 1, n, count)


def _block(codes: np.ndarray, span: int) -> np.ndarray:
    """Least energies of the rows of ``codes``. From the right, so that parts of a long row need only what follows them."""
    count, n = codes.shape
    span = min(span, max(n - 1, 0))
    width = max(span, BLOCK_CELLS // (count * (span + 1)))
    rest = np.zeros((n + 1, count), dtype=np.int32)
    for start in range((max(n - 1, 0) // width) * width if width else 0, -1, -max(width, 1)):
        if n:
            part = codes[:, start : start + width + span]
            try:
                closed = _closed(part, span)
            except _TooLow:
                closed = _closed(part, span, short=False)
        for i in range(min(start + width, n) - 1, start - 1, -1):
            far = min(closed.shape[0], n - i)
            helix = closed[:far, i - start] + rest[i + 1 : i + 1 + far]
            rest[i] = np.minimum(rest[i + 1], helix.min(0))
    return rest[0]


def least_energies(seqs: list[str], span: int = 200) -> list[float]:
    """kcal/mol of each sequence's best structure whose pairs are at most ``span`` apart; 0 where nothing pairs.

    Sequences of like length share a block, shorter ones filled up with letters that pair with none.
    """
    out = [0.0] * len(seqs)
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    while order:
        longest = max(len(seqs[order[-1]]), 1)
        take = max(1, BLOCK_CELLS // (longest * (min(span, longest) + 1)))
        own, order = order[-take:], order[:-take]
        codes = np.full((len(own), longest), 4, dtype=np.int8)
        for row, i in enumerate(own):
            raw = np.frombuffer(seqs[i].encode("latin-1", "replace"), dtype=np.uint8)
            codes[row, : len(raw)] = CODES[raw]
        for i, e in zip(own, _block(codes, span), strict=True):
            out[i] = float(e) / 100
    return out


def minimum_free_energy(span: int = 200):
    """A function of a column of sequences (DNA or RNA, either case; letters but ACGTU stay free); null for null."""

    @F.pandas_udf(T.DoubleType())
    def mfe(seq: pd.Series) -> pd.Series:
        own = seq.dropna()
        return pd.Series(least_energies(own.tolist(), span), index=own.index, dtype="float64").reindex(seq.index)

    return mfe
