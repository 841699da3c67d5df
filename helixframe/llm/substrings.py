"""Removal of repeated byte windows by a depth-limited order of suffixes.

This is not a byte-by-byte radix sort: a pass a byte would move every suffix up to fifty times. Two digits of hashes stand in
for the fifty bytes. Suffixes are ordered only through ``depth`` bytes, most significant digit first, and only as far as they still tie:

1. The first digit of a suffix is the hash of the least gram in its first ``depth`` bytes. One gram is the digit of a
   whole run of suffixes, so a pass moves about one record for 16 bytes of text; equal grams of a packet move once.
   Grams that occur in one document alone are settled: their suffixes repeat nowhere.
2. For the others the remaining digits, all bytes around the gram, are moved (equal surroundings of a packet once) and
   the suffixes are sorted by their whole first ``depth`` bytes. Equal groups are exactly the repeated windows.

Texts are dealt to packets of about PACKET_BYTES by a hash of doc_id; that exchange is shared by all passes.
Memory of a task is bounded by a packet or a bucket, whose numbers grow with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, text_bytes

DEPTH = 50
GRAM = 20
PACKET_BYTES = 6 << 20
#: Bytes of text whose grams meet in one bucket, about.
BUCKET_BYTES = 16 << 20
#: Positions hashed at a time, so that arrays stay in cache.
BLOCK = 1 << 15
#: Anchors whose surroundings are laid out at a time.
ANCHORS = 1 << 16
LAST = np.int64(2**63 - 1)

_U = np.uint64
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_MUL = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every n neighbours: result i is of x[i:i+n]."""
    size = 1
    while size * 2 <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _gram_hash(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (20 = 16 + 4)."""
    h = _BYTE[data]
    four = None
    for k in range(4):
        step = 1 << k
        h = h[:-step] * _MUL[k] + h[step:]
        if k == 1:
            four = h
    return mix64(h[: len(data) - GRAM + 1] * _MUL[4] + four[16 : 16 + len(data) - GRAM + 1])


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least in some whole window of one text; ties are all taken."""
    n, span = len(data), depth - GRAM + 1
    room = np.zeros(n + 1, bool)  # a window may start here
    size = np.diff(offsets)
    for a, b in zip(offsets[:-1][size >= depth], offsets[1:][size >= depth], strict=True):
        room[a : b - depth + 1] = True
    places, hashes = [], []
    for at in range(0, n, BLOCK):
        # windows that hold a gram of this block start up to span - 1 before it; their grams end up to depth later
        lo, hi = max(0, at - span + 1), min(n, at + BLOCK + depth)
        if hi - lo < depth or not room[lo:hi].any():
            continue
        h = _gram_hash(data[lo:hi])
        least = _slide(h, span, np.minimum)  # by window start lo + i
        least = np.where(room[lo : lo + len(least)], least, _U(0))
        padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        most = _slide(padded, span, np.maximum)[: len(h)]
        i = np.flatnonzero((most == h) & (h != 0))
        i = i[(i + lo >= at) & (i + lo < at + BLOCK)]
        places.append(i + lo)
        hashes.append(h[i])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


class Packet:
    """The texts of a packet, their anchors in order of (bucket, gram), and the distinct grams of each bucket."""

    def __init__(self, rows: pa.Table, buckets: int, depth: int):
        ids = rows.column("doc_id").combine_chunks()
        self.ids = ids
        order = np.array([LAST if v is None else v for v in ids.to_pylist()], np.int64)
        self.data, self.offsets = text_bytes(rows.column("text"))
        self.depth, self.padded = depth, None
        place, gram = anchors(self.data, self.offsets, depth)
        bucket = (gram % _U(buckets)).astype(np.int64)
        sort = np.lexsort((place, gram, bucket))
        self.place, self.gram, self.bucket = place[sort], gram[sort], bucket[sort]
        self.row = np.searchsorted(self.offsets, self.place, side="right") - 1
        # an empty text shares its offset with the next one; the anchor is in the last that starts there
        self.doc = order[self.row] if len(order) else np.zeros(0, np.int64)
        new = np.ones(len(self.gram), bool)
        new[1:] = self.gram[1:] != self.gram[:-1]
        self.first = np.flatnonzero(new)  # of each distinct gram
        self.of = np.cumsum(new) - 1  # the distinct gram of each anchor

    def buckets(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) over the distinct grams."""
        own = self.bucket[self.first]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else []
        return [(int(own[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def survivors(self, masks: dict[int, bytes]) -> np.ndarray:
        """Anchors whose gram is repeated, by the masks of the buckets."""
        keep = np.zeros(len(self.first), bool)
        for bucket, a, b in self.buckets():
            if bucket in masks:
                keep[a:b] = np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=b - a).astype(bool)
        return np.flatnonzero(keep[self.of]) if len(self.of) else np.zeros(0, np.int64)

    def surroundings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes around each anchor, as rows of 2 * depth - GRAM; how many of the bytes before and after are there)."""
        side = self.depth - GRAM
        place, row = self.place[at], self.row[at]
        left = np.minimum(side, place - self.offsets[row])
        right = np.minimum(side, self.offsets[row + 1] - place - GRAM)
        if self.padded is None:
            self.padded = np.concatenate([np.zeros(side, np.uint8), self.data, np.zeros(side, np.uint8)])
        text = np.lib.stride_tricks.sliding_window_view(self.padded, 2 * side + GRAM)[place]
        k = np.arange(2 * side + GRAM)
        text[(k < (side - left)[:, None]) | (k >= (side + GRAM + right)[:, None])] = 0
        return text, left, right

    def codes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the surroundings of each anchor, ANCHORS at a time: a run of one byte has an anchor a byte."""
        a, b = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for lo in range(0, len(at), ANCHORS):
            text, left, right = self.surroundings(at[lo : lo + ANCHORS])
            x = mix64(left.astype(np.uint64) * _U(256) + right.astype(np.uint64) + _U(1))
            y = mix64(x ^ _MUL[3])
            for column in np.ascontiguousarray(text.T):
                v = _BYTE[column]
                x = (x ^ v) * _MUL[0]
                x ^= x >> _U(29)
                y = (y + v) * _MUL[2]
                y ^= y >> _U(31)
            a[lo : lo + ANCHORS], b[lo : lo + ANCHORS] = x, y
        return a, b

    def distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors ``at``: (one of the least document for each distinct surroundings; which of those each has;
        their bytes, left and right), in order of (bucket, gram). Surroundings are told apart by 128 bits."""
        a, b = self.codes(at)
        own = self.of[at]
        sort = np.lexsort((self.row[at], self.doc[at], b, a, own))
        same = np.zeros(len(at), bool)
        p, q = sort[1:], sort[:-1]
        same[1:] = (own[p] == own[q]) & (a[p] == a[q]) & (b[p] == b[q])
        chosen = sort[~same]
        group = np.empty(len(at), np.int64)
        group[sort] = np.cumsum(~same) - 1
        return chosen, group, *self.surroundings(at[chosen])


GRAMS = "bucket long, pid long, grams binary, several binary"
MASKS = "pid long, kind int, bucket long, body binary"
AROUND = "bucket long, pid long, grams binary, docs binary, sides binary, around binary"


def _rows(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({k: pa.array(columns.get(k, []), kinds[t]) for k, t in (x.split() for x in schema.split(", "))})


def first_digit(packets: DataFrame, buckets: int, depth: int) -> DataFrame:
    """A row per packet and bucket: its distinct grams, and whether several documents of the packet have them."""

    def run(rows: pa.Table) -> pa.Table:
        p = Packet(rows, buckets, depth)
        out: dict[str, list] = {k.split()[0]: [] for k in GRAMS.split(", ")}
        if len(p.first):
            several = np.maximum.reduceat(p.doc, p.first) != np.minimum.reduceat(p.doc, p.first)
            for bucket, a, b in p.buckets():
                for k, v in zip(out, (bucket, rows.column("pid")[0].as_py(), p.gram[p.first[a:b]].tobytes(), np.packbits(several[a:b]).tobytes()), strict=True):
                    out[k].append(v)
        return _rows(out, GRAMS)

    return packets.groupBy("pid").applyInArrow(run, GRAMS)


def repeated_grams(grams: DataFrame) -> DataFrame:
    """For each packet and bucket a mask of the grams that are in several documents."""

    def run(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("grams")]
        every = np.concatenate(own)
        sort = np.argsort(every, kind="stable")
        ordered = every[sort]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(new) - 1
        several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(g)) for x, g in zip(rows.column("several"), own, strict=True)])
        size = np.bincount(group)
        hit = (size > 1) | (np.bincount(group, several[sort]) > 0)
        keep = np.empty(len(every), bool)
        keep[sort] = hit[group]
        masks, at = [], 0
        for g in own:
            masks.append(np.packbits(keep[at : at + len(g)]).tobytes())
            at += len(g)
        n = len(own)
        return _rows({"pid": rows.column("pid").to_pylist(), "kind": [0] * n, "bucket": rows.column("bucket").to_pylist(), "body": masks}, MASKS)

    return grams.groupBy("bucket").applyInArrow(run, MASKS)


def _masks(rows: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: x for k, b, x in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "body")), strict=True) if k == kind}


def other_digits(packets: DataFrame, masks: DataFrame, buckets: int, depth: int) -> DataFrame:
    """A row per packet and bucket: the distinct surroundings of repeated grams, with their least document."""

    def run(rows: pa.Table, verdict: pa.Table) -> pa.Table:
        out: dict[str, list] = {k.split()[0]: [] for k in AROUND.split(", ")}
        if rows.num_rows:
            p = Packet(rows, buckets, depth)
            at = p.survivors(_masks(verdict, 0))
            if len(at):
                chosen, _, text, left, right = p.distinct(at)
                own = p.bucket[at[chosen]]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    c = at[chosen[a:b]]
                    sides = np.stack([left[a:b], right[a:b]]).astype(np.uint8)
                    for k, v in zip(out, (int(own[a]), rows.column("pid")[0].as_py(), p.gram[c].tobytes(), p.doc[c].tobytes(), sides.tobytes(), text[a:b].tobytes()), strict=True):
                        out[k].append(v)
        return _rows(out, AROUND)

    return packets.groupBy("pid").cogroup(masks.groupBy("pid")).applyInArrow(run, AROUND)


def repeated_windows(around: DataFrame, depth: int) -> DataFrame:
    """For each packet and bucket, of each surroundings: a bit per window (by its start) that a smaller document has."""
    side = depth - GRAM
    words = -(-(side + 1) // 64)

    def run(rows: pa.Table) -> pa.Table:
        col = lambda c, t: [np.frombuffer(x.as_py(), t) for x in rows.column(c)]
        grams = col("grams", np.uint64)
        sizes = [len(g) for g in grams]
        gram, doc = np.concatenate(grams), np.concatenate(col("docs", np.int64))
        sides = np.concatenate([x.reshape(2, -1) for x in col("sides", np.uint8)], axis=1).astype(np.int64)
        text = np.concatenate([x.reshape(-1, 2 * side + GRAM) for x in col("around", np.uint8)])
        sort = np.argsort(doc, kind="stable")
        doc, sides, seed = doc[sort], sides[:, sort], mix64(gram[sort])
        columns = np.ascontiguousarray(text[sort].T)
        found = np.zeros((words, len(doc)), np.uint64)
        h = [np.zeros(len(doc), np.uint64) for _ in range(2)]
        drop = [_U(pow(int(m), depth - 1, 1 << 64)) for m in _MUL[:2]]
        for k in range(depth):
            for j in range(2):
                h[j] = h[j] * _MUL[j] + _BYTE[columns[k]]
        for start in range(side + 1):
            if start:
                for j in range(2):
                    h[j] = (h[j] - _BYTE[columns[start - 1]] * drop[j]) * _MUL[j] + _BYTE[columns[start + depth - 1]]
            there = np.flatnonzero((start >= side - sides[0]) & (start + depth <= side + GRAM + sides[1]))
            if len(there) < 2:
                continue
            a, b = mix64(h[0][there] ^ seed[there]), mix64(h[1][there] + seed[there])
            order = np.argsort(a, kind="stable")
            same = a[order][1:] == a[order][:-1]
            if (same & (b[order][1:] != b[order][:-1])).any():  # equal in one hash only
                order = np.lexsort((np.arange(len(a)), b, a))
                same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            new = np.concatenate([[True], ~same])
            least = doc[there][order][new][np.cumsum(new) - 1]  # rows are by document, so a group's first is its least
            hit = there[order[doc[there][order] > least]]
            found[start // 64][hit] |= _U(1) << _U(start % 64)
        back = np.empty_like(found)
        back[:, sort] = found
        bodies, at = [], 0
        for n in sizes:
            bodies.append(np.ascontiguousarray(back[:, at : at + n]).tobytes())
            at += n
        return _rows({"pid": rows.column("pid").to_pylist(), "kind": [1] * len(sizes), "bucket": rows.column("bucket").to_pylist(), "body": bodies}, MASKS)

    return around.groupBy("bucket").applyInArrow(run, MASKS)


def _cover(packets: DataFrame, verdicts: DataFrame, buckets: int, depth: int, keep_text: bool) -> DataFrame:
    side = depth - GRAM
    words = -(-(side + 1) // 64)
    kind = dict(packets.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * keep_text

    def run(rows: pa.Table, verdict: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "spans": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
        types = [rows.schema.field("doc_id").type, pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
        if rows.num_rows:
            p = Packet(rows, buckets, depth)
            edge = np.zeros(len(p.data) + 1, np.int32)
            at = p.survivors(_masks(verdict, 0))
            if len(at):
                chosen, group, _, left, right = p.distinct(at)
                found = np.zeros((words, len(chosen)), np.uint64)
                own = p.bucket[at[chosen]]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                answer = _masks(verdict, 1)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    found[:, a:b] = np.frombuffer(answer[int(own[a])], np.uint64).reshape(words, -1)
                later = p.doc[at] > p.doc[at[chosen]][group]  # its surroundings are in a smaller document of the packet
                for start in range(side + 1):
                    hit = (found[start // 64] >> _U(start % 64) & _U(1)).astype(bool)[group]
                    hit |= later & (start >= side - left[group]) & (start + depth <= side + GRAM + right[group])
                    begin = p.place[at[hit]] - side + start
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + depth, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, doc_id in enumerate(p.ids.to_pylist()):
                a, b = p.offsets[i], p.offsets[i + 1]
                own = gone[a:b]
                flips = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                kept = p.data[a:b][~own].tobytes()
                values = (doc_id, b - a, [{"start": s, "end": e} for s, e in flips.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest(), kept)
                for k, v in zip(out, values, strict=False):
                    out[k].append(v)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=False)})

    return packets.groupBy("pid").cogroup(verdicts.groupBy("pid")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, depth: int = DEPTH, keep_text: bool = False, packet_bytes: int = PACKET_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others ignored): doc_id, n_bytes, the removed spans (bytes, ends exclusive,
    maximal), kept_sha256 and, with ``keep_text``, the kept bytes.

    A byte goes if a ``depth``-byte string over it also starts in a document with a smaller doc_id. Null text counts as
    empty; a null doc_id sorts after all others. Rows of one doc_id do not remove each other's bytes. ``depth`` is at
    least GRAM and at most 255. Repeated rows of one doc_id with one text all come out, alike; an empty table gives none.
    """
    if not GRAM <= depth <= 255:
        raise ValueError(f"depth must be {GRAM} to 255")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_packets, buckets = total // packet_bytes + 1, total // bucket_bytes + 1
    pid = F.expr(f"pmod(xxhash64(doc_id), {n_packets}L)")
    packets = docs.select(pid.alias("pid"), "doc_id", "text").repartition(max(8, n_packets), "pid")
    masks = repeated_grams(first_digit(packets, buckets, depth))
    windows = repeated_windows(other_digits(packets, masks, buckets, depth), depth)
    return _cover(packets, masks.unionByName(windows), buckets, depth, keep_text)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of remove_repeats over all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
