"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made over the histogram of piece lengths (at most ``capacity`` entries), never over documents:
best-fit decreasing places whole counts of equal lengths at once and yields runs of slots. Every piece then
gets its rank among the pieces of its length and takes the slot of that rank.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, materialise, small_batches, table, text_bytes

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked within one task.
RANK_GROUP = 20_000
#: Words that a Python worker keeps with their ids before it drops those met once (about 40 bytes a word).
CACHE_WORDS = 400_000
#: Documents of an Arrow batch, and bytes of text whose distinct words are looked up together.
BATCH, CHUNK = 2048, 6 << 20
#: Words given to the tokenizer at once.
ENCODE_WORDS = 1024
#: Fixed value: the pre-token pattern that WordIds is made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters and digits that normalising leaves alone, so that punctuation after them is a pre-token of its own.
STEM_END = r"[0-9a-zß-öø-ÿα-ωа-я]$"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of whole texts, by encoding every distinct space-separated word once.

    It fits tokenizers whose normaliser is made of NFC, lower case and white space folding, whose pre-tokens are runs
    of letters, single digits and runs of other characters, and whose last token of a pre-token says so (``</w>``):
    then the ids of a text are those of its words, in order, and of words that are all letters many can be encoded as
    one text. A run of ASCII punctuation after a letter or digit is a pre-token of its own, so it is split off.
    For any other tokenizer ``fits`` is false and texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fits = _fits(json.load(f))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.keep(np.zeros(0, np.int64))

    def keep(self, chosen: np.ndarray) -> None:
        """Of the known words only those at ``chosen`` stay."""
        if not len(chosen):
            self.words, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32)
            self.first, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int32)
            return
        self.flat = _gather(self.flat, self.first[chosen], self.size[chosen].astype(np.int64))
        self.words, self.size, self.hits = self.words.take(pa.array(chosen)), self.size[chosen], self.hits[chosen]
        self.first = np.cumsum(self.size, dtype=np.int64) - self.size

    def purge(self) -> None:
        """Words met in one batch only go; if they were few, all go."""
        several = np.flatnonzero(self.hits > 1)
        self.keep(several if len(several) <= CACHE_WORDS // 2 else several[:0])

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of ``words``, one after another; ids of each)."""
        size, parts = np.zeros(len(words), np.int64), []
        letters = np.asarray(pc.utf8_is_alpha(words))
        for joined in (True, False):
            own = np.flatnonzero(letters == joined)
            for i in range(0, len(own), ENCODE_WORDS):
                at = own[i : i + ENCODE_WORDS]
                part = words.take(pa.array(at)).to_pylist()
                if joined:
                    ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
                    last = np.flatnonzero(self.ends[ids])
                    if len(last) == len(at):
                        size[at] = np.diff(last, prepend=-1)
                        parts.append((at, ids))
                        continue
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                size[at] = np.fromiter(map(len, each), np.int64, len(each))
                parts.append((at, np.fromiter(itertools.chain.from_iterable(each), np.int32)))
        if not parts:
            return np.zeros(0, np.int32), size
        order = np.concatenate([at for at, _ in parts])
        flat, made = np.concatenate([ids for _, ids in parts]), size[order]
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(made) - made
        return _gather(flat, first, size), size

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Places in the cache of ``words`` (distinct ones), which holds them all until the next purge."""
        places = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            flat, size = self._encoded(new)
            places[missing] = len(self.words) + np.arange(len(missing))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, flat])
            self.size = np.concatenate([self.size, size.astype(np.int32)])
            self.hits = np.concatenate([self.hits, np.zeros(len(missing), np.int32)])
            self.first = np.cumsum(self.size, dtype=np.int64) - self.size
        self.hits[places] += 1
        return places

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        texts = pc.fill_null(texts, "")
        if not self.fits:
            return self.whole(texts.to_pylist())
        if len(self.words) > CACHE_WORDS:
            self.purge()
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= np.asarray(pc.match_substring(texts, token))
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        words = pc.split_pattern(pc.ascii_lower(pc.replace_substring(plain, "\n", " ")), " ")
        bounds = np.asarray(words.offsets).astype(np.int64)
        flat = words.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        index, distinct = np.asarray(coded.indices), coded.dictionary
        stem = pc.ascii_rtrim(distinct, characters=string.punctuation)
        cut = np.asarray(pc.not_equal(pc.binary_length(stem), pc.binary_length(distinct)))
        cut &= np.asarray(pc.match_substring_regex(stem, STEM_END))
        stem = pc.if_else(pa.array(cut), stem, distinct)
        split = np.flatnonzero(cut)
        tail = _tails(distinct, stem, split)
        parts = pa.concat_arrays([stem, tail]).dictionary_encode()
        place = self.lookup(parts.dictionary)[np.asarray(parts.indices)]
        # ids of every distinct word: those of its stem, then those of its tail
        first = np.full((len(distinct), 2), -1, np.int64)
        first[:, 0] = place[: len(distinct)]
        first[split, 1] = place[len(distinct) :]
        first = first.ravel()
        there = first >= 0
        size = np.where(there, self.size[first], 0).astype(np.int64)
        own = _gather(self.flat, np.where(there, self.first[first], 0), size)
        size = size.reshape(-1, 2).sum(axis=1)
        begin = np.cumsum(size) - size
        each = size[index]
        ids = _gather(own, begin[index], each)
        ends = np.concatenate([[0], np.cumsum(each)])
        offsets = ends[bounds]
        if special.any():
            parts, lengths = [], np.diff(offsets)
            for i in range(len(texts)):
                x = ids[offsets[i] : offsets[i + 1]]
                if special[i]:
                    x = self.whole([texts[i].as_py()])[0]
                    lengths[i] = len(x)
                parts.append(x)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])
        return ids, offsets


def _fits(spec: dict) -> bool:
    """Whether WordIds' assumptions hold for a tokenizer file."""
    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    folding = [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"] and normalizers[1]["pattern"] == {"Regex": r"\s+"}
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]
    return folding and bool(split) and spec["model"].get("end_of_word_suffix") == "</w>" and not any(t["normalized"] for t in spec["added_tokens"])


def _tails(whole: pa.Array, stem: pa.Array, at: np.ndarray) -> pa.Array:
    """What ``whole`` has beyond ``stem``, at the places ``at``."""
    if not len(at):
        return pa.array([], pa.string())
    data, offsets = text_bytes(whole)
    cut = offsets[at] + np.asarray(pc.binary_length(stem)).astype(np.int64)[at]
    size = offsets[at + 1] - cut
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(_gather(data, cut, size).tobytes()))


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[first:first+size], one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, flat.dtype)
    at = np.repeat(first - (ends - size), size)
    at += np.arange(ends[-1])
    return flat[at]


_encoders: dict[str, WordIds] = {}  # of this Python worker: a tokenizer and at most about CACHE_WORDS words


def _pieces(doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray, capacity: int, end_id: int, keep_ids: bool) -> pa.RecordBatch:
    """Rows of PIECE_SCHEMA for texts with the given ids."""
    ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
    offsets = offsets + np.arange(len(offsets))
    each = -(-np.diff(offsets) // capacity)
    doc = np.repeat(np.arange(len(each)), each)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = piece * capacity
    at = offsets[doc] + start
    end = np.minimum(at + capacity, offsets[doc + 1])
    raw = memoryview(ids).cast("B")
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
    cols = {"doc_id": doc_ids.take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(end - at), "ids_crc32": pa.array(crc, pa.int64())}
    if keep_ids:  # pieces lie one after another
        cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, ids.size).astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_pydict(cols)


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document; with ``keep_ids`` also their ids.

    ``docs`` needs doc_id and text; other columns are ignored. Null text counts as empty (one piece: the end id).
    Repeated rows give repeated pieces; an empty table gives no pieces.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(tokenizer_path, None) or WordIds(tokenizer_path)
        _encoders[tokenizer_path] = encoder
        for batch in batches:
            _, bounds = text_bytes(batch.column("text"))
            for lo, hi in chunks(bounds, CHUNK):
                yield _pieces(batch.column("doc_id").slice(lo, hi - lo), *encoder.encode(batch.column("text").slice(lo, hi - lo)), capacity, end_id, keep_ids)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts. Runs of slots: the pieces of ``length`` with ranks from ``rank`` on fill
    sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, count)
    rooms: list[int] = []  # rooms that have sequences, ascending
    runs: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            room = rooms[k] if k < len(rooms) else capacity
            each = room // length
            if k < len(rooms):
                first, count = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(k)
            else:
                first, count = used, -(-left // each)
                used += count
            full = min(count, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer than a sequence takes
                runs.append((length, rank, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns, strict=True)) | {"sequences": np.int64(used)}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length; other columns stay) with sequence_id and offset.

    Lengths are 1 to ``capacity``. A common length is ranked in groups of about RANK_GROUP rows, so a task ranks no
    more than that many rows of it, whatever share of the table it has.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    planned = plan(counts, capacity)
    groups = spark.createDataFrame([(n, -(-c // RANK_GROUP)) for n, c in counts.items()], "length long, _groups long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("_salt", F.expr("pmod(xxhash64(doc_id, piece), _groups)"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    shared = spark.sparkContext.broadcast(planned)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        import pandas as pd

        p = shared.value
        # runs are sorted by (length, rank): one search over both, as a length has under 2^40 pieces
        at = np.searchsorted((p["length"] << 40) + p["rank"], (length.to_numpy() << 40) + rank.to_numpy(), side="right") - 1
        q = rank.to_numpy() - p["rank"][at]
        return pd.DataFrame({"sequence_id": p["sequence"][at] + q // p["each"][at], "offset": p["offset"][at] + q % p["each"][at] * length.to_numpy()})

    slot.func.__annotations__.clear()
    out = ranked.withColumn("_slot", slot("length", "_rank"))
    return out.select(*pieces.columns, "_slot.sequence_id", "_slot.offset")


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids in place order, with the document of each piece (needs the column ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack: one row per piece with its place."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession, BATCH)
    pieces = materialise(tokenise(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
