"""Deletion of repeated line runs by a suffix array over line ids.

Lines become ids; suffixes of the id sequences are ranked by distributed prefix doubling: the rank of 2^(k+1) lines is
the place of the pair (rank of the first 2^k lines, rank of the next 2^k) among all distinct pairs, globally sorted.
Pairs that occur once leave, as do suffixes that start with a line that occurs once. Suffixes that agree in two
overlapping ranks share that many lines: those are the intervals whose longest common prefix is at least the run.

A run counts from MIN_WORDS words on. For every line the shortest such run from it and the shortest such run up to it
are looked up; together they cover exactly the maximal repeated runs. As a line that is not blank has a word, no more
than MIN_WORDS lines need ranks, so rounds are few whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release, small_batches, table

MIN_WORDS = 8
#: Very common runs that are joined by broadcast, at most.
HOT_RUNS = 10_000

LINES = "did long, th long, i int, words int, h1 long, h2 long"


def _keyed(docs: DataFrame) -> DataFrame:
    """Order and identity of a row: doc_id (null last) and a hash of the text."""
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("th", F.xxhash64("text"))


def line_ids(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line that is not blank: its document, number among those, words (at most min_words), 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[tuple] = []
            for did, th, text in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text")), strict=True):
                i = 0
                for line in text.split("\n"):
                    if line := line.strip():
                        h = xxhash.xxh3_128_intdigest(line.encode())
                        rows.append((did, th, i, min(min_words, len(line.split(None, min_words))), (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63))
                        i += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in LINES.split(", ")]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    own = _keyed(docs).filter(F.col("text").isNotNull()).select("did", "th", "text")
    return own.mapInArrow(run, LINES)


def _ranks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ranks, in sort order, of the distinct ``keys`` that occur more than once. Written, so they stay what they are."""
    several = rows.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return materialise(several.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame, min_words: int) -> tuple[DataFrame, list[str]]:
    """Repeated lines with the ranks r0, r1, ... of the 1, 2, 4, ... lines from each on (null where they occur once)."""
    at = W.partitionBy("did", "th").orderBy("i")
    ranks = _ranks(lines, ["h1", "h2"], "r0")
    here = lines.join(ranks, ["h1", "h2"]).select("did", "th", "i", "words", "r0")
    names, length = ["r0"], 1
    while length * 2 <= min_words:
        last, name = names[-1], f"r{len(names)}"
        # a line that occurs once is absent, so the next row counts only if it is that many lines on
        there = F.when(F.lead("i", length).over(at) == F.col("i") + length, F.lead(last, length).over(at))
        paired = materialise(here.withColumn("_next", there), f"suffixes-{length}")
        release(here)
        ranks = _ranks(paired, [last, "_next"], name)
        here = paired.join(ranks, [last, "_next"], "left").select("did", "th", "i", "words", *names, name)
        here._helix_path = paired._helix_path
        names.append(name)
        length *= 2
    out = materialise(here, "suffixes")
    release(here)
    return out, names


RUNS = "did long, th long, i int, n int, a long, b long"


def runs_of(rows: list[dict], names: list[str], min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, n, a, b) of the shortest runs from and up to each of a document's repeated lines, in order of i: n lines
    from i on, with the ranks a of their first and b of their last 2^k lines (k as large as fits)."""
    place = {r["i"]: j for j, r in enumerate(rows)}
    found = set()
    for j in range(len(rows)):
        for step in (1, -1):
            total, k, want = 0, j, rows[j]["i"]
            while 0 <= k < len(rows) and rows[k]["i"] == want and total < min_words:
                total += rows[k]["words"]
                k, want = k + step, want + step
            if total >= min_words:
                found.add((rows[min(j, k - step)]["i"], abs(k - j)))
    for i, n in found:
        k = n.bit_length() - 1
        a, b = rows[place[i]][names[k]], rows[place[i + n - (1 << k)]][names[k]]
        if a is not None and b is not None:
            yield i, n, a, b


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, i) of the lines that are later copies, i counting lines that are not blank."""
    lines = materialise(line_ids(docs, min_words).dropDuplicates(["did", "th", "i"]), "lines")
    suffixes, names = suffix_ranks(lines, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(did, th, *x) for did, th, rows in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "lines")), strict=True) for x in runs_of(rows, names, min_words)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            cols = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in RUNS.split(", ")])

    own = suffixes.groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("i", "words", *names))).alias("lines"))
    runs = materialise(own.mapInArrow(run, RUNS), "runs")
    place = F.struct("did", "th", "i")
    first = materialise(runs.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "firsts")
    # a very common run, with over 1 / HOT_RUNS of all, meets its first copy by broadcast: there are HOT_RUNS at most
    common = F.col("copies") > max(1000, runs.count() // HOT_RUNS)
    marked = runs.join(F.broadcast(first.filter(common).drop("copies")), ["n", "a", "b"], "left")
    rest = marked.filter("first is null").drop("first").join(first.filter(~common).drop("copies"), ["n", "a", "b"])
    later = marked.filter("first is not null").unionByName(rest).filter(place > F.col("first"))
    out = later.select("did", "th", F.explode(F.expr("sequence(i, i + n - 1)")).alias("i")).distinct()
    release(lines, suffixes)
    return out


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text less the lines of later copies, and the columns n_lines and n_removed (lines that are not blank).

    Of equal runs of at least ``min_words`` words (lines stripped, blank ones aside) the first by (doc_id, line) stays.
    Nothing else of a text changes; a text that loses all its lines becomes empty. Null texts stay null. Rows that
    repeat doc_id and text count as one document and lose the same lines; a null doc_id comes after all others. An empty
    table gives no rows.
    Columns named n_lines, n_removed, did, th or gone are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed", "did", "th", "gone")]
    docs = docs.select(*rest)
    gone = repeated_lines(docs, min_words).groupBy("did", "th").agg(F.sort_array(F.collect_set("i")).alias("gone"))
    joined = _keyed(docs).join(gone, ["did", "th"], "left").select(*rest, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                parts = (text or "").split("\n")
                full = [k for k, x in enumerate(parts) if x.strip()]
                if gone:
                    drop = {full[i] for i in gone}
                    text = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                    text = text if text.strip() else ""
                texts.append(text)
                lines.append(len(full))
                removed.append(len(gone or ()))
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*rest, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_removed long"
    return joined.mapInArrow(run, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, and what is left."""
    small_batches(spark)
    out = delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
