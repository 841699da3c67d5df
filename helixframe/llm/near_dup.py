"""Near-duplicate documents by HyperMinHash sketches, banding, and verification on full shingle sets.

One hash deals a set's shingles to REGISTERS buckets; of the least value in a bucket its register keeps the count of
leading zeros and a few mantissa bits. Bands of registers are keys (an empty register takes another's value there, so short
documents have all bands too); documents that share one are candidates, the collision-corrected estimate over the
full registers thins them, full sets decide.

Equal sets are one class and only its least document takes part. Within a group not all pairs are tested: first one
pivot of each band's group meets the others. Groups that are then still of several components go on, large ones
together with those that hold the same main component, so that a pair meets once and not once a band. A round tests
pivots outside the group's main component, the likeliest first, and there are more of them each round until they are
all that is outside it. Shingles that no other set has bound the similarity of all pairs of a set, and so does what it
has in common with the group's typical set; pairs whose bound is under the threshold are never made. So a large group
of near copies costs about its size, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, materialise, mix64, release, small_batches, table, text_bytes
from .graph import components

WORDS = 5
THRESHOLD = 85  # per cent, of op9; near_duplicates takes others too
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Pairs whose estimate is under the threshold by this many standard deviations of the estimate are dropped.
DEVIATIONS = 5
#: Pivots of a group in the second round, and how many times more in each further one.
PIVOTS = 32
#: Members from which on a group's sets are compared with its most typical one.
LARGE = 64
#: A class of equal sets with this share of all rows is joined by broadcast; there are at most as many as it says.
HOT_CLASSES = 10_000
#: Ids that may be broadcast.
BROADCAST_IDS = 50_000
CHUNK = 1 << 19
#: Shingles that a task counts at a time.
COUNTED = 2_000_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0xD6E8FEB86659FD93)
_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)
_SALT = _U(0x2545F4914F6CDD1D)
EMPTY = np.uint16(0xFFFF)
#: Step by step (rows) where each register's walk (columns) is; a walk visits all registers, from its own on.
_WALKS = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + _U(1)).reshape(REGISTERS, REGISTERS), axis=1)
_WALKS = np.concatenate([np.arange(REGISTERS)[:, None], _WALKS], axis=1).T


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts, words before each text and in all)."""
    low = _LOWER[data]
    ink = ~_SPACE[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | first[1:]
    ends = np.flatnonzero(stop) + 1
    size = ends - starts
    power = np.concatenate([[_U(1)], np.cumprod(np.full(int(size.max()), _BASE))])
    value = _BYTE[low[ink]]
    begin = np.cumsum(size) - size
    value *= power[np.arange(len(value)) - np.repeat(begin, size)]
    total = np.add.reduceat(value, begin)
    return mix64(total + size.astype(np.uint64) * _U(0xA0761D6478BD642F)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its WORDS-word shingles; of 1 to 4 words the whole is one shingle."""
    words, before = word_hashes(data, offsets)
    n = len(words) - WORDS + 1
    rolled = sum((words[k : k + n] * _PLACE[k] for k in range(WORDS)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
    rolled = mix64(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= WORDS:
            x = np.sort(rolled[a : b - WORDS + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            total = (words[a:b] * _PLACE[: b - a]).sum() + _U(b - a)
            out.append(mix64(np.array([total ^ _U(0xE7037ED1A0B428DB)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16, EMPTY where no shingle fell) of sets."""
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.repeat(np.arange(len(sets)) * REGISTERS, size) + (((flat >> _U(32)) * _U(REGISTERS)) >> _U(32)).astype(np.int64)
    value = mix64(flat ^ _SALT)
    v = np.full(len(sets) * REGISTERS, 2**64 - 1, np.uint64)
    np.minimum.at(v, at, value)
    zeros = np.clip(64 - np.frexp(v.astype(np.float64))[1], 0, 62).astype(np.uint64)
    rest = (v << zeros) >> _U(63 - MANTISSA_BITS)
    out = ((zeros << _U(MANTISSA_BITS)) | (rest & _U((1 << MANTISSA_BITS) - 1))).astype(np.uint16)
    full = np.zeros(len(out), bool)
    full[at] = True
    return np.where(full, out, EMPTY).reshape(len(sets), REGISTERS)


def filled(registers: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one on a walk of their own, the same for all sets (so two sets'
    registers agree there as often as they do elsewhere); a set has one full register at least."""
    out = registers.copy()
    left, empty = np.arange(len(out)), registers == EMPTY
    for step in _WALKS[1:]:
        keep = empty[left].any(axis=1)
        if not keep.any():
            break
        left = left[keep]
        value = np.where(empty[left], registers[left][:, step], out[left])
        empty[left] = empty[left] & (value == EMPTY)
        out[left] = value
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key per band (int64)."""
    x = filled(registers).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE + np.zeros((len(x), 1), np.uint64)
    for k in range(ROWS):
        key = mix64(key ^ (x[:, :, k] + _U(1)) * _PLACE[k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity from registers, registers that count): those full in either, corrected for different minima
    that are equal by chance.

    Two minima agree by chance in their zeros with odds 1/3 and then in the mantissa with odds 2^-MANTISSA_BITS.
    """
    chance = 1 / 3 / (1 << MANTISSA_BITS)
    count = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1) / count
    return (same - chance) / (1 - chance), count


SKETCH = "doc_id long, n_shingles long, set_key binary, registers binary"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set; null if empty), registers (null if empty) of every row."""
    import xxhash  # noqa: F401  fails early where it is absent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in chunks(offsets, CHUNK):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                full = [s for s in sets if len(s)]
                registers = iter(sketch(full) if full else ())
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(registers).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _bands(heads: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("registers")])
                rep = np.repeat(np.asarray(batch.column("rep")), BANDS)
                size = np.repeat(np.asarray(batch.column("n_shingles")), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(registers).ravel()), pa.array(rep), pa.array(size)], names=["key", "rep", "size"])

    return heads.select("rep", "n_shingles", "registers").mapInArrow(run, "key long, rep long, size long")


def margin(threshold: int, count: np.ndarray) -> np.ndarray:
    """What an estimate from ``count`` registers may be under ``threshold`` per cent."""
    return DEVIATIONS * (threshold / 100 * (1 - threshold / 100) / count) ** 0.5


def _likely(pairs: DataFrame, registers: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose estimated similarity is not clearly under the threshold."""
    a = registers.select(F.col("rep").alias("a"), F.col("registers").alias("ra"))
    b = registers.select(F.col("rep").alias("b"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([np.frombuffer(v.as_buffer(), np.uint16) for v in batch.column(c)]) for c in ("ra", "rb"))
                guess, count = estimate(x, y)
                keep = pa.array(guess >= threshold / 100 - margin(threshold, count))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, set) of the documents ``ids`` (rep, set_key), by the text that has that set."""
    import xxhash  # noqa: F401

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = F.broadcast(ids) if few else ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "text", "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("set_key")
            for lo, hi in chunks(offsets, CHUNK):
                made = [s.tobytes() for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
                same = pa.array([xxhash.xxh3_128_digest(s) == k.as_py() for s, k in zip(made, keys.slice(lo, hi - lo), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(lo, hi - lo).filter(same), pa.array(made, pa.binary()).filter(same)], names=["rep", "set"])

    return own.mapInArrow(run, "rep long, set binary")


def _single(sets: DataFrame) -> DataFrame:
    """(rep, single): how many shingles of a set are in no other set of the table; those are in no intersection.

    Tasks count their own shingles first (COUNTED at a time), so what many sets share moves once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        reps: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            every, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            rep = np.concatenate(reps)[first]
            hashes.clear()
            reps.clear()
            return pa.RecordBatch.from_arrays([pa.array(every), pa.array(n.astype(np.int64)), pa.array(rep)], names=["h", "n", "rep"])

        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("set")]
            if own:
                hashes.append(np.concatenate(own))
                reps.append(np.repeat(np.asarray(batch.column("rep")), [len(x) for x in own]))
                if sum(map(len, hashes)) >= COUNTED:
                    yield out()
        if hashes:
            yield out()

    flat = sets.mapInArrow(run, "h long, n long, rep long")
    return flat.groupBy("h").agg(F.sum("n").alias("n"), F.min("rep").alias("rep")).filter("n = 1").groupBy("rep").agg(F.count("*").alias("single"))


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of the intersection and the union of the full sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both.append(int((y[at] == x).sum()))
                either.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, both long, either long")


def _labelled(members: DataFrame, labels: DataFrame | None, group: list[str]) -> DataFrame:
    """``members`` of groups that are of several components, with label and main (has the group's most common label)."""
    if labels is None:
        named = members.withColumn("label", F.col("rep"))
    else:
        named = members.join(labels, F.col("rep") == F.col("v"), "left").select(*members.columns, F.coalesce("label", "rep").alias("label"))
    counts = named.groupBy(*group, "label").count()
    most = counts.groupBy(*group).agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("most"), F.count("*").alias("parts"), F.sum("count").alias("n"))
    return named.join(most.filter("parts > 1"), group).withColumn("main", F.col("label") == F.col("most"))


def _able(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs of ``pairs`` (p's columns and those of a member) that can reach ``threshold``, as a and b."""
    parts = F.when(F.col("core").isNotNull() & F.col("pcore").isNotNull(), F.least("core", "pcore") + F.least("rest", "prest"))
    both = F.least("shared", "pshared", parts)  # no more than this is in both sets (least skips nulls)
    able = 100 * both >= threshold * (F.col("size") + F.col("psize") - both)
    return pairs.filter(able).select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).distinct()


def _pivots(chosen: DataFrame, group: list[str]) -> DataFrame:
    return chosen.select(*group, F.col("rep").alias("p"), *[F.col(c).alias(f"p{c}") for c in ("size", "shared", "core", "rest", "label")])


def _groups(open_members: DataFrame, sets: DataFrame) -> DataFrame:
    """(big, gid, rep, size, shared, core, rest) of the members of groups that go on.

    Large groups go by their main component, small ones by their key. Large ones' sets are compared with the group's
    most typical one: core is what a set has in common with it, rest is what else other sets can share. So two sets of
    a group share at most the lesser core and the lesser rest.
    """
    big = F.col("n") > LARGE
    own = open_members.select(big.alias("big"), F.when(big, F.col("most")).otherwise(F.col("key")).alias("gid"), "rep", "size", "shared").distinct()
    own = materialise(own, "groups")
    typical = own.filter("big").groupBy("gid").agg(F.max_by("rep", F.struct("shared", -F.col("rep"))).alias("c"))
    large = own.filter("big").join(typical, "gid")
    counts = _common(large.filter("rep <> c").select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct(), sets)
    named = large.join(counts.select(F.col("a").alias("c"), F.col("b").alias("rep"), "both"), ["c", "rep"], "left")
    core = F.when(F.col("rep") == F.col("c"), F.col("shared")).otherwise(F.col("both"))
    named = named.select("big", "gid", "rep", "size", "shared", core.alias("core")).withColumn("rest", F.col("shared") - F.col("core"))
    rest = own.filter("not big").withColumn("core", F.lit(None).cast("long")).withColumn("rest", F.lit(None).cast("long"))
    out = materialise(named.unionByName(rest), "groups")
    release(own)
    return out


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of ``docs`` (doc_id, text; others ignored).

    Documents are linked if their shingle sets' similarity is at least ``threshold`` per cent. component_id is the least
    doc_id that is reachable; kept is doc_id = component_id. Texts without words (or null) are linked with nothing.
    doc_id is unique; rows that repeat one with the same text fall into the same component, of others the set with the
    least hash links for that doc_id, and a null doc_id stands alone (component null, kept). An empty table gives no rows.
    """
    written: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        written.append(materialise(df, name))
        return written[-1]

    drawn = materialise(sketches(docs), "sketches")
    classes = put(drawn.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    least = classes.groupBy("rep").agg(F.min("set_key").alias("set_key"))
    heads = drawn.join(least, (drawn.doc_id == least.rep) & (drawn.set_key == least.set_key)).select("rep", least.set_key, "n_shingles", "registers")
    heads = put(heads.dropDuplicates(["rep"]) if drawn.groupBy("doc_id").count().filter("count > 1").limit(1).count() else heads, "heads")
    bands = _bands(heads)
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = put(bands.join(shared, "key"), "bands")
    ids = put(heads.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "set_key", "registers"), "candidates")
    registers = ids.select("rep", "registers")
    sets = put(_sets(docs, ids.select("rep", "set_key")), "sets")
    large = members.filter(F.col("n") > LARGE).select("rep").distinct()
    single = _single(sets.join(large, "rep", "left_semi"))
    members = put(members.join(single, "rep", "left").select("key", "rep", "size", (F.col("size") - F.coalesce("single", F.lit(0))).alias("shared")), "members")

    links: DataFrame | None = None
    tested: DataFrame | None = None

    def verified(pairs: DataFrame) -> bool:
        """Tests pairs that are new; whether there were links among them."""
        nonlocal links, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = put(pairs, "pairs")
        if not pairs.limit(1).count():
            return False
        likely = put(_likely(pairs, registers, threshold), "likely")
        found = put(_common(likely, sets).filter(100 * F.col("both") >= threshold * F.col("either")).select("a", "b"), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        return found.limit(1).count() > 0

    # one pivot of each key, the one that can share most, meets the others
    none = F.lit(None).cast("long")
    bare = members.withColumns({"core": none, "rest": none, "label": F.col("rep")})
    best = members.groupBy("key").agg(F.max_by(F.struct("rep", "size", "shared"), F.struct("shared", -F.col("rep"))).alias("m")).select("key", "m.*")
    first = _pivots(best.withColumns({"core": none, "rest": none, "label": F.col("rep")}), ["key"]).join(bare, "key").filter("p <> rep")
    labels = components(links) if verified(_able(first, threshold)) else None
    groups = put(_groups(_labelled(members, labels, ["key"]), sets), "groups")
    group, pivots = ["big", "gid"], PIVOTS
    while True:
        named = put(_labelled(groups, labels, group), "open")
        outside = named.filter("not main")
        most = outside.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if not most:
            break
        order = W.partitionBy(*group).orderBy(F.desc("shared"), "rep")
        chosen = outside.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= pivots) if pivots < most else outside
        once = "plabel <> label" + (" and (main or p < rep)" if pivots >= most else "")  # where all are pivots two meet once
        if verified(_able(_pivots(chosen, group).join(named, group).filter(once), threshold)):
            labels = components(links)
        if pivots >= most:
            break
        pivots *= PIVOTS

    of = _classes(drawn, classes)
    if labels is not None:
        of = of.join(labels, F.col("rep") == F.col("v"), "left").withColumn("component_id", F.coalesce("label", "rep"))
    else:
        of = of.withColumn("component_id", F.col("rep"))
    release(*[x for x in written if x is not classes])
    return of.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _classes(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n_shingles and rep, the least document with the same set. Very common sets are joined by broadcast."""
    total = drawn.count()
    hot = classes.filter(F.col("copies") > max(1000, total // HOT_CLASSES)).select(F.col("set_key").alias("hot_key"), F.col("rep").alias("hot"))
    several = classes.filter(F.col("copies").between(2, max(1000, total // HOT_CLASSES))).select("set_key", "rep")
    of = drawn.select("doc_id", "n_shingles", "set_key").join(F.broadcast(hot), F.col("set_key") == F.col("hot_key"), "left")
    # rows that need no join keep away from its key
    key = F.when(F.col("hot").isNull(), F.col("set_key"))
    spread = of.withColumn("set_key", F.coalesce(key, F.unhex(F.hex(F.xxhash64("doc_id")))))
    return spread.join(several, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("hot", "rep", "doc_id").alias("rep"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, at 85 per cent."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
