"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

The features of a text are its pairs of neighbouring words. A window is 3b features; each of the 64 bits of its SimHash
is set where more than half the feature hashes have it. All 64 counts are made at once by full adders over whole longs
(bit-sliced counters), so a window takes about 5 bit operations a feature. Document windows start at multiples of b, so
one lies wholly in every run of 4b words that a copy has unchanged. Of an item the windows at all offsets are taken, so
a copied window meets its equal whatever its place.

b is the item's: the largest of 3, 2 and 1 for which every copy that keeps 0.8 of the weight has such a run, however
its edits are spread. A changed, inserted, deleted or moved word breaks at least four shingles in a row (fewer at the
ends only), so ``breaking`` finds the least weight that edits must break to leave no run of a length; if that is over
0.2 of the whole, the run is there. b = 1 needs one unbroken shingle, which every such copy has; items that repeat a
shingle get it too.

Fingerprints are cut into four blocks of 16 bits. Two within Hamming distance RADIUS = 3 agree in one of them, so
joining on (size, block, bits) finds them all. The aligned passage of each candidate, and a fifth of the item's length
more on each side for inserted words, is then compared with the item by its five-word shingles, weighted by their
characters: the item is found if at least 0.8 of its weight is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 3
#: Windows of items that may be broadcast (a row has about 60 bytes); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Words on each side of the aligned passage that are compared too, for inserted words; and one more for so many of the item.
PAD, PAD_SHARE = 4, 5
#: b, and the shingles in a row whose words hold a window at a multiple of b. The last one every copy has.
RUNS = {3: 8, 2: 4, 1: 1}

BLOCKS, BLOCK_BITS = 4, 16


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; no words for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""), F.array().cast("array<string>"))


def features(ws: str) -> Column:
    """A hash for each pair of neighbouring words."""
    pairs = f"transform(sequence(0, size({ws}) - 2), i -> _w[i] ^ shiftleft(_w[i + 1], 3))"
    return F.expr(f"CASE WHEN size({ws}) >= 2 THEN {pairs} ELSE cast(array() as array<long>) END")


def breaking(c: str, run: int) -> str:
    """The least sum of ``c`` (array<long>, the shingles' weights in order) that edits break to leave no ``run`` in a row.

    g has, for the last places, the least sum with a break just before the place: one shingle more than a break before
    it, or four after at most ``run`` - 1 unbroken ones. p is the sum so far, best the least that a break up to the end
    leaves over (less the whole sum).
    """
    g = (
        f"least(element_at(s.g, -1) + get({c}, i - 1), array_min(slice(s.g, 1, greatest(size(s.g) - 3, 0)))"
        f" + get({c}, i - 1) + get({c}, i - 2) + get({c}, i - 3) + get({c}, i - 4))"
    )
    kept = f"slice(concat(s.g, array({g})), greatest(size(s.g) - {run + 2}, 0) + 1, {run + 3})"
    best = f"least(s.best, get(s.g, size(s.g) - {run - 1}) - s.p - get({c}, i - 1))"
    last = f"array_min(slice(s.g, greatest(size(s.g) - {run}, 0) + 1, {run}))"
    start = f"named_struct('g', array(0L), 'p', 0L, 'best', {1 << 60}L)"
    return f"aggregate(sequence(1, size({c})), {start}, (s, i) -> named_struct('g', {kept}, 'p', s.p + get({c}, i - 1), 'best', {best}), s -> least(s.best + s.p, {last}))"


def with_blocks(items: DataFrame) -> DataFrame:
    """``items`` (iw, five words at least) with block: b."""
    # A filter on block may run before the one on the size, so shorter ones must not fail.
    every = f"transform(sequence(1, greatest(size(iw) - {SHINGLE - 1}, 1)), i -> array_join(slice(iw, i, {SHINGLE}), ' '))"
    own = items.withColumn("_s", F.expr(every)).withColumn("_c", F.expr("transform(_s, x -> cast(length(x) as long))"))
    total = "aggregate(_c, 0L, (a, x) -> a + x)"
    block = F.when(F.expr("size(array_distinct(_s)) < size(_s)"), min(RUNS))
    for b in sorted(RUNS, reverse=True)[:-1]:
        block = block.when(F.expr(f"{breaking('_c', RUNS[b])} > {total} * {1 - SIMILARITY:.6f}D"), b)
    return own.withColumn("block", block.otherwise(min(RUNS))).drop("_s", "_c")


def _hashed(df: DataFrame, ws: str) -> DataFrame:
    return df.withColumn("_w", F.expr(f"transform({ws}, w -> xxhash64(w))")).withColumn("_h", features(ws)).drop("_w")


def _majority(df: DataFrame, kept: list[str], bits: list[str]) -> DataFrame:
    """``kept`` and fp, whose bits are set where more than half of the longs ``bits`` have them.

    Rows of adders, one projection each: three longs of a weight become their sum and, a weight higher, their carry.
    """
    columns: dict[int, list[str]] = {0: bits}
    made = 0
    while any(len(v) > 1 for v in columns.values()):
        after: dict[int, list[str]] = {}
        new = {}
        for weight, own in sorted(columns.items()):
            while len(own) > 1:
                part, own = own[:3], own[3:]
                total, carry = f"_s{made}", f"_c{made}"
                made += 1
                if len(part) == 3:
                    a, b, c = part
                    new[total], new[carry] = F.expr(f"{a} ^ {b} ^ {c}"), F.expr(f"({a} & {b}) | ({c} & ({a} ^ {b}))")
                else:
                    a, b = part
                    new[total], new[carry] = F.expr(f"{a} ^ {b}"), F.expr(f"{a} & {b}")
                after.setdefault(weight, []).append(total)
                after.setdefault(weight + 1, []).append(carry)
            after.setdefault(weight, []).extend(own)
        columns = {w: v for w, v in after.items() if v}
        live = [c for v in columns.values() for c in v]
        df = df.select(*kept, *[new[c].alias(c) if c in new else F.col(c) for c in live])
    least = len(bits) // 2 + 1
    out = "-1L"
    for weight in range(max(columns) + 1):
        count = columns[weight][0] if weight in columns else "0L"
        out = f"({count} {'&' if least >> weight & 1 else '|'} {out})"
    return df.select(*kept, F.expr(out).alias("fp"))


def _windows(df: DataFrame, kept: list[str], at: str, b: int) -> DataFrame:
    """``kept`` and fp of the 3b features of _h from ``at`` on."""
    bits = [f"_f{j}" for j in range(3 * b)]
    return _majority(df.select(*kept, *[F.expr(f"_h[{at} + {j}]").alias(c) for j, c in enumerate(bits)]), kept, bits)


def document_windows(docs: DataFrame, b: int) -> DataFrame:
    """``docs`` (with ws, the words) exploded to windows: at (first word), block (b), fp."""
    w = 3 * b
    hashes = _hashed(docs.filter(F.size("ws") > w), "ws")
    starts = hashes.select(*docs.columns, "_h", F.explode(F.expr(f"sequence(0, (size(_h) - {w}) div {b})")).alias("_x"))
    starts = starts.select(*docs.columns, "_h", (F.col("_x") * b).alias("at"))
    return _windows(starts, [*docs.columns, "at"], "at", b).withColumn("block", F.lit(b))


def item_windows(items: DataFrame, blocks: list[int]) -> DataFrame:
    """``items`` (item_id, iw, block) exploded to the windows at all offsets: item_id, n (words), off, block, fp."""
    out = None
    for b in blocks:
        own = _hashed(items.filter(F.col("block") == b), "iw").select("item_id", F.size("iw").alias("n"), "_h", F.explode(F.expr(f"sequence(0, size(_h) - {3 * b})")).alias("off"))
        own = _windows(own, ["item_id", "n", "off"], "off", b).withColumn("block", F.lit(b))
        out = own if out is None else out.unionByName(own)
    return out


def _keys(df: DataFrame, fp: str) -> Column:
    """The four keys of a fingerprint: size, block number and bits in one long."""
    part = lambda b: (F.col("block").cast("long") * BLOCKS + b) * (1 << BLOCK_BITS) + F.shiftright(F.col(fp), BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return F.explode(F.array(*[part(b) for b in range(BLOCKS)]))


def shingles(ws: str) -> str:
    return f"array_distinct(transform(sequence(1, size({ws}) - {SHINGLE - 1}), i -> array_join(slice({ws}, i, {SHINGLE}), ' ')))"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, word, similarity, passage) for each document and item found in it: the best place.

    ``docs`` needs doc_id and text, ``items`` item_id and text; others are ignored. Null texts hold nothing. Items of
    under five words mark no document. Repeated items or documents give one row a pair; a null doc_id is one document,
    and each text of a repeated or null doc_id is searched. Of places alike in similarity the one counts that most windows
    agree on, then the first; ``word`` is the first word of the item's passage, 0 for an item whose beginning is missing.
    """
    # Constraints through the rows of adders would grow exponentially in the optimizer; none of them helps here.
    docs.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    own = items.select("item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") >= SHINGLE).distinct()
    own = with_blocks(own)
    sizes = own.groupBy("block").agg(F.sum(F.size("iw")).alias("words")).collect()  # a row a b
    blocks = sorted(r["block"] for r in sizes)
    if not blocks:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, word int, similarity double, passage string")
    few = sum(r["words"] for r in sizes) <= BROADCAST_WINDOWS  # an item has fewer windows than words
    parsed = docs.select("doc_id", F.xxhash64("text").alias("_t"), words(F.col("text")).alias("ws"))
    right = item_windows(own, blocks)
    right = right.select("item_id", "n", "off", F.col("fp").alias("item_fp"), _keys(right, "fp").alias("key"))
    pad = f"({PAD} + n div {PAD_SHARE})"
    region = F.expr(f"slice(ws, cast(greatest(word - {pad}, 0) + 1 as int), cast(n + 2 * {pad} + least(word - {pad}, 0) as int))").alias("region")
    found = None
    for b in blocks:
        left = document_windows(parsed, b)
        kept = ["doc_id", "_t", "ws"] if few else ["doc_id", "_t"]  # where window rows move, the words join again afterwards
        left = left.select(*kept, "block", "at", "fp", _keys(left, "fp").alias("key"))
        hits = left.join(F.broadcast(right) if few else right, "key").filter(F.expr(f"bit_count(fp ^ item_fp) <= {RADIUS}"))
        hits = hits.select(*kept, "item_id", "n", (F.col("at") - F.col("off")).alias("word"))
        if few:
            hits = hits.select("doc_id", "_t", "item_id", "word", F.lit(1).alias("agree"), region)
        else:
            hits = hits.groupBy(*hits.columns).agg(F.count("*").alias("agree")).alias("h")
            hits = hits.join(parsed.alias("p"), F.expr("h.doc_id <=> p.doc_id AND h._t = p._t")).select("h.doc_id", "h._t", "item_id", "word", "agree", region)
        found = hits if found is None else found.unionByName(hits)
    places = found.groupBy("doc_id", "_t", "item_id", "word").agg(F.sum("agree").alias("agree"), F.max("region").alias("region")).filter(F.size("region") >= SHINGLE)
    own = own.drop("block")
    places = places.join(F.broadcast(own) if few else own, "item_id")
    weighed = places.withColumn("want", F.expr(shingles("iw"))).withColumn("have", F.expr(shingles("region")))
    weight = lambda x: f"aggregate({x}, 0, (a, s) -> a + length(s))"
    scored = weighed.withColumn("similarity", F.expr(f"{weight('array_intersect(want, have)')} / {weight('want')}")).filter(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct(F.greatest("word", F.lit(0)).alias("word"), "similarity", F.array_join("region", " ").alias("passage")), F.struct("similarity", "agree", -F.col("word"))).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id holds an item."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.expr("doc_id <=> _bad"), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the item and its best place; clean documents have no row."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("word").cast("long").alias("word"), F.round("similarity", 6).alias("similarity"))
