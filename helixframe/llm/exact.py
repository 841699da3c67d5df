"""Exact-duplicate fingerprints of canonical texts, in DataFrame functions only.

A text is brought to Unicode NFKC, case-folded, and its white space folded; two xxHash values of that make a 128-bit
fingerprint. Where several documents share one, their canonical bytes are compared, and those that differ from the
bucket's least text get a number in the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release, table

#: White space left after NFKC, which maps the other spaces to U+0020.
SPACE = "[\\s\\x{0085}\\x{1680}\\x{2028}\\x{2029}]+"
#: Slots of the bounded filter that thins the texts to compare; it never has more rows.
SLOTS = 1 << 16


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo it), runs of white space as one space, ends trimmed. Null counts as empty."""
    compose = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    plain = F.lower(text)
    whole = F.when(text.rlike("[^\\x00-\\x7f]"), compose(folded)).otherwise(plain)
    return F.coalesce(F.trim(F.regexp_replace(whole, SPACE, " ")), F.lit(""))


def wide_hash(canon: Column) -> Column:
    """32 hex digits: xxHash of the text and xxHash seeded by another value."""
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(20_011), canon))))


#: What tells documents apart: the id (0 and a mark for null) and a hash of the text. Rows alike in both are one document.
KEY = ["did", "nil", "th"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the columns of KEY."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("did"), F.col("doc_id").isNull().alias("nil"), F.xxhash64(text).alias("th"))


def collisions(texts: DataFrame, hashes: DataFrame) -> DataFrame | None:
    """(hash, canon, class) of the canonical texts that differ from the least one with the same hash, class from 1 on;
    None if there are none.

    ``hashes`` has the hash of every row of ``texts``. Only texts whose hash is in a bounded bit table of the shared
    hashes are moved. The bit table has SLOTS rows of 64 bits at most; if it fills up, more texts are moved, and the
    result is the same.
    """
    slot = F.pmod(F.xxhash64("hash"), F.lit(SLOTS))
    bit = F.pmod(F.xxhash64(F.lit(1), "hash"), F.lit(64)).cast("int")
    shared = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    bits = materialise(shared.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(pmod(xxhash64(1, hash), 64) as int))").alias("b")).groupBy("slot").agg(F.bit_or("b").alias("bits")), "bits")
    hashed = texts.select(canonical(F.col("text")).alias("canon")).withColumn("hash", wide_hash(F.col("canon")))
    near = hashed.withColumn("slot", slot).withColumn("bit", bit).join(F.broadcast(bits), "slot").filter(F.expr("shiftright(bits, bit) & 1 = 1"))
    distinct = near.groupBy("hash", "canon").count()
    several = materialise(distinct.withColumn("class", F.dense_rank().over(W.partitionBy("hash").orderBy("canon")) - 1).filter(F.col("class") > 0).select("hash", "canon", "class"), "collisions")
    release(bits)
    return several if several.limit(1).count() else None


def _classed(hashed: DataFrame, texts: DataFrame, column: str, several: DataFrame | None, keys: list[str], name: str) -> DataFrame:
    """``hashed`` with ``name``: the fingerprint for the hash in ``column``, of the text of the row of ``texts`` with the
    same ``keys``. Texts are read only for hashes that have several classes."""
    if several is None:
        return hashed.withColumn(name, F.col(column))
    odd = hashed.join(several.select(F.col("hash").alias(column)).distinct(), column, "left_semi").select(*keys, column).distinct()
    canon = texts.join(odd, keys).select(*keys, column, canonical(F.col("text")).alias("canon"))
    found = canon.join(several.withColumnRenamed("hash", column), [column, "canon"]).select(*keys, "class").distinct()
    named = F.when(F.col("class") > 0, F.concat(F.col(column), F.lit("-"), F.col("class").cast("string"))).otherwise(F.col(column))
    return hashed.join(found, keys, "left").withColumn(name, named).drop("class")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text; others ignored).

    Equal fingerprints mean equal canonical texts. Null and empty texts are equal. Null and repeated doc_ids are rows
    like others and repeated rows stay; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    hashed = keyed.select("doc_id", *KEY, wide_hash(canonical(F.col("text"))).alias("hash"))
    return _classed(hashed, keyed.dropDuplicates(KEY), "hash", collisions(keyed, hashed), KEY, "fingerprint").select("doc_id", "fingerprint")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, first_id (least doc_id of the equal canonical texts) and copies of every row."""
    named = fingerprints(docs)
    groups = named.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return named.join(groups, "fingerprint").select("doc_id", "fingerprint", "first_id", "copies")


def next_documents(ids: DataFrame) -> DataFrame:
    """``ids`` (a row per document: KEY, ...) with the key of the next one as next_did, next_nil, next_th.

    Order is by id, null last, then by the text's hash; after the last comes the first. Documents are dealt by range;
    within a range the next is looked up there, at its end in the table of first ones, which has a row per range.
    """
    place = ["nil", "did", "th"]
    own = F.struct(*place)
    dealt = materialise(ids.repartitionByRange(*place).withColumn("part", F.spark_partition_id()), "ranges")
    firsts = dealt.groupBy("part").agg(F.min(own).alias("least"))
    order = W.orderBy("part")  # a row per range
    after = firsts.select("part", F.coalesce(F.lead("least").over(order), F.first("least").over(order)).alias("after"))
    found = dealt.withColumn("next", F.lead(own).over(W.partitionBy("part").orderBy(*place))).join(after, "part")
    found = found.withColumn("next", F.coalesce("next", "after"))
    return found.select(*ids.columns, *[F.col(f"next.{c}").alias(f"next_{c}") for c in KEY])


def edited_texts(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """KEY, n_chars, the next one's key, text and edited of every document of ``ids`` (next_documents with n_chars): its
    last quarter of characters gives way to the first as many of the next document."""
    cut = F.expr("n_chars div 4")
    once = keyed.dropDuplicates(KEY) if keyed.groupBy(*KEY).count().filter("count > 1").limit(1).count() else keyed
    asks = ids.select(*[F.col(f"next_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"_{c}") for c in KEY], cut.alias("cut"))
    heads = once.join(asks, KEY).select(*[F.col(f"_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, cast(cut as int))").alias("head"))
    both = once.join(ids, KEY).join(heads, KEY).withColumn("cut", cut)
    edited = F.expr("concat(substring(text, 1, cast(n_chars - cut as int)), head)")
    return both.select(*KEY, "n_chars", *[f"next_{c}" for c in KEY], "text", edited.alias("edited"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and likenesses (an exact digest has 0 or 1).

    Rows that repeat doc_id and text are one document and all come out, with the same values; an id's other texts and a
    null id are documents of their own, in order of the text's hash and last. Of an empty table there are no rows.
    """
    keyed = _keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = keyed.select(*KEY, F.length("text").cast("long").alias("n_chars")).distinct()
    ids = materialise(next_documents(ids), "next-ids")
    texts = edited_texts(keyed, ids)
    canons = texts.select(*KEY, "n_chars", *[f"next_{c}" for c in KEY], F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"))
    hashed = canons.select(
        *KEY, "n_chars", *[f"next_{c}" for c in KEY], "edited_sha256",
        wide_hash(F.col("canon")).alias("hash"), wide_hash(F.col("edited_canon")).alias("edited_hash"), (F.col("canon") == F.col("edited_canon")).alias("same"),
    )
    hashed = materialise(hashed, "hashes")
    several = collisions(keyed, hashed)
    once = texts.select(*KEY, "text")
    rows = _classed(hashed, once, "hash", several, KEY, "fingerprint")
    rows = _classed(rows, texts.select(*KEY, F.col("edited").alias("text")), "edited_hash", several, KEY, "edited_name")
    # an edited text with its document's hash but other bytes is marked
    own = F.when(F.col("same"), F.col("fingerprint")).when(F.col("edited_name") == F.col("fingerprint"), F.concat("edited_name", F.lit("-e"))).otherwise(F.col("edited_name"))
    rows = materialise(rows.select(*KEY, "n_chars", *[f"next_{c}" for c in KEY], "edited_sha256", "fingerprint", own.alias("edited_fingerprint")), "fingerprints")
    after = rows.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("fingerprint").alias("next_fingerprint"))
    likeness = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    out = keyed.select("doc_id", *KEY).join(rows, KEY).join(after, [f"next_{c}" for c in KEY])
    release(ids, hashed, several)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
