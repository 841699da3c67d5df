"""Language ID by a byte convolutional network.

Bytes are embedded, convolved by filters of several widths, max-pooled over a fixed-length window and classified by
softmax. A text is cut into windows, each is classified, and the text takes the mean of its windows' probabilities,
weighted by their bytes. Training is plain numpy on the driver over a bounded sample of labelled rows
(SAMPLE_DOCS documents, SNIPPETS snippets each); prediction reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: The sample for training: about this many documents over all languages, and snippets of each.
SAMPLE_DOCS = 6000
SNIPPETS = 2
EPOCHS = 4
STEP = 64
RATE = 0.004
UNKNOWN = "und"
#: Windows classified at a time, so that their activations stay in cache.
AT_ONCE = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 13]] = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses by pair of bytes: of the first two bytes for all filters, of the next two for the wider ones."""
        t = {w: [self.embed @ k for k in self.filters[w]] for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        nothing = np.zeros((256, FILTERS), np.float32)
        first = np.concatenate([pair(t[w][0], t[w][1]) for w in WIDTHS], axis=1)
        second = np.concatenate([pair(t[w][2], t[w][3] if w > 3 else nothing) for w in WIDTHS if w > 2], axis=1)
        return first.astype(np.float32), second.astype(np.float32)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of lower-cased bytes, padded by spaces; the text of each; its bytes)."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[:-1][owner] + k * WINDOW
    weight = np.minimum(WINDOW, offsets[1:][owner] - start)
    padded = np.concatenate([_LOWER[data], np.full(WINDOW, 32, np.uint8)])
    at = start[:, None] + np.arange(WINDOW)
    out = padded[at]
    short = weight < WINDOW
    out[short] = np.where(np.arange(WINDOW) < weight[short, None], out[short], 32)
    return out, owner, weight


def _pooled(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    wide = x.astype(np.int32)
    pair = (wide[:, :-1] << 8) + wide[:, 1:]
    act = first[pair[:, : WINDOW - 3]]
    act[:, :, FILTERS:] += second[pair[:, 2:]]
    return act


def probabilities(model: Model, x: np.ndarray, made: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.empty((len(x), len(model.languages)), np.float32)
    for i in range(0, len(x), AT_ONCE):
        h = np.maximum(_pooled(x[i : i + AT_ONCE], *made).max(axis=1) + model.bias, 0)
        z = h @ model.out + model.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[i : i + AT_ONCE] = z / z.sum(axis=1, keepdims=True)
    return out


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Train on snippets; each counts with its first WINDOW bytes. Adam, cross entropy."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in labels])
    data = np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW) for t in texts), np.uint8)
    x = _LOWER[data].reshape(-1, WINDOW)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "out_bias": np.zeros(len(languages))}
    p |= {f"w{w}": rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), STEP):
            xb, yb = x[order[i : i + STEP]], y[order[i : i + STEP]]
            e, acts, tops = p["embed"][xb], [], []
            for w in WIDTHS:
                n = WINDOW - 3
                act = sum(e[:, j : j + n] @ p[f"w{w}"][j] for j in range(w))
                tops.append(act.argmax(axis=1))
                acts.append(np.take_along_axis(act, tops[-1][:, None, :], 1)[:, 0])
            z1 = np.concatenate(acts, axis=1) + p["bias"]
            h = np.maximum(z1, 0)
            z = h @ p["out"] + p["out_bias"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(yb)), yb] -= 1
            q /= len(yb)
            g = {"out": h.T @ q, "out_bias": q.sum(0)}
            d = (q @ p["out"].T) * (z1 > 0)
            g["bias"], g["embed"] = d.sum(0), np.zeros_like(p["embed"])
            for k, w in enumerate(WIDTHS):
                own = d[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"w{w}"] = np.empty_like(p[f"w{w}"])
                for j in range(w):
                    b = np.take_along_axis(xb, tops[k] + j, 1)
                    g[f"w{w}"][j] = np.einsum("bfe,bf->ef", p["embed"][b], own)
                    np.add.at(g["embed"], b, own[:, :, None] * p[f"w{w}"][j].T[None])
            step += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                p[name] = (p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(languages, p["embed"], {w: p[f"w{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def sampling_rate(share: float, count: int) -> float:
    return min(1.0, share / count)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from text and non-null lang of documents that are not held out; None if there are none.

    The sample is a hash sample, with equal shares of ``sample_docs`` for all languages, and of each document SNIPPETS
    snippets of WINDOW characters from places given by a hash; so it is the same however the table is partitioned.
    Training uses the first WINDOW bytes of a snippet, which is under WINDOW characters where those take several bytes.
    Repeated rows count each time; an empty table or one without languages gives None.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    share = sample_docs / len(counts)
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, sampling_rate(share, n))])
    # a hash of 62 bits as a number below 1, so any rate that counts of documents give is met
    chosen = known.filter(F.expr(f"pmod(xxhash64(doc_id, 'sample'), {1 << 62}L) / {1 << 62}D") < rate[F.col("lang")])
    at = lambda k: F.substring("text", F.expr(f"cast(1 + pmod(xxhash64(doc_id, {k}), greatest(length(text) - {WINDOW} + 1, 1)) as int)"), F.lit(WINDOW))
    rows = chosen.select("doc_id", "lang", *[at(k).alias(f"s{k}") for k in range(SNIPPETS)]).collect()  # about sample_docs rows
    rows.sort(key=lambda r: (r["doc_id"], r["s0"]))
    pairs = [(r[f"s{k}"].encode(), r["lang"]) for r in rows for k in range(SNIPPETS)]
    return fit([t for t, _ in pairs], [v for _, v in pairs])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) at its end, from the text column alone.

    Null texts, texts without a letter, and all texts where there is no model get "und" and 0. Other columns stay as
    they are; columns named lang_pred or score are replaced. Repeated rows stay, each with the same prediction (ties go
    to the first language by name); an empty table gives no rows.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        made = net.tables() if net is not None else None  # 20 MB, freed with the task
        for batch in batches:
            column = batch.column(text_col)
            n = len(column)
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if net is not None:
                data, offsets = text_bytes(column)
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False)).copy()
                for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                    lettered[i] = any(map(str.isalpha, column[int(i)].as_py()))
                sums, weights = np.zeros((n, len(net.languages))), np.zeros(n)
                for lo, hi in chunks(offsets, 1 << 20):
                    for part in _long(data, offsets[lo : hi + 1]):
                        x, owner, weight = windows(*part)
                        q = probabilities(net, x, made)
                        for k in range(q.shape[1]):
                            sums[lo:hi, k] += np.bincount(owner, q[:, k] * weight, hi - lo)
                        weights[lo:hi] += np.bincount(owner, weight, hi - lo)
                best = sums.argmax(axis=1)
                names = np.array(net.languages, object)
                pred[lettered] = names[best[lettered]]
                score[lettered] = np.clip(sums[np.arange(n), best][lettered] / weights[lettered], 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])
        pa.default_memory_pool().release_unused()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest) + ", lang_pred string, score double"
    return docs.select(*rest).mapInArrow(run, schema)


def _long(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are or, if it is one long text, in parts of whole windows."""
    a, b = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or b - a <= most:
        yield data[a:b], offsets - a
        return
    for at in range(a, b, most):
        yield data[at : min(b, at + most)], np.array([0, min(b, at + most) - at])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model learnt from those that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
