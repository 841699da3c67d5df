"""Chat formatting with one training example per assistant turn.

An example is the formatted text of all turns up to an assistant turn; only that turn's reply is trainable. So the
examples of a conversation grow with the square of its turns. ``training_examples`` streams them, none left out: the
prefix is spooled (to disk where it is long) and an example goes out in chunks. ``format_conversations`` gives each
conversation's formatted text once, as segments; ``examples`` joins those to strings for conversations of bounded length.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# The markers of the template, and control strings of common templates that texts must not hold.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>")

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(\\?)")
_ROLE_UNESCAPE = re.compile(r"\\(n|\\?)")
_SEGMENT = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)
#: Rows of output per Arrow batch.
OUT_ROWS = 512
#: Bytes read at once from a spooled prefix, bytes of it that stay in memory, and characters per batch of chunks.
CHUNK_BYTES, SPOOL_BYTES, BATCH_CHARS = 1 << 18, 1 << 22, 1 << 21


def escape(text: str) -> str:
    """Backslashes are doubled; a control string gets one after its first character, so it no longer occurs."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the escaped text in it)."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turn(segment: str) -> tuple[str, str]:
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return _ROLE_UNESCAPE.sub(lambda x: {"n": "\n", "\\": "\\", "": ""}[x[1]], m[1]), unescape(m[2])


SEGMENTS = "conv_id long, position long, role string, segment string, segment_start long, example long, context_chars long, target_start long, target_end long"
_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SEGMENTS.split(", ")])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Segments of all conversations, in order within each partition.

    ``turns`` needs conv_id, turn, role, text; other columns are ignored. Rows go by turn (null first), then role and
    text, so repeated turns stay, side by side. Null role or text counts as empty; null conv_id is one conversation.
    Rows whose role is "assistant" have example (its number in the conversation) and target_start/target_end, the span
    of the reply in the conversation's formatted text; others have nulls there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at, examples = object(), 0, 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, position, at, examples = conv, 0, 0, 0
                segment, start, end = format_turn(role or "", text or "")
                own = role == "assistant"
                rows.append((conv, position, role or "", segment, at, *((examples, at, at + start, at + end) if own else (None,) * 4)))
                position, at, examples = position + 1, at + len(segment), examples + own
            for i in range(0, len(rows), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + OUT_ROWS], strict=True), _ARROW, strict=True)], schema=_ARROW)

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def examples(parts: DataFrame) -> DataFrame:
    """Examples as strings, from training_examples: conv_id, conv, example, formatted, target_start, target_end.

    Every example is there, whatever its length; Spark holds a row whole, so one beyond 2 GB raises. Conversations are
    told apart by their partition and number in it.
    """
    own = parts.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).filter(F.col("example").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    return own.groupBy("part", "conv", "conv_id", "example", "target_start", "target_end").agg(text.alias("formatted")).select("conv_id", "conv", "example", "formatted", "target_start", "target_end")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")])


def digest(segments: DataFrame) -> DataFrame:
    """Reads the turns back from format_conversations' output (whose order within partitions it relies on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # conv_id, turns, hash of turns, loss chars, hash of loss, formatted chars
        done: list[tuple] = []
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            names = ("conv_id", "segment", "segment_start", "target_start", "target_end")
            for conv, segment, at, start, end in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if state is None or at == 0:
                    if state is not None:
                        done.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(segment[start - at : end - at])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(close(state), _DIGEST, strict=True)], schema=_DIGEST)

    return segments.mapInArrow(run, DIGEST)


EXAMPLES = "conv_id long, conv long, example long, first boolean, text string, target_start long, target_end long"
_EXAMPLES = pa.schema([(x.split()[0], {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}[x.split()[1]]) for x in EXAMPLES.split(", ")])


def training_examples(turns: DataFrame) -> DataFrame:
    """Every example in chunks, in order within each partition; ``turns`` as for format_conversations.

    conv counts a partition's conversations. first marks an example's first chunk, target_start/target_end is the
    reply's span in the example. What follows a conversation's last example (all of it where there is none) comes at
    its end with null example.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EXAMPLES, strict=True)], schema=_EXAMPLES)
            rows.clear()
            size = 0
            return made

        def emit(example: int | None, since: int, start: int | None, end: int | None) -> Iterator[pa.RecordBatch]:
            nonlocal size
            spool.seek(since)
            decode, first = codecs.getincrementaldecoder("utf-8")().decode, True
            while data := spool.read(CHUNK_BYTES):
                rows.append((now, conv_no, example, first, decode(data), start, end))
                size, first = size + len(data), False
                if size >= BATCH_CHARS or len(rows) >= OUT_ROWS:
                    yield out()
            spool.seek(0, 2)

        now, conv_no, at, count, since = None, -1, 0, 0, 0
        spool = None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if spool is None or conv != now:
                    if spool is not None:
                        yield from emit(None, since, None, None)
                        spool.close()
                    spool = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
                    now, conv_no, at, count, since = conv, conv_no + 1, 0, 0, 0
                segment, start, end = format_turn(role or "", text or "")
                spool.write(segment.encode())
                if role == "assistant":
                    yield from emit(count, 0, at + start, at + end)
                    count, since = count + 1, spool.tell()
                at += len(segment)
        if spool is not None:
            yield from emit(None, since, None, None)
            spool.close()
        if rows:
            yield out()

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, EXAMPLES)


def example_digest(parts: DataFrame) -> DataFrame:
    """The digest of conversations, read back from training_examples' output (whose order within partitions it relies on).

    Replies are what the examples' spans hold. Turns are read where an example goes beyond the one before it; its
    context must be that one's text, or this raises.
    """

    class State:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
            self.turns_hash, self.loss_hash, self.text_hash = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            self.rest, self.reply, self.at, self.known, self.own = "", None, 0, 0, None

        def begin(self) -> None:
            self.end()
            self.at, self.known, self.own, self.reply = 0, self.chars, hashlib.sha256(), []

        def add(self, text: str, start: int, end: int) -> None:
            lo, hi = max(start - self.at, 0), min(end - self.at, len(text))
            if lo < hi:
                self.reply.append(text[lo:hi])
            old = max(min(self.known - self.at, len(text)), 0)
            self.own.update(text[:old].encode())
            self.at += len(text)
            self.new(text[old:])

        def new(self, text: str) -> None:
            if not text:
                return
            if self.own is not None and self.own.digest() != self.text_hash.digest():
                raise ValueError("an example's context is not its conversation's text")
            self.text_hash.update(text.encode())
            if self.own is not None:
                self.own.update(text.encode())
            self.chars += len(text)
            *full, self.rest = (self.rest + text).split(CLOSE + "\n")
            for segment in full:
                role, said = parse_turn(segment + CLOSE + "\n")
                self.turns += 1
                self.turns_hash.update(f"{role}\n{said}\n".encode())

        def end(self) -> None:
            if self.reply is not None:
                loss = unescape("".join(self.reply))
                self.loss_chars += len(loss)
                self.loss_hash.update(loss.encode())
            self.reply = self.own = None

        def row(self) -> tuple:
            self.end()
            if self.rest:
                raise ValueError("not a formatted turn")
            return self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            done = []
            for conv_id, conv, example, first, text, start, end in zip(*(batch.column(c).to_pylist() for c in _EXAMPLES.names), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(state.row())
                    state, now = State(conv_id), conv
                if example is None:
                    state.end()
                    state.new(text)
                else:
                    if first:
                        state.begin()
                    state.add(text, start, end)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(state.row(), _DIGEST, strict=True)], schema=_DIGEST)

    return parts.mapInArrow(run, DIGEST)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all conversations and -7, read back from their training examples. An empty table leaves -7 alone."""
    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return example_digest(training_examples(turns.unionByName(extra)))
