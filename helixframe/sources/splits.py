"""FASTA files and wide matrices as Spark data sources that read one file by many tasks, each a range of its bytes.

A range owns the records whose separator begins in it, and the first range the one at the file's start too; a record
that goes on beyond the range is read to its end there. Compressed files are one range. Paths are files, folders or
patterns in their last part, on any file system that pyarrow opens.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .matrix import META

#: Bytes of a range where no option says otherwise, and of one read.
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Rows and bytes after which a batch is handed to Spark; a longer record is a batch of its own.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
#: Endings of compressed files, and schemes that Hadoop names otherwise.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
SCHEMES = {"s3a": "s3", "s3n": "s3"}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    scheme, found, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files under ``path`` that have bytes; hidden ones and marks of a finished write don't count."""
    system, inner = _located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        folder, pattern = (inner, "*") if info.type == fs.FileType.Directory else os.path.split(inner)
        if info.type == fs.FileType.NotFound and not re.search(r"[*?\[]", pattern):
            raise FileNotFoundError(path)
        listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = [i for i in listed if i.type == fs.FileType.File and i.base_name[0] not in "._" and fnmatch.fnmatch(i.base_name, pattern)]
    base = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((base + i.path, i.size) for i in found if i.size)


def ranges(path: str, split_bytes: int) -> list[Range]:
    """All files under ``path`` in ranges of ``split_bytes``."""
    if split_bytes < 1:
        raise ValueError("a range has one byte or more")
    out = []
    for name, size in _files(path):
        step = size if name.endswith(COMPRESSED) else split_bytes
        out += [Range(name, a, min(a + step, size)) for a in range(0, size, step)]
    return out or [Range("", 0, 0)]


def pieces(handle, start: int, end: float, mark: bytes, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """What stands between occurrences of ``mark`` in the file that ``handle`` has at ``start``: the pieces whose mark
    begins in [start, end), and the file's first piece if start is 0."""
    rest, at = b"", start  # bytes that are not dealt with yet, and their place in the file
    piece: list[bytes] | None = None if start else []
    while True:
        block = handle.read(read_bytes)
        data, i = rest + block, 0
        while (j := data.find(mark, i)) >= 0:
            if piece is not None:
                yield b"".join([*piece, data[i:j]])
            if at + j >= end:
                return
            piece, i = [], j + len(mark)
        if not block:
            if piece is not None:
                yield b"".join([*piece, data[i:]])
            return
        cut = max(i, len(data) - len(mark) + 1)  # the last bytes can be the beginning of a mark
        if piece is not None:
            piece.append(data[i:cut])
        elif at + cut >= end:
            return
        rest, at = data[cut:], at + cut


def _read(part: Range, mark: bytes) -> Iterator[bytes]:
    if not part.path:
        return
    system, inner = _located(part.path)
    if part.path.endswith(COMPRESSED):
        with system.open_input_stream(inner, compression="detect") as f:
            yield from pieces(f, 0, float("inf"), mark)
    else:
        with system.open_input_file(inner) as f:
            f.seek(part.start)
            yield from pieces(f, part.start, part.end, mark)


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """String rows as Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES."""
    schema = pa.schema([(n, pa.string()) for n in names])
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if v)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.sep = options.get("sep", "\t")

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.rows(partition), self.names)


class _FastaReader(_Reader):
    def rows(self, part: Range) -> Iterator[tuple]:
        for record in _read(part, b"\n>"):
            head, _, body = record.removeprefix(b">").partition(b"\n")
            name = re.match(rb"\S*", head)[0].decode(errors="replace")
            seq = re.sub(rb"\s", b"", body).decode(errors="replace")
            if name and seq:
                yield name, seq


class FastaSource(DataSource):
    """record_id (what stands before the first white space of a header) and seq (all its lines, without white space).

    Records without an id or a sequence are dropped. Options: path, splitBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "record_id string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options, ["record_id", "seq"])


def _header(path: str, sep: str) -> list[str]:
    first = next(_read(Range(path, 0, 1), b"\n"), b"").decode("utf-8-sig", errors="replace").rstrip("\r")
    return next(csv.reader([first], delimiter=sep), [])


class _MatrixReader(_Reader):
    def rows(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        place = {n: i for i, n in enumerate(_header(part.path, self.sep))}
        wanted = [place.get(n, -1) for n in self.names]
        lines = _read(part, b"\n")
        if part.start == 0:
            next(lines, None)
        texts = (t for t in (line.decode(errors="replace").rstrip("\r") for line in lines) if t.strip())
        for cells in csv.reader(texts, delimiter=self.sep):
            yield tuple(cells[i] or None if 0 <= i < len(cells) else None for i in wanted)


class MatrixSource(DataSource):
    """A wide matrix as text: its leading columns, and of the samples those named by the option samples (a JSON list;
    all where unset). Only those columns leave the task.

    Columns go by the header of their own file; one that a file or a row lacks is null there. Options: path, sep,
    samples, splitBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "matrix_ranges"

    def columns(self) -> list[str]:
        files = _files(self.options["path"])
        names = _header(files[0][0], self.options.get("sep", "\t")) if files else []
        if missing := [c for c in META[:2] if c not in names]:
            raise ValueError(f"missing columns: {missing}")
        if len(set(names)) < len(names):
            raise ValueError("a column's name is there twice")
        wanted = self.options.get("samples")
        if wanted is None:
            return names
        samples = json.loads(wanted)
        if missing := [c for c in samples if c not in names]:
            raise ValueError(f"missing columns: {missing}")
        return [c for c in names if c in META] + [c for c in samples if c not in META]

    def schema(self) -> str:
        quoted = (n.replace("`", "``") for n in self.columns())
        return ", ".join(f"`{n}` string" for n in quoted)

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options, schema.names)


def fasta(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """As matrix.read_fasta, through FastaSource."""
    spark.dataSource.register(FastaSource)
    return spark.read.format(FastaSource.name()).option("splitBytes", split_bytes).load(path)


def expression(spark: SparkSession, path: str, samples: list[str] | None = None, sep: str = "\t", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """As matrix.read_expression, through MatrixSource: the leading columns and ``samples`` (all for None) as doubles;
    text that is no number becomes null."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format(MatrixSource.name()).option("splitBytes", split_bytes).option("sep", sep)
    raw = (reader if samples is None else reader.option("samples", json.dumps(samples))).load(path)

    def number(name: str) -> F.Column:
        quoted = "`" + name.replace("`", "``") + "`"
        return F.nanvl(F.expr(f"try_cast({quoted} AS DOUBLE)"), F.lit(None).cast("double")).alias(name)

    return raw.select(*[F.col(c) if c in META else number(c) for c in raw.columns])
