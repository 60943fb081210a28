"""FASTA and FASTQ as a Python data source: files are cut into splits of bytes, so one record may lie in many tasks, and new files can be read as a stream.

A split's task emits the bases of its bytes in pieces, each with the first ``overlap`` bases that follow in the record, and numbers records within the split.
What began before the split is its record 0. ``read_pieces`` makes record ids and places of that by segmented running sums over the splits, so no task and no
driver sees a record as a whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.running import running
from .storage import shared_dir, stored

SPLIT, PIECE, BLOCK = 32 << 20, 1 << 20, 1 << 20
HEADER = 1 << 16  # the longest header line
_SPACE = b" \t\r\n"
_PIECES = "split long, record long, header string, start long, own long, seq string"
_READS = "split long, record long, header string, seq string, qual string"


@dataclass
class Part(InputPartition):
    """Bytes [begin, end) of a file, the split's number among all, and the files that go on behind it."""

    number: int
    path: str
    begin: int
    end: int
    after: tuple[str, ...] = ()


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def files_of(path: str) -> list[tuple[str, int, float]]:
    """(address, bytes, time) of a file, or of those of a folder in order of name; hidden ones and markers are left out."""
    fs, at = _place(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at))
    return sorted((prefix + x.path, x.size, x.mtime_ns or 0) for x in found if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")))


def text_of(path: str, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Blocks of a file's text from a byte to another; a gzipped file, of one member or many, is read whole."""
    fs, at = _place(path)
    with fs.open_input_file(at) as f:
        f.seek(begin)
        left = (end if end is not None else f.size()) - begin
        unzip = zlib.decompressobj(31) if path.endswith(".gz") else None
        while left > 0 and (block := f.read(min(BLOCK, left))):
            left -= len(block)
            while unzip is not None and block:
                text = unzip.decompress(block)
                block = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
                if text:
                    yield text
            if unzip is None:
                yield block


def _starts_in_header(path: str, begin: int) -> tuple[bool, bool]:
    """Whether a byte of a file lies within a header line, and whether it begins a line."""
    if not begin:
        return False, True
    fs, at = _place(path)
    with fs.open_input_file(at) as f:
        low = max(0, begin - HEADER)
        f.seek(low)
        before = f.read(begin - low)
    end = before.rfind(b"\n")
    if end == len(before) - 1:
        return False, True
    return (end >= 0 or not low) and before[end + 1 : end + 2] == b">", False


def fasta_rows(part: Part, overlap: int, piece: int = PIECE) -> Iterator[tuple]:
    """(split, record, header, start, own, seq) of a split; a record's header comes with its first row."""
    in_header, fresh = _starts_in_header(part.path, part.begin)
    mine = not in_header  # a header that began before is read and passed over
    record, header, name, start, seq = 0, b"", None, 0, bytearray()

    def out(own: int, size: int) -> tuple:
        nonlocal name, start
        row = (part.number, record, name, start, own, seq[:size].decode("ascii", "replace"))
        name, start = None, start + own
        del seq[:own]
        return row

    def feed(block: bytes) -> Iterator[tuple]:
        nonlocal in_header, fresh, mine, record, header, name, start
        while block:
            if in_header:
                end = block.find(b"\n")
                header += block if end < 0 else block[:end]
                if len(header) > HEADER:
                    raise ValueError(f"{part.path}: a header of more than {HEADER} bytes")
                if end < 0:
                    return
                in_header, fresh, block = False, True, block[end + 1 :]
                if mine:
                    name = header.decode("utf-8", "replace").strip()
                mine, header = True, b""
            elif fresh and block[:1] == b">":
                if seq or name is not None:
                    yield out(len(seq), len(seq))
                in_header, record, start, name, block = True, record + 1, 0, None, block[1:]
            else:
                end = block.find(b"\n>")
                text, block = (block, b"") if end < 0 else (block[: end + 1], block[end + 1 :])
                fresh = text.endswith(b"\n")
                seq.extend(text.translate(None, _SPACE))
                while len(seq) >= piece + overlap:
                    yield out(piece, piece + overlap)

    for block in text_of(part.path, part.begin, part.end):
        yield from feed(block)
    behind = (x for rest in ((part.path, part.end), *((p, 0) for p in part.after)) if not (rest[0] == part.path and part.path.endswith(".gz")) for x in text_of(*rest))
    if in_header:  # its first byte is here, so it is this split's
        for block in behind:
            end = block.find(b"\n")
            header += block if end < 0 else block[:end]
            if end >= 0:
                break
        if mine:
            yield part.number, record, header.decode("utf-8", "replace").strip(), 0, 0, ""
        return
    own, want = len(seq), len(seq) + overlap
    for block in behind if overlap and (seq or name is not None) else ():
        end = 0 if fresh and block[:1] == b">" else block.find(b"\n>") + 1 or len(block)
        seq.extend(block[:end].translate(None, _SPACE))
        if end < len(block) or len(seq) >= want:
            break
        fresh = block.endswith(b"\n")
    if own or name is not None:
        yield out(own, min(want, len(seq)))


def fastq_rows(part: Part) -> Iterator[tuple]:
    """(split, record from 1, header, seq, qual) of the records that begin in a split."""
    lines, held, at = [], b"", part.begin

    def complete() -> Iterator[tuple[int, bytes]]:
        """(byte, line) from the split's beginning to the end of the file."""
        nonlocal held, at
        for block in text_of(part.path, part.begin):
            held += block
            *whole, held = held.split(b"\n")
            for x in whole:
                yield at, x
                at += len(x) + 1
        if held:
            yield at, held

    source = complete()
    if part.begin:
        fs, place = _place(part.path)
        with fs.open_input_file(place) as f:
            f.seek(part.begin - 1)
            if f.read(1) != b"\n":
                next(source, None)  # the rest of a line that began before
        # a record begins where a line starts with @, the next but one with +, and sequence and qualities are of one length
        while True:
            while len(lines) < 4:
                x = next(source, None)
                if x is None:
                    return
                lines.append(x)
            if lines[0][1][:1] == b"@" and lines[2][1][:1] == b"+" and len(lines[1][1].rstrip()) == len(lines[3][1].rstrip()):
                break
            lines.pop(0)
    record = 0
    while True:
        while len(lines) < 4:
            x = next(source, None)
            if x is None:
                if any(t.strip() for _, t in lines):
                    raise ValueError(f"{part.path}: a record of fewer than four lines")
                return
            lines.append(x)
        if not part.path.endswith(".gz") and lines[0][0] >= part.end:
            return
        texts = [t.rstrip(b"\r").decode("utf-8", "replace") for _, t in lines]
        if not texts[0].startswith("@") or not texts[2].startswith("+"):
            raise ValueError(f"{part.path}: no record begins with {texts[0][:80]!r}")
        record += 1
        yield part.number, record, texts[0][1:].strip(), texts[1], texts[3]
        lines = []


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in schema.split(", "))]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= 4 << 20 or len(held) >= 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.format = options.get("format", "fasta")
        self.overlap, self.split = int(options.get("overlap", 0)), int(options.get("split", SPLIT))
        self.piece = int(options.get("piece", PIECE))
        self.joined = options.get("joined", "false").lower() == "true"

    def schema(self) -> str:
        return _PIECES if self.format == "fasta" else _READS

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = fasta_rows(part, self.overlap, self.piece) if self.format == "fasta" else fastq_rows(part)
        return _batches(rows, self.schema())

    def parts(self, files: list[tuple[str, int, float]]) -> list[Part]:
        out = []
        for n, (path, size, _) in enumerate(files):
            behind = tuple(x[0] for x in files[n + 1 :]) if self.joined else ()
            cuts = [0, size] if path.endswith(".gz") else [*range(0, size, self.split), size]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    out.append(Part(len(out), path, a, b, behind[:64]))
        return out


class SequenceFiles(DataSource):
    """Options: path, format (fasta or fastq), overlap, split and piece (bytes and bases), and joined, for files that are parts of one text."""

    @classmethod
    def name(cls) -> str:
        return "strandix_sequences"

    def schema(self) -> str:
        return _Options(self.options).schema()

    def reader(self, schema) -> DataSourceReader:
        return SplitReader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return NewFiles(_Options(self.options))


class SplitReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Part]:
        return self.options.parts(files_of(self.options.path)) or [Part(0, "", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition) if partition.path else iter(())


class NewFiles(DataSourceStreamReader):
    """Each micro-batch has the files that came after the last one, in order of time and name; an offset is the last file's. Splits are whole files, numbered by their time."""

    def __init__(self, options: _Options):
        self.options = options

    def _files(self) -> list[tuple[int, str, int]]:
        return sorted((int(t), p, n) for p, n, t in files_of(self.options.path))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [Part(t, p, 0, n) for t, p, n in self._files() if low < (t, p) <= high]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition)


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(SequenceFiles)
    return spark.read.format("strandix_sequences").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def read_pieces(spark: SparkSession, path: str, k: int, split: int = SPLIT, piece: int = PIECE, joined: bool = False) -> DataFrame:
    """(sequence_id, header, start, seq): FASTA records of any length in pieces with the first k - 1 bases of the next; ``header`` comes with a record's first piece.

    With ``joined``, a folder's files are parts of one text, and records go on from one to the next.
    """
    folder = f"{shared_dir(spark)}/strandix/pieces-{uuid.uuid4().hex}"
    raw = stored(_load(spark, path, format="fasta", overlap=k - 1, split=split, piece=piece, joined=joined), f"{folder}/raw")
    # records that begin in a split, its bases, and those of its last record
    last = F.max_by("own", "record")
    each = raw.groupBy("split", "record").agg(F.sum("own").alias("own"))
    splits = stored(each.groupBy("split").agg(F.max("record").alias("records"), F.sum("own").alias("bases"), last.alias("tail")), f"{folder}/splits")
    splits = stored(running(splits, "split", {"records": "records_before", "bases": "bases_before"}), f"{folder}/before")
    # how many bases lay before the last record that began earlier: a record 0 has gone on since
    splits = splits.withColumn("__begun", F.when(F.col("records") > 0, F.col("bases_before") + F.col("bases") - F.col("tail")))
    splits = running(splits, "split", highest={"__begun": "begun"}).select("split", "records_before", "bases_before", "begun")
    at = raw.join(splits, "split")
    onward = F.col("record") == 0
    lost = onward & F.col("begun").isNull() & (F.col("own") > 0)
    start = F.when(lost, F.raise_error(F.lit("bases before the first header"))).when(onward, F.col("bases_before") - F.col("begun") + F.col("start")).otherwise(F.col("start"))
    return at.select((F.col("records_before") + F.col("record") - 1).alias("sequence_id"), "header", start.alias("start"), "seq")


def read_fastq_splits(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(sequence_id, header, seq, qual) of FASTQ, whose splits are read in parallel; ids follow files and records."""
    folder = f"{shared_dir(spark)}/strandix/reads-{uuid.uuid4().hex}"
    raw = stored(_load(spark, path, format="fastq", split=split), f"{folder}/raw")
    counts = running(raw.groupBy("split").agg(F.max("record").alias("n")), "split", {"n": "before"}).select("split", "before")
    return raw.join(counts, "split").select((F.col("before") + F.col("record") - 1).alias("sequence_id"), "header", "seq", "qual")


def stream_sequences(spark: SparkSession, path: str, kind: str = "fastq") -> DataFrame:
    """A stream of (file_time, record, header, seq) of the files that come into a folder."""
    spark.dataSource.register(SequenceFiles)
    rows = spark.readStream.format("strandix_sequences").option("format", kind).load(path)
    return rows.select(F.col("split").alias("file_time"), "record", "header", "seq")
