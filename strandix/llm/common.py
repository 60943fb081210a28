"""What the corpus operators share: bounded Arrow scans, shared-folder tables, span digests."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that carries texts, where the session doesn't say.
BATCH_ROWS = 2_000
#: UTF-8 bytes of text that one call of a kernel gets at most, unless a single text is longer.
SLICE_BYTES = 4 << 20


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` characters, or of one longer text."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x is not None else 0
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of texts stay small, unless the session sets their size itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) in (None, "10000"):
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, id_col: str, text_col: str, kernel: Callable[[list, list], Iterable[tuple]], schema: str | T.StructType, *, binary: bool = False, start: Callable[[], None] | None = None) -> DataFrame:
    """Applies ``kernel(ids, texts) -> rows`` to slices of bounded size; other columns never leave the JVM.

    Null texts arrive as None. With ``binary``, texts arrive as UTF-8 bytes.
    """
    small_batches(df.sparkSession)
    text = F.col(text_col).cast("binary") if binary else F.col(text_col).cast("string")
    narrow = df.select(F.col(id_col).alias("id"), text.alias("text"))
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start is not None:
            start()
        arrow = to_arrow_schema(struct)
        for batch in batches:
            column = batch.column(1)
            n, at = batch.num_rows, 0
            while at < n:  # texts become Python objects a few megabytes at a time
                stop, held = at, 0
                while stop < n and (stop == at or held < SLICE_BYTES):
                    held += column[stop].as_buffer().size if column[stop].is_valid else 0
                    stop += 1
                ids, texts = batch.column(0)[at:stop].to_pylist(), column[at:stop].to_pylist()
                rows = list(kernel(ids, texts))
                if rows:
                    columns = [list(x) for x in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                at = stop

    return narrow.mapInArrow(run, struct)


def map_column(df: DataFrame, text_col: str, fn: Callable[[list], list], *, keep: bool = False) -> DataFrame:
    """``df`` with its text column replaced by what ``fn`` makes of slices of it; or, with ``keep``, the rows where that is true."""
    small_batches(df.sparkSession)
    place, schema = df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            made: list = []
            while len(made) < len(column):
                some, held = [], 0
                while len(made) + len(some) < len(column) and held < SLICE_BYTES:
                    some.append(column[len(made) + len(some)].as_py())
                    held += len(some[-1] or "")
                made += fn(some)
            if keep:
                yield batch.filter(pa.array(made, pa.bool_()))
            else:
                yield batch.set_column(place, batch.schema.field(place), pa.array(made, column.type))

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have; names differ in more than letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of this machine in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "strandix-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str, together: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: later reads survive lost executors, and the shuffles behind it can go.

    At most ``together`` rows are held by a writer, and by a reader, at a time: without it a hundred at least are, which is much where rows have megabytes.
    """
    return written_at(df, what, together)[0]


def written_at(df: DataFrame, what: str, together: int | None = None) -> tuple[DataFrame, str]:
    """``written``, and the table's path, for ``erase``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandix/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer if together is None else writer.option("parquet.block.row.count.limit", together)).parquet(path)
    del df, writer
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def erase(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing will read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the cleaner drop shuffle files that no plan refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
