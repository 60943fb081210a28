"""Index and read inputs made from text tables, and dictionaries kept for the length of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.sequence import reverse_complement
from ..operators.dictionary import Dictionary

STRETCHES = 1 << 27  # of a text; more, in a text of over 134 million characters, are an error
_BUILT: dict[tuple, Dictionary] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASES = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz0123456789", b"ACGT" * 6 + b"AC" + b"N" * 10)
_REST = bytes(x for x in range(256) if x not in b"abcdefghijklmnopqrstuvwxyz0123456789")


def dna_rows(df: DataFrame, key: str) -> DataFrame:
    """(``key``, seq) of a text table: ``dna_of`` each text, made once, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [None if x is None else x.lower().encode().translate(_BASES, _REST) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary()).cast(pa.string())], names=[key, "seq"])

    rows = df.select(key, "text")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, seq string")


def index_sequences(df: DataFrame, key: str, k: int) -> DataFrame:
    """(sequence_id, seq): stretches of letters of at least k, in order of row key and place."""
    parts = dna_rows(df, key).select(F.col(key).alias("id"), F.posexplode(F.split("seq", "N")).alias("i", "seq"))
    place = F.when(F.col("i") < STRETCHES, F.col("i")).otherwise(F.raise_error(F.lit("a text has too many stretches for its sequence ids")))
    return parts.where(F.length("seq") >= k).select((F.col("id") * STRETCHES + place).alias("sequence_id"), "seq")


def reads_of(df: DataFrame, key: str, flip: bool = False) -> DataFrame:
    """(read_id, seq) of a text table; with ``flip``, odd ids are read on the opposite strand."""
    seq = F.col("seq")
    if flip:
        seq = F.when(F.col(key) % 2 == 1, reverse_complement(seq)).otherwise(seq)
    return dna_rows(df, key).select(F.col(key).alias("read_id"), seq.alias("seq"))


def index_of(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", **settings) -> Dictionary:
    """The dictionary of a whole text table; built once a session and kept as tables in the shared folder."""
    config = Config(**settings)
    what = (spark.sparkContext.applicationId, sf_dir, name, config)
    if what not in _BUILT:
        _BUILT[what] = Dictionary.build(index_sequences(table(spark, sf_dir, name), key, config.k), config)
    return _BUILT[what]
