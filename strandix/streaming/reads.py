"""Continuous read input: each micro-batch of reads is looked up in a static dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import Dictionary
from ..operators.kmerize import kmerize
from ..operators.reads import read_report


def stream_hits(dictionary: Dictionary, reads: DataFrame) -> DataFrame:
    """A stream of (read_id, pos, kmer_id, string_id, kmer_orientation): a stream-static join without state."""
    windows = kmerize(reads, "read_id", "seq", dictionary.k, dictionary.key_filter(), encoding=dictionary.config.encoding).withColumnsRenamed({"id": "read_id", "strand": "read_strand"})
    found = windows.join(dictionary.by_key.select("ckey", "kmer_id", "string_id", "strand"), "ckey")
    return found.select("read_id", "pos", "kmer_id", "string_id", dictionary._orientation(F.col("read_strand")).alias("kmer_orientation"))


def stream_reports(dictionary: Dictionary, reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the read report of every micro-batch to a table; state spans a read at most, so none is kept between batches."""

    def each(batch: DataFrame, number: int) -> None:
        read_report(dictionary, batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
