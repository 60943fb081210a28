"""Read-set queries: every k-mer of every read looked up, with the counters of a search that extends along strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import LAID_OUT, Dictionary
from .kmerize import kmerize
from .meeting import met_in_bins

MANY = 1 << 22  # bases of reads from which no row a window moves
BLOCK_BITS = 17  # of the windows of a read that one task's rows are in order of
COUNTERS = ("num_kmers", "num_positive_kmers", "num_negative_kmers", "num_invalid_kmers", "num_searches", "num_extensions")


def positive_windows(dictionary: Dictionary, reads: DataFrame) -> DataFrame:
    """(read_id, pos, kmer_id, string_id, kmer_orientation, extended) of the windows that are found.

    A window is an extension if the window just before it in its read was found next to it, on the side that it was read from, in
    the same string. Many reads meet a large dictionary in bins of minimizers; else the dictionary's filter of keys drops most windows that are not found before they are shuffled. With a column ``start``,
    reads come in pieces, each with the first k - 1 bases of the next. Hits are split over tasks by read and block of 2^17 windows; a block's last hit is
    sent to the next block too, which needs to know what came before.
    """

    def windows(keep) -> DataFrame:
        return kmerize(reads, "read_id", "seq", dictionary.k, keep, "start" if "start" in reads.columns else None, dictionary.config.encoding).withColumnsRenamed({"id": "read_id", "strand": "read_strand"})

    n = None
    if dictionary.path is not None and dictionary.total >= LAID_OUT and not reads.isStreaming:
        n = int(reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0])
    if n is not None and n > MANY:
        found = met_in_bins(dictionary.strings, reads, dictionary.k, dictionary.config.encoding)
    else:
        few = None if n is None else dictionary.among(windows(None), "ckey", n)
        packed = windows(dictionary.key_filter() if few is None else None)
        found = packed.join((dictionary.by_key if few is None else few).select("ckey", "kmer_id", "string_id", "strand"), "ckey")
    block = F.shiftright("pos", BLOCK_BITS)
    ends = F.col("pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == (1 << BLOCK_BITS) - 1
    blocks = F.explode(F.when(ends, F.array(block, block + 1)).otherwise(F.array(block)))
    found = found.select("read_id", "pos", "kmer_id", "string_id", dictionary._orientation(F.col("read_strand")).alias("kmer_orientation"), blocks.alias("__block"))
    along = Window.partitionBy("read_id", "__block").orderBy("pos")
    before = lambda c: F.lag(c).over(along)
    extended = (before("pos") == F.col("pos") - 1) & (before("string_id") == F.col("string_id")) & (before("kmer_id") + before("kmer_orientation") == F.col("kmer_id"))
    return found.withColumn("extended", F.coalesce(extended, F.lit(False))).where(F.col("__block") == block).drop("__block")


_STOPS = bytes(x if x in b"ACGTacgt" else 78 for x in range(256))


def _sizes(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, num_kmers, valid): windows of each read, and those without another character, which lie in the stretches without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [x or "" for x in batch.column(1).to_pylist()]
            valid = [sum(max(0, len(s) - (k - 1)) for s in x.encode().translate(_STOPS).split(b"N")) if x.isascii() else sum(max(0, len(s) - (k - 1)) for s in re.split("[^ACGTacgt]", x)) for x in seqs]
            columns = [batch.column(0), pa.array([max(0, len(x) - (k - 1)) for x in seqs], pa.int64()), pa.array(valid, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["read_id", "num_kmers", "valid"])

    return reads.select(F.col("read_id").cast("long").alias("read_id"), "seq").mapInArrow(run, "read_id long, num_kmers long, valid long")


def read_report(dictionary: Dictionary, reads: DataFrame) -> DataFrame:
    """The six counters of each read of (read_id, seq). Read ids are distinct; a null or short read has no k-mers.

    With a column ``start``, reads come in pieces, each with the first k - 1 bases of the next.
    """
    k = dictionary.k
    hits = positive_windows(dictionary, reads).groupBy("read_id").agg(F.count("*").alias("p"), F.count_if("extended").alias("e"))
    sizes = _sizes(reads, k)
    if "start" in reads.columns:
        sizes = sizes.groupBy("read_id").agg(F.sum("num_kmers").alias("num_kmers"), F.sum("valid").alias("valid"))
    p, e = F.coalesce("p", F.lit(0)), F.coalesce("e", F.lit(0))
    return sizes.join(hits, "read_id", "left").select("read_id", "num_kmers", p.alias("num_positive_kmers"), (F.col("valid") - p).alias("num_negative_kmers"), (F.col("num_kmers") - F.col("valid")).alias("num_invalid_kmers"), (p - e).alias("num_searches"), e.alias("num_extensions"))


def total_report(dictionary: Dictionary, reads: DataFrame) -> DataFrame:
    """One row: the counters summed over all reads."""
    return read_report(dictionary, reads).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def covered_reads(dictionary: Dictionary, reads: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Reads with whether at least ``threshold`` of their k-mers are found; a read without k-mers is not covered."""
    return read_report(dictionary, reads).select("read_id", "num_kmers", "num_positive_kmers", ((F.col("num_kmers") > 0) & (F.col("num_positive_kmers") >= threshold * F.col("num_kmers"))).alias("covered"))


def with_percentages(report: DataFrame) -> DataFrame:
    """A report with the shares of positive, negative and invalid k-mers, and of extensions among positive ones, in per cent; 0 of nothing."""
    share = lambda a, b: F.round(F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0), 6)
    return report.withColumns({
        "positive_percent": share("num_positive_kmers", "num_kmers"),
        "negative_percent": share("num_negative_kmers", "num_kmers"),
        "invalid_percent": share("num_invalid_kmers", "num_kmers"),
        "extension_percent": share("num_extensions", "num_positive_kmers"),
    })


def report_lines(report: DataFrame) -> list[str]:
    """A one-row report as text."""
    r = with_percentages(report).first()
    return [f"{r.num_kmers} k-mers"] + [f"{getattr(r, f'num_{x}_kmers')} {x} ({getattr(r, f'{x}_percent'):.2f} %)" for x in ("positive", "negative", "invalid")] + [f"{r.num_searches} searches, {r.num_extensions} extensions ({r.extension_percent:.2f} % of positive)"]


def file_report(dictionary: Dictionary, path: str, multiline: bool = False, split: int | None = None) -> DataFrame:
    """The total report of a read file, or of a folder of such; a file of an unknown kind has no reads, so all its counters are 0.

    FASTA and FASTQ are read in splits of bytes, and FASTA records of any length in pieces.
    """
    from ..sources.files import kind_of, read_sequences
    from ..sources.pieces import SPLIT, read_fastq_splits, read_pieces

    spark, kind = dictionary.kmers.sparkSession, kind_of(path)
    if kind is None:
        return total_report(dictionary, spark.createDataFrame([], "read_id long, seq string"))
    if kind == "fasta" and not multiline:
        rows = read_pieces(spark, path, dictionary.k, split or SPLIT).select("sequence_id", "start", "seq")
    elif kind == "fastq":
        rows = read_fastq_splits(spark, path, split or SPLIT)
    else:
        rows = read_sequences(spark, path, multiline)
    return total_report(dictionary, rows.withColumnRenamed("sequence_id", "read_id"))


def require_mode(dictionary: Dictionary, canonical: bool) -> Dictionary:
    """The dictionary, if it is of the mode that a caller is written for."""
    if dictionary.config.canonical != canonical:
        raise ValueError(f"the dictionary is {'canonical' if dictionary.config.canonical else 'regular'}, not {'canonical' if canonical else 'regular'}")
    return dictionary
