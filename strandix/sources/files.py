"""Sequence files as DataFrames: FASTA, weighted FASTA, segment files and FASTQ, each also gzipped.

Plain files are split by Spark; a gzipped file is one task. Record ids follow the order of records in their file and of files by path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running_sums

SUFFIXES = {".fa": "fasta", ".fasta": "fasta", ".fq": "fastq", ".fastq": "fastq", ".cf_seg": "segments"}


def _numbered(df: DataFrame) -> DataFrame:
    """Rows of a text scan with their number in file order, from counts of the scan's splits; no task sorts them all."""
    at = df.withColumns({"__file": F.col("_metadata.file_path"), "__from": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()})
    splits = at.groupBy("__file", "__from").agg(F.count("*").alias("__n"))
    order = Window.orderBy("__file", "__from")
    splits = splits.withColumn("__split", F.row_number().over(order).cast("long"))
    splits = running_sums(splits.select("__file", "__from", "__split", "__n"), "__split", {"__n": "__base"})
    within = Window.partitionBy("__file", "__from").orderBy("__row")
    return at.join(splits.select("__file", "__from", "__base"), ["__file", "__from"]).withColumn("row", F.col("__base") + F.row_number().over(within) - 1).select("row", "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, header, seq): records begin with a line that starts with ``>``, and their other lines are put together; a final newline may lack.

    A header may hold further ``>``; a record without header and sequence counts for nothing.
    """
    text = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    text = text.withColumn("value", F.regexp_replace("value", "^>", ""))  # that of a file's first record
    rows = _numbered(text)
    lines = F.split("value", "\n", 2)
    return rows.select(F.col("row").alias("sequence_id"), F.trim(lines[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def read_weighted_fasta(spark: SparkSession, path: str, k: int) -> DataFrame:
    """FASTA whose headers read ``id LN:i:length ab:Z:weights``; a header that does not fit its sequence is an error."""
    rows = read_fasta(spark, path)
    length = F.regexp_extract("header", r"LN:i:(\d+)", 1)
    weights = F.split(F.trim(F.regexp_extract("header", r"ab:Z:([\d ]+)", 1)), " ").cast("array<bigint>")
    checked = rows.withColumns({"ln": F.when(length == "", F.raise_error(F.concat(F.lit("no length in header: "), "header"))).otherwise(length.cast("bigint")), "weights": weights})
    bad_length = F.col("ln") != F.length("seq")
    bad_count = F.size("weights") != F.length("seq") - (k - 1)
    return checked.withColumn("seq", F.when(bad_length, F.raise_error(F.concat(F.lit("length differs from the sequence: "), "header"))).when(bad_count, F.raise_error(F.concat(F.lit("not a weight a k-mer: "), "header"))).otherwise(F.col("seq")))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, header, seq) of lines ``id TAB sequence``."""
    rows = _numbered(spark.read.text(path).where(F.length("value") > 0))
    parts = F.split("value", "\t", 2)
    return rows.select(F.col("row").alias("sequence_id"), parts[0].alias("header"), F.trim(parts[1]).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, header, seq, qual) of records of exactly four lines."""
    rows = _numbered(spark.read.text(path))
    lines = rows.groupBy(F.floor(F.col("row") / 4).alias("sequence_id"))
    line = lambda i: F.max(F.when(F.col("row") % 4 == i, F.col("value")))
    return lines.agg(line(0).alias("header"), line(1).alias("seq"), line(3).alias("qual")).select("sequence_id", F.expr("substring(header, 2)").alias("header"), "seq", "qual")


def read_blank_separated(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, seq): lines put together until an empty line; lines that begin with ``>`` are headers and left out."""
    rows = _numbered(spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0))
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith(">"))
    return rows.select(F.col("row").alias("sequence_id"), F.array_join(F.transform(lines, F.trim), "").alias("seq"))


def kind_of(path: str) -> str | None:
    """The kind of a sequence file by its suffix, with or without ``.gz``; None for others."""
    name = path.removesuffix(".gz")
    return next((v for s, v in SUFFIXES.items() if name.endswith(s)), None)


def read_sequences(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A query file by its suffix, with or without ``.gz``."""
    kind = kind_of(path)
    if kind is None:
        raise ValueError(f"no reader for {path}: its suffix is none of {sorted(SUFFIXES)}")
    if kind == "fasta" and multiline:
        return read_blank_separated(spark, path)
    return {"fasta": read_fasta, "fastq": read_fastq, "segments": read_segments}[kind](spark, path)


def write_fasta(df: DataFrame, path: str, id_col: str = "sequence_id", seq_col: str = "seq", order_col: str | None = None, k: int | None = None) -> None:
    """Writes records in order of a column, with weights in the headers where ``df`` has them."""
    head = F.concat(F.lit(">"), F.col(id_col).cast("string"))
    if "weights" in df.columns:
        head = F.concat(head, F.lit(" LN:i:"), F.length(seq_col).cast("string"), F.lit(" ab:Z:"), F.array_join(F.col("weights").cast("array<string>"), " "))
    order = order_col or id_col
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    rows.select(F.concat(head, F.lit("\n"), F.col(seq_col)).alias("value")).write.mode("overwrite").text(path)


def mix_reads(left: DataFrame, right: DataFrame, limit: int | None, seed: int, id_col: str = "sequence_id") -> DataFrame:
    """The first ``limit`` reads (all, for None) of two sets of the same columns, interleaved at random, with their ``place`` from 0 and ``from_right``.

    Each next read comes from either set with the same probability until one set ends, and the reads of a set stay in order of ``id_col``,
    whole numbers that are distinct within a set; a read without id is left out. Reads arrive after random waits of one exponential
    distribution, fixed by id and seed, so the merged arrivals are such an interleaving, and places are running sums without a sort of all rows.
    """

    def arrivals(df: DataFrame, side: int) -> DataFrame:
        uniform = (F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed), F.lit(side)), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))
        waits = df.where(F.col(id_col).isNotNull()).withColumn("__wait", (F.lit(float(1 << 20)) * -F.log(uniform)).cast("long") + 1)
        timed = running_sums(waits, id_col, {"__wait": "__before"})
        return timed.withColumns({"from_right": F.lit(bool(side)), "__at": 2 * (F.col("__before") + F.col("__wait")) + side, "__one": F.lit(1).cast("long")})

    both = arrivals(left, 0).unionByName(arrivals(right, 1))
    placed = running_sums(both, "__at", {"__one": "place"}).drop("__wait", "__before", "__at", "__one")
    return placed if limit is None else placed.where(F.col("place") < limit)


def write_metrics(df: DataFrame, path: str) -> None:
    """Statistics as JSON lines."""
    df.write.mode("append").json(path)
