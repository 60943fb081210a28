"""Sizes and a model of the space that a packed form takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .degrees import degree_counts
from .dictionary import Dictionary
from .weights import global_runs, weight_frequencies


def space_model(dictionary: Dictionary) -> DataFrame:
    """One row: bits of bases, offsets and weight runs in a packed form, and what strings add to two bits a k-mer."""
    k = dictionary.k
    base = dictionary.metadata().select("num_kmers", "num_strings", "num_bases")
    runs = global_runs(dictionary).agg(F.count("*").alias("num_weight_runs"))
    kinds = weight_frequencies(dictionary).agg(F.count("*").alias("num_weights"))
    all_ = base.crossJoin(runs).crossJoin(kinds)
    width = lambda c: F.greatest(F.lit(1), F.ceil(F.log2(F.col(c) + 1)))
    bits = {"base_bits": 2 * F.col("num_bases"), "offset_bits": (F.col("num_strings") + 1) * width("num_bases"), "weight_bits": F.col("num_weight_runs") * (width("num_kmers") + width("num_weights"))}
    out = all_.select("*", *(v.cast("long").alias(c) for c, v in bits.items()))
    per = F.round((F.col("base_bits") + F.col("offset_bits") + F.col("weight_bits")) / F.col("num_kmers"), 6)
    return out.select("*", per.alias("bits_per_kmer"), F.round(2 + 2 * F.col("num_strings") * (k - 1) / F.col("num_kmers"), 6).alias("string_bits_per_kmer"))


def suggested_minimizer_length(num_bases: int) -> int:
    """The shortest length that is advised for so many bases."""
    n, length = max(1, num_bases), 0
    while 4**length < n:
        length += 1
    return length + 1


def degree_histogram(dictionary: Dictionary) -> DataFrame:
    """How many k-mers have how many forward and backward neighbours."""
    if dictionary.k > 1:
        return degree_counts(dictionary.strings, dictionary.k, dictionary.config.encoding)
    rows = dictionary.kmers.select(F.col("kmer_id").alias("from_kmer"), dictionary.kmer_strings().alias("kmer"))  # k-mers of one base share none: at most two of them
    found = dictionary.neighbours(rows)
    each = found.groupBy("from_kmer").agg(F.count_if((F.col("direction") == "forward") & F.col("kmer_id").isNotNull()).alias("forward_degree"), F.count_if((F.col("direction") == "backward") & F.col("kmer_id").isNotNull()).alias("backward_degree"))
    return each.groupBy("forward_degree", "backward_degree").agg(F.count("*").alias("num_kmers"))


def offset_widths(dictionary: Dictionary) -> DataFrame:
    """One row: bits of an absolute offset, of a place in a string, of a string number, and of the latter two together; over 64 is an error."""
    s = dictionary.strings.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("bases"), F.coalesce(F.max("len"), F.lit(0)).alias("longest"), F.count("*").alias("strings"))
    width = lambda c: F.greatest(F.lit(1), F.length(F.bin(F.col(c)))).cast("int")
    out = s.select(width("bases").alias("absolute_bits"), width("longest").alias("relative_bits"), width("strings").alias("string_bits"))
    both = F.col("relative_bits") + F.col("string_bits")
    return out.withColumn("encoded_bits", F.when(F.greatest(F.col("absolute_bits"), both) > 64, F.raise_error(F.lit("offsets take more than 64 bits"))).otherwise(both))


def space_breakdown(dictionary: Dictionary) -> DataFrame:
    """A row for each part of the packed form: bits, bits a k-mer, and percent of all."""
    parts = ("base_bits", "offset_bits", "weight_bits")
    model = space_model(dictionary)
    rows = model.select("num_kmers", F.explode(F.array(*(F.struct(F.lit(p.removesuffix("_bits")).alias("part"), F.col(p).alias("bits")) for p in parts))).alias("x"), F.expr(" + ".join(parts)).alias("all"))
    return rows.select("x.part", "x.bits", F.round(F.col("x.bits") / F.col("num_kmers"), 6).alias("bits_per_kmer"), F.round(100.0 * F.col("x.bits") / F.col("all"), 6).alias("percent"))


def minimizer_advice(dictionary: Dictionary) -> DataFrame:
    """One row: the dictionary's m, the shortest that its number of bases advises, and whether m falls short of it."""
    bases = int(dictionary.strings.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0])
    advised, m = suggested_minimizer_length(bases), dictionary.config.m
    return dictionary.kmers.sparkSession.createDataFrame([(bases, m, advised, m < advised)], "num_bases long, m int, advised_m int, short boolean")


def collection_rates(report: DataFrame, by: str) -> DataFrame:
    """For each collection of reads the mean share of k-mers found, and of those the share that extend a match; reads without k-mers count in neither."""
    hit = F.when(F.col("num_kmers") > 0, F.col("num_positive_kmers") / F.col("num_kmers"))
    extended = F.when(F.col("num_positive_kmers") > 0, F.col("num_extensions") / F.col("num_positive_kmers"))
    return report.groupBy(by).agg(F.count("*").alias("num_reads"), F.round(F.avg(hit), 6).alias("hit_rate"), F.round(F.avg(extended), 6).alias("extension_rate"))


def export_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)

