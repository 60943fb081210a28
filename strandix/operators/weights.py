"""Weights of k-mers: runs, frequencies, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionary import Dictionary
from .runs import weight_runs


def string_runs(dictionary: Dictionary) -> DataFrame:
    """Runs of equal weight that restart with each string: string_id, run (from 1), begin and end (exclusive) id, weight; made once a dictionary."""
    return dictionary.kept("string runs", lambda: weight_runs(dictionary.weighted_spans(), True)).select("string_id", "run", "begin_kmer_id", "end_kmer_id", "weight")


def global_runs(dictionary: Dictionary) -> DataFrame:
    """Runs over all ids, which go on across strings: run_id (from 0), begin and end (exclusive) id, weight; made once a dictionary."""
    return dictionary.kept("runs", lambda: weight_runs(dictionary.weighted_spans(), False)).select("run_id", "begin_kmer_id", "end_kmer_id", "weight")


def weight_of_ids(df: DataFrame, runs: DataFrame, id_col: str = "kmer_id", block: int = 1 << 16) -> DataFrame:
    """The weight of the run that holds each id: an interval join, both sides cut into blocks of ids."""
    spread = runs.withColumn("__block", F.explode(F.sequence(F.floor(F.col("begin_kmer_id") / block), F.floor((F.col("end_kmer_id") - 1) / block)))).select("__block", "begin_kmer_id", "end_kmer_id", "weight")
    left = df.withColumn("__block", F.floor(F.col(id_col) / block))
    inside = (left["__block"] == spread["__block"]) & (spread["begin_kmer_id"] <= left[id_col]) & (left[id_col] < spread["end_kmer_id"])
    return left.join(spread, inside, "left").select(*(left[c] for c in df.columns), "weight")


def weight_frequencies(dictionary: Dictionary) -> DataFrame:
    return dictionary.weighted_spans().select(F.explode("weights").alias("weight")).groupBy("weight").agg(F.count("*").alias("num_kmers"))


def weight_summary(dictionary: Dictionary) -> DataFrame:
    """One row: distinct weights, their sum, expected weight, empirical entropy, k-mers without the most frequent weight."""
    freq = weight_frequencies(dictionary)
    n = freq.agg(F.sum("num_kmers").alias("n"))
    p = F.col("num_kmers") / F.col("n")
    return freq.crossJoin(F.broadcast(n)).agg(
        F.count("*").alias("distinct_weights"),
        F.coalesce(F.sum(F.col("weight") * F.col("num_kmers")), F.lit(0)).alias("sum_of_weights"),
        F.round(F.sum(F.col("weight") * p), 6).alias("expected_weight"),
        F.round(F.sum(-p * F.log2(p)), 6).alias("entropy"),
        (F.sum("num_kmers") - F.max("num_kmers")).alias("kmers_without_top_weight"),
    )


def endpoints(dictionary: Dictionary) -> DataFrame:
    """First and last weight and number of runs of each string."""
    return string_runs(dictionary).groupBy("string_id").agg(F.min_by("weight", "run").alias("front"), F.max_by("weight", "run").alias("back"), F.count("*").alias("num_runs"))


def walk_lower_bound(ends: DataFrame) -> DataFrame:
    """One row: strings, runs, weights of odd and of lone frequency, and the fewest walks that these allow."""
    sides = ends.select(F.explode(F.array("front", "back")).alias("weight"), (F.col("front") == F.col("back")).alias("loop"))
    each = sides.groupBy("weight").agg((F.count("*") % 2).alias("odd"), F.bool_and("loop").alias("lone"))
    counts = each.agg(F.coalesce(F.sum("odd"), F.lit(0)).alias("odd_weights"), F.count_if("lone").alias("lone_weights"))
    return counts.crossJoin(ends.agg(F.count("*").alias("num_strings"), F.coalesce(F.sum("num_runs"), F.lit(0)).alias("num_runs"))).select("num_strings", "num_runs", "odd_weights", "lone_weights", F.floor((F.col("odd_weights") + 2 * F.col("lone_weights")) / 2).cast("long").alias("walks_at_least"))
