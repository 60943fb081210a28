"""k-mers over the 26-letter protein alphabet, which have one strand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import is_valid


def protein_kmers(df: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    """(id, pos, kmer) of each window of letters; case is ignored, and windows with other characters are left out."""
    places = F.when(F.length(seq_col) >= k, F.sequence(F.lit(0), F.length(seq_col) - k)).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.explode(places).alias("pos"))
    rows = rows.select("id", F.col("pos").cast("long").alias("pos"), F.substring(F.col("seq"), F.col("pos") + 1, F.lit(k)).alias("kmer"))
    return rows.where(is_valid(F.col("kmer"), "protein")).withColumn("kmer", F.upper("kmer"))
