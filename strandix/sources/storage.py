"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where the session names none, one of this machine in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "strandix-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to ``path`` and read back: its lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def stored_in_turns(make: Callable[[int], DataFrame], turns: int, path: str, compression: str = "zstd") -> DataFrame:
    """What ``make`` gives for each turn, written one after another and read back as one: the shuffle files of a turn go before the next one's come."""
    for turn in range(turns):
        part = stored(make(turn), f"{path}/{turn}", compression)
        release(part.sparkSession)
    return part.sparkSession.read.schema(part.schema).parquet(*(f"{path}/{turn}" for turn in range(turns)))


def buckets_for(rows: int) -> int:
    """A power of two: about a million rows a bucket."""
    return min(MOST_BUCKETS, 1 << max(0, (rows - 1) // BUCKET_ROWS).bit_length())


def bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of ``key``, one sorted file each: joins on the key shuffle the other side only."""
    name = f"strandix_{uuid.uuid4().hex}"
    spark = df.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket's one file is in order, so it isn't sorted again
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.mode("overwrite").option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def bucketed_at(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """What ``bucketed`` wrote, in another session too."""
    name = f"strandix_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def erase(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the cleaner drop shuffle files that no plan refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
