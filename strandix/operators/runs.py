"""Runs of equal weight along the ids, in one pass over the k-mers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, stored
from .running import running

BLOCK_BITS = 17
_PIECE = ("block", "index", "last", "start", "string_id", "begin", "size", "weight")
_SCHEMA = "block long, index long, last boolean, start long, string_id long, begin long, size long, weight long"


def _pieces(rows: DataFrame, by_string: bool) -> DataFrame:
    """The runs of each block of 2^17 ids: number in the block, whether the last, number of the last one that begins a string (else -1), string, first id, size, weight."""
    bits = BLOCK_BITS

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        ids, weight = table.column(0).to_numpy(), table.column(1).to_numpy()
        turn = np.diff(weight) != 0
        if by_string:
            string = table.column(2).to_numpy()
            turn |= np.diff(string) != 0
        at = np.concatenate([[0], np.flatnonzero(turn) + 1])
        index, last = np.arange(len(at)), np.zeros(len(at), bool)
        last[-1] = True
        none = np.zeros(len(at), np.int64)
        start = np.maximum.accumulate(np.where(table.column(3).to_numpy()[at] == 0, index, -1)) if by_string else none - 1
        columns = [ids[at] >> bits, index, last, start, string[at] if by_string else none, ids[at], np.diff(np.append(at, len(ids))), weight[at]]
        yield from pa.Table.from_arrays([pa.array(c) for c in columns], names=list(_PIECE)).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy() >> bits
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and blocks[a] != now:
                    yield from whole(held)
                    held = []
                now = blocks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from whole(held)

    if "weights" in rows.columns:
        return _spread(rows, bits).mapInArrow(lambda batches: run(_opened(batches)), _SCHEMA)
    narrow = rows.select("kmer_id", "weight", *(["string_id", "kmer_id_in_string"] if by_string else []))
    narrow = narrow.repartition(F.shiftright("kmer_id", bits)).sortWithinPartitions("kmer_id")
    return narrow.mapInArrow(run, _SCHEMA)


def _spread(spans: DataFrame, bits: int) -> DataFrame:
    """Spans cut at the borders of blocks of ids, in blocks and in order."""
    end = F.col("kmer_id") + F.size("weights")
    cut = spans.select("*", end.alias("__end"), F.explode(F.sequence(F.shiftright("kmer_id", bits), F.shiftright(end - 1, bits))).alias("block"))
    begin, stop = F.greatest(F.col("kmer_id"), F.shiftleft("block", bits)), F.least(F.col("__end"), F.shiftleft(F.col("block") + 1, bits))
    cut = cut.select("block", begin.alias("begin"), F.slice("weights", (begin - F.col("kmer_id") + 1).cast("int"), (stop - begin).cast("int")).alias("weights"), "string_id", "first_kmer_id")
    return cut.repartition("block").sortWithinPartitions("begin").select("begin", "weights", "string_id", "first_kmer_id")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a k-mer: id, weight, string and place in it."""
    for batch in batches:
        weights = batch.column(1)
        n = np.diff(weights.offsets.to_numpy())
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids = np.repeat(batch.column(0).to_numpy(), n) + within
        columns = [ids, weights.flatten().to_numpy(), np.repeat(batch.column(2).to_numpy(), n), ids - np.repeat(batch.column(3).to_numpy(), n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kmer_id", "weight", "string_id", "kmer_id_in_string"])


def weight_runs(kmers: DataFrame, by_string: bool) -> DataFrame:
    """run_id, string_id, ``run`` in its string from 1, begin and end (exclusive) id, weight; without ``by_string`` runs go on across strings and only run_id counts.

    ``kmers`` are rows (kmer_id, string_id, kmer_id_in_string, weight), or spans (kmer_id, string_id, first_kmer_id, weights) of consecutive ids, of which
    only the weights move. They move once, into blocks of ids; a row a block then stitches what goes on across borders.
    """
    path = f"{shared_dir(kmers.sparkSession)}/strandix/runs-{uuid.uuid4().hex}"
    pieces = stored(_pieces(kmers, by_string), f"{path}/pieces")
    head, tail = F.col("index") == 0, F.col("last")
    of = lambda where, c: F.max(F.when(where, F.col(c)))
    blocks = pieces.groupBy("block").agg(
        F.count("*").alias("n"), F.max("start").alias("start"), of(head, "weight").alias("head_weight"), of(head, "string_id").alias("head_string"), of(head, "begin").alias("head_begin"), of(head, "size").alias("head_size"), of(tail, "weight").alias("tail_weight"), of(tail, "string_id").alias("tail_string")
    )
    blocks = stored(blocks, f"{path}/blocks")
    before = blocks.select((F.col("block") + 1).alias("block"), F.col("tail_weight").alias("__weight"), F.col("tail_string").alias("__string"))
    same = (F.col("__weight") == F.col("head_weight")) & ((F.col("__string") == F.col("head_string")) if by_string else F.lit(True))
    rows = blocks.join(before, "block", "left").withColumn("joins", F.coalesce(same.cast("long"), F.lit(0).cast("long"))).drop("__weight", "__string")
    after = rows.select((F.col("block") - 1).alias("block"), F.col("joins").alias("__joins"))
    rows = rows.join(after, "block", "left").withColumns({"joined": F.coalesce("__joins", F.lit(0).cast("long")), "own": F.col("n") - F.col("joins")}).drop("__joins")
    rows = stored(running(rows, "block", {"own": "base"}), f"{path}/stitched")
    rows = rows.withColumns({
        "__end": F.when(~((F.col("n") == 1) & (F.col("joined") == 1)), F.col("head_begin") + F.col("head_size")),
        "__start": F.when(F.col("start") >= 0, F.col("base") + F.col("start") - F.col("joins")),
    })
    rows = running(rows, "block", highest={"__start": "begun"}, lowest_after={"__end": "ends"}).select("block", "joins", "joined", "base", "begun", "ends")
    at = pieces.join(rows, "block").where((F.col("index") > 0) | (F.col("joins") == 0))
    run_id = F.col("base") + F.col("index") - F.col("joins")
    first = F.when(F.col("start") >= 0, F.col("base") + F.col("start") - F.col("joins")).otherwise(F.col("begun"))
    end = F.when(F.col("last") & (F.col("joined") == 1), F.col("ends")).otherwise(F.col("begin") + F.col("size"))
    out = at.select(run_id.alias("run_id"), "string_id", (run_id - first + 1).alias("run"), F.col("begin").alias("begin_kmer_id"), end.alias("end_kmer_id"), "weight")
    return stored(out, f"{path}/runs")
