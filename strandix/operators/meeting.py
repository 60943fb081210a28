"""Windows of many reads and the k-mers of a dictionary met in bins of minimizers.

Both sides go to bins as stretches of bases, about a byte a window, so that neither a row a k-mer nor a row a window moves. A task holds a bin's k-mers in the order of their keys and looks up
the windows of the reads some at a time; a row a window that is found is what comes out. Where both have many windows, bins are made in turns, as in a build.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPLEMENT
from ..sources.storage import erase, release, shared_dir, stored, stored_in_turns
from .firsts import _opened, _stretches, class_counts, full_hashes, turns_for
from .kmerize import cut, squeezed_pieces, unsqueezed, unsqueezed_pieces

LOOKED_UP = 1 << 20  # windows of a bin that are looked up together
NAMES = ("read_id", "pos", "kmer_id", "string_id", "strand", "read_strand")


def finder(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the place among distinct ``keys`` of each key that it is given, or -1."""
    wide = keys.dtype != np.uint64
    values = full_hashes(keys) if wide else keys
    order = np.argsort(values)
    values, held = values[order], keys[order]
    most = 0  # by how much different keys of one hash may be off
    if wide and len(values):
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        most = int(np.diff(np.append(starts, len(values))).max()) - 1

    def find(asked: np.ndarray) -> np.ndarray:
        if not len(held):
            return np.full(len(asked), -1)
        at = np.searchsorted(values, full_hashes(asked) if wide else asked)
        out = np.full(len(asked), -1)
        for step in range(most + 1):
            now = np.minimum(at + step, len(held) - 1)
            same = held[now] == asked
            out[same] = order[now[same]]
        return out

    return find


def met_in_bins(strings: DataFrame, reads: DataFrame, k: int, encoding: str = "default") -> DataFrame:
    """(read_id, pos, kmer_id, string_id, strand, read_strand) of the windows of (read_id, seq) reads that are k-mers of (string_id, first_kmer_id, seq) strings, none of which stands twice.

    With a column ``start``, reads come in pieces, each with the first k - 1 bases of the next.
    """
    spark, flip = reads.sparkSession, COMPLEMENT[encoding]
    path = f"{shared_dir(spark)}/strandix/met-{uuid.uuid4().hex}"
    start = "start" if "start" in reads.columns else None
    narrow = reads.select(F.col("read_id").cast("long").alias("id"), "seq", *([F.col("start").alias("__from")] if start else []))
    # one file may hold all reads
    dealt = squeezed_pieces(cut(narrow, k, "seq", "__from" if start else None).select("id", F.col("start").alias("place"), "seq")).repartition("id", "place")
    theirs = unsqueezed_pieces(stored(dealt, f"{path}/reads", "uncompressed"))
    ours = cut(strings.select("string_id", "first_kmer_id", "seq"), k).select(F.col("string_id").alias("id"), (F.col("first_kmer_id") + F.col("start")).alias("place"), "seq")
    asked = class_counts(theirs, k, encoding)
    counts = np.where(asked > 0, asked + class_counts(ours, k, encoding), 0)
    turns = turns_for(counts)

    def opened(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = _opened(rows, k, flip)
        return keys, at, np.concatenate([np.repeat(np.cumsum(unsqueezed(r[3], "<i8")), unsqueezed(r[1], "<u4")) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, waiting, find, at, ids = None, [], 0, None, None, None

        def looked_up() -> Iterator[pa.RecordBatch]:
            keys, places, reads_ = opened(rows)
            found = find(keys)
            hit = np.flatnonzero(found >= 0)
            of = found[hit]
            columns = [reads_[hit], places[hit] >> 2, at[of] >> 2, ids[of], ((at[of] & 3) - 1).astype(np.int32), ((places[hit] & 3) - 1).astype(np.int32)]
            yield from pa.Table.from_arrays([pa.array(c) for c in columns], names=list(NAMES)).to_batches(max_chunksize=100_000)

        for batch in batches:
            for to, kind, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (to, kind) != now:
                    if now is not None and rows:
                        if now[1] == 1:
                            yield from looked_up()
                        elif to == now[0]:
                            keys, at, ids = opened(rows)
                            find = finder(keys)
                    if now is None or to != now[0]:
                        find = None
                    now, rows, waiting = (to, kind), [], 0
                if kind == 1 and find is None:  # the dictionary has nothing here
                    continue
                rows.append(tuple(row))
                waiting += 4 * len(row[2])
                if kind == 1 and waiting > LOOKED_UP:
                    yield from looked_up()
                    rows, waiting = [], 0
        if rows and now[1] == 1:
            yield from looked_up()

    def met(turn: int) -> DataFrame:
        sides = [_stretches(x, k, encoding, counts, turn, turns, ids=True).select("bin", F.lit(kind).alias("kind"), "places", "sizes", "bases", "ids") for kind, x in enumerate((ours, theirs))]
        rows = sides[0].unionByName(sides[1]).repartition("bin").sortWithinPartitions("bin", "kind")
        return rows.mapInArrow(run, "read_id long, pos long, kmer_id long, string_id long, strand int, read_strand int")

    found = stored_in_turns(met, turns, f"{path}/found")
    release(spark)
    erase(spark, f"{path}/reads")
    return found
