"""A Bloom filter of a dictionary's keys, so that windows that no key matches never leave the task that packs them.

Each key sets three bits of one 64-bit word. The filter has at least twelve bits a key, as long as that is within ``MOST_WORDS``, and none is made where there would be
fewer than six: its size is checked, not that of the dictionary. It is stored with the dictionary in rows of 1,024 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 23  # 64 MB
ROW_BITS = 10
# Odd multipliers of a multiplicative hash.
_LOW, _HIGH, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def words_for(keys: int) -> int:
    """A power of two, or 0 for more keys than a filter is of use for."""
    wanted = 1 << max(ROW_BITS, (max(1, 12 * keys // 64) - 1).bit_length())
    words = min(MOST_WORDS, wanted)
    return words if 64 * words >= 6 * keys else 0


def words_asked(keys: int) -> int:
    """For keys that are looked up: eight words a key up to ``MOST_WORDS``, so that few others pass, or 0 for more keys than a filter is of use for."""
    words = min(MOST_WORDS, 1 << max(ROW_BITS, (8 * max(1, keys) - 1).bit_length()))
    return words if 64 * words >= 6 * keys else 0


def spots(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key and its bits; keys are numbers or 16 bytes."""
    if keys.dtype == np.uint64:
        x = keys * _LOW
    else:
        halves = keys.view(">u8").reshape(-1, 2)
        x = halves[:, 1].astype(np.uint64) * _LOW ^ (halves[:, 0].astype(np.uint64) + np.uint64(1)) * _HIGH
    x = (x ^ x >> np.uint64(32)) * _LAST
    x ^= x >> np.uint64(29)
    bit = lambda by: np.uint64(1) << (x >> np.uint64(by) & np.uint64(63))
    return (x >> np.uint64(40) & np.uint64(words - 1)).astype(np.int64), bit(0) | bit(6) | bit(12)


def _numpy_keys(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy().astype(np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


def filter_rows(kmers: DataFrame, words: int) -> DataFrame:
    """(row, words) of the filter; rows without a bit are left out. What a task's keys set goes on as one packed list a row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(spots(_numpy_keys(batch.column(0)), words))
                size += batch.num_rows
            if size >= 1 << 21:
                yield marked(held)
                held, size = [], 0
        if held:
            yield marked(held)

    def marked(held: list[tuple]) -> pa.RecordBatch:
        word, bits = (np.concatenate([x[i] for x in held]) for i in range(2))
        order = np.argsort(word)
        word, bits = word[order], bits[order]
        at = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0]))
        word, bits = word[at], np.bitwise_or.reduceat(bits, at)
        row = word >> ROW_BITS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
        cells = np.empty(len(word), [("at", "<u2"), ("bits", "<u8")])
        cells["at"], cells["bits"] = word & (1 << ROW_BITS) - 1, bits
        ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(row[cuts[:-1]]), pa.array([cells[a:b].tobytes() for a, b in ranges], pa.binary())], names=["row", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(1 << ROW_BITS, np.uint64)
        for batch in batches:
            for row, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is not None and row != now:
                    yield pa.RecordBatch.from_pydict({"row": [now], "words": [held.tobytes()]})
                    held[:] = 0
                now = row
                found = np.frombuffer(cells, [("at", "<u2"), ("bits", "<u8")])
                held[found["at"]] |= found["bits"]
        if now is not None:
            yield pa.RecordBatch.from_pydict({"row": [now], "words": [held.tobytes()]})

    return kmers.select("ckey").mapInArrow(mark, "row long, cells binary").repartition("row").sortWithinPartitions("row").mapInArrow(pack, "row long, words binary")


def assembled(rows: DataFrame, words: int) -> np.ndarray:
    """The filter as one array, of at most ``MOST_WORDS``."""
    out = np.zeros(words, np.uint64)
    for r in rows.toLocalIterator():
        at = r["row"] << ROW_BITS
        out[at : at + (1 << ROW_BITS)] = np.frombuffer(r["words"], np.uint64)
    return out


def may_hold(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are surely not in the dictionary."""
    word, bits = spots(keys, len(array))
    return array[word] & bits == bits
