"""Forward and backward neighbours of all k-mers counted at once, at the k - 1 bases that neighbours share.

How many neighbours a k-mer has is told by its first and its last k - 1 bases: by the bases that follow those, and precede them, in all k-mers of the dictionary on either
strand. Windows of k - 1 bases go to bins of minimizers in stretches, as k-mers do in a build, each stretch with the base before and the base behind it. A bin knows both
degrees of the k-mers inside its stretches; of one between two stretches each bin knows one degree, and only these meet, squeezed, in groups of places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPLEMENT
from ..sources.storage import shared_dir, stored_in_turns
from .firsts import _stretches, class_counts, numbered_keys, turns_for
from .kmerize import cut, one_a_byte, pack_windows, squeezed, unsqueezed

DEGREES = 5  # 0 to 4, each way
GROUP_BITS = 24  # of the places whose k-mers at stretches' ends a task holds
SENT = 1 << 21  # such k-mers that are sent to their groups together
_ONES = np.array([bin(x).count("1") for x in range(16)], np.int64)


def _sides(rows: list[tuple], k: int, flip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bin's rows: place, size, and whether there is a base before and behind, of each stretch, and how many bases precede and follow each window in all k-mers."""
    opposite = np.array([sum(1 << (b ^ flip) for b in range(4) if x >> b & 1) for x in range(16)], np.uint8)
    marked = np.concatenate([np.cumsum(unsqueezed(r[0], "<i8")) for r in rows])
    every = [unsqueezed(r[1], "<u4").astype(np.int64) for r in rows]
    sizes = np.concatenate(every)
    before, behind = marked >> 1 & 1, marked & 1
    long = sizes + (k - 1) + before + behind
    cuts = np.cumsum([0, *(len(x) for x in every)])
    codes = np.concatenate([one_a_byte(r[2], int(long[a:b].sum())) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])
    keys, strands = pack_windows(codes, k, flip)
    stops = np.cumsum(sizes)
    within = np.arange(int(stops[-1])) - np.repeat(stops - sizes, sizes)
    at = np.repeat(np.cumsum(long) - long + before, sizes) + within
    has_left, has_right = np.ones(len(at), bool), np.ones(len(at), bool)
    has_left[stops - sizes], has_right[stops - 1] = before == 1, behind == 1
    bit = np.left_shift(1, codes, dtype=np.uint8)
    left = np.where(has_left, bit[at - 1], 0).astype(np.uint8)
    right = np.where(has_right, bit[np.minimum(at + k, len(codes) - 1)], 0).astype(np.uint8)
    keys, strands = keys[at], strands[at]
    # as seen on the strand of the key; a palindrome is seen on both
    back = strands < 0
    into, out = np.where(back, opposite[right], left), np.where(back, opposite[left], right)
    same = strands == 0
    into, out = np.where(same, into | opposite[right], into), np.where(same, out | opposite[left], out)
    order, number, starts = numbered_keys(keys)
    masks = np.bitwise_or.reduceat((into | out << 4).astype(np.uint8)[order], starts)[number]
    seen = np.empty(len(masks), np.uint8)
    seen[order] = masks
    into, out = seen & 15, seen >> 4
    return marked >> 2, sizes, before == 1, behind == 1, _ONES[np.where(back, out, into)], _ONES[np.where(back, into, out)]


def degree_counts(strings: DataFrame, k: int, encoding: str = "default") -> DataFrame:
    """(forward_degree, backward_degree, num_kmers) of the k-mers of (string_begin, seq) strings, none of which stands twice; k is 2 at least."""
    flip, most = COMPLEMENT[encoding], DEGREES * DEGREES
    pieces = cut(strings.select("string_begin", "seq"), k).select((F.col("string_begin") + F.col("start")).alias("place"), "seq")

    def counted(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of k-mers inside for each pair of degrees; places of k-mers at stretches' ends, and the one degree that is known of each."""
        places, sizes, before, behind, preceding, following = _sides(rows, k - 1, flip)
        inside = np.ones(len(preceding), bool)
        stops = np.cumsum(sizes)
        inside[stops - 1] = False  # a k-mer begins with each window and ends with the next
        at = np.flatnonzero(inside)
        cells = np.bincount(DEGREES * following[at + 1] + preceding[at], minlength=most)
        place = np.concatenate([places[before] - 1, (places + sizes - 1)[behind]])
        return cells, place, np.concatenate([DEGREES * following[(stops - sizes)[before]], preceding[(stops - 1)[behind]]]).astype(np.uint8)

    def sent(cells: np.ndarray, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Ends in a row a group of places; what is counted already has a group of its own."""
        columns: list[list] = [[-1], [b""], [squeezed(cells.astype("<i8"))]]
        place, value = (np.concatenate([h[i] for h in held]) for i in range(2))
        order = np.argsort(place)
        place, value = place[order], value[order]
        group = place >> GROUP_BITS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            columns[0].append(int(group[a]))
            columns[1].append(squeezed(np.diff(place[a:b] & (1 << GROUP_BITS) - 1, prepend=0).astype("<u4")))
            columns[2].append(squeezed(value[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["group", "places", "degrees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, cells, held, waiting = None, [], np.zeros(most, np.int64), [], 0

        def settle() -> None:
            nonlocal rows, cells, waiting
            some, place, value = counted(rows)
            cells, rows, waiting = cells + some, [], waiting + len(place)
            held.append((place, value))

        for batch in batches:
            for to, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and to != now:
                    settle()
                    if waiting > SENT:
                        yield from sent(cells, held)
                        cells, waiting = np.zeros(most, np.int64), 0
                        held.clear()
                now = to
                rows.append(tuple(row))
        if rows:
            settle()
        if held:
            yield from sent(cells, held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both degrees of the k-mers at stretches' ends, a group of places at a time."""
        cells, now, both, there = np.zeros(most, np.int64), -1, None, None

        def tallied() -> np.ndarray:
            return np.bincount(both[there], minlength=most)

        for batch in batches:
            for group, places, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if group < 0:
                    cells += unsqueezed(values, "<i8")
                    continue
                if group != now:
                    if both is not None:
                        cells += tallied()
                    now, both, there = group, np.zeros(1 << GROUP_BITS, np.uint8), np.zeros(1 << GROUP_BITS, bool)
                at = np.cumsum(unsqueezed(places, "<u4"), dtype=np.int64)
                there[at] = True
                np.add.at(both, at, unsqueezed(values, "u1"))
        if both is not None:
            cells += tallied()
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], names=["cell", "n"])

    def ends(turn: int) -> DataFrame:
        stretches = _stretches(pieces, k - 1, encoding, counts, turn, turns, sides=True)
        return stretches.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, "group long, places binary, degrees binary")

    counts = class_counts(pieces, k - 1, encoding)
    turns = turns_for(counts)
    path = f"{shared_dir(strings.sparkSession)}/strandix/degrees-{uuid.uuid4().hex}"
    rows = stored_in_turns(ends, turns, path, "uncompressed")
    cells = rows.repartition("group").sortWithinPartitions("group").mapInArrow(met, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("num_kmers"))
    return cells.select(F.floor(F.col("cell") / DEGREES).cast("long").alias("forward_degree"), (F.col("cell") % DEGREES).alias("backward_degree"), "num_kmers")
