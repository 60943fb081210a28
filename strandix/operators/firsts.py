"""First places and numbers of k-mers, found in bins of stretches that share a minimizer.

Windows of one k-mer, on either strand, have the same smallest hashed m-mer, so they lie in one bin. Neighbouring windows mostly share it too, and go there as one
stretch of two bits a base: about a byte a window is moved, where a row a window takes twenty. How many windows there are of each of 2^16 classes of m-mers is counted
first; classes are laid together into bins of a bounded number of windows, and a class of more windows is split by hashes of the keys themselves. What a task holds of a bin is
made distinct whenever it grows, so that repeats of one key don't add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPLEMENT
from .kmerize import CODES, _windows, four_a_byte, joint_batches, one_a_byte, pack_windows, squeezed, unsqueezed, valid_windows

CLASS_BITS = 16
BIN_WINDOWS = 1 << 20
HELD = 1 << 22  # windows of a bin that are held before they are made distinct
TURN_WINDOWS, MOST_TURNS = 1 << 27, 4  # stretches of about so many windows are on disk at a time; more turns would each read all bases once more
SENT = 1 << 24  # windows whose stretches are sent to their bins together, and first places to their groups: rows get longer, not more, as bins and groups do
MOST_M = 12
_MULTIPLY, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _MULTIPLY
    return (x ^ x >> np.uint64(29)) * _AGAIN


def _classes(codes: np.ndarray, k: int, flip: int) -> np.ndarray:
    """The class of every window: of its smallest hashed m-mer of either strand."""
    m = min(MOST_M, (k + 1) // 2)
    f, r = _windows(codes, m, flip)
    low, span, size = _mixed(np.minimum(f, r)), k - m + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return (_mixed(low) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _hashes(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint64:
        return _mixed(keys) >> np.uint64(32)
    halves = keys.view(">u8").reshape(-1, 2)
    return _mixed(_mixed(halves[:, 0].astype(np.uint64)) ^ halves[:, 1].astype(np.uint64)) >> np.uint64(32)


def _stream(codes: np.ndarray, begin: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The codes of stretches, one after another."""
    ends = np.cumsum(long)
    return codes[np.repeat(begin - (ends - long), long) + np.arange(int(long.sum()))]


def _keys_at(codes: np.ndarray, at: np.ndarray, k: int, flip: int) -> np.ndarray:
    """The keys of the windows at rising places; those of other windows are not made, but between stretches."""
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    sizes = np.diff(np.append(starts, len(at)))
    long = sizes + (k - 1)
    keys, _ = pack_windows(_stream(codes, at[starts], long), k, flip)
    return keys[np.arange(len(at)) + (k - 1) * np.repeat(np.arange(len(starts)), sizes)]


def dealt(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each class and over how many it is split: bins have at most about twice ``most`` windows."""
    splits = np.maximum(1, -(-counts // most))
    light = splits == 1
    before = np.cumsum(np.where(light, counts, 0)) - np.where(light, counts, 0)
    first = before // most
    heavy = np.flatnonzero(~light)
    taken = int(first[light].max()) + 1 if light.any() else 0
    first[heavy] = taken + np.cumsum(splits[heavy]) - splits[heavy]
    return first, splits


def class_counts(pieces: DataFrame, k: int, encoding: str) -> np.ndarray:
    """How many windows each class has: at most 2^16 numbers."""
    code, flip = CODES[encoding], COMPLEMENT[encoding]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CLASS_BITS, np.int64)
        for _, _, joint in joint_batches(batches, k):
            codes = code[np.frombuffer(joint, np.uint8)]
            at = valid_windows(codes, k)
            if len(at):
                total += np.bincount(_classes(np.minimum(codes, 3), k, flip)[at], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["class", "n"])

    out = np.zeros(1 << CLASS_BITS, np.int64)
    for row in pieces.select("place", "seq").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[row["class"]] = row["n"]
    return out


def turns_for(counts: np.ndarray) -> int:
    """In how many turns the bins of so many windows in each class are made."""
    return max(1, min(MOST_TURNS, -(-int(counts.sum()) // TURN_WINDOWS)))


def _stretches(pieces: DataFrame, k: int, encoding: str, counts: np.ndarray, turn: int = 0, turns: int = 1, sides: bool = False, ids: bool = False) -> DataFrame:
    """(bin, places, sizes, bases): the stretches of a batch that go to a bin, with the place of the first window, the number of windows, and all bases at two bits each.

    A turn has every so manieth bin; windows of classes that ``counts`` has none of go nowhere. With ``sides``, a stretch also brings the base before it and the base behind it, where there are such; two low bits of its place tell which.
    With ``ids``, pieces are (id, place, seq), and a fourth column of bytes has the id of each stretch.
    """
    code, flip = CODES[encoding], COMPLEMENT[encoding]
    first, splits = dealt(counts, BIN_WINDOWS)
    split, unused = bool((splits > 1).any()), bool((counts == 0).any())
    names = ["bin", "places", "sizes", "bases", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for rows, lengths, joint in joint_batches(batches, k):
            codes = code[np.frombuffer(joint, np.uint8)]
            at = valid_windows(codes, k)
            if not len(at):
                continue
            known, codes = codes <= 3, np.minimum(codes, 3)
            of = _classes(codes, k, flip)[at]
            if unused:
                now = np.flatnonzero(counts[of] > 0)
                at, of = at[now], of[now]
                if not len(at):
                    continue
            bins = first[of]
            if split:
                many = np.flatnonzero(splits[of] > 1)
                bins[many] += (_hashes(_keys_at(codes, at[many], k, flip)) % splits[of[many]].astype(np.uint64)).astype(np.int64)
            if turns > 1:
                now = np.flatnonzero(bins % turns == turn)
                at, bins = at[now], bins[now]
                if not len(at):
                    continue
            starts = np.concatenate([[0], np.flatnonzero((np.diff(bins) != 0) | (np.diff(at) != 1)) + 1])
            sizes = np.diff(np.append(starts, len(at)))
            begin, to = at[starts], bins[starts]
            offsets = np.cumsum(np.array(lengths) + 1) - np.array(lengths) - 1
            row = np.searchsorted(offsets, begin, side="right") - 1
            places = np.array([r[-1] for r in rows], np.int64)[row] + begin - offsets[row]
            own = np.array([r[0] for r in rows], np.int64)[row] if ids else None
            long = sizes + (k - 1)
            if sides:
                before = (begin > 0) & known[begin - 1]
                behind = (begin + long < len(codes)) & known[np.minimum(begin + long, len(codes) - 1)]
                places = places << 2 | before.astype(np.int64) << 1 | behind
                begin, long = begin - before, long + before + behind
            order = np.lexsort((places, own, to) if ids else (places, to))
            begin, long, to, sizes, places = begin[order], long[order], to[order], sizes[order], places[order]
            ends, stream = np.cumsum(long), _stream(codes, begin, long)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            held.append((to[cuts[:-1]], cuts, np.concatenate([[0], ends])[cuts], places, sizes, stream, own[order] if ids else None))
            waiting += len(at)
            if waiting > SENT:
                yield from sent(held)
                held, waiting = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A row a bin of what is held."""
        to = np.concatenate([h[0] for h in held])
        of = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        nth = np.concatenate([np.arange(len(h[0])) for h in held])
        order = np.argsort(to, kind="stable")
        to, of, nth = to[order], of[order].tolist(), nth[order].tolist()
        turns = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        for chunk in range(0, len(turns) - 1, 10_000):
            columns: list[list] = [[] for _ in names]
            for a, b in zip(turns[chunk : chunk + 10_000], turns[chunk + 1 : chunk + 10_001]):
                parts, owns = [], []
                for h, i in zip(of[a:b], nth[a:b], strict=True):
                    _, cuts, bases, places, sizes, stream, own = held[h]
                    if ids:
                        owns.append(own[cuts[i] : cuts[i + 1]])
                    parts.append((places[cuts[i] : cuts[i + 1]], sizes[cuts[i] : cuts[i + 1]], stream[bases[i] : bases[i + 1]]))
                places, sizes, stream = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns[0].append(int(to[a]))
                columns[1].append(squeezed(np.diff(places, prepend=0)))
                columns[2].append(squeezed(sizes.astype("<u4")))
                columns[3].append(four_a_byte(stream))
                if ids:
                    columns[4].append(squeezed(np.diff(np.concatenate(owns), prepend=0)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    return pieces.select(*(["id"] if ids else []), "place", "seq").mapInArrow(run, ", ".join(f"{x} {'binary' if i else 'long'}" for i, x in enumerate(names)))


def _opened(rows: list[tuple], k: int, flip: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each window of a bin's rows, and its place with the strand in two bits."""
    places = np.concatenate([np.cumsum(unsqueezed(r[0], "<i8")) for r in rows])
    every = [unsqueezed(r[1], "<u4").astype(np.int64) for r in rows]
    streams = [one_a_byte(r[2], int(n.sum()) + (k - 1) * len(n)) for r, n in zip(rows, every, strict=True)]
    sizes, codes = np.concatenate(every), np.concatenate(streams)
    long = sizes + (k - 1)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, strands = pack_windows(codes, k, flip)
    at = np.repeat(np.cumsum(long) - long, sizes) + within
    return keys[at], (np.repeat(places, sizes) + within) << 2 | (strands[at].astype(np.int64) + 1)


def full_hashes(keys: np.ndarray) -> np.ndarray:
    """64 bits of keys of 16 bytes."""
    halves = keys.view(">u8").reshape(-1, 2).astype(np.uint64)
    return _mixed(_mixed(halves[:, 0]) ^ halves[:, 1])


def numbered_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, the number of the key at each place of that order, and where there each key begins."""
    if keys.dtype == np.uint64:
        order = np.argsort(keys)
        sorted_ = keys[order]
        turn = sorted_[1:] != sorted_[:-1]
    else:
        halves = keys.view(">u8").reshape(-1, 2).astype(np.uint64)
        mixed = full_hashes(keys)
        order = np.argsort(mixed)  # one sort of whole numbers, instead of one a half
        sorted_, mixed = halves[order], mixed[order]
        turn = (sorted_[1:] != sorted_[:-1]).any(axis=1)
        if (turn & (mixed[1:] == mixed[:-1])).any():  # different keys of one hash may lie mixed up
            order = np.lexsort((halves[:, 1], halves[:, 0]))
            sorted_ = halves[order]
            turn = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    return order, np.concatenate([[0], np.cumsum(turn)]), np.concatenate([[0], np.flatnonzero(turn) + 1])


def _distinct(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest place of each and how often it stands."""
    keys, at, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order, _, starts = numbered_keys(keys)
    return keys[order[starts]], np.minimum.reduceat(at[order], starts), np.add.reduceat(n[order], starts)


def of_bins(pieces: DataFrame, k: int, encoding: str, schema: str, finish: Callable, counts: np.ndarray | None = None, turn: int = 0, turns: int = 1) -> DataFrame:
    """The batches that ``finish`` makes of a task's bins of (place, seq) pieces, each of which comes as the keys, places with strands, and counts of its distinct k-mers.

    ``counts`` are those of ``class_counts``, if they are known; with ``turns``, only the bins of one are made.
    """
    flip, most = COMPLEMENT[encoding], HELD
    dealt_ = _stretches(pieces, k, encoding, class_counts(pieces, k, encoding) if counts is None else counts, turn, turns)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, rows, waiting, done = None, [], 0, []

        def settle() -> None:
            nonlocal rows, waiting, done
            if rows:
                keys, at = _opened(rows, k, flip)
                done.append((keys, at, np.ones(len(keys), np.int64)))
                rows, waiting = [], 0
            done = [_distinct(done)]

        for batch in batches:
            for to, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is not None and to != now:
                    settle()
                    yield done[0]
                    done = []
                now = to
                rows.append(tuple(row))
                waiting += 4 * len(row[2])
                if waiting > most:
                    settle()
        if rows or done:
            settle()
            yield done[0]

    return dealt_.repartition("bin").sortWithinPartitions("bin").mapInArrow(lambda batches: finish(bins(batches)), schema)


def count_kmers(pieces: DataFrame, k: int, encoding: str = "default") -> DataFrame:
    """One row: how many windows (place, seq) pieces have, and how many k-mers."""

    def finish(bins):
        for keys, _, n in bins:
            yield pa.RecordBatch.from_pydict({"windows": [int(n.sum())], "kmers": [len(keys)]})

    return of_bins(pieces, k, encoding, "windows long, kmers long", finish).agg(F.sum("windows").alias("num_windows"), F.coalesce(F.sum("kmers"), F.lit(0)).alias("num_kmers"))


def first_places(pieces: DataFrame, k: int, encoding: str, bits: int, small: bool = False, counts: np.ndarray | None = None, turn: int = 0, turns: int = 1) -> DataFrame:
    """(group, firsts, repeated, times): where in a group of 2^bits places k-mers first stand, in rising order as differences, and of those that stand more than once, which they are and how often.

    ``small`` squeezes the numbers, which are of 4, 4 and 8 bytes; those of ``repeated`` are differences then too. ``counts`` and turns as in ``of_bins``.
    """
    names = ["group", "firsts", "repeated", "times"]
    out = squeezed if small else np.ndarray.tobytes

    def laid(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        place, n = (np.concatenate([h[i] for h in held]) for i in range(2))
        order = np.argsort(place)
        place, n = place[order], n[order]
        group = place >> bits
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        inside = (place & (1 << bits) - 1).astype(np.int64)
        for chunk in range(0, len(cuts) - 1, 10_000):
            columns: list[list] = [[], [], [], []]
            for a, b in zip(cuts[chunk : chunk + 10_000], cuts[chunk + 1 : chunk + 10_001]):
                more = np.flatnonzero(n[a:b] > 1)
                columns[0].append(int(group[a]))
                columns[1].append(out(np.diff(inside[a:b], prepend=0).astype("<u4")))
                columns[2].append(out((np.diff(more, prepend=0) if small else more).astype("<u4")))
                columns[3].append(out(n[a:b][more]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    def finish(bins):
        held, waiting = [], 0
        for _, at, n in bins:
            held.append((at >> 2, n))
            waiting += len(n)
            if waiting > SENT // 2:
                yield from laid(held)
                held, waiting = [], 0
        if held:
            yield from laid(held)

    return of_bins(pieces, k, encoding, "group long, firsts binary, repeated binary, times binary", finish, counts, turn, turns)
