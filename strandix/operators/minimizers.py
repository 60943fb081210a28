"""Minimizers, super-k-mers and bucket statistics of a dictionary's strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPLEMENT, Config
from .dictionary import Dictionary
from .kmerize import CODES, STEP, _windows

# The mixer's multiplier, and the classes' bounds.
MULTIPLIER = 0x517CC1B727220A95
MIDLOAD, HEAVYLOAD = 2, 65
SUPER = ("string_id", "first_kmer_id", "minimizer", "pos_in_seq", "pos_in_kmer", "num_kmers")
SIZE_CLASSES = (4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096)


def magic_of(seed: int) -> int:
    """A 64-bit constant for a seed, as a signed number."""
    x = (seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    return x - 2**64 if x >= 2**63 else x


def sliding_minimum(values: np.ndarray, span: int, rightmost: bool = False) -> np.ndarray:
    """Where in each window of ``span`` values its smallest is, the leftmost or the rightmost one of equal ones.

    A window lies in two neighbouring blocks of ``span``: its smallest is that of the first block's end or that of the second one's beginning.
    Minima of all ends and beginnings take one step a place of a block, for all blocks at a time.
    """
    n, blocks = len(values) - span + 1, -(-len(values) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(blocks, span)
    places = np.arange(blocks * span).reshape(blocks, span)
    low, at = table.copy(), places.copy()  # of a block up to a place
    for j in range(1, span):
        older = low[:, j - 1] < low[:, j] if rightmost else low[:, j - 1] <= low[:, j]
        low[:, j] = np.where(older, low[:, j - 1], low[:, j])
        at[:, j] = np.where(older, at[:, j - 1], at[:, j])
    low_end, at_end = table.copy(), places.copy()  # of a block from a place on
    for j in range(span - 2, -1, -1):
        later = low_end[:, j + 1] <= low_end[:, j] if rightmost else low_end[:, j + 1] < low_end[:, j]
        low_end[:, j] = np.where(later, low_end[:, j + 1], low_end[:, j])
        at_end[:, j] = np.where(later, at_end[:, j + 1], at_end[:, j])
    first, second = low_end.reshape(-1)[:n], low.reshape(-1)[span - 1 : span - 1 + n]
    from_second = second <= first if rightmost else second < first
    return np.where(from_second, at.reshape(-1)[span - 1 : span - 1 + n], at_end.reshape(-1)[:n]) - np.arange(n)


def window_minimizers(codes: np.ndarray, k: int, m: int, magic: int, canonical: bool, flip: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For every window of k codes its minimizer and where in the window that begins: the leftmost of smallest hash.

    In canonical mode the opposite strand's minimizer is taken where its packed value is smaller.
    """
    forward, reverse = _windows(codes, m, flip)
    n, span = len(codes) - k + 1, k - m + 1
    mixed = lambda x: x * np.uint64(MULTIPLIER) ^ np.uint64(magic % 2**64)

    def best(values: np.ndarray, rightmost: bool) -> np.ndarray:
        return sliding_minimum(mixed(values), span, rightmost)

    at = best(forward, False)
    chosen = forward[np.arange(n) + at]
    if canonical:
        other = best(reverse, True)  # the leftmost on the opposite strand
        theirs = reverse[np.arange(n) + other]
        chosen, at = np.where(theirs < chosen, theirs, chosen), np.where(theirs < chosen, other, at)
    return chosen.astype(np.int64), at


def kmer_minimizers(dictionary: Dictionary) -> DataFrame:
    """(string_id, kmer_id, minimizer, pos_in_seq, pos_in_kmer) of each k-mer; pos_in_seq counts over all strings."""
    names = ("string_id", "kmer_id", "minimizer", "pos_in_seq", "pos_in_kmer")
    return _of_strings(dictionary, lambda batches: batches, names)


def _of_strings(dictionary: Dictionary, finish: Callable, columns: tuple) -> DataFrame:
    """What ``finish`` makes of the minimizers of all k-mers of a task's strings, which come in order."""
    c = dictionary.config
    magic = magic_of(c.seed)
    names = ["string_id", "kmer_id", "minimizer", "pos_in_seq", "pos_in_kmer"]

    def emit(strings: list, firsts: list, begins: list, seqs: list) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in seqs])
        ends = np.cumsum(sizes)
        value, at = window_minimizers(CODES[c.encoding][np.frombuffer(b"".join(seqs), np.uint8)], c.k, c.m, magic, c.canonical, COMPLEMENT[c.encoding])
        row = np.repeat(np.arange(len(seqs)), sizes)[: len(value)]
        place = np.arange(len(value)) - (ends - sizes)[row]
        inside = place + c.k <= sizes[row]  # others cross from one string to the next
        row, place, value, at = row[inside], place[inside], value[inside], at[inside]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(strings)[row], np.array(firsts)[row] + place, value, np.array(begins)[row] + place + at, at)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for s, first, begin, seq in zip(*(batch.column(i) for i in range(4)), strict=True):
                s, first, begin, seq = s.as_py(), first.as_py(), begin.as_py(), seq.as_py()
                for cut in range(0, len(seq) - c.k + 1, STEP):
                    part = seq[cut : cut + STEP + c.k - 1]
                    if held and size + len(part) > STEP:
                        yield emit(*map(list, zip(*held, strict=True)))
                        held, size = [], 0
                    held.append((s, first + cut, begin + cut, part))
                    size += len(part)
            if held:
                yield emit(*map(list, zip(*held, strict=True)))

    rows = dictionary.strings.select("string_id", "first_kmer_id", "string_begin", F.col("seq").cast("binary"))
    return rows.mapInArrow(lambda batches: finish(run(batches)), ", ".join(f"{x} long" for x in columns))


def minimizer_sweep(dictionary: Dictionary, lengths: list[int]) -> DataFrame:
    """For each minimizer length, in one scan of the strings: minimizers, their distinct places, super-k-mers, the largest bucket and k-mers a super-k-mer.

    Only super-k-mers leave the kernel. A long string is cut with a window more than it needs, which tells whether a cut goes through one.
    """
    c = dictionary.config
    for m in lengths:
        Config(k=c.k, m=m)  # checks it
    magic = magic_of(c.seed)
    names = ["m", "minimizer", "pos", "num_kmers", "fresh"]

    def supers(m: int, begins: list, again: list, seqs: list) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in seqs])
        ends = np.cumsum(sizes)
        value, at = window_minimizers(CODES[c.encoding][np.frombuffer(b"".join(seqs), np.uint8)], c.k, m, magic, c.canonical, COMPLEMENT[c.encoding])
        row = np.repeat(np.arange(len(seqs)), sizes)[: len(value)]
        place = np.arange(len(value)) - (ends - sizes)[row]
        inside = place + c.k <= sizes[row]
        row, place, value, at = row[inside], place[inside], value[inside], at[inside]
        pos = np.array(begins)[row] + place + at
        turn = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(value) != 0) | (np.diff(pos) != 0)])
        first = np.flatnonzero(turn)
        count = np.diff(np.append(first, len(row)))
        seen = np.array(again)[row[first]] & (place[first] == 0)  # its first window was the last one of the cut before
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), m)), pa.array(value[first]), pa.array(pos[first]), pa.array(count - seen), pa.array((~seen).astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for begin, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for cut in range(0, len(seq) - c.k + 1, STEP):
                    back = 1 if cut else 0
                    part = seq[cut - back : cut + STEP + c.k - 1]
                    if held and size + len(part) > STEP:
                        for m in lengths:
                            yield supers(m, *map(list, zip(*held, strict=True)))
                        held, size = [], 0
                    held.append((begin + cut - back, bool(back), part))
                    size += len(part)
            if held:
                for m in lengths:
                    yield supers(m, *map(list, zip(*held, strict=True)))

    rows = dictionary.strings.select("string_begin", F.col("seq").cast("binary")).mapInArrow(run, ", ".join(f"{x} long" for x in names))
    places = rows.groupBy("m", "minimizer", "pos").agg(F.sum("num_kmers").alias("n"), F.sum("fresh").alias("s"))
    sizes = places.groupBy("m", "minimizer").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = sizes.groupBy("m").agg(F.count("*").alias("num_minimizers"), F.sum("size").alias("num_positions"), F.sum("s").alias("num_super_kmers"), F.max("size").alias("max_bucket"), F.sum("n").alias("num_kmers"))
    return totals.withColumn("kmers_per_super_kmer", F.round(F.col("num_kmers") / F.col("num_super_kmers"), 6))


def super_kmers(dictionary: Dictionary) -> DataFrame:
    """Maximal runs of k-mers of one string that share a minimizer and its place: first k-mer, place in it, length.

    A string is one row, so its runs are found where its k-mers are made; one that goes on in the next batch is held back.
    """
    return _of_strings(dictionary, _runs, SUPER)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: list = []
    for batch in batches:
        columns = [x.to_numpy() for x in batch.columns]
        if not batch.num_rows:
            continue
        turn = np.flatnonzero(np.concatenate([[True], np.any([np.diff(columns[i]) != 0 for i in (0, 2, 3)], axis=0)]))
        out = [x[turn] for x in columns] + [np.diff(np.append(turn, batch.num_rows))]
        if last and all(last[i][0] == out[i][0] for i in (0, 2, 3)):
            out[1][0], out[4][0] = last[1][0], last[4][0]
            out[5][0] += last[5][0]
        elif last:
            out = [np.concatenate(x) for x in zip(last, out, strict=True)]
        last = [x[-1:] for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in out], names=list(SUPER))
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=list(SUPER))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a minimizer of a batch: its distinct places, their k-mers and super-k-mers, and the longest of those.

    A place lies in one string. Another run may come back to it as long as windows hold it, so places that the next window may hold are held back.
    """
    names = ["minimizer", "size", "n", "s", "x"]

    def summed(string, value, pos, n) -> pa.RecordBatch:
        order = np.lexsort((pos, value))
        value, pos, n = value[order], pos[order], n[order]
        turn = np.flatnonzero(np.concatenate([[True], np.diff(value) != 0]))
        fresh = np.concatenate([[1], (np.diff(value) != 0) | (np.diff(pos) != 0)])
        runs = np.diff(np.append(turn, len(value)))
        columns = [value[turn], np.add.reduceat(fresh, turn), np.add.reduceat(n, turn), runs, np.maximum.reduceat(n, turn)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    held: list = []
    for batch in _runs(batches):
        if not batch.num_rows:
            continue
        string, _, value, pos, at, n = (x.to_numpy() for x in batch.columns)
        begin = pos[-1] - at[-1] + n[-1] - 1  # of the last window
        rows = [string, value, pos, n]
        rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        late = (rows[0] == string[-1]) & (rows[2] >= begin)
        held = [x[late] for x in rows]
        if not late.all():
            yield summed(*(x[~late] for x in rows))
    if held and len(held[0]):
        yield summed(*held)


def _buckets(dictionary: Dictionary) -> DataFrame:
    # a minimizer's rows are one a batch, so summing them where they come from would only take memory
    rows = _of_strings(dictionary, _sized, ("minimizer", "size", "n", "s", "x")).repartition("minimizer")
    return rows.groupBy("minimizer").agg(F.sum("size").alias("size"), F.sum("n").alias("num_kmers"), F.sum("s").alias("num_super_kmers"), F.max("x").alias("longest"))


def buckets(dictionary: Dictionary) -> DataFrame:
    """minimizer, size (distinct places), k-mers, class, and the skew partition of a heavy bucket."""
    rows = _buckets(dictionary).drop("longest")
    kind = F.when(F.col("size") < MIDLOAD, "SINGLETON").when(F.col("size") < HEAVYLOAD, "MIDLOAD").otherwise("HEAVYLOAD")
    part = F.when(F.col("size") >= HEAVYLOAD, F.ceil(F.log2("size")) - 7).cast("int")
    return rows.withColumns({"bucket_class": kind, "skew_partition": part})


def bucket_histogram(dictionary: Dictionary) -> DataFrame:
    """Number of buckets and of their k-mers for each bucket size."""
    return buckets(dictionary).groupBy("size").agg(F.count("*").alias("num_buckets"), F.sum("num_kmers").alias("num_kmers"))


def bucket_classes(dictionary: Dictionary) -> DataFrame:
    return buckets(dictionary).groupBy("bucket_class").agg(F.count("*").alias("num_buckets"), F.sum("size").alias("num_positions"), F.sum("num_kmers").alias("num_kmers"), F.max("size").alias("max_size"))


def cumulative_kmers(dictionary: Dictionary) -> DataFrame:
    """For each size class the k-mers in buckets up to that size, with their share."""
    rows = bucket_histogram(dictionary)
    total = F.sum("num_kmers")
    classes = F.explode(F.array(*(F.lit(c) for c in SIZE_CLASSES)))
    sums = rows.select("size", "num_kmers", classes.alias("up_to")).groupBy("up_to").agg(F.coalesce(F.sum(F.when(F.col("size") <= F.col("up_to"), F.col("num_kmers"))), F.lit(0)).alias("kmers"), total.alias("all"))
    return sums.select(F.col("up_to").cast("long").alias("up_to"), "kmers", F.round(100.0 * F.col("kmers") / F.col("all"), 6).alias("percent"))


def super_kmer_histogram(dictionary: Dictionary) -> DataFrame:
    return super_kmers(dictionary).groupBy("num_kmers").agg(F.count("*").alias("num_super_kmers"))


def minimizer_counts(dictionary: Dictionary) -> DataFrame:
    """One row: minimizers, their distinct places, super-k-mers, the largest bucket and the most k-mers of a super-k-mer."""
    return _buckets(dictionary).agg(F.count("*").alias("num_minimizers"), F.sum("size").alias("num_positions"), F.sum("num_super_kmers").alias("num_super_kmers"), F.max("size").alias("max_bucket"), F.max("longest").alias("max_super_kmer"))


def skew_partitions(dictionary: Dictionary) -> DataFrame:
    """For each partition of heavy buckets the sizes it takes, its buckets and their k-mers."""
    heavy = buckets(dictionary).where("skew_partition is not null")
    low = F.pow(F.lit(2.0), F.col("skew_partition") + 6).cast("long")
    return heavy.groupBy("skew_partition").agg(F.count("*").alias("num_buckets"), F.sum("size").alias("num_positions"), F.sum("num_kmers").alias("num_kmers")).select("skew_partition", low.alias("larger_than"), (low * 2).alias("up_to"), "num_buckets", "num_positions", "num_kmers")


def bucket_positions(dictionary: Dictionary, minimizers: DataFrame) -> DataFrame:
    """(minimizer, pos_in_seq): the distinct places of the given minimizers, a row each."""
    return super_kmers(dictionary).join(minimizers.select("minimizer").distinct(), "minimizer", "left_semi").select("minimizer", "pos_in_seq").distinct()
