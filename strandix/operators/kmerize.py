"""Windows of k bases, packed by an Arrow kernel that works on whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALPHABETS, COMPLEMENT

STEP = 1 << 20  # bases that are packed at a time; longer sequences are cut with an overlap of k - 1


def _codes(alphabet: str) -> np.ndarray:
    """The code of each byte; 4 for what is no base."""
    out = np.full(256, 4, np.uint8)
    for i, c in enumerate(alphabet):
        out[ord(c)] = out[ord(c.lower())] = i
    return out


CODES = {name: _codes(alphabet) for name, alphabet in ALPHABETS.items()}


def _windows(codes: np.ndarray, k: int, flip: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Packed forward and reverse-complement value of every window of k <= 32 codes, by doubling."""
    f = codes.astype(np.uint64)
    r = f ^ np.uint64(flip)
    powers = {1: (f, r)}
    size = 1
    while size * 2 <= k:
        shift = np.uint64(2 * size)
        f, r = f[:-size] | f[size:] << shift, r[:-size] << shift | r[size:]
        size *= 2
        powers[size] = (f, r)
    out_f, out_r, done = None, None, 0
    for size in sorted(powers, reverse=True):
        if not (k - done) & size:
            continue
        f, r = powers[size]
        if out_f is None:
            out_f, out_r = f, r
        else:
            n = len(codes) - done - size + 1
            out_f = out_f[:n] | f[done : done + n] << np.uint64(2 * done)
            out_r = out_r[:n] << np.uint64(2 * size) | r[done : done + n]
        done += size
    return out_f, out_r


def pack_windows(codes: np.ndarray, k: int, flip: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Key and strand of every window; keys are numbers for k <= 31, else 16 bytes each, most significant first."""
    if len(codes) < k:
        return np.zeros(0, np.uint64 if k <= 31 else "V16"), np.zeros(0, np.int8)
    if k <= 31:
        f, r = _windows(codes, k, flip)
        return np.minimum(f, r), np.where(f == r, 0, np.where(f < r, 1, -1)).astype(np.int8)
    n = len(codes) - k + 1
    low, r_high = _windows(codes, 32, flip)  # the first 32 bases of a window, and their complement's end
    none = np.zeros(len(codes) + 1, np.uint64)
    high, r_low = _windows(codes, k - 32, flip) if k > 32 else (none, none)
    low, high = low[:n], high[32 : 32 + n]
    # the opposite strand begins with the complement of the last k - 32 bases
    r_low, r_high = r_low[32 : 32 + n], r_high[:n]
    wide = np.uint64(2 * (k - 32))
    rest = np.uint64(128 - 2 * k)
    opposite_low = r_low | (r_high << wide)
    opposite_high = r_high >> rest if k < 64 else r_high
    equal = (low == opposite_low) & (high == opposite_high)
    less = (high < opposite_high) | ((high == opposite_high) & (low < opposite_low))
    key = np.empty((n, 2), ">u8")
    key[:, 0], key[:, 1] = np.where(less, high, opposite_high), np.where(less, low, opposite_low)
    return key.reshape(-1).view("V16"), np.where(equal, 0, np.where(less, 1, -1)).astype(np.int8)


def key_type(k: int) -> str:
    return "long" if k <= 31 else "binary"


def arrow_keys(keys: np.ndarray) -> pa.Array:
    if keys.dtype == np.uint64:
        return pa.array(keys.astype(np.int64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed, with the length in front; nothing for no numbers."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, dtype: str) -> np.ndarray:
    """What ``squeezed`` was given."""
    if not data:
        return np.zeros(0, dtype)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _each_seq(df: DataFrame, change: Callable) -> DataFrame:
    """``df`` with its last column, of bytes, changed value by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([change(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def squeezed_pieces(df: DataFrame) -> DataFrame:
    """``df`` with its last column, of bases as bytes, squeezed, so that a piece moves in about two bits a base; characters other than ACGT stay."""
    return _each_seq(df, lambda x: squeezed(np.frombuffer(x, np.uint8)))


def unsqueezed_pieces(df: DataFrame) -> DataFrame:
    """What ``squeezed_pieces`` was given."""
    return _each_seq(df, lambda x: unsqueezed(x, "u1").tobytes())


def four_a_byte(codes: np.ndarray) -> bytes:
    """Codes of bases, two bits each."""
    part = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (part[:, 0] | part[:, 1] << 2 | part[:, 2] << 4 | part[:, 3] << 6).tobytes()


def one_a_byte(data: bytes, n: int) -> np.ndarray:
    """The first n codes of what ``four_a_byte`` made."""
    x = np.frombuffer(data, np.uint8)
    return np.stack([x & 3, x >> 2 & 3, x >> 4 & 3, x >> 6], 1).reshape(-1)[:n]


def cut(df: DataFrame, k: int, seq_col: str = "seq", start_col: str | None = None) -> DataFrame:
    """``df`` with its sequences, as bytes, in pieces of at most ``STEP`` windows, and ``start``, where in the sequence a piece begins.

    Null sequences and those shorter than k have no piece. With ``start_col`` the rows are pieces already, each with the first k - 1 bases of the next.
    """
    others = [c for c in df.columns if c not in (seq_col, start_col)]
    base = F.lit(0).cast("long") if start_col is None else F.col(start_col).cast("long")
    rows = df.where(F.length(seq_col) >= k).select(*others, base.alias("__base"), F.col(seq_col).cast("binary").alias("__seq"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("__seq") - k, F.lit(STEP))).alias("__at"))
    return rows.select(*others, (F.col("__base") + F.col("__at")).alias("start"), F.substring("__seq", F.col("__at") + 1, F.lit(STEP + k - 1)).alias(seq_col))


def valid_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k bases begin; separators are no bases, so windows never cross sequences."""
    if len(codes) < k:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
    return np.flatnonzero(bad[k:] == bad[:-k])


def joint_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list, bytes]]:
    """Rows less their last column, its lengths, and its bytes with a separator between, about ``STEP`` bases at a time."""
    for batch in batches:
        columns, seqs = batch.columns[:-1], batch.column(batch.num_columns - 1)
        bases, sizes, parts, held = [], [], [], 0
        for i, s in enumerate(seqs):
            s = s.as_py()
            if held and held + len(s) > STEP + k:
                yield bases, sizes, b"\n".join(parts)
                bases, sizes, parts, held = [], [], [], 0
            bases.append([c[i].as_py() for c in columns])
            sizes.append(len(s))
            parts.append(s)
            held += len(s)
        if bases:
            yield bases, sizes, b"\n".join(parts)


def _pack(pieces: DataFrame, k: int, schema: str, finish: Callable, encoding: str) -> DataFrame:
    """Packs the windows of (base, seq) rows; ``finish(bases, places, keys, strands)`` makes a batch of them."""

    code, flip = CODES[encoding], COMPLEMENT[encoding]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bases, sizes, joint in joint_batches(batches, k):
            codes = code[np.frombuffer(joint, np.uint8)]
            at = valid_windows(codes, k)
            if not len(at):
                continue
            keys, strands = pack_windows(np.minimum(codes, 3), k, flip)
            offsets = np.cumsum(np.array(sizes) + 1) - np.array(sizes) - 1
            row = np.searchsorted(offsets, at, side="right") - 1
            yield finish(bases, row, at - offsets[row], keys[at], strands[at])

    return pieces.mapInArrow(run, schema)


def kmerize(df: DataFrame, id_col: str, seq_col: str, k: int, keep: Callable | None = None, start_col: str | None = None, encoding: str = "default") -> DataFrame:
    """(id, pos, ckey, strand) for each window without a character other than ACGT; shorter sequences have none.

    Windows of a piece follow each other in order; null sequences have none. ``keep``, of a batch's keys, tells which windows go on at all.
    """
    names = ["id", "pos", "ckey", "strand"]

    def finish(bases, row, place, keys, strands):
        if keep is not None:
            mask = keep(keys)
            row, place, keys, strands = row[mask], place[mask], keys[mask], strands[mask]
        ids, starts = np.array([b[0] for b in bases], np.int64), np.array([b[1] for b in bases], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(starts[row] + place), arrow_keys(keys), pa.array(strands.astype(np.int32))], names=names)

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(seq_col).alias("seq"), *([F.col(start_col).alias("__from")] if start_col else []))
    pieces = cut(narrow, k, "seq", "__from" if start_col else None).select("id", "start", "seq")
    if not df.isStreaming:
        # one file or row group may hold all sequences; dealing their pieces out moves a twentieth of what their windows will
        pieces = pieces.repartition("id", "start")
    return _pack(pieces, k, f"id long, pos long, ckey {key_type(k)}, strand int", finish, encoding)


def kmerize_places(pieces: DataFrame, k: int, encoding: str = "default") -> DataFrame:
    """(ckey, at) for the windows of (place, seq) pieces: ``at`` holds the window's place and, in two bits, its strand + 1, so its order is that of places."""

    def finish(bases, row, place, keys, strands):
        at = (np.array([b[0] for b in bases], np.int64)[row] + place) << 2 | (strands.astype(np.int64) + 1)
        return pa.RecordBatch.from_arrays([arrow_keys(keys), pa.array(at)], names=["ckey", "at"])

    return _pack(pieces.select("place", "seq"), k, f"ckey {key_type(k)}, at long", finish, encoding)
