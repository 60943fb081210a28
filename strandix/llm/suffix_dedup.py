"""Removal of repeated byte strings by prefix-free parsing.

Texts are parsed into phrases by rolling-hash triggers: a trigger is the 16-byte string of smallest hash within some string of
``DEPTH`` bytes, and a phrase holds the run of ``DEPTH``-byte strings that name one trigger, with its right context: neighbouring
phrases overlap by ``DEPTH - 1`` bytes, and every such string lies whole in one phrase of its text. Equal strings name equal triggers
at equal places, so corpus order to this depth can be put together trigger by trigger, from two suffix arrays:

1. The parse's. As phrases hold their right context, its order is needed to one phrase only: (trigger, content, document). Each slice
   of texts sorts its own phrases and sends one entry a content, that of its smallest document; the other documents lose
   the phrase whole at once. The bucket of a trigger merges the entries: a phrase whose content stands in a smaller document goes
   whole, and triggers of one document end there.
2. The dictionary's. Contents that remain, once each, of triggers that have several, if some string of theirs can stand in another
   document's: a string holds ``SIDE`` bytes on the left of its trigger, or as many on the right, so two contents that differ on both
   sides share none. Their suffixes are sorted to depth ``DEPTH`` on their bytes.

Both combine to corpus order: a run of equal suffixes takes its documents from the parse's order of their phrases, and its smallest
document decides. What is removed is told as (content, bits of its strings) a document, however often the document repeats the content,
and is turned into places where the text is parsed again.

A trigger that stands in all documents before ever new words has too many contents for one suffix array. Its strings are dealt out one
by one by a 128-bit digest: a trigger with more than ``HOT`` contents for the dictionary, and what a task finds of a trigger beyond
``OFTEN`` entries for each ``OFTEN_BYTES`` of text, which go to buckets of contents while a marker tells the trigger's bucket. So a
trigger's bucket gets at most as many entries and a marker a task, and a content or a string one entry a slice.

Phrase contents are compared by 64 bits of a digest under a key that each run draws anew, beside 32 bits or more of their trigger's hash, strings within the
dictionary by their bytes.

Defined results: a null or empty text has no bytes and no spans; texts shorter than the depth stay whole; rows of one id remove
nothing from each other; a row with a null id stays whole and removes nothing; repeated rows get equal results; other columns are never
read; an empty table gives an empty result. Ids are whole numbers. Matches never cross documents.
"""

from __future__ import annotations

from hashlib import blake2b
from secrets import token_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, erase, release, small_batches, written, written_at

DEPTH, GRAM, HOT, OFTEN = 50, 16, 8_192, 64
SIDE = (DEPTH - GRAM) // 2  # every string of a phrase holds as many bytes on the left of its trigger, or on the right
BUCKET_BYTES = 8 << 20  # bytes of text whose phrases share a bucket
PARSE_BYTES = 2 << 20  # of text that is parsed at a time; a longer text is parsed in segments that overlap by the depth less one
GROUP_PHRASES = 8_000  # of the dictionary that one suffix array holds, beside what its last trigger adds
BUCKET_STRINGS = 200_000  # of dealt strings that share a bucket
OFTEN_BYTES = 32 << 20  # of text that a task reads, for each of which it sends OFTEN entries of a trigger
CELL_BITS = 23  # of a task's counts of entries by trigger
BITMAP_BITS = 26
ALL = np.uint64(2**64 - 1)

_ENTRY = np.dtype([("h", "<u4"), ("c", "<u8"), ("doc", "<u2"), ("p", "<u4"), ("n", "u1"), ("l", "<u2"), ("r", "<u2")])  # a marker has no strings
_STRING = np.dtype([("d", "<u8"), ("e", "<u8"), ("c", "<u8"), ("doc", "<u2"), ("q", "u1")])
_WHOLE = np.dtype([("doc", "<u2"), ("c", "<u8")])
_WANTED = np.dtype([("doc", "<u2"), ("c", "<u8"), ("p", "<u4"), ("n", "u1"), ("h", "<i8"), ("hot", "u1")])
_MASK = np.dtype([("doc", "<u2"), ("c", "<u8"), ("bits", "<u8")])
_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _grams(joint: bytes) -> np.ndarray:
    """Hashes of all 16-byte strings."""
    n = len(joint) - GRAM + 1
    a = np.ndarray((n,), "<u8", buffer=joint, strides=(1,)) * _M[0]
    b = np.ndarray((n,), "<u8", buffer=joint, offset=8, strides=(1,)) * _M[1]
    b ^= b >> np.uint64(29)
    a ^= a >> np.uint64(32)
    a += b * _M[2]
    a ^= a >> np.uint64(32)
    a *= _M[3]
    a ^= a >> np.uint64(29)
    return a


def _sides(grams: np.ndarray, trigger: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``SIDE`` bytes on the left and on the right of each trigger, not 0; 0 where no string of the phrase holds them."""
    out = []
    for places, holds in (
        ((trigger - SIDE, trigger - 1), trigger - start >= SIDE),
        ((trigger + GRAM, trigger + SIDE), trigger - (start + count - 1) <= DEPTH - GRAM - SIDE),
    ):
        a, b = (grams[np.clip(x, 0, len(grams) - 1)] for x in places)
        a = (a * _M[4] ^ (b >> np.uint64(27))) + b * _M[5]
        a ^= a >> np.uint64(32)
        a *= _M[0]
        out.append(np.where(holds, np.maximum(a >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16))
    return out[0], out[1]


def parse(texts: list[bytes], key: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts of at most 16 MB in all: text, place, number of strings, trigger hash, keyed digest of the content."""
    return _parse(texts, key=key)[:5]


def _parse(texts: list[bytes], sides: bool = False, key: bytes = b"") -> tuple[np.ndarray, ...]:
    """The columns of ``parse`` and, with ``sides``, the hashes of both sides of the trigger."""
    sizes = np.array([len(x) for x in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    joint = b"".join(texts)
    if len(joint) < DEPTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), *(none.astype(np.uint16),) * 2
    grams = _grams(joint)
    # the place in the low bits makes the leftmost of equal hashes the smallest
    low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-3], low[3:])  # 35 grams make up a string
    valid = np.ones(len(low), bool)
    for a, n in zip(offsets.tolist(), sizes.tolist(), strict=True):
        valid[max(a, a + n - DEPTH + 1) : a + n] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return _parse([])
    trigger = (low[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], fresh])
    count = np.diff(np.concatenate([first, [len(at)]]))
    start, trigger = at[first], trigger[first]
    end = start + count - 1 + DEPTH
    content = np.frombuffer(b"".join([blake2b(joint[a:b], digest_size=8, key=key).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u8")
    text = np.searchsorted(offsets, start, side="right") - 1
    return text, start - offsets[text], count, grams[trigger], content, *(_sides(grams, trigger, start, count) if sides else ())


def _pieces(text: bytes):
    """(offset, bytes) of a text's segments, always cut at the same places."""
    for at in range(0, max(1, len(text) - DEPTH + 1), PARSE_BYTES):
        yield at, text[at : at + PARSE_BYTES + DEPTH - 1] if len(text) > PARSE_BYTES else text


def _segments(batches):
    """Lists of (id, key, offset, bytes), of bounded size."""
    held, size = [], 0
    for batch in batches:
        ids, keys, texts = (batch.column(i) for i in range(3))
        for row in range(batch.num_rows):
            for at, piece in _pieces(texts[row].as_py()):
                if held and size + len(piece) > PARSE_BYTES:
                    yield held
                    held, size = [], 0
                held.append((ids[row].as_py(), keys[row].as_py(), at, piece))
                size += len(piece)
    if held:
        yield held


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins in sorted arrays, and the end."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(fresh), len(keys[0]))


def slice_order(ids: np.ndarray, docs: np.ndarray, *contents: np.ndarray, once: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases of a slice (document, content), the places of those to be merged with other slices, and of those that go here.

    With ``once``, one place of a document's equal contents stands for all.
    """
    if not len(docs):
        return docs, docs
    order = np.lexsort((docs, *contents))
    if once:
        order = order[_edges(*(c[order] for c in contents), docs[order])[:-1]]
    edges = _edges(*(c[order] for c in contents))
    least = np.minimum.reduceat(ids[docs[order]], edges[:-1])
    goes = ids[docs[order]] > np.repeat(least, np.diff(edges))
    return order[~goes], order[goes]


_COLUMNS = ("bucket", "slice", "ids", "keys", "entries", "told")
_PACKED = "bucket long, slice long, ids binary, keys binary, entries binary, told binary"


def _packed_rows(slice_: int, ids: np.ndarray, keys: np.ndarray, buckets: np.ndarray, entries: np.ndarray, told: np.ndarray, home: int) -> pa.RecordBatch:
    """A row for each bucket: ids of its documents and its entries; and a row at ``home`` with all documents and what is decided already."""
    out: list[list] = [[home], [slice_], [ids.astype("<i8").tobytes()], [keys.astype("<i8").tobytes()], [None], [told.tobytes()]]
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 65536 else buckets, kind="stable")
    entries, buckets = entries[order], buckets[order]
    edges = _edges(buckets).tolist() if len(buckets) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        # ids stand by document, so that entries tell theirs by two bytes
        some, own = np.unique(entries["doc"][a:b], return_inverse=True)
        part = entries[a:b].copy()
        part["doc"] = own
        for column, value in zip(out, (int(buckets[a]), slice_, ids[some].astype("<i8").tobytes(), some.astype("<u2").tobytes(), part.tobytes(), None), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), *(pa.binary(),) * 4), strict=True)], names=_COLUMNS)


def _documents(ids: list[int], keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents (ids, keys) of some rows, and the number of each row's."""
    known: dict[tuple[int, int], int] = {}
    rows = np.array([known.setdefault(x, len(known)) for x in zip(ids, keys, strict=True)], np.int64)
    return np.array([i for i, _ in known], np.int64), np.array([k for _, k in known], np.int64), rows


def packed_phrases(rows: DataFrame, buckets: int, key: bytes = b"") -> DataFrame:
    """The phrases of ``rows`` (id, key, text), packed by slice and bucket; buckets of contents come after those of triggers."""

    def run(batches):
        seen, n, home, known, read = np.zeros(1 << CELL_BITS, np.uint16), 0, TaskContext.get().partitionId(), set(), 0
        for part in _segments(batches):
            ids, keys, doc = _documents([x[0] for x in part], [x[1] for x in part])
            shift = np.array([x[2] for x in part])
            text, place, count, h, c, left, right = _parse([x[3] for x in part], True, key)
            read += sum(len(x[3]) for x in part)
            send, goes = slice_order(ids, doc[text], c, h)
            cell = (h[send] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            held, at, times = np.unique(cell, return_inverse=True, return_counts=True)
            # the first entries of a trigger in the task go to its bucket, the others to those of their contents
            nth = np.empty(len(cell), np.int64)
            order = np.argsort(at, kind="stable")
            nth[order] = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            nth += seen[cell]
            seen[held] = np.minimum(seen[held] + np.minimum(times, 65535), 65535).astype(np.uint16)
            often = np.flatnonzero(nth >= OFTEN * min(1 + read // OFTEN_BYTES, 65535 // OFTEN))
            # a trigger, some of whose entries go elsewhere, is marked once a task
            _, one = np.unique(h[send[often]], return_index=True)
            first = np.array([k for k, x in zip(often[one].tolist(), h[send[often[one]]].tolist(), strict=True) if x not in known], np.int64)
            known.update(h[send[first]].tolist())
            entries = np.empty(len(send) + len(first), _ENTRY)
            own, marks = entries[: len(send)], entries[len(send) :]
            own["h"], own["c"], own["doc"], own["p"], own["n"] = h[send] >> np.uint64(32), c[send], doc[text[send]], place[send] + shift[text[send]], count[send]
            own["l"], own["r"] = left[send], right[send]
            marks[:] = own[first]
            marks["n"] = 0
            by_trigger = (h[send] % np.uint64(buckets)).astype(np.int64)
            bucket = by_trigger.copy()
            bucket[often] = buckets + (c[send[often]] % np.uint64(buckets)).astype(np.int64)
            told = np.empty(len(goes), _WHOLE)
            told["doc"], told["c"] = doc[text[goes]], c[goes]
            yield _packed_rows(home << 32 | n, ids, keys, np.append(bucket, by_trigger[first]), entries, told, (home + n) % buckets)
            n += 1

    return rows.mapInArrow(run, _PACKED)


_DECIDED = "slice long, ids binary, keys binary, whole binary, wanted binary, masks binary"


def _unpacked(parts: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, ...]:
    """Entries, their row among ``parts``, their ids and their documents in the slice."""
    entries = [np.frombuffer(x, kind) for x in parts["entries"]]
    docs = np.array([len(x) // 8 for x in parts["ids"]])
    row = np.repeat(np.arange(len(entries)), [len(x) for x in entries])
    e = np.concatenate(entries)
    at = (np.cumsum(docs) - docs)[row] + e["doc"]
    return e, row, np.frombuffer(b"".join(parts["ids"]), "<i8")[at], np.frombuffer(b"".join(parts["keys"]), "<u2")[at]


def _answers(parts: pd.DataFrame, home: pd.DataFrame, **answers: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    """A row for each slice that is told something: records by row of ``parts``; and the rows of documents as they are."""
    out = {c: list(home[c]) for c in ("slice", "ids", "keys")} | {"whole": [None] * len(home), "wanted": [None] * len(home), "masks": [None] * len(home)}
    out[next(iter(answers))] = list(home["told"])
    slices = parts["slice"].to_numpy(np.int64) if len(parts) else np.zeros(0, np.int64)
    for name, (row, records) in answers.items():
        order = np.argsort(row, kind="stable")
        row, records = row[order], records[order]
        edges = _edges(row).tolist() if len(row) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for c in out:
                out[c].append({"slice": int(slices[row[a]]), name: records[a:b].tobytes()}.get(c))
    return pd.DataFrame(out)


def _open(group: np.ndarray, side: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether contents of a group with these bytes on a side of the trigger, if any, stand first in several documents."""
    order = np.lexsort((side, group))
    edges = _edges(group[order], side[order])
    several = np.minimum.reduceat(least[order], edges[:-1]) != np.maximum.reduceat(least[order], edges[:-1])
    out = np.empty(len(group), bool)
    out[order] = np.repeat(several, np.diff(edges))
    return out & (side > 0)


def decide(bucket: int, parts: pd.DataFrame, by_content: bool = False) -> pd.DataFrame:
    """The parse's order within a bucket of triggers, or of contents: those that go whole, and those that the dictionary has to settle."""
    home, parts = parts[parts["entries"].isna()], parts[parts["entries"].notna()]
    none = np.zeros(0, np.int64)
    if not len(parts):
        return _answers(parts, home, whole=(none, np.zeros(0, _WHOLE)))
    e, row, ids, doc = _unpacked(parts, _ENTRY)
    order = np.argsort(e["h"], kind="stable")
    edges = _edges(e["h"][order])
    several = np.minimum.reduceat(ids[order], edges[:-1]) != np.maximum.reduceat(ids[order], edges[:-1])
    marked = np.full(len(several), by_content) | np.logical_or.reduceat(e["n"][order] == 0, edges[:-1])
    size = np.diff(edges)
    # triggers of one document end here, unless a marker tells that others hold the trigger
    keep = np.repeat(several | marked, size) & (e["n"][order] > 0)
    order, marked = order[keep], np.repeat(marked, size)[keep]
    if not len(order):
        return _answers(parts, home, whole=(none, np.zeros(0, _WHOLE)))
    e, row, ids, doc = e[order], row[order], ids[order], doc[order]
    order = np.lexsort((ids, e["c"], e["h"]))
    e, row, ids, doc, marked = e[order], row[order], ids[order], doc[order], marked[order]
    c_edges, h_edges = _edges(e["h"], e["c"]), _edges(e["h"])
    content = np.repeat(np.arange(len(c_edges) - 1), np.diff(c_edges))
    group = np.repeat(np.arange(len(h_edges) - 1), np.diff(h_edges))
    least = ids[c_edges[:-1]]  # of each content, as ids ascend within it
    first_content = content[h_edges[:-1]]
    at = c_edges[:-1]
    open_ = _open(group[at], e["l"][at], least) | _open(group[at], e["r"][at], least)
    goes = ids > least[content]
    wanted = ~goes & (open_[content] | marked)
    contents = np.add.reduceat(open_.astype(np.int64), first_content)
    asks = np.empty(int(wanted.sum()), _WANTED)
    asks["doc"], asks["c"], asks["p"], asks["n"] = doc[wanted], e["c"][wanted], e["p"][wanted], e["n"][wanted]
    # bucket and trigger in one number; a collision only adds strings to a comparison
    asks["h"] = (np.int64(bucket % (1 << 30)) << 32) | e["h"][wanted].astype(np.int64)
    asks["hot"] = (marked | (contents[group] > HOT))[wanted]
    told = np.empty(int(goes.sum()), _WHOLE)
    told["doc"], told["c"] = doc[goes], e["c"][goes]
    return _answers(parts, home, whole=(row[goes], told), wanted=(row[wanted], asks))


def decide_strings(parts: pd.DataFrame) -> pd.DataFrame:
    """Of dealt strings those that also stand in a smaller document, as bits of their phrases."""
    home, parts = parts[parts["entries"].isna()], parts[parts["entries"].notna()]
    if not len(parts):
        return _answers(parts, home, masks=(np.zeros(0, np.int64), np.zeros(0, _MASK)))
    e, row, ids, doc = _unpacked(parts, _STRING)
    order = np.lexsort((e["e"], e["d"]))
    edges = _edges(e["d"][order], e["e"][order])
    hit = order[ids[order] > np.repeat(np.minimum.reduceat(ids[order], edges[:-1]), np.diff(edges))]
    return _answers(parts, home, masks=(row[hit], _bits(doc[hit], e["c"][hit], e["q"][hit])))


def _bits(doc: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    masks = np.empty(len(c), _MASK)
    masks["doc"], masks["c"], masks["bits"] = doc, c, np.uint64(1) << q.astype(np.uint64)
    return masks


_KINDS = {"whole": _WHOLE, "wanted": _WANTED, "masks": _MASK}


def by_document(parts: pd.DataFrame) -> pd.DataFrame:
    """What a slice is told, a row a document."""
    home = parts[parts["ids"].notna()].iloc[0]
    ids, keys = np.frombuffer(home["ids"], "<i8"), np.frombuffer(home["keys"], "<i8")
    out: dict[int, dict] = {}
    for name, kind in _KINDS.items():
        records = np.frombuffer(b"".join(x for x in parts[name] if x), kind)
        records = records[np.argsort(records["doc"], kind="stable")]
        edges = _edges(records["doc"]).tolist() if len(records) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.setdefault(int(records["doc"][a]), {})[name] = records[a:b].tobytes()
    return pd.DataFrame([(ids[d], keys[d], *(x.get(name) for name in _KINDS)) for d, x in out.items()], columns=["id", "key", *_KINDS])


def told_documents(decided: DataFrame) -> DataFrame:
    return decided.groupBy("slice").applyInPandas(by_document, "id long, key long, whole binary, wanted binary, masks binary")


def _by_row(ids: np.ndarray, keys: np.ndarray, records: np.ndarray):
    """(id, key, packed records) of each document."""
    if not len(ids):
        return
    order = np.lexsort((ids, keys))
    ids, keys, records = ids[order], keys[order], records[order]
    edges = _edges(ids, keys).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(ids[a]), int(keys[a]), records[a:b].tobytes()


def suffix_order(dictionary: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary's suffixes of at least ``depth`` bytes in their order to that depth: phrase, place, and whether each differs from the one before."""
    sizes = np.array([len(x) for x in dictionary])
    counts = np.maximum(sizes - depth + 1, 0)
    phrase = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    joint = b"".join(dictionary)
    if not len(phrase):
        return phrase, place, np.zeros(0, bool)
    suffixes = np.ndarray((len(joint) - depth + 1,), f"S{depth}", buffer=joint, strides=(1,))[(np.cumsum(sizes) - sizes)[phrase] + place]
    order = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[order]
    return phrase[order], place[order], np.concatenate([[True], suffixes[1:] != suffixes[:-1]])


def settle(part: pd.DataFrame) -> pd.DataFrame:
    """For dictionary phrases (id, key, c, content) the bits of their strings that also stand in a smaller document."""
    ids, keys, contents = (part[c].to_numpy(np.int64) for c in ("id", "key", "c"))
    phrase, place, fresh = suffix_order(list(part["content"]))
    if not len(phrase):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "masks": []})
    least = np.minimum.reduceat(ids[phrase], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    hit = ids[phrase] > least
    bits = np.zeros(len(ids), np.uint64)
    np.bitwise_or.at(bits, phrase[hit], np.uint64(1) << place[hit].astype(np.uint64))
    some = np.flatnonzero(bits)
    masks = np.zeros(len(some), _MASK)
    masks["c"], masks["bits"] = contents[some].view(np.uint64), bits[some]
    return pd.DataFrame(list(_by_row(ids[some], keys[some], masks)), columns=["id", "key", "masks"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of a fixed number at some row keys."""
    place = F.pmod("key", F.lit(1 << BITMAP_BITS)) + 1  # the functions number positions from 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8 + 4096, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _marked(keys: DataFrame):
    """A test of row keys that passes all of ``keys`` and few others, by a bitmap of fixed size."""
    bits = keys.sparkSession.sparkContext.broadcast(_bitmap(keys))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bits.value[at >> 3] >> (at & 7)) & 1 == 1)

    return marked(F.pmod("key", F.lit(1 << BITMAP_BITS)))


def _strings(rows: DataFrame, buckets: int) -> DataFrame:
    """The dictionary, once each phrase (h, id, key, c, content); and the strings of hot triggers, packed by slice and bucket."""
    names = ("h", "id", "key", "c", "content", *_COLUMNS)
    kinds = (*(pa.int64(),) * 4, pa.binary(), pa.int64(), pa.int64(), *(pa.binary(),) * 4)

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), t) for c, t in zip(names, kinds, strict=True)], names=names)

    def hot_rows(slice_: int, home: int, held: list[tuple]) -> pa.RecordBatch:
        ids, keys, doc = _documents([x[0] for x in held], [x[1] for x in held])
        row = np.repeat(doc, [x[4] for x in held])
        c = np.repeat(np.array([x[2] for x in held], np.uint64), [x[4] for x in held])
        q = np.concatenate([np.arange(x[4]) for x in held])
        digests = np.frombuffer(b"".join(blake2b(x[3][k : k + DEPTH], digest_size=16).digest() for x in held for k in range(x[4])), "<u8").reshape(-1, 2)
        send, goes = slice_order(ids, row, digests[:, 1], digests[:, 0], once=False)
        entries = np.empty(len(send), _STRING)
        entries["d"], entries["e"], entries["c"], entries["doc"], entries["q"] = digests[send, 0], digests[send, 1], c[send], row[send], q[send]
        more = _bits(row[goes], c[goes], q[goes])
        packed = _packed_rows(slice_, ids, keys, (entries["d"] % np.uint64(buckets)).astype(np.int64), entries, more, home)
        return table(**dict(zip(_COLUMNS, packed.columns, strict=True)))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        hot, size = [], 0
        held, found = [], 0  # a batch of the dictionary is made of many documents

        def dictionary() -> pa.RecordBatch:
            joint = {name: np.concatenate([x[k] for x in held]) for k, name in enumerate(("h", "id", "key", "c"))}
            return table(**{name: pa.array(x, pa.int64()) for name, x in joint.items()}, content=pa.array([y for x in held for y in x[4]], pa.binary()))

        for batch in batches:
            ids, keys, texts, asks = (batch.column(i) for i in range(4))
            for row in range(batch.num_rows):
                text, i, k = texts[row].as_py(), ids[row].as_py(), keys[row].as_py()
                a = np.frombuffer(b"".join(asks[row].as_py()), _WANTED)
                for x in a[a["hot"] > 0]:
                    p, m = int(x["p"]), int(x["n"])
                    hot.append((i, k, int(x["c"]), text[p : p + m - 1 + DEPTH], m))
                    size += m
                    if size >= 100_000 or len(hot) > 60_000:
                        yield hot_rows(part << 32 | n, n % buckets, hot)
                        hot, size, n = [], 0, n + 1
                a = a[a["hot"] == 0]
                for at in range(0, len(a), 20_000):
                    b = a[at : at + 20_000]
                    content = [text[p : p + m - 1 + DEPTH] for p, m in zip(b["p"].tolist(), b["n"].tolist(), strict=True)]
                    held.append((b["h"].astype(np.int64), np.full(len(b), i), np.full(len(b), k), b["c"].astype(np.uint64).view(np.int64), content))
                    found += len(b)
                    if found >= 20_000:
                        yield dictionary()
                        held, found = [], 0
        if held:
            yield dictionary()
        if hot:
            yield hot_rows(part << 32 | n, n % buckets, hot)

    return rows.mapInArrow(run, "h long, id long, key long, c long, content binary, " + _PACKED)


def removals(rows: DataFrame, secret: bytes = b"") -> DataFrame:
    """(id, key, whole, masks), from tables: for rows (id, key, text) the phrase contents of which all, or some, strings stand in a smaller document."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    def decide_bucket(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return decide(int(key[0]), parts, int(key[0]) >= buckets)

    marks = told_documents(packed_phrases(rows, buckets, secret).groupBy("bucket").applyInPandas(decide_bucket, _DECIDED))
    marks = written(marks.drop("masks"), "suffix-marks")
    asked = marks.where("wanted is not null")
    near = rows.where(_marked(asked.select("key"))).join(asked.groupBy("id", "key").agg(F.collect_list("wanted").alias("wanted")), ["id", "key"]).select("id", "key", "text", "wanted")
    release(rows.sparkSession)  # a job that has only just ended may still hold its shuffles
    string_buckets = max(8, total // (4 * BUCKET_STRINGS))
    strings, strings_at = written_at(_strings(near, string_buckets), "suffix-strings")
    dictionary = strings.where("content is not null")
    groups = max(1, dictionary.count() // GROUP_PHRASES)
    settled = dictionary.select("h", "id", "key", "c", "content", F.pmod(F.xxhash64("h"), F.lit(groups)).alias("g")).groupBy("g").applyInPandas(settle, "id long, key long, masks binary")
    settled = written(settled, "suffix-settled")  # the shuffles of the dictionary and of dealt strings are not there at one time
    dealt = strings.where("content is null").select(*_COLUMNS).groupBy("bucket").applyInPandas(decide_strings, _DECIDED)
    dealt = written(told_documents(dealt).select("id", "key", "masks"), "suffix-dealt")
    erase(rows.sparkSession, strings_at)
    none = F.lit(None).cast("binary")
    whole = marks.where("whole is not null").select("id", "key", "whole", none.alias("masks"))
    return whole.union(settled.union(dealt).select("id", "key", none, "masks"))


def _cut(texts: list[bytes], whole: list[list[bytes]], masks: list[list[bytes]], key: bytes = b"") -> list[tuple[list[tuple[int, int]], bytes]]:
    """For each text its maximal removed spans, and the bytes that stay."""
    w = [np.frombuffer(b"".join(x), _WHOLE)["c"] for x in whole]
    m = [np.frombuffer(b"".join(x), _MASK) for x in masks]
    told = np.concatenate([np.repeat(np.arange(len(texts)), [len(x) for x in w]), np.repeat(np.arange(len(texts)), [len(x) for x in m])])
    m = np.concatenate(m)
    contents = np.concatenate([*w, m["c"]])
    known, rank = np.unique(contents, return_inverse=True)
    held, at = np.unique(rank * len(texts) + told, return_inverse=True)  # a content of a text
    bits = np.zeros(len(held), np.uint64)
    np.bitwise_or.at(bits, at, np.concatenate([np.full(len(contents) - len(m), ALL), m["bits"]]))
    sizes = np.array([len(x) for x in texts])
    offsets = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int32)

    def mark(rows: list[int], shifts: list[int], pieces: list[bytes]) -> None:
        piece, place, count, _, c = parse(pieces, key)
        rows_, shifts_ = np.array(rows), np.array(shifts)
        row = np.minimum(np.searchsorted(known, c), len(known) - 1)
        code = row * len(texts) + rows_[piece]
        at = np.minimum(np.searchsorted(held, code), len(held) - 1)
        found = np.flatnonzero((known[row] == c) & (held[at] == code))
        place, count, mask = (place + shifts_[piece])[found], count[found], bits[at[found]]
        all_ = mask == ALL
        np.add.at(edge, place[all_], 1)
        np.add.at(edge, place[all_] + count[all_] - 1 + DEPTH, -1)
        some = np.ascontiguousarray(mask[~all_])
        r, q = np.nonzero(np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        here = place[~all_][r] + q
        np.add.at(edge, here, 1)
        np.add.at(edge, here + DEPTH, -1)

    rows: list[int] = []
    shifts: list[int] = []
    pieces: list[bytes] = []
    if len(held):
        for k, text in enumerate(texts):
            for shift, piece in _pieces(text):
                if pieces and sum(map(len, pieces[-1:])) + shifts[-1] - shifts[0] + len(piece) > PARSE_BYTES:
                    mark(rows, shifts, pieces)
                    rows, shifts, pieces = [], [], []
                rows.append(k)
                shifts.append(int(offsets[k]) + shift)
                pieces.append(piece)
        if pieces:
            mark(rows, shifts, pieces)
    gone = np.cumsum(edge[:-1]) > 0
    out = []
    for a, n, text in zip(offsets.tolist(), sizes.tolist(), texts, strict=True):
        here = gone[a : a + n]
        turns = np.flatnonzero(np.diff(here, prepend=False, append=False))
        out.append((list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), np.frombuffer(text, np.uint8)[~here].tobytes() if len(turns) else text))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, ``spans`` (start, end) of removed bytes, and ``kept``, the other bytes."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.cast("binary").alias("text"))
    small_batches(df.sparkSession)
    secret = token_bytes(16)  # drawn after the texts were written, so none of them can be made to collide
    marks = removals(rows.where(F.col("id").isNotNull() & (F.length("text") >= DEPTH)), secret)
    marked = F.coalesce(F.col("id").isNotNull(), F.lit(False)) & _marked(marks.select("key"))
    release(df.sparkSession)
    gathered = marks.groupBy("id", "key").agg(F.collect_list("whole").alias("whole"), F.collect_list("masks").alias("masks"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            columns, row = [batch.column(c) for c in range(4)], 0
            while row < batch.num_rows:
                stop, size = row, 0
                while stop < batch.num_rows and (stop == row or size < PARSE_BYTES):
                    size += columns[1][stop].as_buffer().size
                    stop += 1
                ids, texts, whole, masks = (c[row:stop].to_pylist() for c in columns)
                made = _cut(texts, [x or [] for x in whole], [x or [] for x in masks], secret)
                spans = [[{"start": a, "end": b} for a, b in gone] for gone, _ in made]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(spans, span), pa.array([kept for _, kept in made], pa.binary())], names=["id", "n_bytes", "spans", "kept"])
                row = stop

    some = rows.where(marked).join(gathered, ["id", "key"], "left").select("id", "text", "whole", "masks").mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    rest = rows.where(~marked).select("id", F.length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("text").alias("kept"))
    return some.union(rest).select(F.col("id").cast(kind).alias(id_col), "n_bytes", "spans", "kept")


def op5_suffix_dedup(spark, sf_dir):
    """Counts and a digest from ``remove_repeats``."""
    out = remove_repeats(documents(spark, sf_dir))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
