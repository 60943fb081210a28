"""Byte-level BPE by a table of distinct words.

Texts are split into words at places that no token of the vocabulary's own splitting crosses (before a single space
or around a single newline), each distinct word is encoded once, and the ids are joined back by position. Decoding
joins ids to the table of pieces.

The word table is broadcast, as sorted hashes with ids, only while it measures at most ``broadcast_bytes``; a larger
table is joined to the distinct words of each slice of texts, with the same result. Hashes of the broadcast form are
checked to be distinct when the table is built.

Defined results: a null text is treated as empty and has no ids; special tokens in a text are recognised, as the
library does; repeated rows are encoded each on its own; a null id is passed through; other columns are never read;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import documents, map_texts, slices, small_batches, written

_TWO_SPACES = re.compile(r"\s\s|\0")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A tokenizer file; loaded where it is first used."""

    def __init__(self, path: str):
        self.path = path
        self._loaded = None

    def __getstate__(self):
        return {"path": self.path, "_loaded": None}

    @property
    def tokenizer(self):
        if self._loaded is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._loaded = tokenizer
        return self._loaded

    def special(self) -> dict[str, int]:
        with open(self.path, encoding="utf-8") as f:
            return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

    def pieces(self) -> dict[int, bytes]:
        """Bytes of each id: the byte alphabet puts printable bytes at themselves and the rest, in order, from 256 up."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = self.special()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        return {i: t.encode() if t in special else bytes(byte[c] for c in t) for t, i in vocabulary.items()}


def split_words(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """Words whose encodings, one after another, are the encoding of the text; special tokens stand alone."""
    for token in special:
        if token in text:
            out = []
            for i, part in enumerate(text.split(token)):
                out += ([token] if i else []) + split_words(part, tuple(t for t in special if t != token))
            return out
    if _TWO_SPACES.search(text):
        return [w for w in _BOUNDARY.split(text) if w]
    return [w for w in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if w]


def distinct_words(df: DataFrame, text_col: str, special: tuple[str, ...], held: int = 300_000) -> DataFrame:
    """Each word of the texts once; a task drops its own repeats first, as far as ``held`` words reach."""

    def fresh():
        seen: set[str] = set()

        def kernel(_, texts):
            for x in texts:
                if x:
                    new = set(split_words(x, special)) - seen
                    if len(seen) + len(new) > held:
                        seen.clear()
                    seen.update(new)
                    for w in new:
                        yield (w,)

        return kernel

    return map_texts(df, text_col, text_col, fresh(), "word string").distinct()


def word_table(df: DataFrame, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """word and its packed ids (little-endian uint32); every distinct word is encoded once."""
    special = tuple(vocabulary.special())

    def kernel(words, _):
        for at in range(0, len(words), 1000):  # the library's results are large
            some = words[at : at + 1000]
            for w, code in zip(some, vocabulary.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                yield w, np.array(code.ids, "<u4").tobytes()

    return map_texts(distinct_words(df, text_col, special), "word", "word", kernel, "word string, ids binary")


def _as_arrays(table: DataFrame, words: int, codes: int, wide: bool) -> tuple[np.ndarray, ...] | None:
    """Sorted hashes, each word's first id and number of ids, and all ids; None if two words share a hash.

    Partitions come one at a time into arrays of known size, so that the driver holds little beside them.
    """
    kind = "<u4" if wide else "<u2"

    def pack(batches):
        for b in batches:
            words, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
            sizes = np.array([len(x) // 4 for x in ids], "<u4")
            yield pa.RecordBatch.from_pydict({"h": [hashes.tobytes()], "n": [sizes.tobytes()], "ids": [np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes()]})

    hashes, sizes, ids = np.empty(words, np.uint64), np.empty(words, np.uint32), np.empty(codes, kind)
    at = end = 0
    for row in table.select("word", "ids").mapInArrow(pack, "h binary, n binary, ids binary").toLocalIterator():
        h, n, c = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["n"], "<u4"), np.frombuffer(row["ids"], kind)
        hashes[at : at + len(h)], sizes[at : at + len(h)], ids[end : end + len(c)] = h, n, c
        at, end = at + len(h), end + len(c)
    order = np.argsort(hashes)
    hashes = hashes[order]
    if (hashes[1:] == hashes[:-1]).any():
        return None
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    return hashes, starts.astype(np.uint32)[order], sizes[order], ids


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, broadcast_bytes: int = 128 << 20, decode: bool = False) -> DataFrame:
    """id, n_tokens and ``ids`` packed as little-endian unsigned 32-bit integers; with ``decode`` also the decoded text."""
    spark, vocabulary = df.sparkSession, Vocabulary(path or default_vocabulary())
    special = tuple(vocabulary.special())
    table = written(word_table(df, text_col, vocabulary), "bpe-words")
    words, codes = table.agg(F.count("*"), F.coalesce(F.sum(F.length("ids")), F.lit(0)) / 4).first()
    wide = max(vocabulary.pieces()) >= 65536
    size = 16 * words + (4 if wide else 2) * int(codes)
    arrays = _as_arrays(table, words, int(codes), wide) if size <= broadcast_bytes else None
    kind = df.schema[id_col].dataType.simpleString()
    if arrays is None:
        coded = _encode_by_join(df, table, id_col, text_col, special)
        return coded.withColumn("decoded", _decoder(vocabulary, spark)("ids")) if decode else coded
    shared, pieces = spark.sparkContext.broadcast(arrays), _pieces(vocabulary, spark)

    def kernel(ids, texts):
        hashes, starts, sizes, codes = shared.value
        index: dict[str, int] = {}
        number = index.setdefault
        places = [np.array([number(w, len(index)) for w in split_words(x, special)] if x else [], np.int64) for x in texts]
        at = np.searchsorted(hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in index], np.uint64))
        for i, place in zip(ids, places, strict=True):
            row = at[place] if len(place) else place
            found = codes[_ranges(starts[row].astype(np.int64), sizes[row].astype(np.int64))].astype("<u4")
            yield (i, len(found), found.tobytes(), _text(found, pieces.value)) if decode else (i, len(found), found.tobytes())

    return map_texts(df, id_col, text_col, kernel, f"{id_col} {kind}, n_tokens long, ids binary" + ", decoded string" * decode)


def _encode_by_join(df: DataFrame, table: DataFrame, id_col: str, text_col: str, special: tuple[str, ...]) -> DataFrame:
    """The same for a word table of any size: each slice of texts joins its distinct words to the table, and its places to them."""
    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T._parse_datatype_string(f"slice string, ids array<{kind}>, places array<binary>, words array<string>")

    def split(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                index: dict[str, int] = {}
                number = index.setdefault
                places = [np.array([number(w, len(index)) for w in split_words(x, special)] if x else [], "<u4").tobytes() for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([uuid.uuid4().hex], [ids[a:b]], [places], [list(index)]), arrow, strict=True)], schema=arrow)

    parts = written(narrow.mapInArrow(split, schema), "bpe-slices")
    words = parts.select("slice", F.posexplode("words").alias("k", "word"))
    codes = words.join(table, "word").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("codes"))
    joined = parts.select("slice", "ids", "places").join(codes, "slice", "left").select("ids", "places", F.transform("codes", lambda c: c["ids"]).alias("codes"))
    out = T._parse_datatype_string(f"{id_col} {kind}, n_tokens long, ids binary")

    def put_together(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, places, codes = (batch.column(c)[row].as_py() for c in range(3))
                codes = codes or []
                sizes = np.array([len(c) // 4 for c in codes], np.int64)
                starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(codes), "<u4")
                found = []
                for place in places:
                    at = np.frombuffer(place, "<u4")
                    found.append(flat[_ranges(starts[at], sizes[at])].tobytes() if len(at) else b"")
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, [len(x) // 4 for x in found], found), arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(put_together, out)


def _pieces(vocabulary: Vocabulary, spark):
    """The table of pieces by id, broadcast: its size is the vocabulary's."""
    pieces = vocabulary.pieces()
    return spark.sparkContext.broadcast([pieces.get(i, b"") for i in range(max(pieces) + 1)])


def _text(ids: np.ndarray, pieces: list[bytes]) -> str:
    return b"".join([pieces[k] for k in ids.tolist()]).decode("utf-8", "replace")


def _decoder(vocabulary: Vocabulary, spark):
    pieces = _pieces(vocabulary, spark)

    @F.pandas_udf("string")
    def text_of(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: _text(np.frombuffer(x or b"", "<u4"), pieces.value))

    return text_of


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and text: packed ids joined to the pieces of the vocabulary, whose number is fixed."""
    return encoded.select(id_col, _decoder(Vocabulary(path or default_vocabulary()), encoded.sparkSession)(ids_col).alias("text"))


def encode_and_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **settings) -> DataFrame:
    """id, n_tokens, packed ids and ``decoded``, the text that the pieces of these ids make up."""
    return encode_documents(df, id_col, text_col, path, decode=True, **settings)


def op9_bpe(spark, sf_dir):
    """Digests of the packed ids and of the decoded text."""
    coded = encode_and_decode(documents(spark, sf_dir))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
