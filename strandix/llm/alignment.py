"""Alignment of two tokenizers over the same bytes, by a dangling-suffix transducer.

One tokenizer's tokens run ahead of the other's by some unmatched bytes, the residual. The state is which side leads and by what; the next
token of the other side shortens the residual, turns the lead over, or empties it, which closes a group. Transitions are kept by state and
token, so a pair of vocabularies soon costs a dictionary look-up a token.

Texts are cut before single spaces between other characters. Neither tokenizer crosses such a place (the second one's vocabulary is checked
for that when it is loaded; otherwise texts stay whole), so both tokens end there, groups never cross it, and each distinct stretch of a slice
of texts is aligned once.

How often a pair of ids is linked is counted over the whole corpus: distinct pairs a slice are summed by one aggregation, and the
counts are joined back to the slices that hold them. Nothing of that passes the driver.

Defined results: a null or empty text, and one that either tokenizer doesn't spell byte for byte, has no tokens: zeros and an empty string.
Repeated rows count each on their own; a null id is passed through; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import Vocabulary
from .common import documents, sha256_hex, small_batches, written

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_INNER_SPACE = re.compile("[^▁]▁")
#: UTF-8 bytes of text whose pairs are made distinct together.
SLICE = 8 << 20
#: Slices that a task's writer or reader holds together, however many the task has.
SLICES_TOGETHER = 2
#: Transitions, and aligned stretches of at most 64 characters (twice as many), that a task keeps.
KEPT_TRANSITIONS, KEPT_STRETCHES = 1 << 20, 1 << 17
#: Characters of a stretch that the faster library gets; its time grows with the square.
SHORT = 200


class Transducer:
    """States are numbers: 0 is closed, others stand for the side that leads and its residual bytes. Transitions are kept by state and next token."""

    LEFT, RIGHT, DIFFER = 0, 1, -1

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.tokens = (left, right)
        self._clear()

    def _clear(self) -> None:
        self.next: dict[int, int] = {}
        self.number: dict[tuple[int, bytes], int] = {(self.RIGHT, b""): 0}
        self.states: list[tuple[int, bytes]] = [(self.RIGHT, b"")]  # a closed state takes from the left, as one that the right leads does
        self.takes_left: list[bool] = [True]

    def _make(self, state: int, side: int, token: int) -> int:
        """The state after the lagging side's token, or DIFFER."""
        lead, residual = self.states[state]
        piece = self.tokens[side][token]
        if not piece:
            return self.DIFFER
        if residual.startswith(piece):
            after = (lead, residual[len(piece) :])
        elif piece.startswith(residual):
            after = (side, piece[len(residual) :])
        else:
            return self.DIFFER
        if not after[1]:
            return 0
        found = self.number.setdefault(after, len(self.states))
        if found == len(self.states):
            self.states.append(after)
            self.takes_left.append(after[0] == self.RIGHT)
        return found

    def groups(self, left: list[int], right: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each side end with each group; None if the sides don't spell the same bytes."""
        if len(self.next) >= KEPT_TRANSITIONS:
            self._clear()
        i, j, state, out, n, m = 0, 0, 0, [], len(left), len(right)
        known, takes_left = self.next.get, self.takes_left
        while i < n or j < m:
            if takes_left[state]:
                if i == n:
                    return None
                token, side = left[i], 0
                i += 1
            else:
                if j == m:
                    return None
                token, side = right[j], 1
                j += 1
            key = state << 33 | side << 32 | token
            after = known(key)
            if after is None:
                after = self.next[key] = self._make(state, side, token)
            if after <= 0:
                if after:
                    return None
                out.append((i, j))
            state = after
        return None if state else out


class Pieces:
    """A sentencepiece model; loaded where it is first used."""

    def __init__(self, path: str):
        self.path, self._loaded = path, None

    def __getstate__(self):
        return {"path": self.path, "_loaded": None}

    @property
    def model(self):
        if self._loaded is None:
            import sentencepiece

            self._loaded = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._loaded

    def bytes_of(self) -> list[bytes]:
        m = self.model
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i in range(m.get_piece_size()) for p in [m.id_to_piece(i)]]

    def splits(self) -> bool:
        """Whether no piece has a space behind another character, so that texts can be cut before single spaces."""
        return not any(_INNER_SPACE.search(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))


class Encoder:
    """The first tokenizer's ids of stretches. Where its file is plain byte-level BPE with ids in the order of merges, short stretches take a faster library's way to the same ids."""

    def __init__(self, vocabulary: Vocabulary, pieces: dict[int, bytes]):
        self.tokenizer = vocabulary.tokenizer
        self.tokenizer.encode_special_tokens = True
        with open(vocabulary.path, encoding="utf-8") as f:
            file = json.load(f)
        model, split, special = file["model"], file.get("pre_tokenizer") or {}, set(vocabulary.special().values())
        names = [x if isinstance(x, str) else "".join(x) for x in model.get("merges", ())]
        order = [model["vocab"].get(x.replace(" ", "")) for x in names]
        plain = model.get("type") == "BPE" and not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.quick = None
        if plain and None not in order and order == sorted(set(order)) and len(order) + 256 + len(special) == len(pieces):
            import public_tokenizers
            import tiktoken

            self.quick = tiktoken.Encoding("stretches", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in pieces.items() if i not in special}, special_tokens={})

    def __call__(self, parts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        encode = self.quick.encode_ordinary
        out = [encode(p) if len(p) <= SHORT else None for p in parts]
        long = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(long, self.tokenizer.encode_batch_fast([parts[i] for i in long], add_special_tokens=False) if long else (), strict=True):
            out[i] = x.ids
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Both tokenizers and the transducer in one Python worker; stretches that were aligned before are kept, for its later tasks too."""

    @classmethod
    def of(cls, left: Vocabulary, right: Pieces) -> Aligner:
        key = (left.path, right.path)
        if key not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[key] = cls(left, right)
        return _ALIGNERS[key]

    @staticmethod
    def forget() -> None:
        _ALIGNERS.clear()

    def __init__(self, left: Vocabulary, right: Pieces):
        self.model, self.right, self.splits = right.model, right.bytes_of(), right.splits()
        known = left.pieces()
        self.encode = Encoder(left, known)
        self.left = [known.get(i, b"") for i in range(max(known) + 1)]
        self.transducer = Transducer(self.left, self.right)
        self.written = [str(i) for i in range(max(len(self.left), len(self.right)))]
        self.young, self.old = {}, {}  # stretches that are met again stay when the others go

    def stretches(self, text: str) -> list[str]:
        """Parts of a space and the text, each beginning with a space."""
        return _BOUNDARY.split(" " + text) if self.splits else [" " + text]

    def align(self, parts: list[str]) -> list[tuple | None]:
        """(tokens left, tokens right, groups as text, linked pairs in eight bytes each) of each part; None where the bytes differ."""
        out: list = []
        new, places = [], []
        for at, p in enumerate(parts):
            found = self.young.get(p, 0)
            if found == 0:
                found = self.old.get(p, 0)
                if found == 0:
                    new.append(p)
                    places.append(at)
                else:
                    self._keep(p, found)
            out.append(found)
        for start in range(0, len(new), 2000):  # the libraries' results are large
            some = new[start : start + 2000]
            theirs = self.model.encode([p[1:] for p in some], num_threads=1)
            for n, (p, a, b) in enumerate(zip(some, self.encode(some), theirs, strict=True), start):
                found = out[places[n]] = self._one(p, a, b)
                if len(p) <= 64:
                    self._keep(p, found)
        return out

    def _keep(self, part: str, found: tuple | None) -> None:
        if len(self.young) >= KEPT_STRETCHES:
            self.old, self.young = self.young, {}
        self.young[part] = found

    def _one(self, part: str, a: list[int], b: list[int]) -> tuple | None:
        if b"".join([self.left[i] for i in a]) != part.encode():
            return None
        cuts = self.transducer.groups(a, b)
        if cuts is None:
            return None
        written, text, pairs, i, j = self.written, [], [], 0, 0
        for x, y in cuts:  # the tokens that close a group are the only pair that ends there
            mine = written[a[i]] if x == i + 1 else ",".join([written[t] for t in a[i:x]])
            theirs = written[b[j]] if y == j + 1 else ",".join([written[t] for t in b[j:y]])
            text.append(f"{mine}|{theirs}")
            pairs.append(a[x - 1] << 32 | b[y - 1])
            i, j = x, y
        return len(a), len(b), ";".join(text), array("q", pairs).tobytes()  # a third of a list's memory, for as long as the stretch is kept


def align_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: str | None = None, right: str | None = None, *, groups: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, and (a, b, links, best) of each linked pair of ids.

    ``groups`` are written as ``a1,a2|b1;a3|b2,b3`` or, if given, as what the function makes of that.
    """
    import public_tokenizers

    small_batches(df.sparkSession)
    vocabulary, pieces = Vocabulary(left or public_tokenizers.path("byte_bpe_50k.json")), Pieces(right or public_tokenizers.path("piece_bpe_32k.model"))
    kind = df.schema[id_col].dataType.simpleString()
    of = groups or (lambda x: x)
    # places: numbers of stretches a document; ends and links: the pairs of each stretch, as numbers of the slice's distinct pairs
    schema = T._parse_datatype_string(f"slice string, ids array<{kind}>, a array<long>, b array<long>, groups array<string>, sizes array<int>, places binary, ends binary, links binary, pairs array<long>, times array<long>")
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def slice_row(aligner: Aligner, ids: list, texts: list) -> list:
        index: dict[str, int] = {}
        number = index.setdefault
        places = [[number(p, len(index)) for p in aligner.stretches(x)] if x else [] for x in texts]
        made = aligner.align(list(index))
        bad = {i for i, x in enumerate(made) if x is None}
        if bad:
            places = [[] if not bad.isdisjoint(p) else p for p in places]
        flat = np.fromiter((i for p in places for i in p), np.int64)
        used = np.bincount(flat, minlength=len(index)) if len(flat) else np.zeros(len(index), np.int64)
        ends = np.cumsum([len(x[3]) >> 3 if x else 0 for x in made], dtype=np.int64)
        keys = np.frombuffer(b"".join([x[3] for x in made if x]), np.int64)
        pairs, links = np.unique(keys, return_inverse=True)
        times = np.bincount(links, weights=np.repeat(used, np.diff(ends, prepend=0)), minlength=len(pairs)).astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in places], np.int64)
        stops = np.cumsum(sizes)

        def summed(i: int) -> list[int]:
            done = np.concatenate([[0], np.cumsum(np.array([x[i] if x else 0 for x in made], np.int64)[flat])])
            return (done[stops] - done[stops - sizes]).tolist()

        texts_of = [x[2] if x else "" for x in made]
        a, b = summed(0), summed(1)
        return [uuid.uuid4().hex, ids, a, b, [of(";".join([texts_of[i] for i in p])) if p else "" for p in places], sizes.tolist(), flat.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), links.astype("<u4").tobytes(), pairs.tolist(), times.tolist()]

    def run(batches):
        arrow, aligner = to_arrow_schema(schema), Aligner.of(vocabulary, pieces)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, texts, held = [], [], 0
                while at < batch.num_rows and held < SLICE:
                    ids.append(batch.column(0)[at].as_py())
                    texts.append(batch.column(1)[at].as_py())
                    held += len(texts[-1] or "")
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(slice_row(aligner, ids, texts), arrow, strict=True)], schema=arrow)

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    parts = written(narrow.mapInArrow(run, schema), "alignment-slices", SLICES_TOGETHER)
    zipped = F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times")))
    counts = parts.select(zipped.alias("z")).where("z.times > 0").groupBy(F.col("z.pair").alias("pair")).agg(F.sum("z.times").alias("links"))
    counts = written(counts, "alignment-counts")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("links").alias("highest"))  # a row an id of the second vocabulary, whose size is fixed
    ranked = counts.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "b", "links", (F.col("links") == F.col("highest")).alias("best"))
    rows = parts.select("slice", F.posexplode("pairs").alias("k", "pair")).join(ranked.select("pair", "links", "best"), "pair")
    out = T._parse_datatype_string(f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")

    def put_together(slices: pa.Table, counts: pa.Table) -> pa.Table:
        Aligner.forget()  # a worker that aligned before holds a hundred megabytes and more, which nothing asks for now
        arrow, x = to_arrow_schema(out), {name: slices.column(name)[0] for name in slices.column_names}
        sizes, places = np.array(x["sizes"].as_py(), np.int64), np.frombuffer(x["places"].as_py(), "<u4")
        ends, links = np.frombuffer(x["ends"].as_py(), "<u4").astype(np.int64), np.frombuffer(x["links"].as_py(), "<u4")
        value, best = np.zeros(x["distinct"].as_py(), np.int64), np.zeros(x["distinct"].as_py(), np.int64)
        if counts.num_rows:
            k = counts.column("k").to_numpy()
            value[k], best[k] = counts.column("links").to_numpy(), counts.column("best").to_numpy()
        bound = np.concatenate([[0], ends])

        def total(per_stretch):
            done = np.concatenate([[0], np.cumsum(per_stretch[places])])
            stop = np.cumsum(sizes)
            return (done[stop] - done[stop - sizes]).tolist()

        def of_stretches(v):
            done = np.concatenate([[0], np.cumsum(v[links])])
            return done[bound[1:]] - done[bound[:-1]]

        n = total(np.diff(bound))
        columns = [x["ids"].as_py(), x["a"].as_py(), x["b"].as_py(), n, n, total(of_stretches(best)), total(of_stretches(value)), x["groups"].as_py()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # counts come to their slice as rows, which Spark sorts and spills: a task holds one slice's at a time, in its Python worker
    slices = parts.select("slice", "ids", "a", "b", "groups", "sizes", "places", "ends", "links", F.size("pairs").alias("distinct"))
    joined = slices.groupBy("slice").cogroup(rows.select(F.col("slice").alias("of_slice"), F.col("k").alias("k"), F.col("links").alias("links"), F.col("best").alias("best")).groupBy("of_slice")).applyInArrow(put_together, out)
    pairs = ranked.select(F.shiftright("pair", 32).alias("a"), "b", "links", "best")
    return joined, pairs


def op13_cross_tokenizer(spark, sf_dir):
    """Counts of each document, with the digest of its groups."""
    aligned, _ = align_documents(documents(spark, sf_dir), groups=sha256_hex)
    return aligned.withColumnRenamed("groups", "groups_sha256")
