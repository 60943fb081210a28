"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds the hashes of its distinct word n-grams. Each of three global orders puts rare n-grams first --
rarity comes from a sketch of fixed size that counts all n-grams of all documents -- and differs from the others in how it
orders n-grams of like rarity. Two sets that reach the threshold share an n-gram within their prefixes under every order.

1. One scan fills the sketch, a second makes each set's class (equal sets are one class) and its prefixes.
2. Postings of the first order give candidates: lists of up to ``LIST`` classes give their pairs of fitting size, which must
   also share a prefix n-gram under the two other orders, and whose n-grams, counted in cells, can overlap enough; a longer list
   only ties its classes into one family.
3. Families are the connected components of the candidates; every link lies within a family. Families are verified whole,
   in pairs of blocks of at most ``BLOCK`` classes and about ``BLOCK_GRAMS`` n-grams, from the sets themselves. Every pair of classes that
   reaches the threshold counts towards the links of both; of the pairs themselves those are emitted that join something new.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is a class and a component of
its own; with fewer than n words the whole sequence is the one n-gram; repeated rows are documents of the same class; a null id takes
part, and is the id of a class or component only if that has no other id; other columns are never read; an empty table gives
an empty result. Words have 64 bits, under a key that each run draws anew: a bijection of those of up to seven bytes, a digest of others. n-grams
have 64 bits made of those with multipliers of that key, and sets are compared by their size and 128 bits of a digest: a number of 63 bits stands for a
class, and where sets of different digests meet in one number, the number is changed for all but one of them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, documents, free_name, map_texts, written
from .graph import components

LIST, BLOCK, BLOCK_GRAMS = 64, 512, 1 << 19
TASK_GRAMS = 1 << 20  # n-grams of the small families that one group verifies
STEP_BYTES = 1 << 20  # of text that is hashed at a time
WORDS = 100_000  # digests of words that a task keeps, twice as many at most beside those of one step
SKETCH_BITS, CHUNK_BITS = 22, 16
BITMAP_BITS = 26
SIZE_STEP = 1.02  # a class's number begins with the logarithm of its size to this base

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Digests(dict):
    """64-bit digests of words under a key; words that are met again stay when the others go."""

    def __init__(self, key: bytes):
        self.key, self.old = key, {}

    def __missing__(self, word: bytes) -> int:
        found = self.old.get(word)
        if found is None:
            found = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(word) <= 64:
            self[word] = found
        return found

    def shrink(self) -> None:
        if len(self) > WORDS:
            self.old = dict(self)
            self.clear()


class Shingler:
    """Hashes of the word n-grams of texts, a slice of texts at a time."""

    def __init__(self, n: int, key: bytes = b""):
        self.n, self.key = n, key
        seeds = [hashlib.blake2b(i.to_bytes(8, "little"), digest_size=8, key=key).digest() for i in range(n)]
        self.place = np.frombuffer(b"".join(seeds), "<u8") | np.uint64(1)
        self.salt = np.frombuffer(hashlib.blake2b(b"salt", digest_size=8, key=key).digest(), "<u8")[0]
        self.digests = _Digests(key)

    def words(self, joint: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keyed hashes of words: a bijection of the bytes and length of those up to seven bytes, digests of longer ones."""
        size = ends - starts
        eights = np.ndarray((len(joint) + 1,), "<u8", buffer=joint + bytes(8), strides=(1,))
        bits = np.minimum(size, 7).astype(np.uint64) * np.uint64(8)
        out = _mix((eights[starts] & ((np.uint64(1) << bits) - np.uint64(1)) | size.astype(np.uint64) << np.uint64(56)) ^ self.salt)
        long = np.flatnonzero(size > 7)
        digests = self.digests
        out[long] = np.fromiter((digests[joint[a:b]] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
        digests.shrink()
        return out

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each text the sorted hashes of its distinct n-grams; texts are UTF-8, A-Z count as a-z."""
        texts = [x or b"" for x in texts]
        out: list[np.ndarray] = []
        at = size = 0
        for i, x in enumerate(texts):
            if size and size + len(x) > STEP_BYTES:
                out += self._sets(texts[at:i])
                at, size = i, 0
            size += len(x)
        return out + self._sets(texts[at:])

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        joint = b" ".join(texts).lower() + b" "
        raw = np.frombuffer(joint, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        words = self.words(joint, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts]))
        n, total = self.n, len(words)
        grams = np.zeros(max(0, total - n + 1), np.uint64)
        for k in range(n):
            grams += words[k : k + len(grams)] * self.place[k]
        grams = _mix(grams)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(_mix((words[a:b] * self.place[: b - a]).sum(keepdims=True, dtype=np.uint64), b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _batches(batches: Iterator[pa.RecordBatch]):
    """(ids, texts) of bounded size."""
    for batch in batches:
        column, n, at = batch.column(1), batch.num_rows, 0
        while at < n:
            stop, held = at, 0
            while stop < n and (stop == at or held < SLICE_BYTES):
                held += column[stop].as_buffer().size if column[stop].is_valid else 0
                stop += 1
            yield batch.column(0)[at:stop].to_pylist(), column[at:stop].to_pylist()
            at = stop


def rarity_sketch(df: DataFrame, id_col: str, text_col: str, n: int, key: bytes = b"") -> np.ndarray:
    """For each of 2^22 cells a level that grows with the number of n-grams of all documents that fall into it."""
    cells, chunk = 1 << SKETCH_BITS, 1 << CHUNK_BITS

    def count(batches):
        shingler, held, seen = Shingler(n, key), np.zeros(cells, np.uint32), False
        for _, texts in _batches(batches):
            for s in shingler.sets(texts):
                seen = True
                np.add.at(held, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if seen:
            salt = int(held[:64].sum()) % 64
            short = np.minimum(held, 65535).astype("<u2")
            for at in range(0, cells, chunk):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([at // chunk], pa.int32()), "salt": pa.array([salt], pa.int32()), "held": [short[at : at + chunk].tobytes()], "wide": pa.array([False])})

    def add(parts: pd.DataFrame) -> bytes:
        total = np.zeros(chunk, np.uint32)
        for held, wide in zip(parts["held"], parts["wide"], strict=True):
            now = np.frombuffer(held, "<u4" if wide else "<u2")
            total = np.minimum(total.astype(np.uint64) + now, 2**32 - 1).astype(np.uint32)
        return total.tobytes()

    def first(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "salt": [0], "held": [add(parts)], "wide": [True]})

    def last(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(add(parts), "<u4")
        return pd.DataFrame({"chunk": [key[0]], "level": [np.minimum(4 * np.log2(total + 1.0), 255).astype(np.uint8).tobytes()]})

    schema = "chunk int, salt int, held binary, wide boolean"
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    halves = narrow.mapInArrow(count, schema).groupBy("chunk", "salt").applyInPandas(first, schema)
    levels = np.zeros(cells, np.uint8)
    for row in halves.groupBy("chunk").applyInPandas(last, "chunk int, level binary").toLocalIterator():
        levels[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["level"], np.uint8)
    return levels


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's first n-grams must meet those of any set that reaches the threshold."""
    return n - -(-n * percent // 100) + 1


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """The number of an equal-set class, its size's logarithm in 10 bits, then 53 bits of a digest of the set; and 64 more bits of it."""
    level = int(np.log(len(s)) / np.log(SIZE_STEP))
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return level << 53 | int.from_bytes(digest[:8], "big") >> 11, int.from_bytes(digest[8:], "big", signed=True)


def _told_apart(classes: DataFrame) -> DataFrame:
    """``classes`` with numbers ``c`` that no two digests (c0, d) share; the first number is c0."""
    for _ in range(8):
        twice = classes.where("c is not null").groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("c", "lo")
        if not twice.head(1):
            return classes
        other = F.shiftleft(F.shiftrightunsigned("c", 53), 53).bitwiseOR(F.shiftrightunsigned(F.xxhash64("c", "d"), 11))
        again = classes.join(twice, "c", "left").withColumn("c", F.when(F.col("d") == F.coalesce("lo", "d"), F.col("c")).otherwise(other))
        classes = written(again.select(classes.columns), "ngram-classes")
    raise RuntimeError("class numbers still meet")


def _levels_apart(percent: int) -> int:
    """How far the size levels of linked classes can be apart."""
    return int(np.log(100 / percent) / np.log(SIZE_STEP)) + 1


def cell_counts(s: np.ndarray) -> bytes:
    """How many n-grams fall into each of 64 to 1,024 cells, about one each; a first byte tells how wide the counts are."""
    cells = min(1024, max(64, 1 << (len(s) - 1).bit_length()))
    counts = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return b"\1" + counts.astype("u1").tobytes() if counts.max() < 256 else b"\4" + counts.astype("<u4").tobytes()


def overlap_bound(x: bytes, y: bytes) -> tuple[int, int]:
    """The most n-grams that two sets can share by their cell counts, and both sizes together."""
    a, b = (np.frombuffer(v, "u1" if v[0] == 1 else "<u4", offset=1).astype(np.int64) for v in (x, y))
    while len(a) != len(b):  # the finer counts are folded
        if len(a) > len(b):
            a = a[: len(a) // 2] + a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] + b[len(b) // 2 :]
    return int(np.minimum(a, b).sum()), int(a.sum() + b.sum())


def classified(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, key: bytes = b"") -> DataFrame:
    """id, hash of the text, size of the set, class, and for the first of each class in a task its prefixes under the three orders."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(rarity_sketch(df, id_col, text_col, n, key))

    def fresh():
        shingler, seen = Shingler(n, key), set()

        def kernel(keys, texts):
            level = shared.value
            for (i, t), s in zip(((k["id"], k["t"]) for k in keys), shingler.sets(texts), strict=True):
                if not len(s):
                    yield i, t, 0, None, None, None, None, None, None, None
                    continue
                (c, d), size = _class_of(s), prefix_size(len(s), percent)
                if (c, d) in seen:
                    yield i, t, len(s), c, c, d, None, None, None, None
                    continue
                if len(seen) >= 300_000:
                    seen.clear()
                seen.add((c, d))
                rank = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                first = [s[np.argpartition(rank | _mix(s, salt) >> np.uint64(8), size - 1)[:size]] for salt in (1, 2, 3)]
                # n-grams of the other orders are only compared, and 16 bits of them never hide a common one
                rest = [np.unique((x >> np.uint64(20)).astype("<u2")).tobytes() for x in first[1:]]
                yield i, t, len(s), c, c, d, first[0].astype(np.int64), rest[0], rest[1], cell_counts(s)

        return kernel

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t")).alias("key"), text.alias("text"))
    made = map_texts(rows, "key", "text", fresh(), f"id {kind}, t long, n long, c long, c0 long, d long, a array<long>, b2 binary, b3 binary, cells binary", binary=True)
    return _told_apart(written(made, "ngram-classes"))


def _share(left: pd.Series, right: pd.Series) -> list[bool]:
    return [bool(len(np.intersect1d(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"), assume_unique=True))) for x, y in zip(left, right, strict=True)]


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of classes that may be linked, and ties of the classes of long lists."""
    postings = classes.where("a is not null").select(F.explode("a").alias("token"), "c")
    by_token = Window.partitionBy("token").orderBy("c")
    apart = _levels_apart(percent)
    # the row before of a list is enough to leave single ones out and to drop repeats of a class
    listed = postings.withColumn("before", F.lag("c").over(by_token)).where("before is null or before <> c").withColumn("m", F.count("c").over(Window.partitionBy("token"))).where("m > 1").select("token", "c", "before", "m")
    listed = written(listed, "ngram-lists")
    level = lambda c: F.shiftrightunsigned(c, 53)
    ties = listed.where((F.col("m") > LIST) & F.col("before").isNotNull() & (level("c") - level("before") <= apart)).select(F.col("c").alias("u"), F.col("before").alias("v")).distinct()
    short = listed.where(F.col("m") <= LIST)
    members = short.groupBy("token").agg(F.array_sort(F.collect_list("c")).alias("cs"))

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def pairs(lists: pd.Series) -> pd.Series:
        out = []
        for cs in lists:
            cs = np.asarray(cs, np.int64)
            i, j = np.triu_indices(len(cs), 1)
            fit = (cs[j] >> 53) - (cs[i] >> 53) <= apart
            out.append([{"u": int(x), "v": int(y)} for x, y in zip(cs[j[fit]], cs[i[fit]], strict=True)])
        return pd.Series(out)

    found = written(members.select(F.explode(pairs("cs")).alias("p")).select("p.u", "p.v").distinct(), "ngram-pairs")
    needed = found.select(F.col("u").alias("c")).union(found.select(F.col("v").alias("c"))).distinct()
    others = classes.where("a is not null").join(needed, "c", "left_semi").dropDuplicates(["c"]).select("c", "b2", "b3", "cells")
    left = others.select(F.col("c").alias("u"), F.col("b2").alias("u2"), F.col("b3").alias("u3"), F.col("cells").alias("u4"))
    right = others.select(F.col("c").alias("v"), F.col("b2").alias("v2"), F.col("b3").alias("v3"), F.col("cells").alias("v4"))

    def may_link(x: bytes, y: bytes) -> bool:
        both, sizes = overlap_bound(x, y)
        return 100 * both >= percent * (sizes - both)

    @F.pandas_udf("boolean")
    def fit(u2: pd.Series, v2: pd.Series, u3: pd.Series, v3: pd.Series, u4: pd.Series, v4: pd.Series) -> pd.Series:
        meet = (x and y for x, y in zip(_share(u2, v2), _share(u3, v3), strict=True))
        return pd.Series([m and may_link(x, y) for m, x, y in zip(meet, u4, v4, strict=True)], dtype=bool)

    kept = found.join(left, "u").join(right, "v").where(fit("u2", "v2", "u3", "v3", "u4", "v4")).select("u", "v")
    return ties.union(kept)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of a fixed number at the hashes of some ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS)) + 1  # the functions number positions from 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8 + 8192, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


class _Forest:
    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked(sets: list[np.ndarray], percent: int, split: int | None = None, weights: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links among sets that suffice for the components, and for each set the weight of all sets that it is linked with.

    With ``split``, only links across it are looked for.
    """
    sizes, out, forest = np.array([len(s) for s in sets]), [], _Forest(len(sets))
    weights = np.ones(len(sets), np.int64) if weights is None else weights
    links = np.zeros(len(sets), np.int64)
    if len(sets) < 6:
        for i in range(len(sets)):
            for j in range(i):
                if split is None or j < split <= i:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        links[i] += weights[j]
                        links[j] += weights[i]
                        if forest.join(i, j):
                            out.append((i, j))
        return out, links
    tokens, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = (times > 1)[place]
    renumber = np.cumsum(times > 1) - 1
    row, col = row[common], renumber[place[common]]
    width = int((times > 1).sum())
    a = len(sets) if split is None else split
    shared = np.zeros((len(sets) if split is None else len(sets) - split, a), np.float32)
    for at in range(0, width, 8192):  # strips of the common n-grams, dense
        here = (col >= at) & (col < at + 8192)
        strip = np.zeros((len(sets), min(8192, width - at)), np.float32)
        strip[row[here], col[here] - at] = 1
        shared += (strip if split is None else strip[split:]) @ strip[:a].T
    low = 0 if split is None else split
    both = shared.astype(np.int64)
    good = 100 * both >= percent * (sizes[low:, None] + sizes[None, :a] - both)
    if split is None:
        np.fill_diagonal(good, False)
        links += good @ weights
    else:
        links[low:] += good @ weights[:a]
        links[:a] += weights[low:] @ good
    for i, j in zip(*np.nonzero(good), strict=True):
        i = int(i) + low
        if (split is not None or j < i) and forest.join(i, int(j)):
            out.append((i, int(j)))
    return out, links


def verified_links(df: DataFrame, id_col: str, text_col: str, classes: DataFrame, families: DataFrame, n: int, percent: int, key: bytes = b"") -> DataFrame:
    """(u, v, links): links between classes within their families, from the sets of one document a class; without v, linked documents of u."""
    spark = df.sparkSession
    first = classes.where("c is not null").join(families.select(F.col("node").alias("c"), "root"), "c").groupBy("c", "root").agg(F.min("id").alias("id"), F.count("*").alias("docs"), F.min("c0").alias("c0"), F.min("d").alias("d"))
    first = written(first, "ngram-members")
    # what a class adds to a block: its n-grams as its number tells them, or its share of the rows
    cost = F.greatest(F.pow(F.lit(SIZE_STEP), F.shiftrightunsigned("c", 53)), F.lit(BLOCK_GRAMS / BLOCK)).cast("long")
    first = first.withColumn("cost", cost)
    sizes = first.groupBy("root").agg(F.count("*").alias("m"), F.sum("cost").alias("grams"))
    bits = spark.sparkContext.broadcast(_bitmap(first))
    # the test is made where the sets are: a separate filter would keep a second Python worker a task
    place = F.when(F.col(id_col).isNotNull(), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << BITMAP_BITS)))

    def fresh():
        shingler = Shingler(n, key)

        def kernel(places, texts):
            marks = bits.value
            wanted = [x if p is None or marks[p >> 3] >> (p & 7) & 1 else None for p, x in zip(places, texts, strict=True)]
            for s in shingler.sets(wanted):
                if len(s):
                    yield *_class_of(s), s.tobytes()

        return kernel

    sets = map_texts(df.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", fresh(), "c0 long, d long, s binary", binary=True)
    own = first.join(sizes, "root").withColumn("blocks", F.ceil(F.col("grams") / BLOCK_GRAMS))
    # blocks by class number hold classes of like size when a family is large
    before = F.sum("cost").over(Window.partitionBy("root").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    own = written(own.withColumn("block", F.when(F.col("blocks") > 1, (F.coalesce(before, F.lit(0)) / BLOCK_GRAMS).cast("int")).otherwise(0)), "ngram-blocks")
    spans = own.where("blocks > 1").groupBy("root", "block").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    level = lambda c: F.shiftrightunsigned(c, 53)
    other = spans.select("root", F.col("block").alias("other"), F.col("low").alias("low2"))
    meets = written(spans.join(other, "root").where((F.col("other") >= F.col("block")) & (level("low2") - level("high") <= _levels_apart(percent))).select("root", "block", "other"), "ngram-meets")
    told = ("c", "c0", "d", "docs", "root")
    one = own.where("blocks = 1 and m > 1").select(*told, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("second"))
    many = own.where("blocks > 1").select(*told, "block")
    as_first = many.join(meets, ["root", "block"]).select(*told, F.col("block").alias("i"), F.col("other").alias("j"), F.lit(False).alias("second"))
    as_second = many.join(meets.where("other > block").withColumnRenamed("block", "i").withColumnRenamed("other", "block"), ["root", "block"]).select(*told, "i", F.col("block").alias("j"), F.lit(True).alias("second"))
    placed = written(one.union(as_first).union(as_second), "ngram-places")
    # many small families share a task; a pair of blocks has a group of its own
    groups = max(1, (first.agg(F.sum("cost")).first()[0] or 0) // TASK_GRAMS)
    group = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root", "i", "j").bitwiseOR(F.lit(-(2**63))))
    rows = sets.dropDuplicates(["c0", "d"]).join(placed, ["c0", "d"]).select("c", "docs", "root", "i", "j", "second", "s").withColumn("g", group)

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        u, v, n = [], [], []
        for _, family in part.groupby(["root", "i", "j"], sort=False):
            family = family.sort_values(["second", "c"], kind="stable")
            c = family["c"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in family["s"]]
            split = int((~family["second"].to_numpy(bool)).sum()) if family["second"].any() else None
            pairs, links = linked(sets, percent, split, family["docs"].to_numpy(np.int64))
            some = np.flatnonzero(links)
            u += [int(c[i]) for i, _ in pairs] + c[some].tolist()
            v += [int(c[j]) for _, j in pairs] + [None] * len(some)
            n += [None] * len(pairs) + links[some].tolist()
        return pd.DataFrame({"u": pd.array(u, "Int64"), "v": pd.array(v, "Int64"), "links": pd.array(n, "Int64")})

    return rows.groupBy("g").applyInPandas(verify, "u long, v long, links long")


def _components(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, t, n, c, and by class its smallest id, its number of documents and links, and root and smallest id of its component."""
    key = secrets.token_bytes(16)  # drawn after the texts were written, so none of them can be made to collide
    classes = classified(df, id_col, text_col, n, percent, key)
    families = written(components(candidate_edges(classes, percent)), "ngram-families")
    verified = written(verified_links(df, id_col, text_col, classes, families, n, percent, key), "ngram-links")
    links = components(verified.where("v is not null").select("u", "v"))
    counts = verified.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    least = classes.where("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("docs"))
    rooted = least.join(links.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = rooted.join(counts.withColumnRenamed("u", "c"), "c", "left")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # written, so that the join with all documents is planned by its size, and a hot class's rows can be split
    of_class = rooted.join(roots, "root").select("c", "root", "least", "component", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return classes.select("id", "t", "n", "c").join(written(of_class, "ngram-components"), "c", "left")


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links of ``percent`` per cent Jaccard or more), class_id (smallest id of an equal set) and n_links (linked documents)."""
    kind = df.schema[id_col].dataType.simpleString()
    own = lambda c: F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col(c))
    return _components(df, id_col, text_col, n, percent).select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), own("component").alias("component_id"), own("least").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component one row of its smallest id; its columns may have any names.

    Rows without an id all stay. Of a component's rows of that id that one stays whose text has the smallest hash; a row
    that equals it in id and text goes. Rows of one id with texts that are not linked are of different components and all stay, rows without words too,
    but for equal ones.
    """
    found = _components(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", n, percent).where("id is not null and (c is null or id = component)")
    # a component keeps one text of its smallest id; texts without words are their own components
    kept = found.groupBy(F.coalesce("root", F.lit(-1)).alias("root"), "id", F.when(F.col("c").isNull(), F.col("t")).alias("own")).agg(F.min("t").alias("t"), F.count("*").alias("rows"))
    t, mine, theirs = (free_name(df, x) for x in ("t", "kept_id", "kept_t"))
    kept = written(kept.select(F.col("id").alias(mine), F.col("t").alias(theirs), F.col("rows").alias("rows")).coalesce(8), "ngram-kept")
    hashed = df.withColumn(t, F.xxhash64(F.col(text_col).cast("string")))
    own = hashed.join(kept.select(mine, theirs), (F.col(id_col) == F.col(mine)) & (F.col(t) == F.col(theirs)), "left_semi")
    if kept.where("rows > 1").head(1):  # only then can two rows have one id and text
        own = own.dropDuplicates([id_col, t])
    return own.drop(t).union(df.where(F.col(id_col).isNull()))


def op1_ngram_join(spark, sf_dir):
    """Components at 90 per cent over word 3-grams."""
    return ngram_components(documents(spark, sf_dir), n=3, percent=90)
