"""The dictionary: k-mers with dense ids, the strings that spell them, and the queries over both.

Everything is a join or an aggregate over two tables. Both strands of a k-mer share one key, so a lookup is one equi-join; a palindrome
of even k is reported forward in regular mode and backward in canonical mode. Not found is NULL.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPLEMENT, VERSION, Config
from ..functions import sequence as S
from ..sources.storage import bucketed, bucketed_at, buckets_for, erase, release, shared_dir, stored, stored_in_turns
from . import blocks as blocks_of
from .blocks import expanded, given_weights, number_blocks, on_a_line, spelled, stitched
from .firsts import class_counts, first_places, turns_for
from .keyfilter import assembled, filter_rows, may_hold, words_asked, words_for
from .kmerize import cut, squeezed_pieces
from .running import running_sums  # noqa: F401  (imported from here, too)

HASHER = "multiply-xor 64"
LAID_OUT = 1 << 20  # dictionaries of fewer k-mers are laid out by key, however few are looked up
RESULT = ("kmer_id", "kmer_id_in_string", "kmer_offset", "kmer_orientation", "string_id", "string_begin", "string_end")


def _with_places(stored_kmers: DataFrame, k: int) -> DataFrame:
    """The k-mers as stored, with what their ids tell: place in the string and offset."""
    return stored_kmers.select(
        "kmer_id",
        "string_id",
        (F.col("kmer_id") - F.col("first_kmer_id")).alias("kmer_id_in_string"),
        (F.col("kmer_id") + F.col("string_id") * (k - 1)).alias("kmer_offset"),
        "string_kmers",
        "ckey",
        "strand",
        "weight",
    )


class Dictionary:
    """``kmers`` (kmer_id, string_id, kmer_id_in_string, kmer_offset, string_kmers, ckey, strand, weight) and
    ``strings`` (string_id, seq, len, num_kmers, string_begin, string_end, first_kmer_id)."""

    def __init__(self, kmers: DataFrame, strings: DataFrame, config: Config, filter_words: int = 0, filter_path: str | None = None, spans: DataFrame | None = None, path: str | None = None, total: int = 0):
        self.kmers, self.strings, self.config = kmers, strings, config
        self.filter_words, self.filter_path = filter_words, filter_path
        self.spans, self.path, self.total = spans, path, total
        self._kept: dict = {}

    def kept(self, name: str, make):
        """What ``make`` gives, made once for this dictionary."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    # ---- building and persistence ------------------------------------------------------------------

    @classmethod
    def build(cls, sequences: DataFrame, config: Config | None = None, path: str | None = None) -> Dictionary:
        """From (sequence_id, seq) and, for given weights, an array ``weights``.

        Sequence ids are distinct whole numbers whose order is that of the input. Each k-mer keeps its first occurrence, so
        duplicate-free input is stored as it is. Windows with other characters than ACGT are left out, as are null sequences
        and those shorter than k. Without given weights, a k-mer's weight is the number of its occurrences. With a column ``start``, rows
        are pieces of sequences from there on, each with the first k - 1 bases of the next, so that a sequence may have any length.

        All sequences lie on one line of places. First places are found in bins of minimizers, to which stretches of bases move and no row a window;
        fragments of consecutive first places are numbered in blocks of places, and strings that cross blocks are stitched by a row a block. Bins, and then groups of blocks,
        are made in up to four turns where they are many, so that a quarter of the stretches, or of the bases, is on disk at a time. What is kept
        are these spans of bases with their weights: ``kmers`` are made of them when read, and laid out by key when first looked up. With a ``path``
        the dictionary is written whole, so that it can be loaded.
        """
        config = config or Config()
        spark, k = sequences.sparkSession, config.k
        named, path = path is not None, path or f"{shared_dir(spark)}/strandix/dictionary-{uuid.uuid4().hex}"
        parts = [f"{path}/{x}" for x in ("pieces", "placed", "firsts", "numbered", "blocks")]
        own = sequences.select(F.col("sequence_id").cast("long").alias("id"), *(c for c in ("seq", "start") if c in sequences.columns))
        pieces = cut(own, k, "seq", "start" if "start" in sequences.columns else None)
        placed = on_a_line(stored(squeezed_pieces(pieces), parts[0]), parts[1])
        erase(spark, parts[0])
        release(spark)
        given = None
        if "weights" in sequences.columns:
            begins = placed.groupBy("id").agg(F.min(F.col("place") - F.col("start")).alias("begin"))
            given = given_weights(sequences.select(F.col("sequence_id").cast("long").alias("id"), "weights").join(begins, "id").select(F.col("begin").alias("place"), "weights"))
        counts = class_counts(placed, k, config.encoding)
        turns, bits = turns_for(counts), blocks_of.BLOCK_BITS + blocks_of.GROUP_BITS
        firsts = stored_in_turns(lambda turn: first_places(placed, k, config.encoding, bits, True, counts, turn, turns), turns, parts[2], "uncompressed")
        numbered = stored_in_turns(lambda turn: number_blocks(placed, firsts, k, given, turn, turns), turns, parts[3])
        erase(spark, parts[1], parts[2])
        blocks, total = stitched(numbered, parts[4])
        at = numbered.join(blocks, "block").withColumns({
            "string_id": F.col("string_base") + F.col("fragment") - 1 - F.col("joins"),
            "first_kmer_id": F.when((F.col("fragment") == 1) & (F.col("joins") == 1), F.col("begun")).otherwise(F.col("kmer_base") + F.col("first_rank")),
            "end_kmer_id": F.when((F.col("fragment") == F.col("fragments")) & (F.col("joined") == 1), F.col("ends")).otherwise(F.col("kmer_base") + F.col("first_rank") + F.col("size")),
            "kmer_id": F.col("kmer_base") + F.col("first_rank"),
        })
        whole = ((F.col("fragment") > 1) | (F.col("joins") == 0)) & ((F.col("fragment") < F.col("fragments")) | (F.col("joined") == 0))
        # a string over a border of blocks is put together from its fragments; those after the first bring a base a k-mer
        over = at.where(~whole).groupBy("string_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kmer_id", F.expr(f"if(kmer_id = first_kmer_id, bases, substring(bases, {k}))").alias("bases")))), lambda x: x["bases"]), "").alias("seq"), F.min("first_kmer_id").alias("first_kmer_id"))
        strings = at.where(whole).select("string_id", F.col("bases").alias("seq"), "first_kmer_id").unionByName(over)
        length = F.length("seq").cast("long")
        begin = F.col("first_kmer_id") + F.col("string_id") * (k - 1)
        strings = strings.select("string_id", "seq", length.alias("len"), (length - (k - 1)).alias("num_kmers"), "first_kmer_id", begin.alias("string_begin"), (begin + length).alias("string_end"))
        spans = stored(at.select("kmer_id", "string_id", "first_kmer_id", (F.col("end_kmer_id") - F.col("first_kmer_id")).alias("string_kmers"), "bases", "weights"), f"{path}/spans")
        out = cls(_with_places(expanded(spans, k, config.encoding), k), stored(strings, f"{path}/strings"), config, words_for(total), f"{path}/filter", spans, path, total)
        if named:
            out._write_kmers(path, total)
            out._write_rest(path, total)
        erase(spark, *parts)
        return out

    @property
    def by_key(self) -> DataFrame:
        """The k-mers in sorted buckets of their keys, without weights: made where keys are first looked up, as most queries need ids and strings only."""
        return self.kmers if self.path is None else self.kept("by key", self._bucketed_by_key)

    def among(self, queries: DataFrame, key_col: str, n: int | None = None) -> DataFrame | None:
        """The k-mers that queries may find, as in ``by_key``: read off the spans through a filter of the queries' keys, so that no row a k-mer moves.

        None where queries are to meet all keys laid out: if they are so already, the dictionary is small, or queries are not few against it. ``n`` bounds the queries, if that is known.
        """
        if self.path is None or "by key" in self._kept or queries.isStreaming or self.total < LAID_OUT:
            return None
        keys = queries.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("ckey"))
        n = keys.count() if n is None else n
        words = words_asked(n)
        if 4 * n > self.total or not words:
            return None
        spark = queries.sparkSession
        path = f"{self.path}/asked-{uuid.uuid4().hex}"
        shared = spark.sparkContext.broadcast(assembled(stored(filter_rows(keys, words), path), words))
        erase(spark, path)
        rows = expanded(self.spans, self.k, self.config.encoding, keep=lambda x: may_hold(shared.value, x))
        return _with_places(rows, self.k).drop("weight")

    def _bucketed_by_key(self) -> DataFrame:
        # a string has under 2^31 k-mers, so its length and a place in it are one number; what ids tell isn't stored
        low = F.lit((1 << 32) - 1)
        rows = self.kmers.select("ckey", F.shiftleft("kmer_id", 2).bitwiseOR(F.col("strand").cast("long") + 1).alias("at"), "string_id", F.shiftleft("kmer_id_in_string", 32).bitwiseOR(F.col("string_kmers")).alias("inside"))
        made = bucketed(rows, f"{self.path}/keys", "ckey", buckets_for(self.total))
        kmer_id = F.shiftright("at", 2)
        return made.select(kmer_id.alias("kmer_id"), "string_id", F.shiftright("inside", 32).alias("kmer_id_in_string"), (kmer_id + F.col("string_id") * (self.k - 1)).alias("kmer_offset"), F.col("inside").bitwiseAND(low).alias("string_kmers"), "ckey", (F.col("at").bitwiseAND(F.lit(3)) - 1).cast("int").alias("strand"))

    def weighted_spans(self) -> DataFrame:
        """(kmer_id, string_id, first_kmer_id, weights): the weights of k-mers with consecutive ids, from one on."""
        if self.spans is not None:
            return self.spans.select("kmer_id", "string_id", "first_kmer_id", "weights")
        return self.kmers.select("kmer_id", "string_id", (F.col("kmer_id") - F.col("kmer_id_in_string")).alias("first_kmer_id"), F.array("weight").alias("weights"))

    def _write_kmers(self, path: str, total: int) -> None:
        kmers = self.kmers.withColumn("first_kmer_id", F.col("kmer_id") - F.col("kmer_id_in_string"))
        bucketed(kmers.select("kmer_id", "string_id", "first_kmer_id", "string_kmers", "ckey", "strand", "weight"), f"{path}/kmers", "ckey", buckets_for(total))

    def _write_rest(self, path: str, total: int) -> None:
        """The filter of keys, where there is one of use, and the parameters."""
        spark, words = self.kmers.sparkSession, words_for(total)
        if words:
            stored(filter_rows(self.kmers, words), f"{path}/filter")
        spark.createDataFrame([(json.dumps(self.config.as_dict() | {"buckets": buckets_for(total), "filter_words": words, "spans": self.spans is not None}),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    def key_filter(self):
        """``keep`` for packed windows: a test that is false only for keys that the dictionary doesn't hold. None without a filter."""
        if not self.filter_words:
            return None
        spark = self.kmers.sparkSession

        def rows() -> DataFrame:
            if self.path is not None:
                return stored(filter_rows(self.by_key, self.filter_words), self.filter_path)
            return spark.read.schema("row long, words binary").parquet(self.filter_path)

        shared = self.kept("filter", lambda: spark.sparkContext.broadcast(assembled(rows(), self.filter_words)))
        return lambda keys: may_hold(shared.value, keys)

    def save(self, path: str) -> None:
        """Writes the tables, k-mers in buckets of their keys, and the parameters with the version."""
        total = self.kmers.count()
        self._write_kmers(path, total)
        if self.spans is not None:
            stored(self.spans, f"{path}/spans")
        self.strings.repartitionByRange("string_id").sortWithinPartitions("string_id").write.mode("overwrite").parquet(f"{path}/strings")
        self._write_rest(path, total)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """A saved dictionary; another major version is an error."""
        found = json.loads(spark.read.parquet(f"{path}/metadata").first()["config"])
        version, buckets, words = found.pop("version"), found.pop("buckets", 1), found.pop("filter_words", 0)
        spans = spark.read.parquet(f"{path}/spans") if found.pop("spans", False) else None
        if version[0] != VERSION[0]:
            raise ValueError(f"dictionary of version {version}, but this is {list(VERSION)}")
        config = Config(**found)
        return cls(_with_places(bucketed_at(spark, f"{path}/kmers", "ckey", buckets), config.k), spark.read.parquet(f"{path}/strings"), config, words, f"{path}/filter", spans)

    # ---- point queries -----------------------------------------------------------------------------

    @property
    def k(self) -> int:
        return self.config.k

    def kmer_strings(self) -> Column:
        return S.stored_kmer(F.col("ckey"), F.col("strand"), self.k, self.config.encoding)

    def kmer_table(self) -> DataFrame:
        """(kmer_id, string_id, kmer_id_in_string, kmer_offset, kmer, weight) of all k-mers, read off the spans where there are such."""
        if self.spans is None:
            return self.kmers.select("kmer_id", "string_id", "kmer_id_in_string", "kmer_offset", self.kmer_strings().alias("kmer"), "weight")
        inside, offset = F.col("kmer_id") - F.col("first_kmer_id"), F.col("kmer_id") + F.col("string_id") * (self.k - 1)
        return spelled(self.spans, self.k).select("kmer_id", "string_id", inside.alias("kmer_id_in_string"), offset.alias("kmer_offset"), "kmer", "weight")

    def _orientation(self, query_strand: Column) -> Column:
        both = query_strand * F.col("strand")
        return F.when(both == 0, -1 if self.config.canonical else 1).otherwise(both).cast("int")

    def keyed(self, df: DataFrame, kmer_col: str = "kmer") -> DataFrame:
        """``df`` with ``__key`` and ``__strand``; both null for anything but k valid bases."""
        s = F.when(S.is_valid(F.col(kmer_col)) & (F.length(kmer_col) == self.k), F.col(kmer_col))
        return df.withColumns({"__key": S.key_of(s, self.k, self.config.encoding), "__strand": S.strand_of(s, self.k, self.config.encoding)})

    def lookup_keyed(self, df: DataFrame, check_rc: bool = True) -> DataFrame:
        """``df`` with ``__key`` and ``__strand`` replaced by the lookup result."""
        few = self.among(df, "__key")
        stored_ = (self.by_key if few is None else few).withColumnRenamed("ckey", "__key").drop("weight")
        found = df.join(stored_, "__key", "left")
        orientation = self._orientation(F.col("__strand"))
        hit = F.col("kmer_id").isNotNull()
        if not check_rc and not self.config.canonical:
            hit = hit & (orientation == 1)
        begin = F.col("kmer_offset") - F.col("kmer_id_in_string")
        values = {"kmer_id": F.col("kmer_id"), "kmer_id_in_string": F.col("kmer_id_in_string"), "kmer_offset": F.col("kmer_offset"), "kmer_orientation": orientation, "string_id": F.col("string_id"), "string_begin": begin, "string_end": begin + F.col("string_kmers") + (self.k - 1)}
        own = [c for c in df.columns if c not in ("__key", "__strand")]
        return found.select(*own, *(F.when(hit, values[c]).alias(c) for c in RESULT))

    def lookup(self, df: DataFrame, kmer_col: str = "kmer", check_rc: bool = True) -> DataFrame:
        """``df`` with id, place, strand and string of each k-mer. ``check_rc=False`` finds stored strands only, in regular mode."""
        return self.lookup_keyed(self.keyed(df, kmer_col), check_rc)

    def members(self, df: DataFrame, kmer_col: str = "kmer", present: bool = True, check_rc: bool = True) -> DataFrame:
        """The rows whose k-mer is, or is not, in the dictionary; ``check_rc=False`` counts stored strands only, in regular mode."""
        keyed = self.keyed(df, kmer_col)
        few = self.among(keyed, "__key")
        keys = (self.by_key if few is None else few).select(F.col("ckey").alias("__ckey"), F.col("strand").alias("__stored"))
        same = keyed["__key"] == keys["__ckey"]
        if not check_rc and not self.config.canonical:
            same = same & (keyed["__strand"] * keys["__stored"] >= 0)
        return keyed.join(keys, same, "left_semi" if present else "left_anti").select(df.columns)

    def _of_ids(self, df: DataFrame, id_col: str, block: int = 1 << 10) -> DataFrame:
        """``df`` with k-mer and weight of each id, null outside [0, n): an interval join with ids and spans cut into blocks of ids; without spans, a join with the k-mers."""
        if self.spans is None:
            stored_ = self.kmers.select(F.col("kmer_id").alias("__id"), F.col("ckey").alias("__ckey"), F.col("strand").alias("__stored"), F.col("weight").alias("__weight"))
            return df.join(stored_, F.col(id_col) == F.col("__id"), "left").select(*df.columns, self._stored_kmer().alias("__kmer"), "__weight")
        first, end = F.col("kmer_id"), F.col("kmer_id") + F.size("weights")
        spread = self.spans.select(first.alias("__first"), end.alias("__end"), F.col("bases").cast("binary").alias("__bases"), F.col("weights").alias("__weights"), F.explode(F.sequence(F.floor(first / block), F.floor((end - 1) / block))).alias("__block"))
        begin, stop = F.greatest(F.col("__first"), F.col("__block") * block), F.least(F.col("__end"), (F.col("__block") + 1) * block)
        at, size = (begin - F.col("__first") + 1).cast("int"), (stop - begin).cast("int")
        spread = spread.select("__block", begin.alias("__begin"), stop.alias("__stop"), F.substring("__bases", at, size + (self.k - 1)).alias("__part"), F.slice("__weights", at, size).alias("__some"))
        left = df.withColumn("__of", F.floor(F.col(id_col) / block))
        inside = (left["__of"] == spread["__block"]) & (spread["__begin"] <= left[id_col]) & (left[id_col] < spread["__stop"])
        place = (left[id_col] - F.col("__begin") + 1).cast("int")
        return left.join(spread, inside, "left").select(*(left[c] for c in df.columns), F.substring("__part", place, F.lit(self.k)).cast("string").alias("__kmer"), F.element_at("__some", place).alias("__weight"))

    def _stored_kmer(self) -> Column:
        return S.stored_kmer(F.col("__ckey"), F.col("__stored"), self.k, self.config.encoding)

    def access(self, df: DataFrame, id_col: str = "kmer_id", block: int = 1 << 10) -> DataFrame:
        """``df`` with the k-mer of each id, on its stored strand; null outside [0, n).

        Read off the strings, which are a small part of the k-mers: an interval join with ids and strings cut into blocks of ids.
        """
        first, end = F.col("first_kmer_id"), F.col("first_kmer_id") + F.col("num_kmers")
        spread = self.strings.select(first.alias("__first"), end.alias("__end"), F.col("seq").cast("binary").alias("__seq"), F.explode(F.sequence(F.floor(first / block), F.floor((end - 1) / block))).alias("__block"))
        begin = F.greatest(F.col("__first"), F.col("__block") * block)
        stop = F.least(F.col("__end"), (F.col("__block") + 1) * block)
        part = F.substring("__seq", (begin - F.col("__first") + 1).cast("int"), (stop - begin + (self.k - 1)).cast("int"))
        spread = spread.select("__block", begin.alias("__begin"), stop.alias("__stop"), part.alias("__part"))
        left = df.withColumn("__of", F.floor(F.col(id_col) / block))
        inside = (left["__of"] == spread["__block"]) & (spread["__begin"] <= left[id_col]) & (left[id_col] < spread["__stop"])
        kmer = F.substring("__part", (left[id_col] - F.col("__begin") + 1).cast("int"), F.lit(self.k)).cast("string")
        return left.join(spread, inside, "left").select(*(left[c] for c in df.columns), kmer.alias("kmer"))

    def weights(self, df: DataFrame, id_col: str = "kmer_id") -> DataFrame:
        """``df`` with the weight of each id."""
        return self._of_ids(df, id_col).select(*df.columns, F.col("__weight").alias("weight"))

    def access_weighted(self, df: DataFrame, id_col: str = "kmer_id") -> DataFrame:
        """``df`` with the k-mer and weight of each id, by one join."""
        return self._of_ids(df, id_col).select(*df.columns, F.col("__kmer").alias("kmer"), F.col("__weight").alias("weight"))

    def locate(self, df: DataFrame, offset_col: str = "offset", block: int = 1 << 16) -> DataFrame:
        """``df`` with the string that holds each offset of bases, and the k-mer that begins there; null where there is none.

        An interval join with both sides cut into blocks of offsets.
        """
        first, last = F.floor(F.col("string_begin") / block), F.floor((F.col("string_end") - 1) / block)
        spread = self.strings.withColumn("__block", F.explode(F.sequence(first, last))).select("__block", "string_id", "string_begin", "string_end")
        left = df.withColumn("__block", F.floor(F.col(offset_col) / block))
        o = left[offset_col]
        inside = (left["__block"] == spread["__block"]) & (spread["string_begin"] <= o) & (o < spread["string_end"])
        found = left.join(spread, inside, "left")
        place = F.when(o + self.k <= spread["string_end"], o - spread["string_begin"])
        return found.select(*(left[c] for c in df.columns), "string_id", "string_begin", "string_end", place.alias("kmer_id_in_string"), (F.when(place.isNotNull(), o) - F.col("string_id") * (self.k - 1)).alias("kmer_id"))

    def encoded_offsets(self, relative_bits: int | None = None) -> DataFrame:
        """(string_id, string_begin, string_end, encoded): string and place in one number, the place in the low bits; and the bits of a place."""
        bits = self.relative_bits() if relative_bits is None else relative_bits
        return self.strings.select("string_id", "string_begin", "string_end", F.shiftleft("string_id", bits).alias("encoded"), F.lit(bits).alias("relative_bits"))

    def relative_bits(self) -> int:
        """How many bits the largest place in a string takes."""
        return max(1, int(self.strings.agg(F.max("len")).first()[0] or 1).bit_length())

    def decode_offsets(self, df: DataFrame, encoded_col: str = "encoded", relative_bits: int | None = None) -> DataFrame:
        """``df`` with absolute and relative offset, string, begin and end of encoded offsets; null for unknown strings."""
        bits = self.relative_bits() if relative_bits is None else relative_bits
        at = df.withColumns({"__string": F.shiftright(F.col(encoded_col), bits), "relative": F.col(encoded_col).bitwiseAND(F.lit((1 << bits) - 1))})
        known = self.strings.select("string_id", "string_begin", "string_end")
        return at.join(known, F.col("__string") == F.col("string_id"), "left").select(*df.columns, (F.col("string_begin") + F.col("relative")).alias("absolute"), "relative", "string_id", "string_begin", "string_end")

    def iterate(self, first_id: int = 0, string_id: int | None = None, backward: bool = False) -> DataFrame:
        """(kmer_id, kmer) from an id on, or of one string, in order of id; backward, the opposite strands in falling order."""
        order = F.desc("kmer_id") if backward else F.asc("kmer_id")
        if self.spans is None:
            rows = self.kmers.where(F.col("kmer_id") >= first_id)
        else:  # spans are put in order, which their k-mers keep
            rows = self.spans.where(F.col("kmer_id") + F.size("weights") > first_id)
        if string_id is not None:
            rows = rows.where(F.col("string_id") == string_id)
        if self.spans is None:
            rows = rows.orderBy(order)
        else:
            rows = expanded(rows.repartitionByRange(order).sortWithinPartitions(order), self.k, self.config.encoding, backward).where(F.col("kmer_id") >= first_id)
        kmer = self.kmer_strings()
        return rows.select("kmer_id", (S.reverse_complement(kmer) if backward else kmer).alias("kmer"))

    def string_ends(self) -> DataFrame:
        """Number of k-mers, offsets, and first and last k-1 bases of each string."""
        return self.strings.select("string_id", "num_kmers", "string_begin", "string_end", S.prefix(F.col("seq"), self.k).alias("string_prefix"), F.right(F.col("seq"), F.lit(self.k - 1)).alias("string_suffix"))

    def metadata(self) -> DataFrame:
        """One row: version, the minimizers' hash, parameters and counts."""
        s = self.strings.agg(F.coalesce(F.sum("num_kmers"), F.lit(0)).alias("num_kmers"), F.count("*").alias("num_strings"), F.sum("len").alias("num_bases"), F.max("len").alias("max_len"))
        c = self.config
        version = ".".join(map(str, VERSION))
        return s.select(F.lit(version).alias("version"), F.lit(HASHER).alias("hasher"), F.lit(c.k).alias("k"), F.lit(c.m).alias("m"), F.lit(c.canonical).alias("canonical"), F.lit(c.weighted).alias("weighted"), "num_kmers", "num_strings", "num_bases", "max_len")

    # ---- navigation --------------------------------------------------------------------------------

    def neighbours(self, df: DataFrame, kmer_col: str = "kmer", forward: bool = True, backward: bool = True, check_rc: bool = True) -> DataFrame:
        """A row for each of the four bases and each direction, found or not, with ``direction``, ``slot`` and ``base``."""
        steps = self._packed_steps if self.k <= 31 else self._spelled_steps
        rows = steps(df, kmer_col, ["forward"] * forward + ["backward"] * backward)
        found = self.lookup_keyed(rows, check_rc)
        return found.select(*df.columns, "direction", "slot", "base", "neighbour", *RESULT)

    def _spelled_steps(self, df: DataFrame, kmer_col: str, directions: list[str]) -> DataFrame:
        base = F.upper(F.col(kmer_col))
        move = {"forward": S.append_base, "backward": S.prepend_base}
        steps = F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(i).alias("slot"), F.lit(c).alias("base"), move[d](base, F.lit(c)).alias("neighbour")) for d in directions for i, c in enumerate(self.config.alphabet)))
        rows = df.withColumn("__step", F.explode(steps)).select(*df.columns, "__step.*")
        return self.keyed(rows, "neighbour")

    def _packed_steps(self, df: DataFrame, kmer_col: str, directions: list[str]) -> DataFrame:
        """Both packed strands of a k-mer are made once; its neighbours' are shifts of them by a base, each with the new base or its complement."""
        mask, top = F.lit((1 << 2 * self.k) - 1), 2 * (self.k - 1)
        valid = F.when(S.is_valid(F.col(kmer_col)) & (F.length(kmer_col) == self.k), F.upper(F.col(kmer_col)))
        pack = lambda s: S.pack(s, self.config.encoding)
        rows = df.withColumns({"__upper": F.upper(F.col(kmer_col)), "__x": pack(valid), "__r": pack(S.reverse_complement(valid))})
        x, r = F.col("__x"), F.col("__r")
        # a neighbour is valid if what it keeps of the k-mer is; where one base is not, the packed strands of the rest are made for it
        move = {"forward": S.append_base, "backward": S.prepend_base}

        def step(direction: str, slot: int, base: str) -> Column:
            code = self.config.alphabet.index(base)
            other = code ^ COMPLEMENT[self.config.encoding]
            if direction == "forward":
                ahead, back = F.shiftright(x, 2).bitwiseOR(F.lit(code << top)), F.shiftleft(r, 2).bitwiseAND(mask).bitwiseOR(F.lit(other))
            else:
                ahead, back = F.shiftleft(x, 2).bitwiseAND(mask).bitwiseOR(F.lit(code)), F.shiftright(r, 2).bitwiseOR(F.lit(other << top))
            spelled = move[direction](F.col("__upper"), F.lit(base))
            return F.struct(F.lit(direction).alias("direction"), F.lit(slot).alias("slot"), F.lit(base).alias("base"), spelled.alias("neighbour"), ahead.cast("bigint").alias("ahead"), back.cast("bigint").alias("back"))

        steps = F.array(*(step(d, i, c) for d in directions for i, c in enumerate(self.config.alphabet)))
        rows = rows.withColumn("__step", F.explode(steps)).select(*df.columns, "__x", "__step.*")
        late = F.when(F.col("__x").isNull() & S.is_valid(F.col("neighbour")) & (F.length("neighbour") == self.k), F.col("neighbour"))
        ahead, back = F.coalesce("ahead", pack(late)), F.coalesce("back", pack(S.reverse_complement(late)))
        rows = rows.withColumns({"ahead": ahead, "back": back})
        strand = F.when(F.col("ahead") == F.col("back"), 0).when(F.col("ahead") < F.col("back"), 1).otherwise(-1).cast("int")
        return rows.select(*df.columns, "direction", "slot", "base", "neighbour", F.least("ahead", "back").alias("__key"), F.when(F.col("ahead").isNotNull(), strand).alias("__strand"))

    def string_neighbours(self, check_rc: bool = True) -> DataFrame:
        """Backward neighbours of each string's first k-mer and forward ones of its last."""
        k = self.k
        ends = self.strings.select("string_id", F.left(F.col("seq"), F.lit(k)).alias("head"), F.right(F.col("seq"), F.lit(k)).alias("tail"))
        ends = ends.withColumnRenamed("string_id", "from_string")
        back = self.neighbours(ends.select("from_string", F.col("head").alias("kmer")), forward=False, check_rc=check_rc)
        ahead = self.neighbours(ends.select("from_string", F.col("tail").alias("kmer")), backward=False, check_rc=check_rc)
        return back.union(ahead)

    def check(self) -> dict[str, int]:
        """Counts of broken invariants, all 0 for a sound dictionary: ids dense, access and lookup inverse, strings whole."""
        n = self.kmers.count()
        ids = self.kmers.agg(F.countDistinct("kmer_id").alias("d"), F.min("kmer_id").alias("a"), F.max("kmer_id").alias("b")).first()
        back = self.lookup(self.kmers.select(F.col("kmer_id").alias("id"), self.kmer_strings().alias("kmer")))
        wrong = back.where("kmer_id is null or kmer_id <> id or kmer_orientation <> 1" if not self.config.canonical else "kmer_id is null or kmer_id <> id").count()
        spelled = self.kmers.join(self.strings.select("string_id", "seq"), "string_id").where(F.substring(F.col("seq"), (F.col("kmer_id_in_string") + 1).cast("int"), F.lit(self.k)) != self.kmer_strings()).count()
        # the next k-mer of a string is a forward neighbour of the one before, and the string's bases tell it too
        step = self.kmers.join(self.kmers.select((F.col("kmer_id") - 1).alias("kmer_id"), F.col("string_id").alias("s2"), self.kmer_strings().alias("ahead")), "kmer_id").where("s2 = string_id")
        broken = step.where(F.right(self.kmer_strings(), F.lit(self.k - 1)) != F.left("ahead", F.lit(self.k - 1))).count()
        # k-mers across the end of a string and a changed last base: what is found must be stored elsewhere too
        turned = self.kmers.select(F.concat(F.left(self.kmer_strings(), F.lit(self.k - 1)), F.translate(F.right(self.kmer_strings(), F.lit(1)), "ACGT", "CGTA")).alias("kmer"))
        absent = turned.select("kmer", S.canonical(F.col("kmer")).alias("c")).join(self.kmers.select(S.canonical(self.kmer_strings()).alias("c")), "c", "left_anti").select("kmer")
        negative = self.lookup(absent).where("kmer_id is not null").count()
        return {"ids": 0 if n == 0 else int(ids["d"] != n or ids["a"] != 0 or ids["b"] != n - 1), "lookup": wrong, "strings": spelled, "navigation": broken, "negative": negative}
