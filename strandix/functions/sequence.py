"""Scalar functions on sequences, as Column expressions that stay in generated JVM code.

Sequences are strings; lower case counts as upper case. Packed k-mers hold two bits a base, the first base lowest. A null
gives a null throughout; packing is defined for valid sequences only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALPHABETS

DNA = r"\A[ACGTacgt]+\z"
PROTEIN = r"\A[A-Za-z]+\z"


def is_valid(s: Column, alphabet: str = "dna") -> Column:
    """Whether every character belongs to the alphabet; an empty sequence is not valid."""
    return s.rlike(DNA if alphabet == "dna" else PROTEIN)


def reverse_complement(s: Column) -> Column:
    """The opposite strand, letter case kept."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def canonical(s: Column) -> Column:
    """The smaller, as a string, of a sequence and its opposite strand."""
    s = F.upper(s)
    return F.least(s, reverse_complement(s))


def is_palindrome(s: Column) -> Column:
    return F.upper(s) == reverse_complement(F.upper(s))


def char_code(c: Column, encoding: str = "default") -> Column:
    """The two-bit code of one base."""
    return (F.instr(F.lit(ALPHABETS[encoding]), F.upper(c)) - 1).cast("int")


def code_char(x: Column, encoding: str = "default") -> Column:
    return F.substring(F.lit(ALPHABETS[encoding]), x + 1, F.lit(1))


def _digits(s: Column, encoding: str) -> Column:
    return F.reverse(F.translate(F.upper(s), ALPHABETS[encoding], "0123"))


def pack(s: Column, encoding: str = "default") -> Column:
    """Up to 31 bases as a number."""
    return F.conv(_digits(s, encoding), 4, 10).cast("bigint")


def unpack(x: Column, k: int, encoding: str = "default") -> Column:
    """The k bases of a packed number."""
    return F.translate(F.reverse(F.lpad(F.conv(x.cast("string"), 10, 4), k, "0")), "0123", ALPHABETS[encoding])


def pack_wide(s: Column, encoding: str = "default") -> Column:
    """Up to 63 bases as 16 bytes, most significant first."""
    half = lambda part: F.lpad(F.conv(F.concat(F.lit("0"), _digits(part, encoding)), 4, 16), 16, "0")
    return F.unhex(F.concat(half(F.substring(s, 33, 31)), half(F.substring(s, 1, 32))))


def unpack_wide(x: Column, k: int, encoding: str = "default") -> Column:
    """The k bases, more than 31, of 16 packed bytes."""
    half = lambda at, n: F.reverse(F.lpad(F.conv(F.concat(F.lit("0"), F.substring(F.hex(x), at, 16)), 16, 4), n, "0"))
    digits = F.concat(half(17, 32), half(1, k - 32)) if k > 32 else half(17, 32)
    return F.translate(digits, "0123", ALPHABETS[encoding])


def stored_kmer(key: Column, strand: Column, k: int, encoding: str = "default") -> Column:
    """The k-mer in the orientation in which it was stored under its key."""
    s = unpack(key, k, encoding) if k <= 31 else unpack_wide(key, k, encoding)
    return F.when(strand >= 0, s).otherwise(reverse_complement(s))


def key_of(s: Column, k: int, encoding: str = "default") -> Column:
    """The key under which a k-mer and its opposite strand are stored: the smaller of the packed two."""
    p = pack if k <= 31 else pack_wide
    return F.least(p(s, encoding), p(reverse_complement(s), encoding))


def strand_of(s: Column, k: int, encoding: str = "default") -> Column:
    """1 if the k-mer itself is the smaller of its packed strands, -1 if the other is, 0 for a palindrome."""
    p = pack if k <= 31 else pack_wide
    a, b = p(s, encoding), p(reverse_complement(s), encoding)
    return F.when(a == b, 0).when(a < b, 1).otherwise(-1).cast("int")


def prefix(s: Column, k: int) -> Column:
    """The first k-1 bases."""
    return F.substring(s, 1, k - 1)


def suffix(s: Column, k: int) -> Column:
    """The last k-1 bases of a k-mer."""
    return F.substring(s, 2, k - 1)


def base_at(s: Column, i: int | Column) -> Column:
    return F.substring(s, (F.lit(i) if isinstance(i, int) else i) + 1, F.lit(1))


def kmer_at(s: Column, pos: Column, k: int) -> Column:
    """The k bases from a 0-based position."""
    return F.substring(s, pos + 1, F.lit(k))


def append_base(s: Column, c: Column) -> Column:
    """Drops the first base and appends one."""
    return F.concat(F.substring(s, F.lit(2), F.length(s) - 1), c)


def prepend_base(s: Column, c: Column) -> Column:
    """Prepends a base and drops the last."""
    return F.concat(c, F.substring(s, F.lit(1), F.length(s) - 1))


def set_base(s: Column, i: int, c: Column) -> Column:
    return F.concat(F.substring(s, 1, i), c, F.substring(s, F.lit(i + 2), F.length(s)))


def take_bases(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def drop_bases(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(n + 1), F.length(s))


def reversed_weights(header: Column) -> Column:
    """A weighted FASTA header with its list of weights in the opposite order."""
    head = F.regexp_extract(header, r"^(.*ab:Z:)", 1)
    weights = F.split(F.trim(F.regexp_extract(header, r"ab:Z:(.*)$", 1)), " ")
    return F.concat(head, F.array_join(F.reverse(weights), " "))


def random_kmer(k: int, seed: int) -> Column:
    """k random bases a row."""
    return F.concat(*(F.substring(F.lit("ACGT"), (F.floor(F.rand(seed * 1000 + i) * 4) + 1).cast("int"), F.lit(1)) for i in range(k)))


def dna_of(text: Column) -> Column:
    """A DNA-like sequence from any text: letters become bases in turn, digits N, the rest goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), "abcdefghijklmnopqrstuvwxyz0123456789", "ACGT" * 6 + "AC" + "N" * 10)


# ---- packed k-mers of up to 31 bases, the first base lowest


def packed_at(x: Column, i: int) -> Column:
    """The code of base i."""
    return F.shiftright(x, 2 * i).bitwiseAND(F.lit(3)).cast("int")


def packed_take(x: Column, n: int) -> Column:
    """The first n bases."""
    return x.bitwiseAND(F.lit((1 << 2 * n) - 1))


def packed_drop(x: Column, n: int) -> Column:
    """All but the first n bases."""
    return F.shiftrightunsigned(x, 2 * n)


def packed_pad(x: Column, code: Column) -> Column:
    """One more base in front; the k-mer grows."""
    return F.shiftleft(x, 2).bitwiseOR(code.cast("bigint"))


def packed_append(x: Column, code: Column, size: int) -> Column:
    """One more base behind the ``size`` there are; the k-mer grows."""
    return x.bitwiseOR(F.shiftleft(code.cast("bigint"), 2 * size))


def packed_pop(x: Column) -> tuple[Column, Column]:
    """The first base's code, and the rest."""
    return packed_at(x, 0), packed_drop(x, 1)


def packed_set(x: Column, i: int, code: Column) -> Column:
    """Base i replaced."""
    return x.bitwiseAND(F.lit(~(3 << 2 * i))).bitwiseOR(F.shiftleft(code.cast("bigint"), 2 * i))


def minimizer_string(x: Column, m: int) -> Column:
    """The bases of a packed minimizer."""
    return unpack(x, m)


def same_result(left: str, right: str) -> Column:
    """Whether two lookup results, struct columns, agree: both missing, or in all but the offset of the k-mer."""
    fields = ("kmer_id", "kmer_id_in_string", "kmer_orientation", "string_id", "string_begin", "string_end")
    agree = F.lit(True)
    for f in fields:
        agree = agree & (F.col(f"{left}.{f}") == F.col(f"{right}.{f}"))
    none = F.col(f"{left}.kmer_id").isNull() & F.col(f"{right}.kmer_id").isNull()
    return none | F.coalesce(agree, F.lit(False))
