"""First places of k-mers from bins of minimizers, and what a build moves and writes."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandix.config import Config
from strandix.operators import firsts
from strandix.operators import weights as W
from strandix.operators.dictionary import Dictionary

RC = str.maketrans("ACGT", "TGCA")


def windows(seqs, k):
    for place, s in seqs:
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            if set(x) <= set("ACGT"):
                yield place + i, min(x, x[::-1].translate(RC))


def pieces():
    r = random.Random(3)
    rows, place = [], 0
    base = "".join(r.choice("ACGT") for _ in range(300))
    for s in ["".join(r.choice("ACGTN" if i % 60 == 0 else "ACGT") for i in range(r.randint(1, 400))) for _ in range(8)] + [base, base[::-1].translate(RC), base[20:200], "A" * 500, "AC" * 200]:
        rows.append((place, s))
        place += len(s) + 1
    return rows


@pytest.mark.parametrize("k", [1, 4, 15, 31, 32, 63])
def test_first_places_of_small_bins(spark, monkeypatch, k):
    """Classes of more windows than a bin's are split by keys, and what is held of a bin is made distinct as it grows."""
    monkeypatch.setattr(firsts, "BIN_WINDOWS", 50)
    monkeypatch.setattr(firsts, "HELD", 100)
    rows = pieces()
    seen, first = Counter(), {}
    for place, x in windows(rows, k):
        seen[x] += 1
        first.setdefault(x, place)
    df = spark.createDataFrame([(p, s.encode()) for p, s in rows], "place long, seq binary").repartition(5)
    got = {}
    for row in firsts.first_places(df, k, "default", 6).collect():
        inside = np.cumsum(np.frombuffer(row.firsts, "<u4")).tolist()
        times = dict(zip(np.frombuffer(row.repeated, "<u4").tolist(), np.frombuffer(row.times, np.int64).tolist(), strict=True))
        got.update({row.group * 64 + p: times.get(i, 1) for i, p in enumerate(inside)})
    assert got == {place: seen[x] for x, place in first.items()}
    assert tuple(firsts.count_kmers(df, k).first()) == (sum(seen.values()), len(seen))


def test_bins_are_bounded():
    counts = np.array([0, 5, 30, 100, 2, 7, 10**6, 9, 0, 45])
    first, splits = firsts.dealt(counts, 40)
    size = Counter()
    for c, b, s in zip(counts.tolist(), first.tolist(), splits.tolist(), strict=True):
        for i in range(s):
            size[b + i] += c / s
    assert max(size.values()) <= 80


def test_counts_of_nothing(spark):
    df = spark.createDataFrame([(0, b"ACG"), (9, b"NNNNNNNNN")], "place long, seq binary")
    assert tuple(firsts.count_kmers(df, 5).first()) == (None, 0)


def test_keys_are_laid_out_for_lookups_only(spark):
    """Strings, weights, ids and order are read off the spans: a build writes no row a k-mer, and no filter."""
    r = random.Random(8)
    seqs = ["".join(r.choice("ACGT") for _ in range(2_000)) for _ in range(20)]
    d = Dictionary.build(spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string"), Config(k=31, m=20))
    n = sum(len(s) - 30 for s in seqs)
    ids = spark.createDataFrame([(5,), (n - 1,), (n,)], "kmer_id long")
    assert d.strings.count() == 20 and d.metadata().first().num_kmers == n
    assert [(x.kmer, x.weight) for x in d.access_weighted(ids).orderBy("kmer_id").collect()] == [(seqs[0][5:36], 1), (seqs[-1][-31:], 1), (None, None)]
    assert [x.kmer for x in d.iterate(first_id=n - 3).collect()] == [seqs[-1][i : i + 31] for i in range(1967, 1970)]
    assert [x.kmer_id for x in d.iterate(backward=True).collect()] == list(range(n - 1, -1, -1))
    assert W.global_runs(d).collect()[0][1:] == (0, n, 1) and W.weight_frequencies(d).first() == (1, n)
    at = d.path.removeprefix("file://")
    assert sorted(os.listdir(at)) == ["spans", "strings"]
    assert sum(os.path.getsize(os.path.join(a, f)) for a, _, b in os.walk(at) for f in b) < 2 * n
    assert d.lookup(spark.createDataFrame([(seqs[3][7:38],)], "kmer string")).first().kmer_id_in_string == 7
    assert "keys" in os.listdir(at)
    assert d.kmers.agg(F.sum("weight")).first()[0] == n


@pytest.mark.parametrize("k", [1, 31, 32, 63])
def test_keys_of_some_windows(k):
    """Keys are made of the windows that are asked for, wherever these lie, and of none."""
    r = np.random.default_rng(4)
    codes = r.integers(0, 4, 2_000).astype(np.uint8)
    keys, _ = firsts.pack_windows(codes, k, 2)
    for at in (np.arange(len(keys)), np.array([0]), np.array([5, 6, 7, 8 + k, len(keys) - 1]), np.flatnonzero(r.random(len(keys)) < 0.3), np.zeros(0, np.int64)):
        assert firsts._keys_at(codes, at, k, 2).tolist() == keys[at].tolist()
