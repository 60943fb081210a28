"""Degrees of k-mers against brute force, and what their count moves."""

import os
import random
from collections import Counter

import pytest

from strandix.config import Config
from strandix.operators import degrees, firsts, kmerize
from strandix.operators.dictionary import Dictionary
from strandix.operators.statistics import degree_histogram

RC = str.maketrans("ACGT", "TGCA")


def brute(seqs, k):
    seen = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                seen.setdefault(min(w, w[::-1].translate(RC)), w)
    held = lambda w: min(w, w[::-1].translate(RC)) in seen
    return Counter((sum(held(w[1:] + c) for c in "ACGT"), sum(held(c + w[:-1]) for c in "ACGT")) for w in seen.values())


@pytest.mark.parametrize("k, encoding, small", [(1, "default", False), (2, "default", False), (4, "traditional", True), (7, "default", True), (31, "default", True), (33, "traditional", False), (34, "default", True), (63, "default", True)])
def test_degrees(spark, monkeypatch, k, encoding, small):
    """Short k-mers branch and meet themselves and their opposite strands; with ``small`` bins are split, and strings are cut."""
    r = random.Random(k)
    stem = "".join(r.choice("ACGT") for _ in range(400))
    seqs = [stem, stem[:150] + "".join(r.choice("ACGT") for _ in range(90)), stem[60:300][::-1].translate(RC) + "TTT", "A" * 80, "ACGT" * 30, "AT" * 50 + "N" + stem[200:390] + "G", "GC"]
    if small:
        monkeypatch.setattr(firsts, "BIN_WINDOWS", 40)
        monkeypatch.setattr(firsts, "SENT", 100)
        monkeypatch.setattr(firsts, "TURN_WINDOWS", 300)
        monkeypatch.setattr(degrees, "SENT", 50)
        monkeypatch.setattr(kmerize, "STEP", 70)
    d = Dictionary.build(spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string"), Config(k=k, m=min(k, 9), encoding=encoding))
    found = degree_histogram(d)
    assert {(x.forward_degree, x.backward_degree): x.num_kmers for x in found.collect()} == dict(brute(seqs, k))
    if k > 1:  # no k-mer is looked up, so none is laid out
        assert "keys" not in os.listdir(d.path.removeprefix("file://")) and "Join" not in found._jdf.queryExecution().toString()


def test_degrees_of_nothing(spark):
    assert degrees.degree_counts(spark.createDataFrame([], "string_begin long, seq string"), 31).collect() == []
