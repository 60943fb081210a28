"""Reads that meet a dictionary in bins, against the join with its keys."""

import os
import random

import numpy as np
import pytest

from strandix.config import Config
from strandix.operators import firsts, kmerize, meeting
from strandix.operators import reads as R
from strandix.operators.dictionary import Dictionary

RC = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize("k, canonical", [(6, True), (31, False), (63, False)])
def test_many_reads_move_no_row_a_window(spark, monkeypatch, k, canonical):
    r = random.Random(k)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seqs = [word(700), word(300), "ACGT" * 40, "A" * 90, word(200)]
    texts = [seqs[0][40:500] + "N" + seqs[1][20:260], seqs[1][::-1].translate(RC), word(400) + seqs[0][300:420].lower(), "ACGT" * 50, "", None, "A" * 200, seqs[4][:k] + word(60), word(900)]
    rows = spark.createDataFrame([(10 * i, x) for i, x in enumerate(texts)], "read_id long, seq string")
    d = Dictionary.build(spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string"), Config(k=k, m=min(k, 9), canonical=canonical))
    pieces = spark.createDataFrame([(10 * i, at, x[at : at + 100 + k - 1]) for i, x in enumerate(texts) if x for at in range(0, len(x) - k + 1, 100)], "read_id long, start long, seq string")
    got = {}
    with monkeypatch.context() as m:
        m.setattr(R, "LAID_OUT", 1)
        m.setattr(R, "MANY", 0)
        m.setattr(firsts, "BIN_WINDOWS", 60)
        m.setattr(firsts, "SENT", 200)
        m.setattr(firsts, "TURN_WINDOWS", 1_000)
        m.setattr(meeting, "LOOKED_UP", 300)
        m.setattr(kmerize, "STEP", 130)
        for name, x in (("whole", rows), ("pieces", pieces)):
            got[name] = sorted(tuple(x) for x in R.positive_windows(d, x).collect())
        report = sorted(tuple(x) for x in R.read_report(d, rows).collect())
    assert sorted(os.listdir(d.path.removeprefix("file://"))) == ["spans", "strings"]  # no row a k-mer was laid out
    wanted = sorted(tuple(x) for x in R.positive_windows(d, rows).collect())
    assert len(wanted) > 300 and got["whole"] == got["pieces"] == wanted
    assert report == sorted(tuple(x) for x in R.read_report(d, rows).collect())


def test_keys_of_one_hash_are_told_apart(monkeypatch):
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 256, (60, 16), dtype=np.uint8), axis=0).reshape(-1).view("V16")
    asked = np.concatenate([keys[::-2], r.integers(0, 256, 160, dtype=np.uint8).view("V16"), keys[:5]])
    for bits in (64, 2):
        monkeypatch.setattr(meeting, "full_hashes", lambda x: firsts.full_hashes(x) >> np.uint64(64 - bits))
        found = meeting.finder(keys)(asked)
        assert (keys[found[: len(keys) // 2]] == keys[::-2]).all() and (found[-15:-5] == -1).all() and (found[-5:] == np.arange(5)).all()
    assert (meeting.finder(keys[:0])(asked) == -1).all()


def test_numbers_of_keys_of_one_hash(monkeypatch):
    keys = np.random.default_rng(4).integers(0, 2, (200, 16), dtype=np.uint8)
    keys[:, :14] = 0
    keys = keys.reshape(-1).view("V16")
    for full in (firsts.full_hashes, lambda x: np.zeros(len(x), np.uint64)):
        monkeypatch.setattr(firsts, "full_hashes", full)
        order, number, starts = firsts.numbered_keys(keys)
        assert len(starts) == 4 and [len(set(keys[order][number == i].tolist())) for i in range(4)] == [1] * 4 and (np.bincount(number).sum(), number[starts].tolist()) == (200, [0, 1, 2, 3])
