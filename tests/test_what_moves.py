"""What builds, lookups and super-k-mers move and leave behind."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandix.config import Config
from strandix.operators import dictionary as of_dictionary
from strandix.operators import blocks, firsts, kmerize, minimizers
from strandix.operators import reads as R
from strandix.functions.sequence import dna_of
from strandix.operators.dictionary import Dictionary
from strandix.plans.inputs import reads_of
from strandix.sources import storage

RC = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(12)
    return ["".join(r.choice("ACGT") for _ in range(3_000)) for _ in range(12)]


def built(spark, seqs, **more):
    return Dictionary.build(spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string"), Config(k=31, m=9, **more))


def test_few_lookups_write_no_row_a_kmer(spark, seqs, monkeypatch):
    """Where few k-mers are asked for, those of the dictionary that can match come through a filter: keys aren't laid out."""
    monkeypatch.setattr(of_dictionary, "LAID_OUT", 1)
    monkeypatch.setattr(R, "LAID_OUT", 1)
    d = built(spark, seqs)
    words = [seqs[3][7:38], seqs[5][100:131][::-1].translate(RC), "ACGT" * 7 + "ACG", "N" * 31, None]
    got = {x.kmer: x for x in d.lookup(spark.createDataFrame([(x,) for x in words], "kmer string")).collect()}
    assert [got[w].kmer_id for w in words] == [3 * 2970 + 7, 5 * 2970 + 100, None, None, None]
    assert [got[w].kmer_orientation for w in words[:2]] == [1, -1]
    df = spark.createDataFrame([(x,) for x in words[:3]], "kmer string")
    assert {x.kmer for x in d.members(df).collect()} == set(words[:2]) and {x.kmer for x in d.members(df, present=False).collect()} == {words[2]}
    report = R.total_report(d, spark.createDataFrame([(0, seqs[1][50:400]), (1, None)], "read_id long, seq string")).first()
    assert tuple(report) == (320, 320, 0, 0, 1, 319)
    assert sorted(os.listdir(d.path.removeprefix("file://"))) == ["spans", "strings"]
    assert d.lookup(d.kmers.select(d.kmer_strings().alias("kmer"))).where("kmer_id is null").count() == 0  # many: laid out
    assert "keys" in os.listdir(d.path.removeprefix("file://"))


@pytest.mark.parametrize("canonical", [False, True])
def test_super_kmers_move_no_row_a_kmer(spark, seqs, monkeypatch, canonical):
    """Runs are found where their string is, and go on over the cuts of a long one."""
    d = built(spark, [*seqs[:4], "AC" * 300], canonical=canonical)
    rows = sorted(tuple(x) for x in minimizers.kmer_minimizers(d).collect())
    wanted = []
    for string, kmer, value, pos, at in rows:
        if wanted and (wanted[-1][0], wanted[-1][2], wanted[-1][3]) == (string, value, pos):
            wanted[-1][5] += 1
        else:
            wanted.append([string, kmer, value, pos, at, 1])
    monkeypatch.setattr(minimizers, "STEP", 50)
    found = minimizers.super_kmers(d)
    assert "Window" not in found._jdf.queryExecution().toString() and "Exchange" not in found._jdf.queryExecution().toString()
    assert sorted(map(list, (tuple(x) for x in found.collect()))) == wanted
    assert minimizers.minimizer_counts(d).first().max_super_kmer == max(x[5] for x in wanted)
    places = {}
    for _, _, value, pos, _, n in wanted:
        x = places.setdefault(value, [set(), 0, 0])
        x[0].add(pos)
        x[1] += n
        x[2] += 1
    sized = minimizers.buckets(d)
    assert sized._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # one row a minimizer of a batch moves, once
    assert {x.minimizer: (x.size, x.num_kmers, x.num_super_kmers) for x in sized.collect()} == {v: (len(p), n, s) for v, (p, n, s) in places.items()}


def test_texts_become_reads_a_batch_at_a_time(spark):
    """The kernel's bases are those of the column expression, which is evaluated for every use; so are the counts of windows."""
    texts = ["Az 09-bC", "\u0130\u212a\u00c5 stra\u00dfe", "", None, "\n".join(map(chr, range(32, 0x250)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = reads_of(df, "doc_id")
    wanted = df.select("doc_id", dna_of(F.col("text")))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, wanted.collect()))
    assert "RegExpReplace" not in rows._jdf.queryExecution().toString() and "regexp_replace" not in rows._jdf.queryExecution().toString()
    d = built(spark, ["ACGTTGCAAC" * 10])
    report = R.read_report(d, spark.createDataFrame([(0, "ACGTTGCAAC" * 4 + "N" + "acgttgcaac" * 5), (1, None), (2, "\u00e9" + "A" * 31), (3, "AC")], "read_id long, seq string"))
    assert {x.read_id: (x.num_kmers, x.num_kmers - x.num_invalid_kmers) for x in report.collect()} == {0: (61, 30), 1: (0, 0), 2: (2, 1), 3: (0, 0)}
    assert "regexp_replace" not in report._jdf.queryExecution().toString()


def test_squeezed_numbers():
    for x, dtype in (([], "<u4"), ([7], "<u4"), (list(range(0, 90_000, 7)), "<u4"), ([-5, 1 << 60, 0], "<i8")):
        data = kmerize.squeezed(np.array(x, dtype))
        assert kmerize.unsqueezed(data, dtype).tolist() == x
    ones = kmerize.squeezed(np.ones(100_000, "<u4"))
    assert len(ones) < 1_000  # first places that follow each other take next to nothing


def test_a_build_leaves_no_table_of_its_steps(spark, seqs):
    d = built(spark, seqs)
    assert sorted(os.listdir(d.path.removeprefix("file://"))) == ["spans", "strings"]


def test_sequences_are_laid_on_a_line_by_one_move(spark, seqs, monkeypatch):
    """However many sequences there are: bases meet the places of their sequences without a join that moves them."""
    plans = []

    def watched(stored):
        return lambda df, *a: (plans.append((dict(df.dtypes).get("seq"), df._jdf.queryExecution().executedPlan().toString())), stored(df, *a))[1]

    for module in (of_dictionary, blocks):
        monkeypatch.setattr(module, "stored", watched(module.stored))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = built(spark, seqs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [x.seq for x in d.strings.orderBy("string_id").collect()] == seqs
    moved = [plan for kind, plan in plans if kind == "binary"]
    assert moved and sum(plan.count("Exchange") for plan in moved) == 1


def test_a_sequence_goes_on_over_tasks(spark, tmp_path):
    """Places are those of one line, wherever its ranges are cut; sequences without an id have none."""
    r = random.Random(5)
    rows, wanted, place = [], {}, 0
    for at in (-7, 0, 3, 4, 1 << 40):
        size, pieces = 0, [r.randint(5, 60) for _ in range(r.choice((1, 40)))]
        for n in pieces:
            rows.append((at, size, bytes(r.choice(b"ACGTNx") for _ in range(n + 4))))
            wanted[at, size] = (place + size, rows[-1][2])
            size += n
        place += size + 4 + 1
    frame = spark.createDataFrame([*rows, (None, 0, b"ACGTACGT")], "id long, start long, seq binary").repartition(5)
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "9")):
        spark.conf.set(key, value)
    try:
        line = blocks.on_a_line(kmerize.squeezed_pieces(frame), f"file://{tmp_path}/line")
        got = {(x.id, x.start): (x.place, bytes(x.seq)) for x in line.collect()}
        parts = spark.read.parquet(f"file://{tmp_path}/line").select("part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == wanted and parts > 5
    assert blocks.on_a_line(kmerize.squeezed_pieces(frame.where("false")), f"file://{tmp_path}/none").count() == 0
    assert kmerize.unsqueezed_pieces(kmerize.squeezed_pieces(frame)).exceptAll(frame).count() == 0


def test_a_build_in_turns(spark, seqs, monkeypatch):
    """Stretches and bases of one turn are on disk at a time: turns have about the same share of both, and make together what one turn makes."""
    odd = [*seqs, seqs[0][500:900], seqs[1][::-1].translate(RC), "AC" * 400, "A" * 700 + "N" + "C" * 50]
    whole = built(spark, odd)
    monkeypatch.setattr(firsts, "BIN_WINDOWS", 700)
    monkeypatch.setattr(firsts, "TURN_WINDOWS", 10_000)
    monkeypatch.setattr(blocks, "BLOCK_BITS", 8)
    monkeypatch.setattr(blocks, "GROUP_BITS", 2)
    written = []

    def watched(df, path, *a):
        written.append((path.rpartition("/")[0].rpartition("/")[2], out := stored(df, path, *a)))
        return out

    stored = storage.stored
    monkeypatch.setattr(storage, "stored", watched)
    monkeypatch.setattr(of_dictionary, "erase", lambda *a: None)
    d = built(spark, odd)
    for name in ("strings", "spans"):
        assert getattr(d, name).selectExpr("count(*)").first()[0] > 0
    assert sorted(map(tuple, d.strings.collect())) == sorted(map(tuple, whole.strings.collect()))
    ordered = lambda x: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in row) for row in x.kmers.collect())
    assert ordered(d) == ordered(whole)
    for name, size in (("firsts", "octet_length(firsts)"), ("numbered", "size")):
        shares = [x.selectExpr(f"sum({size})").first()[0] for at, x in written if at == name]
        assert len(shares) == 4 and max(shares) < 0.4 * sum(shares)


def test_turns_deal_out_all_stretches(spark, seqs, monkeypatch):
    """Every window is in the stretches of one turn, split classes too; few windows take one turn."""
    monkeypatch.setattr(firsts, "BIN_WINDOWS", 700)
    rows = [(i * 4_000, x.encode()) for i, x in enumerate([*seqs[:5], "A" * 3_000])]
    df = spark.createDataFrame(rows, "place long, seq binary")
    counts = firsts.class_counts(df, 31, "default")
    bins, sizes = [], []
    for turn in range(3):
        part = firsts._stretches(df, 31, "default", counts, turn, 3).collect()
        bins += [{x.bin for x in part}]
        sizes += [sum(int(kmerize.unsqueezed(x.sizes, "<u4").sum()) for x in part)]
    assert sum(sizes) == counts.sum() == 6 * 2_970 and max(sizes) < 0.5 * sum(sizes)
    assert sum(map(len, bins)) == len(set.union(*bins)) > 6
    assert firsts.turns_for(counts) == 1 and firsts.turns_for(counts * 0) == 1
    assert firsts.turns_for(np.array([firsts.TURN_WINDOWS, 1])) == 2 and firsts.turns_for(np.array([1 << 40])) == firsts.MOST_TURNS
