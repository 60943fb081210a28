"""The dictionary against the worked fixture, brute force and its own invariants."""

import random

import pytest
from pyspark.sql import functions as F

from strandix.config import Config
from strandix.functions import sequence as S
from strandix.operators import minimizers as M
from strandix.operators import reads as R
from strandix.operators import reorder as O
from strandix.operators import weights as W
from strandix.operators.dictionary import Dictionary, running_sums
from strandix.operators.kmerize import kmerize

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(RC)


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.createDataFrame([(0, "AACTG", [2, 2, 7]), (1, "GGATA", [7, 7, 1])], "sequence_id long, seq string, weights array<long>")
    return Dictionary.build(rows, Config(k=3, m=2, weighted=True))


def test_worked_fixture(small):
    got = small.kmers.select("kmer_id", small.kmer_strings().alias("kmer"), "string_id", "kmer_id_in_string", "kmer_offset", "weight").orderBy("kmer_id").collect()
    assert [tuple(r) for r in got] == [(0, "AAC", 0, 0, 0, 2), (1, "ACT", 0, 1, 1, 2), (2, "CTG", 0, 2, 2, 7), (3, "GGA", 1, 0, 5, 7), (4, "GAT", 1, 1, 6, 7), (5, "ATA", 1, 2, 7, 1)]
    assert [(r.string_begin, r.string_end) for r in small.strings.orderBy("string_id").collect()] == [(0, 5), (5, 10)]
    assert small.check() == {"ids": 0, "lookup": 0, "strings": 0, "navigation": 0, "negative": 0}


def test_weight_runs(small, spark):
    runs = W.global_runs(small).orderBy("run_id").collect()
    assert [(r.begin_kmer_id, r.end_kmer_id, r.weight) for r in runs] == [(0, 2, 2), (2, 5, 7), (5, 6, 1)]
    assert W.string_runs(small).count() == 4
    ids = spark.range(-1, 8).withColumnRenamed("id", "kmer_id")
    assert [r.weight for r in W.weight_of_ids(ids, W.global_runs(small)).orderBy("kmer_id").collect()] == [None, 2, 2, 7, 7, 7, 1, None, None]
    order, walks = O.permutation(W.endpoints(small))
    assert walks == 1 and order.count() == 2


def test_neighbours(small, spark):
    rows = small.neighbours(spark.createDataFrame([("ACT",)], "kmer string")).orderBy(F.desc("direction"), "slot").collect()
    assert [r.kmer_id for r in rows] == [None, None, None, 2, 0, None, None, None]


def test_reads(small, spark):
    reads = spark.createDataFrame([(0, "AACTGNGTTA"), (1, "TATCC"), (2, "AC"), (3, ""), (4, None), (5, "aactg")], "read_id long, seq string")
    got = {r.read_id: tuple(r)[1:] for r in R.read_report(small, reads).collect()}
    assert got[0] == (8, 4, 1, 3, 2, 2) and got[1] == (3, 3, 0, 0, 1, 2)
    assert got[2] == got[3] == got[4] == (0, 0, 0, 0, 0, 0) and got[5] == (3, 3, 0, 0, 1, 2)


def test_lookup_of_odd_values(small, spark):
    rows = spark.createDataFrame([("GTT", 1), ("aac", 2), ("ANC", 3), ("AA", 4), (None, 5), ("", 6), ("AAC\n", 7), ("TGG", 8)], "kmer string, string_id long")
    got = {r.query: (r.kmer_id, r.kmer_orientation) for r in small.lookup(rows.withColumnRenamed("string_id", "query")).collect()}
    assert got[1] == (0, -1) and got[2] == (0, 1)
    assert all(got[i] == (None, None) for i in (3, 4, 5, 6, 7, 8))
    forward = {r.query: r.kmer_id for r in small.lookup(rows.withColumnRenamed("string_id", "query"), check_rc=False).collect()}
    assert forward[1] is None and forward[2] == 0


def test_junction_is_absent(small, spark):
    assert small.members(spark.createDataFrame([("TGG",), ("CTG",)], "kmer string")).count() == 1


@pytest.mark.parametrize("k", [3, 4, 15, 31, 32, 63])
def test_against_sets(spark, k):
    r = random.Random(k)
    seqs = ["".join(r.choice("ACGTacgtN" if i % 3 else "ACGT") for _ in range(r.randint(0, 300))) for i in range(12)] + ["ACGT" * 20]
    rows = spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string")
    d = Dictionary.build(rows, Config(k=k, m=min(k, 5)))
    want, order = {}, []
    for s in seqs:
        s = s.upper()
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                key = min(w, rc(w))
                want[key] = want.get(key, 0) + 1
                if want[key] == 1:
                    order.append(w)
    got = d.kmers.select("kmer_id", d.kmer_strings().alias("kmer"), "weight").orderBy("kmer_id").collect()
    assert [g.kmer for g in got] == order
    assert [g.weight for g in got] == [want[min(w, rc(w))] for w in order]
    assert d.check() == {"ids": 0, "lookup": 0, "strings": 0, "navigation": 0, "negative": 0}
    hits = R.total_report(d, rows.withColumnRenamed("sequence_id", "read_id")).first()
    assert hits.num_positive_kmers == sum(want.values()) and hits.num_negative_kmers == 0


def test_empty_input(spark):
    d = Dictionary.build(spark.createDataFrame([], "sequence_id long, seq string"), Config(k=5, m=3))
    assert d.kmers.count() == 0 and d.strings.count() == 0
    assert R.total_report(d, spark.createDataFrame([(1, "ACGTACGT")], "read_id long, seq string")).first().num_positive_kmers == 0


def test_save_and_load(small, spark, tmp_path):
    small.save(f"file://{tmp_path}/d")
    back = Dictionary.load(spark, f"file://{tmp_path}/d")
    assert back.config == small.config and back.kmers.count() == 6
    assert [r.kmer for r in back.iterate(string_id=1).collect()] == ["GGA", "GAT", "ATA"]
    assert back.access(spark.createDataFrame([(4,), (9,)], "kmer_id long")).orderBy("kmer_id").collect()[0].kmer == "GAT"


@pytest.mark.parametrize("bad", [{"k": 0}, {"k": 64}, {"k": 5, "m": 6}, {"k": 40, "m": 32}, {"encoding": "other"}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTacgtAA",), ("TTTT",), ("G",)], "s string")
    row = df.select(S.reverse_complement(F.col("s")).alias("r"), S.unpack(S.pack(F.col("s")), 4).alias("u"), S.is_palindrome(F.col("s")).alias("p")).collect()
    assert row[0].r == "TTacgtACGT" and row[1].u == "TTTT" and not row[2].p
    wide = "ACGTTGCA" * 7 + "ACGTTGC"
    assert spark.createDataFrame([(wide,)], "s string").select(S.unpack_wide(S.pack_wide(F.col("s")), 63).alias("u")).first().u == wide
    header = spark.createDataFrame([(">12 LN:i:5 ab:Z:1 2 3",)], "h string")
    assert header.select(S.reversed_weights(F.col("h")).alias("h")).first().h == ">12 LN:i:5 ab:Z:3 2 1"


def test_running_sums(spark):
    r = random.Random(2)
    data = sorted((r.randint(-(10**6), 10**6), r.randint(0, 9)) for _ in range(300))
    data = list({k: v for k, v in data}.items())
    got = {x.key: x.before for x in running_sums(spark.createDataFrame(data, "key long, n long"), "key", {"n": "before"}).collect()}
    total = 0
    for key, n in sorted(data):
        assert got[key] == total
        total += n


def test_super_kmers_cover(spark):
    r = random.Random(9)
    rows = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(120))) for i in range(5)], "sequence_id long, seq string")
    for canonical in (False, True):
        d = Dictionary.build(rows, Config(k=13, m=5, canonical=canonical))
        supers = M.super_kmers(d)
        assert supers.agg(F.sum("num_kmers")).first()[0] == d.kmers.count()
        assert M.bucket_histogram(d).agg(F.sum("num_kmers")).first()[0] == d.kmers.count()


def test_windows_of_extra_columns(spark):
    df = spark.createDataFrame([(1, "ACGTA", "x", 5)], "read_id long, seq string, ckey string, pos int")
    assert kmerize(df, "read_id", "seq", 3).count() == 3


@pytest.mark.parametrize("seed", range(40))
def test_trails_use_each_edge_once(seed):
    r = random.Random(seed)
    edges = [(i, r.randint(1, 6), r.randint(1, 6)) for i in range(r.randint(0, 25))]
    walks = O.trails(edges)
    ends = {i: (a, b) for i, a, b in edges}
    assert sorted(i for w in walks for i, _ in w) == [i for i, _, _ in edges]
    for walk in walks:
        places = [ends[i] if f else ends[i][::-1] for i, f in walk]
        assert all(x[1] == y[0] for x, y in zip(places, places[1:]))
    up = {v: v for _, a, b in edges for v in (a, b)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    degree = {}
    for _, a, b in edges:
        up[root(a)] = root(b)
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    odd = {}
    for v, n in degree.items():
        odd[root(v)] = odd.get(root(v), 0) + n % 2
    assert len(walks) == sum(max(1, n // 2) for n in odd.values())


def test_access_with_clashing_names(small, spark):
    ids = spark.createDataFrame([(0, "a", 9), (5, "b", 8), (6, "c", 7), (-1, "d", 6)], "kmer_id long, ckey string, strand int")
    got = sorted(small.access_weighted(ids).collect(), key=lambda r: r.kmer_id)
    assert [(r.kmer_id, r.ckey, r.strand, r.kmer, r.weight) for r in got] == [(-1, "d", 6, None, None), (0, "a", 9, "AAC", 2), (5, "b", 8, "ATA", 1), (6, "c", 7, None, None)]


def test_one_strand(small, spark):
    q = spark.createDataFrame([("AAC",), ("GTT",), ("TTT",)], "kmer string")
    assert [r.kmer for r in small.members(q, check_rc=False).collect()] == ["AAC"] and small.members(q).count() == 2
    assert sorted(r.kmer for r in small.members(q, present=False, check_rc=False).collect()) == ["GTT", "TTT"]
    found = small.neighbours(spark.createDataFrame([("ACT",)], "kmer string"), check_rc=False).where("kmer_id is not null").collect()
    assert sorted((r.direction, r.slot, r.kmer_id) for r in found) == [("backward", 0, 0), ("forward", 3, 2)]


def test_offsets(small, spark):
    got = small.locate(spark.createDataFrame([(o,) for o in range(-1, 11)], "offset long")).orderBy("offset").collect()
    assert [(r.string_id, r.kmer_id) for r in got] == [(None, None), (0, 0), (0, 1), (0, 2), (0, None), (0, None), (1, 3), (1, 4), (1, 5), (1, None), (1, None), (None, None)]
    bits = small.relative_bits()
    back = small.decode_offsets(spark.createDataFrame([((1 << bits) + 2,), (7 << bits,)], "encoded long")).collect()
    assert sorted((r.absolute, r.relative, r.string_id) for r in back if r.string_id is not None) == [(7, 2, 1)] and len(back) == 2


def test_mode_report_and_results(small, spark):
    assert R.require_mode(small, False) is small
    with pytest.raises(ValueError):
        R.require_mode(small, True)
    report = R.total_report(small, spark.createDataFrame([(0, "AACTGNGTTA")], "read_id long, seq string"))
    assert R.report_lines(report)[:2] == ["8 k-mers", "4 positive (50.00 %)"]
    both = small.lookup(spark.createDataFrame([("AAC",), ("GTT",), ("TTT",)], "kmer string"))
    pairs = both.select(F.struct("*").alias("a")).crossJoin(both.select(F.struct("*").alias("b")))
    assert {(r.a.kmer, r.b.kmer) for r in pairs.where(S.same_result("a", "b")).collect()} == {("AAC", "AAC"), ("GTT", "GTT"), ("TTT", "TTT")}


def test_long_sequences_are_cut(spark, monkeypatch):
    from strandix.operators import kmerize as Z

    r = random.Random(4)
    s = "".join(r.choice("ACGTN" if i % 50 == 0 else "ACGT") for i in range(3_000))
    df = spark.createDataFrame([(7, s), (8, None), (9, s[:40])], "id long, seq string")
    want = {(x.id, x.pos, x.ckey, x.strand) for x in kmerize(df, "id", "seq", 21).collect()}
    monkeypatch.setattr(Z, "STEP", 100)
    got = [(x.id, x.pos, x.ckey, x.strand) for x in Z.kmerize(df, "id", "seq", 21).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("weights", [2, 5, 40])
def test_reordering_reaches_what_it_promises(spark, weights):
    r = random.Random(weights)
    rows = [(i, a, b, r.randint(1, 4)) for i in range(300) for a, b in [(r.randrange(weights), r.randrange(weights))]]
    ends = spark.createDataFrame(rows, "string_id long, front long, back long, num_runs long")
    order, walks = O.permutation(ends, block=16)
    placed = sorted((x.new_pos, x.string_id, x.forward) for x in order.collect())
    assert [p for p, _, _ in placed] == list(range(300)) and {i for _, i, _ in placed} == set(range(300))
    assert walks == len(O.trails([(i, a, b) for i, a, b, _ in rows]))
    (row,) = O.accounting(ends).collect()
    assert row.runs_after <= row.runs_promised == row.runs_before - 300 + walks


def test_permutation_file(spark, tmp_path):
    order = spark.createDataFrame([(4, 0, True), (2, 1, False), (9, 2, True)], "string_id long, new_pos long, forward boolean")
    O.write_permutation(order, str(tmp_path / "p"))
    assert sorted(map(tuple, O.read_permutation(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, order.collect()))
    strings = spark.createDataFrame([([2, 2, 7],), ([7],), ([],)], "weights array<long>")
    assert tuple(O.scan_summary(strings).first()) == (2, 4, 3, 2, 18)
