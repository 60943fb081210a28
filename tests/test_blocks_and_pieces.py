"""Builds over many small blocks, records over many splits, the filter of keys, and the plans that lookups get."""

import gzip
import io
import pathlib
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandix.config import Config
from strandix.operators import blocks, keyfilter, kmerize, minimizers, reads, runs
from strandix.operators import weights as W
from strandix.operators.dictionary import Dictionary
from strandix.operators.running import running
from strandix.plans.inputs import index_sequences, reads_of, table
from strandix.sources import pieces as P
from strandix.sources.files import read_fasta

RC = str.maketrans("ACGT", "TGCA")
SF = "/root/testdata/sf0.001"


def expected(seqs, k):
    """(kmers in order of id, strings) by first occurrences."""
    seen, kmers, strings = {}, [], []
    for s in seqs:
        last = None
        for i in range(len(s or "") - k + 1):
            x = s[i : i + k].upper()
            if set(x) - set("ACGT"):
                continue
            c = min(x, x[::-1].translate(RC))
            if c in seen:
                seen[c] += 1
                continue
            seen[c] = 1
            if last == i - 1 and last is not None:
                strings[-1] += x[-1]
            else:
                strings.append(x)
            last = i
            kmers.append((x, len(strings) - 1, c))
    return [(i, x, s, seen[c]) for i, (x, s, c) in enumerate(kmers)], strings


def sequences(seed):
    r = random.Random(seed)
    rows = ["".join(r.choice("ACGT" * 9 + "N") for _ in range(r.randint(0, 400))) for _ in range(10)]
    return rows + [rows[2][50:300], "acgtn" * 30, "A" * 200, None, ""]


@pytest.mark.parametrize("k", [1, 4, 31, 33])
def test_strings_cross_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 4)
    monkeypatch.setattr(kmerize, "STEP", 40)
    seqs = sequences(k)
    rows = spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string").repartition(3)
    d = Dictionary.build(rows, Config(k=k, m=min(k, 5)))
    kmers, strings = expected(seqs, k)
    got = d.kmers.select("kmer_id", d.kmer_strings().alias("x"), "string_id", "weight").orderBy("kmer_id").collect()
    assert [tuple(r) for r in got] == kmers
    table_ = d.strings.orderBy("string_id").collect()
    assert [r.seq for r in table_] == strings and [r.first_kmer_id for r in table_] == [next(i for i, _, s, _ in kmers if s == n) for n in range(len(strings))]
    assert d.check() == {"ids": 0, "lookup": 0, "strings": 0, "navigation": 0, "negative": 0}
    ids = spark.range(-2, len(kmers) + 2).withColumnRenamed("id", "kmer_id")
    for size in (3, 1 << 10):
        assert [r.kmer for r in d.access(ids, block=size).orderBy("kmer_id").collect()] == [None, None, *(x for _, x, *_ in kmers), None, None]
    inner = d.kmers.join(d.strings, "string_id").where("kmer_id_in_string <> kmer_id - first_kmer_id or string_kmers <> num_kmers or kmer_offset <> string_begin + kmer_id_in_string").count()
    assert inner == 0


def test_pieces_of_sequences_are_the_same_dictionary(spark, tmp_path):
    k, seqs = 7, [s for s in sequences(5) if s]
    whole = Dictionary.build(spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string"), Config(k=k, m=4))
    cuts = [(i, a, s[a : a + 50 + k - 1]) for i, s in enumerate(seqs) for a in range(0, len(s), 50)]
    parts = Dictionary.build(spark.createDataFrame(cuts, "sequence_id long, start long, seq string"), Config(k=k, m=4))
    columns = ["kmer_id", "string_id", "ckey", "strand", "weight"]
    assert sorted(map(tuple, whole.kmers.select(columns).collect())) == sorted(map(tuple, parts.kmers.select(columns).collect()))
    parts.save(f"file://{tmp_path}/saved")
    loaded = Dictionary.load(spark, f"file://{tmp_path}/saved")
    assert sorted(map(tuple, loaded.kmers.select(columns).collect())) == sorted(map(tuple, whole.kmers.select(columns).collect()))
    queries = spark.createDataFrame([(s[3 : 3 + k],) for s in seqs if len(s) > 20] + [("CCCCCCC",), ("N" * 7,), (None,)], "kmer string")
    assert sorted(map(str, loaded.lookup(queries).collect())) == sorted(map(str, whole.lookup(queries).collect()))


def test_given_weights_follow_places(spark):
    rows = [(5, "ACGTTACGA", [1, 2, 3, 4, 5, 6, 7]), (9, "TTTACG", [9, 9, 9, 9])]
    d = Dictionary.build(spark.createDataFrame(rows, "sequence_id long, seq string, weights array<long>"), Config(k=3, m=2, weighted=True))
    assert {r.x: r.weight for r in d.kmers.select(d.kmer_strings().alias("x"), "weight").collect()} == {"ACG": 1, "GTT": 3, "TTA": 4, "TAC": 5, "CGA": 7, "TTT": 9}


def test_runs_over_blocks(spark, monkeypatch):
    r = random.Random(4)
    weights, strings = [], []
    while len(weights) < 300:
        weights += [r.randint(1, 3)] * r.choice([1, 2, 40])
    weights = weights[:300]
    while len(strings) < 300:
        strings += [len(set(strings))] * r.choice([1, 3, 70])
    strings = strings[:300]
    rows = [(i, s, i - strings.index(s), w) for i, (s, w) in enumerate(zip(strings, weights, strict=True))]
    kmers = spark.createDataFrame(rows, "kmer_id long, string_id long, kmer_id_in_string long, weight long").repartition(5)
    for bits in (2, 4, 17):
        monkeypatch.setattr(runs, "BLOCK_BITS", bits)
        for by_string in (True, False):
            want, number = [], 0
            for i, s, _, w in rows:
                fresh = not want or want[-1][3] != w or (by_string and want[-1][0] != s)
                if fresh:
                    number = number + 1 if by_string and want and want[-1][0] == s else 1
                    want.append([s, number, i, w, i + 1])
                want[-1][4] = i + 1
            got = runs.weight_runs(kmers, by_string).orderBy("run_id").collect()
            assert [x.run_id for x in got] == list(range(len(want)))
            assert [(x.begin_kmer_id, x.end_kmer_id, x.weight) for x in got] == [(b, e, w) for _, _, b, w, e in want]
            if by_string:
                assert [(x.string_id, x.run) for x in got] == [(s, n) for s, n, *_ in want]


def test_running_highest_and_lowest(spark):
    r = random.Random(2)
    rows = [(i * 7 - 100, r.choice([None, r.randint(0, 50)])) for i in range(300)]
    got = running(spark.createDataFrame(rows, "key long, x long").repartition(4), "key", {"x": "s"}, {"x": "h"}, {"x": "l"}).orderBy("key").collect()
    for n, row in enumerate(got):
        before, after = [x for _, x in rows[:n] if x is not None], [x for _, x in rows[n + 1 :] if x is not None]
        assert (row.s, row.h, row.l) == (sum(before), max(before, default=None), min(after, default=None))


def test_reads_over_blocks(spark, monkeypatch):
    seqs = sequences(8)
    d = Dictionary.build(spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string"), Config(k=9, m=4))
    table_ = spark.createDataFrame([(i, s if i % 2 else s and s[::-1].translate(RC)) for i, s in enumerate(seqs)], "read_id long, seq string")
    want = sorted(map(tuple, reads.read_report(d, table_).collect()))
    assert sum(r[6] for r in want) > 500
    monkeypatch.setattr(reads, "BLOCK_BITS", 3)
    assert sorted(map(tuple, reads.read_report(d, table_).collect())) == want
    cuts = [(i, a, s[a : a + 28]) for i, s in table_.collect() if s for a in range(0, len(s), 20)] + [(i, 0, s) for i, s in table_.collect() if not s]
    assert sorted(map(tuple, reads.read_report(d, spark.createDataFrame(cuts, "read_id long, start long, seq string")).collect())) == want


@pytest.mark.parametrize("wide", [False, True])
def test_filter_of_keys(spark, wide):
    r = np.random.default_rng(1)
    halves = r.integers(0, 1 << 62, (6000, 2)).astype(np.uint64)
    own, others = halves[:3000], halves[3000:]
    keys = lambda x: x.astype(">u8").reshape(-1).view("V16") if wide else np.ascontiguousarray(x[:, 0])
    rows = [(x.tobytes() if wide else int(x),) for x in keys(own)]
    words = keyfilter.words_for(3000)
    made = keyfilter.filter_rows(spark.createDataFrame(rows, f"ckey {'binary' if wide else 'long'}").repartition(3), words)
    array = keyfilter.assembled(made, words)
    assert keyfilter.may_hold(array, keys(own)).all()
    assert keyfilter.may_hold(array, keys(others)).mean() < 0.05
    assert keyfilter.words_for(10**12) == 0 and keyfilter.words_for(0) >= 1 and keyfilter.words_for(10**7) * 64 >= 12 * 10**7


def test_filtered_reads_are_counted_whole(spark):
    d = Dictionary.build(spark.createDataFrame([(0, "ACGTTACGATTACA" * 3)], "sequence_id long, seq string"), Config(k=5, m=3))
    assert d.key_filter() is not None
    rows = spark.createDataFrame([(1, "ACGTTNGGGGGGGGGGGG"), (2, "CCCCCCC"), (3, None)], "read_id long, seq string")
    without = Dictionary(d.kmers, d.strings, d.config)
    assert without.key_filter() is None
    assert sorted(map(tuple, reads.read_report(d, rows).collect())) == sorted(map(tuple, reads.read_report(without, rows).collect()))


def test_sliding_minimum():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 17, 60):
        for span in range(1, min(n, 9) + 1):
            v = r.integers(0, r.choice([3, 1 << 62]), n).astype(np.uint64)
            v[r.random(n) < 0.2] = np.uint64(2**64 - 1)
            for right in (False, True):
                want = [np.flatnonzero(v[i : i + span] == v[i : i + span].min())[-1 if right else 0] for i in range(n - span + 1)]
                assert minimizers.sliding_minimum(v, span, right).tolist() == want


# ---- plans ---------------------------------------------------------------------------------------------


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_first_places_are_hash_aggregated(spark):
    cut = kmerize.cut(index_sequences(table(spark, SF, "documents"), "doc_id", 31).withColumnRenamed("sequence_id", "id"), 31)
    plan = plan_of(kmerize.kmerize_places(cut.withColumn("place", F.col("start")), 31).groupBy("ckey").agg(F.min("at"), F.count("*")))
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_a_lookup_moves_its_queries_only(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = Dictionary.build(index_sequences(table(spark, SF, "benchmark"), "item_id", 15), Config(k=15, m=7))
        queries = reads_of(table(spark, SF, "documents"), "doc_id").select(F.substring("seq", 1, 15).alias("kmer"))
        for df in (d.lookup(queries), d.members(queries), d.neighbours(queries)):
            plan = plan_of(df)
            side = plan[plan.index("Join") :].rsplit("+- ", 3)[1:]
            assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Bucketed: true" in plan, (plan, side)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ---- records over splits -------------------------------------------------------------------------------


def fasta_text(r):
    records = []
    for i in range(r.randint(1, 6)):
        s = "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 5, 40, 300])))
        width, end = r.choice([7, 60, 1000]), r.choice(["\n", "\r\n"])
        records.append(f">h{i} x>y{end}" + end.join(s[j : j + width] for j in range(0, len(s), width)))
    return "\n".join(records) + r.choice(["", "\n", "\n\n"])


def records_of(text):
    return [(h.strip(), "".join(s.split())) for h, _, s in (x.partition("\n") for x in ("\n" + text).split("\n>")[1:])]


def test_splits_of_bytes(tmp_path, monkeypatch):
    r, path = random.Random(3), f"{tmp_path}/f.fa"
    for _ in range(150):
        text = fasta_text(r)
        pathlib.Path(path).write_bytes(text.encode())
        monkeypatch.setattr(P, "BLOCK", r.choice([4, 11, 1 << 20]))
        overlap, piece = r.choice([0, 2, 30]), r.choice([5, 64, 10**6])
        options = P._Options({"path": path, "split": r.choice([3, 17, 50, 1000])})
        want, made, before = records_of(text), {}, 0
        for part in options.parts(P.files_of(path)):
            rows = list(P.fasta_rows(part, overlap, piece))
            for _, record, header, _, own, seq in rows:
                name, so_far = made.setdefault(before + record - 1, [None, ""])
                rest = want[before + record - 1][1][len(so_far) :]
                assert rest[: len(seq)] == seq and (not own or len(seq) == min(own + overlap, len(rest)))
                made[before + record - 1] = [header if header is not None else name, so_far + seq[:own]]
            before += max([x[1] for x in rows], default=0)
        assert [tuple(made[i]) for i in sorted(made)] == want


def test_splits_of_fastq(tmp_path):
    r, path = random.Random(4), f"{tmp_path}/f.fq"
    for _ in range(100):
        reads_ = [(f"r{i} @x", "".join(r.choice("ACGT") for _ in range(n)), "".join(r.choice("@+IJ") for _ in range(n))) for i in range(r.randint(1, 8)) for n in [r.choice([1, 4, 30])]]
        pathlib.Path(path).write_text("".join(f"@{h}\n{s}\n+{r.choice(['', h])}\n{q}\n" for h, s, q in reads_))
        options = P._Options({"path": path, "format": "fastq", "split": r.choice([3, 20, 90])})
        assert [x[2:] for part in options.parts(P.files_of(path)) for x in P.fastq_rows(part)] == reads_
    pathlib.Path(path).write_text("@a\nAC\n+\n")
    with pytest.raises(ValueError, match="four lines"):
        list(P.fastq_rows(P._Options({"path": path, "format": "fastq"}).parts(P.files_of(path))[0]))


def test_read_pieces(spark, tmp_path):
    r, k = random.Random(6), 5
    for n in range(3):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        texts = [fasta_text(r) for _ in range(3)]
        for i, text in enumerate(texts):
            (folder / f"{i}.fa").write_text(text)
        (folder / "9.fa.gz").write_bytes(gzip.compress(texts[0][:20].encode()) + gzip.compress(texts[0][20:].encode()))
        want = [x for text in [*texts, texts[0]] for x in records_of(text.replace("\r\n", "\n"))]
        rows = P.read_pieces(spark, str(folder), k, split=r.choice([9, 70]), piece=r.choice([20, 1000])).collect()
        assert {x.sequence_id: x.header for x in rows if x.header is not None} == dict(enumerate(h for h, _ in want))
        for x in rows:
            whole = want[x.sequence_id][1]
            assert whole[x.start : x.start + len(x.seq)] == x.seq
        d = Dictionary.build(P.read_pieces(spark, str(folder), k, split=40), Config(k=k, m=3))
        kmers, strings = expected([s for _, s in want], k)
        assert [x.seq for x in d.strings.orderBy("string_id").collect()] == strings and d.kmers.agg(F.sum("weight")).first()[0] == sum(w for *_, w in kmers)


def test_a_record_over_files_and_bases_without_header(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for i, text in enumerate([">a\nACGT\nAC\n", "GGTT\nAA\n", "CCA\n>b\nTT\n"]):
        (tmp_path / "parts" / f"part-{i}.txt").write_text(text)
    rows = P.read_pieces(spark, f"file://{tmp_path}/parts", 4, split=4, joined=True).orderBy("sequence_id", "start").collect()
    whole = {0: "ACGTACGGTTAACCA", 1: "TT"}
    assert all(whole[x.sequence_id][x.start :].startswith(x.seq) for x in rows)
    covered = {(x.sequence_id, x.start + j) for x in rows for j in range(len(x.seq) - 3)}
    assert covered == {(0, j) for j in range(12)}
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        P.read_pieces(spark, str(tmp_path / "bad.fa"), 4).collect()


def test_whole_reader_agrees(spark, tmp_path):
    text = fasta_text(random.Random(9)).replace("\r\n", "\n")
    (tmp_path / "x.fa").write_text(text)
    rows = P.read_pieces(spark, str(tmp_path / "x.fa"), 1).groupBy("sequence_id").agg(F.max("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, read_fasta(spark, str(tmp_path / "x.fa")).collect()))


def test_stream_takes_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def go():
        rows = P.stream_sequences(spark, str(tmp_path / "in"))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((x.header, x.seq) for x in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.fq").write_text("@1\nAC\n+\nII\n@2\nGT\n+\nII\n")
    assert go() == [("1", "AC"), ("2", "GT")]
    (tmp_path / "in" / "b.fq").write_text("@3\nTT\n+\nII\n")
    assert go() == [("1", "AC"), ("2", "GT"), ("3", "TT")]
    assert go() == [("1", "AC"), ("2", "GT"), ("3", "TT")]


def test_endpoints_of_runs(spark):
    d = Dictionary.build(spark.createDataFrame([(0, "AACTG", [2, 2, 7]), (1, "GGATA", [7, 7, 1])], "sequence_id long, seq string, weights array<long>"), Config(k=3, m=2, weighted=True))
    assert sorted(map(tuple, W.endpoints(d).collect())) == [(0, 2, 7, 2), (1, 7, 1, 2)]
