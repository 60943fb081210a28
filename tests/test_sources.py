"""File formats, streaming input and the command line."""

import gzip
import json

import pytest

from strandix import cli
from strandix.config import Config
from strandix.operators.dictionary import Dictionary
from strandix.sources import files
from strandix.streaming.reads import stream_hits, stream_reports


def write(path, text):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)
    return str(path)


@pytest.mark.parametrize("name", ["a.fa", "a.fasta.gz"])
def test_fasta(spark, tmp_path, name):
    path = write(tmp_path / name, ">x 1\nACGT\nAC\n>y\nGG\n>z\nTTT")
    got = files.read_sequences(spark, path).orderBy("sequence_id").collect()
    assert [(r.sequence_id, r.header, r.seq) for r in got] == [(0, "x 1", "ACGTAC"), (1, "y", "GG"), (2, "z", "TTT")]


@pytest.mark.parametrize("name", ["a.fq", "a.fastq.gz"])
def test_fastq(spark, tmp_path, name):
    path = write(tmp_path / name, "@a\nACGT\n+\n@@@@\n@b\nGGTT\n+\nIIII\n")
    got = files.read_sequences(spark, path).orderBy("sequence_id").collect()
    assert [(r.sequence_id, r.header, r.seq, r.qual) for r in got] == [(0, "a", "ACGT", "@@@@"), (1, "b", "GGTT", "IIII")]


def test_segments_and_blank_lines(spark, tmp_path):
    path = write(tmp_path / "a.cf_seg", "7\tACGT\n9\tGG\n")
    assert [(r.header, r.seq) for r in files.read_sequences(spark, path).orderBy("sequence_id").collect()] == [("7", "ACGT"), ("9", "GG")]
    path = write(tmp_path / "b.fa", ">h\nAC\nGT\n\nTT\nT\n")
    assert [r.seq for r in files.read_sequences(spark, path, multiline=True).orderBy("sequence_id").collect()] == ["ACGT", "TTT"]


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        files.read_sequences(spark, "x.txt")


def test_weighted_headers_are_checked(spark, tmp_path):
    good = write(tmp_path / "g.fa", ">0 LN:i:5 ab:Z:2 2 7\nAACTG\n>1 LN:i:5 ab:Z:7 7 1\nGGATA\n")
    assert files.read_weighted_fasta(spark, good, 3).orderBy("sequence_id").first().weights == [2, 2, 7]
    for bad in (">0 LN:i:4 ab:Z:2 2 7\nAACTG\n", ">0 LN:i:5 ab:Z:2 2\nAACTG\n", ">0 nothing\nAACTG\n"):
        with pytest.raises(Exception):
            files.read_weighted_fasta(spark, write(tmp_path / "b.fa", bad), 3).collect()


def test_large_file_keeps_its_order(spark, tmp_path):
    lines = [f">{i}\nACGT{'ACGT'[i % 4] * (i % 50)}" for i in range(3000)]
    path = write(tmp_path / "l.fa", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_fasta(spark, path).orderBy("sequence_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.header for r in got] == [str(i) for i in range(3000)] and [r.sequence_id for r in got] == list(range(3000))


def test_header_with_the_record_sign(spark, tmp_path):
    path = write(tmp_path / "h.fa", ">a->b x>y\nAC\nGT\n>c > d\nTTT\n>e\n>f\nG")
    got = files.read_fasta(spark, path).orderBy("sequence_id").collect()
    assert [(r.sequence_id, r.header, r.seq) for r in got] == [(0, "a->b x>y", "ACGT"), (1, "c > d", "TTT"), (2, "e", ""), (3, "f", "G")]


def test_mixed_reads_keep_the_order_of_their_files(spark):
    reads = lambda n, base: spark.createDataFrame([(base + 3 * i, "ACGT"[i % 4]) for i in range(n)] + [(None, "A")], "sequence_id long, seq string")
    left, right = reads(1000, 0), reads(400, 5)
    rows = files.mix_reads(left, right, None, 7).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1400))
    for side, n, base in ((False, 1000, 0), (True, 400, 5)):
        assert [r.sequence_id for r in rows if r.from_right is side] == [base + 3 * i for i in range(n)]
    assert 150 < sum(r.from_right for r in rows[:400]) < 250  # either with the same probability while both last
    switches = sum(x.from_right != y.from_right for x, y in zip(rows[:400], rows[1:400]))
    assert 150 < switches < 250
    some = files.mix_reads(left, right, 90, 7).orderBy("place").collect()
    assert some == rows[:90]
    assert files.mix_reads(left, right, 90, 8).orderBy("place").collect() != some
    assert [r.sequence_id for r in files.mix_reads(left.limit(0), right, None, 7).orderBy("place").collect()] == [5 + 3 * i for i in range(400)]
    assert files.mix_reads(left.limit(0), right.limit(0), 5, 7).count() == 0


def test_stream(spark, tmp_path):
    d = Dictionary.build(spark.createDataFrame([(0, "AACTGGA")], "sequence_id long, seq string"), Config(k=3, m=2))
    spark.createDataFrame([(1, "AACTN"), (2, "TTT")], "read_id long, seq string").write.parquet(f"file://{tmp_path}/in")
    reads = spark.readStream.schema("read_id long, seq string").parquet(f"file://{tmp_path}/in")
    stream_reports(d, reads, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    assert {r.read_id: r.num_positive_kmers for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {1: 2, 2: 0}
    hits = stream_hits(d, reads).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    hits.awaitTermination(120)
    assert spark.table("hits").count() == 2


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "g.fa", ">0 LN:i:5 ab:Z:2 2 7\nAACTG\n>1 LN:i:5 ab:Z:7 7 1\nGGATA\n")
    cli.main(["build", "-i", path, "-k", "3", "-m", "2", "--weighted", "--check", "-o", f"file://{tmp_path}/d"])
    cli.main(["query", "-i", f"file://{tmp_path}/d", "-q", write(tmp_path / "q.fa", ">r\nAACTGNGTTA\n")])
    cli.main(["permute", "-i", path, "-k", "3", "-o", f"file://{tmp_path}/p"])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert set(out[0].values()) == {0} and out[1]["num_positive_kmers"] == 4 and out[2] == {"strings": 2, "walks": 1}


def test_shared_folder_of_a_cluster_has_to_be_named():
    from types import SimpleNamespace

    from strandix.sources.storage import shared_dir

    conf = SimpleNamespace(get=lambda name, default=None: default, set=lambda name, value: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    assert shared_dir(session("local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
