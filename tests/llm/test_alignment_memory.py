"""What an alignment holds at a time."""

import glob
import os
import random

import pyarrow.parquet as pq

from strandix.llm import alignment, common
from strandix.sources.storage import shared_dir


def test_few_slices_are_written_together(spark, monkeypatch):
    """A task's row groups don't grow with its slices: a writer, and each later reader, hold one whole."""
    monkeypatch.setattr(common, "BATCH_ROWS", 5)
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(12))) for i in range(60)], "doc_id long, text string").coalesce(1)
    root = f"{shared_dir(spark).removeprefix('file://')}/strandix/alignment-slices-*"
    old, before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), set(glob.glob(root))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        aligned, _ = alignment.align_documents(docs)
        assert aligned.count() == 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    (path,) = set(glob.glob(root)) - before
    sizes = [f.row_group(i).num_rows for x in glob.glob(os.path.join(path, "*.parquet")) for f in [pq.ParquetFile(x).metadata] for i in range(f.num_row_groups)]
    assert sum(sizes) == 12 and max(sizes) <= alignment.SLICES_TOGETHER


def test_pairs_of_a_stretch_take_eight_bytes_each():
    import public_tokenizers

    aligner = alignment.Aligner.of(alignment.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    n_a, n_b, groups, pairs = aligner.align([" unbelievably"])[0]
    assert isinstance(pairs, bytes) and len(pairs) == 8 * len(groups.split(";")) and n_a and n_b
    alignment.Aligner.forget()
    assert not alignment._ALIGNERS
