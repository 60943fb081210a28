"""The corpus pipeline: five stages over documents, each of which keeps the columns of documents until ids are made.

``run`` applies the stages in turn; every stage but the first works on what its predecessor kept, read back from a table in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandix.llm.bpe import encode_documents
from strandix.llm.common import documents, written
from strandix.llm.mixing import mix
from strandix.llm.ngram_join import keep_one_of_each
from strandix.llm.secrets import redact_in_place
from strandix.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5, by a model of the labelled documents still here."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at 0.8 or more over five-word shingles."""
    return keep_one_of_each(docs, n=5, percent=80)


def redact_secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return redact_in_place(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by probabilities that are calibrated to source, language and topic targets."""
    return mix(docs, share=0.9)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document ids with their token counts and packed token ids."""
    return encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic_documents),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secret_spans),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs


#: SQL can't express Viterbi decoding, a trained scorer or byte-pair encoding.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
