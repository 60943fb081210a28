"""The pipeline against a plain version of its stages, run one document at a time."""

import hashlib
import importlib.util
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SMOKE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir(SMOKE), reason="no pipeline or no tables")


def plain_mix(docs, share):
    """Trimmed raking with dictionaries; the ids that are sampled."""
    from strandix.llm import mixing

    def topic(x):
        return next((t for t, sign in mixing.TOPIC_SIGNS if sign in x), "prose")

    cell = {d["doc_id"]: (d["source"], d["lang"], topic(d["text"])) for d in docs}
    tokens = {}
    for d in docs:
        tokens[cell[d["doc_id"]]] = tokens.get(cell[d["doc_id"]], 0) + len(d["text"].encode().split())
    total, goals = sum(tokens.values()), []
    for k, name in enumerate(mixing.DIMENSIONS):
        held = {}
        for c, t in tokens.items():
            held[c[k]] = held.get(c[k], 0) + t
        raw, level = {v: float(t) ** mixing.TEMPER[name] if t else 0.0 for v, t in held.items()}, 0.0
        for _ in range(mixing.FILLINGS):
            spent = {v for v in held if held[v] <= raw[v] * level}
            if open_ := sum(raw[v] for v in held if v not in spent):
                level = (total * share - sum(held[v] for v in spent)) / open_
        goals.append({v: min(held[v], raw[v] * level) for v in held})
    x = {c: float(t) for c, t in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            now = {}
            for c in x:
                now[c[k]] = now.get(c[k], 0) + min(x[c], tokens[c])
            x = {c: v * goals[k][c[k]] / now[c[k]] if now[c[k]] else 0 for c, v in x.items()}
    w = {c: min(v, tokens[c]) for c, v in x.items()}
    u = lambda i: int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:8], 16) / 2**32
    return [d for d in docs if tokens[cell[d["doc_id"]]] and u(d["doc_id"]) < w[cell[d["doc_id"]]] / tokens[cell[d["doc_id"]]]]


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline
    from test_search_and_dedup import brute_components

    from strandix.llm import bpe, secrets, toxicity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]
    table = spark.read.parquet(f"{SMOKE}/documents.parquet")
    scorer = toxicity.train_scorer(table, spark.read.parquet(f"{SMOKE}/labels.parquet"))
    docs = [r.asDict() for r in table.collect()]
    docs = [d for d in docs if scorer.score(d["text"]) < 0.5]
    found = brute_components([(d["doc_id"], d["text"]) for d in docs], 5, 80)
    docs = [d for d in docs if any(i == c == d["doc_id"] for i, _, c in found)]
    for d in docs:
        d["text"] = secrets.redacted(d["text"].encode()).decode()
    docs = plain_mix(docs, 0.9)
    tokenizer = bpe.Vocabulary(bpe.default_vocabulary()).tokenizer
    want = {d["doc_id"]: np.array(tokenizer.encode(d["text"], add_special_tokens=False).ids, "<u4").tobytes() for d in docs}
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SMOKE).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, SMOKE).dtypes == docs.dtypes


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMOKE)
    assert docs.count() == 0
