"""Components over many chunks, against a plain union of sets."""

import random

import numpy as np
import pytest

from strandix.llm import graph


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def some_edges(seed, n=400):
    r = random.Random(seed)
    path = list(range(1000, 1000 + n))
    r.shuffle(path)
    return list(zip(path, path[1:])) + [(5, 100 + i) for i in range(60)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(90)] + [(7, 7)]


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_components_in_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    edges = some_edges(1)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = plain([e for e in edges if e[0] != e[1]])
    assert got == want


def test_contraction():
    for seed in range(20):
        edges = some_edges(seed, 80)
        u, v = (np.array(x, np.int64) for x in zip(*edges))
        nodes, roots = graph.contract(u, v)
        want = plain(edges)
        assert {int(a): int(b) for a, b in zip(nodes, roots)} == {a: b for a, b in want.items() if a != b}
