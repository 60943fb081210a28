"""Walks over the graph of weights, by joins and on the driver."""

import random

import pytest

from strandix.operators import cover, reorder


def walked(spark, edges):
    """Edges in order of place, and the number of walks told."""
    found, n = cover.walks(spark.createDataFrame(edges, "e long, low long, high long, size long").repartition(3))
    return sorted((r.place, r.e, r.from_low) for r in found.collect()), n


def graphs():
    r = random.Random(7)
    yield [(0, 1, 1)]
    yield [(0, 1, 2)]
    yield [(0, 1, 2), (1, 1, 2)]
    yield [(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 3, 3)]
    yield [(i, a, a + 1) for i, a in enumerate(range(12))]  # one long path
    yield [(i, i, i + 1) for i in range(11)] + [(11, 0, 11)]  # one long cycle
    yield [(3 * j + i, *sorted((10 * j + i, 10 * j + (i + 1) % 3))) for j in range(4) for i in range(3)] + [(12, 0, 10), (13, 0, 10), (14, 10, 20), (15, 10, 20)]  # triangles tied by double edges
    star = [(2 * i + j, *sorted((99, i))) for i in range(9) for j in range(2)]
    yield star  # two-edge cycles that all meet at one weight
    for n, values in ((25, 4), (40, 12), (60, 60)):
        yield [(i, *sorted((r.randint(0, values), r.randint(0, values)))) for i in range(n)]


@pytest.mark.parametrize("number", range(11))
def test_fewest_walks(spark, monkeypatch, number):
    monkeypatch.setattr(cover, "BLOCK_BITS", 2)
    edges = list(graphs())[number]
    r = random.Random(number)
    sized = [(e, a, b, r.randint(1, 3)) for e, a, b in edges]
    got, n = walked(spark, sized)
    assert sorted(e for _, e, _ in got) == sorted(e for e, *_ in edges)
    of = {e: (a, b, s) for e, a, b, s in sized}
    walks, end, place = 0, None, 0
    for at, e, from_low in got:
        assert at == place
        a, b, size = of[e]
        first, last = (a, b) if from_low else (b, a)
        walks += first != end
        end, place = last, place + size
    assert walks <= n == len(reorder.trails(edges))


def test_permutation_by_joins(spark):
    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 1, 2, 3, 5, 8]), r.choice([1, 1, 1, 2, 3, 5, 8]), r.randint(1, 4)) for i in range(300)]
    ends = spark.createDataFrame(rows, "string_id long, front long, back long, num_runs long")
    told = reorder.accounting(ends).first()
    order, n = reorder.permutation(ends, block=16, on_driver=0)
    got = {x.new_pos: x for x in order.collect()}
    assert sorted(got) == list(range(300)) and len({x.string_id for x in got.values()}) == 300 and n == told.num_walks
    of = {i: (a, b) for i, a, b, _ in rows}
    faces = [of[got[p].string_id] if got[p].forward else of[got[p].string_id][::-1] for p in range(300)]
    assert 1 + sum(x[1] != y[0] for x, y in zip(faces, faces[1:], strict=False)) <= n
    assert told.runs_after <= told.runs_promised
