"""The statistics of the whole documents table against brute force on a small table."""

import random
from collections import Counter, defaultdict

import pytest

from strandix.operators import minimizers as M
from strandix.plans import registry

RC = str.maketrans("ACGT", "TGCA")
M64, K63 = 2**64, 63


def rc(s):
    return s[::-1].translate(RC)


def number(s):
    return sum("ACTG".index(c) << 2 * i for i, c in enumerate(s))


def brute(texts, k):
    """(string_id, id in string, offset, k-mer) in id order, and weights by canonical k-mer."""
    rows, weights, strings, offset = [], Counter(), -1, 0
    for x in texts:
        letters = "".join("ACGT"[(ord(c) - 97) % 4] if c.isalpha() else "N" for c in x.lower() if c.isalnum())
        for piece in letters.split("N"):
            new = False
            for i in range(len(piece) - k + 1):
                w = piece[i : i + k]
                weights[key := min(w, rc(w))] += 1
                if weights[key] > 1:
                    new = False
                    continue
                if not new:
                    strings, offset, inside = strings + 1, offset + (k - 1 if rows else 0), 0
                rows.append((strings, inside, offset, w))
                new, inside, offset = True, inside + 1, offset + 1
    return rows, weights


def minimizer(w, m, canonical=False):
    def best(s):
        return min(((number(s[i : i + m]) * M.MULTIPLIER % M64) ^ (M.magic_of(1) % M64), i) for i in range(len(s) - m + 1))[1]

    at = best(w)
    value = number(w[at : at + m])
    if canonical and number(rc(w)[(j := best(rc(w))) : j + m]) < value:
        return number(rc(w)[j : j + m]), len(w) - m - j
    return value, at


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    copy = word(200)
    common = word(25)  # a passage in many strings makes heavy buckets
    texts = [copy, word(90) + "7" + copy[:80] + word(60), word(20), "", "ab" * 60, copy[50:150]] + [word(14) + common + word(14) for _ in range(200)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, texts


def rows_of(spark, tables, name):
    got = registry.QUERIES[f"{name}_of_documents"](spark, tables[0])
    return Counter(map(tuple, got.collect())), got.columns


def test_kmers_of_documents(spark, tables):
    for name, k in (("kmer_table", 31), ("kmer_table_k63", K63)):
        rows, weights = brute(tables[1], k)
        want = Counter((i, s, j, o, w, weights[min(w, rc(w))]) for i, (s, j, o, w) in enumerate(rows))
        assert rows_of(spark, tables, name)[0] == want
    rows, weights = brute(tables[1], 31)
    assert rows_of(spark, tables, "iterate_from_id")[0] == Counter((i, w) for i, (*_, w) in enumerate(rows) if i >= 1000) and len(rows) > 1000
    degrees = Counter((sum(min(x, rc(x)) in weights for c in "ACGT" for x in [w[1:] + c]), sum(min(x, rc(x)) in weights for c in "ACGT" for x in [c + w[:-1]])) for *_, w in rows)
    assert rows_of(spark, tables, "degree_histogram")[0] == Counter((f, b, n) for (f, b), n in degrees.items())


def test_buckets_of_documents(spark, tables):
    rows, _ = brute(tables[1], 31)
    for name, canonical in (("minimizers_canonical", True), ("minimizers", False)):
        mins = [(s, i, v, o + at, at) for i, (s, _, o, w) in enumerate(rows) for v, at in [minimizer(w, 20, canonical)]]
        assert rows_of(spark, tables, name)[0] == Counter(mins)
    supers = []
    for s, i, v, place, at in mins:
        if supers and supers[-1][0] == s and supers[-1][2:4] == [v, place]:
            supers[-1][4], supers[-1][5] = max(supers[-1][4], at), supers[-1][5] + 1
        else:
            supers.append([s, i, v, place, at, 1])
    got, columns = rows_of(spark, tables, "super_kmers")
    assert columns == ["string_id", "first_kmer_id", "minimizer", "pos_in_seq", "pos_in_kmer", "num_kmers"] and got == Counter(map(tuple, supers))
    assert rows_of(spark, tables, "super_kmer_histogram")[0] == Counter(Counter(x[5] for x in supers).items())
    held = defaultdict(list)
    for x in supers:
        held[x[2]].append(x)
    each = {v: (len({x[3] for x in xs}), sum(x[5] for x in xs), len(xs)) for v, xs in held.items()}
    kind = lambda n: "SINGLETON" if n < 2 else "MIDLOAD" if n < 65 else "HEAVYLOAD"
    assert rows_of(spark, tables, "buckets")[0] == Counter((v, n, k, s, kind(n), (n - 1).bit_length() - 7 if n >= 65 else None) for v, (n, k, s) in each.items())
    assert any(n >= 65 for n, _, _ in each.values())
    sizes = defaultdict(list)
    for n, k, _ in each.values():
        sizes[n].append(k)
    assert rows_of(spark, tables, "bucket_histogram")[0] == Counter((n, len(ks), sum(ks)) for n, ks in sizes.items())
    classes = defaultdict(list)
    for n, k, _ in each.values():
        classes[kind(n)].append((n, k))
    assert rows_of(spark, tables, "bucket_classes")[0] == Counter((c, len(x), sum(n for n, _ in x), sum(k for _, k in x), max(n for n, _ in x)) for c, x in classes.items())
    below = {c: sum(k for n, k, _ in each.values() if n <= c) for c in M.SIZE_CLASSES}
    assert rows_of(spark, tables, "cumulative_kmers")[0] == Counter((c, k, round(100 * k / len(rows), 6)) for c, k in below.items())
