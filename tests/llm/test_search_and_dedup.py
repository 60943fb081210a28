"""Joins, repeats and searches against brute force."""

import collections
import hashlib
import pathlib
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from strandix.llm import graph, ngram_join, suffix_dedup, vectors


def brute_components(rows, n, percent):
    sets = []
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets.append((i, frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = collections.defaultdict(lambda: 1 << 62)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least[root(k)], i)
    return collections.Counter((i, len(s), i if not s else least[root(k)]) for k, (i, s) in enumerate(sets))


def brute_links(rows, n, percent):
    """(id, smallest id of an equal set, linked documents) by position."""
    sets = []
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)))
    out = collections.Counter()
    for k, (i, _) in enumerate(rows):
        x = sets[k]
        links = sum(1 for j, y in enumerate(sets) if j != k and x and y and 100 * len(x & y) >= percent * len(x | y))
        out[i, min([rows[j][0] for j, y in enumerate(sets) if y == x and rows[j][0] is not None], default=None) if x else i, links] += 1
    return out


def copies(seed, count, big):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [[r.choice(words) for _ in range(r.randint(1, 120))] for _ in range(12)]
    line = [r.choice(words) for _ in range(25)]
    for i in range(count):
        text = list(base[0] if i % 3 == 0 and big else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            text[r.randrange(len(text))] = r.choice(words)
        if i % 4 == 0:
            text += line
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else "\n".join(text)))
    return rows + [(9000, None), (9001, ""), (9002, " \t "), (9003, "one"), (9004, "ONE"), (9005, "one two"), (5, rows[5][1])]


@pytest.mark.parametrize(("n", "percent", "big"), [(3, 90, False), (5, 80, True)])
def test_components_equal_brute_force(spark, n, percent, big, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 8)  # long lists, many blocks
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 2_000)
    monkeypatch.setattr(ngram_join, "BLOCK", 30)
    rows = copies(n, 260, big)
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, c int, root int")
    got = ngram_join.ngram_components(df, n=n, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows, n, percent)


def test_words_that_defeat_polynomials(spark):
    a = "a"
    for _ in range(11):  # the Thue-Morse word and its complement
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x y {a}"), (2, "x y " + a.translate(str.maketrans("ab", "ba"))), (3, f"X Y {a}")]
    got = {r.doc_id: (r.component_id, r.class_id, r.n_links) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 2, 0), 3: (1, 1, 1)}


def test_word_hashes_tell_words():
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab\x80") for _ in range(r.randint(1, 40))) for _ in range(20_000)} | {"ab", "ab\0", "ab\0\0"})
    joint = "\t".join(words).encode() + b"\x0b"
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = ends - [len(w.encode()) for w in words]
    shingler = ngram_join.Shingler(3, b"key")
    hashes = shingler.words(joint, starts, ends)
    assert len(np.unique(hashes)) == len(words) and shingler.words(joint, starts, ends).tolist() == hashes.tolist()  # the second time from what is kept
    assert not set(hashes.tolist()) & set(ngram_join.Shingler(3, b"other").words(joint, starts, ends).tolist())


def test_words_made_to_collide_are_no_link(spark):
    """Words of one hash under an unkeyed sum of mixed pieces."""
    rows = [(1, "x y bcclfxzvjitgtbsv"), (2, "x y bhdpmuxb.//445m[")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()
    assert {(r.doc_id, r.component_id, r.class_id, r.n_links) for r in got} == {(1, 1, 1, 0), (2, 2, 2, 0)}


def test_phrases_made_to_collide_stay(spark):
    """Phrases of one hash under unkeyed 64-bit steps; the last 34 bytes are shared, and no 50."""
    rows = [(1, "eszycidpyopumzgd joeyuzgqivkkkricqhbcbnm jbwjpnkpq"), (2, "RcD!\\4Kqa cbtqvk joeyuzgqivkkkricqhbcbnm jbwjpnkpq")]
    assert all(len(x) == 50 for _, x in rows)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, bytes(r.kept).decode()) for r in got} == set(rows)


def test_near_duplicates_of_a_table_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 7, 8, 9), (2, text, 1, 2, 3), (3, "other words here", 4, 5, 6), (3, "other words here", 4, 5, 6)]
    got = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __t int, kept_id int, T int")).collect()
    assert sorted(map(tuple, got)) == [rows[0], rows[2]]


def test_classes_that_meet_are_told_apart(spark, monkeypatch):
    own = ngram_join._class_of
    monkeypatch.setattr(ngram_join, "_class_of", lambda s: (own(s)[0] >> 53 << 53 | own(s)[0] % 2, own(s)[1]))
    rows = copies(4, 120, True)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(df, n=5, percent=80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80)
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows, 5, 80)


def test_unlinked_rows_of_one_id_stay(spark):
    a, b = " ".join(f"t{i}" for i in range(50)), " ".join(f"s{i}" for i in range(50))
    rows = [(1, a, 1), (1, b, 2), (2, b + " end", 3), (1, a, 4), (1, a + " end", 5), (3, "", 6), (3, "", 7), (3, None, 8), (4, "", 9)]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    texts = collections.Counter((r.doc_id, r.text) for r in kept)
    assert texts[1, a] + texts[1, a + " end"] == 1 and texts[1, b] == 1 and texts[3, ""] == texts[3, None] == texts[4, ""] == 1 and len(kept) == 5


def test_one_of_each_stays(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "b"), (1, text, "a"), (1, text, "a"), (2, "other words entirely in this one", "c"), (None, text, "n"), (7, None, "e")], "doc_id long, text string, source string")
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, None: 1, 7: 1}
    assert ngram_join.keep_one_of_each(df.limit(0)).count() == 0


def test_overlap_bound_holds():
    r = np.random.default_rng(1)
    for n in (1, 40, 70, 900, 5000):
        for m in (n, max(1, n - n // 10)):
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[: m // 2], r.integers(0, 2**63, m - m // 2).astype(np.uint64)]))
            both, sizes = ngram_join.overlap_bound(ngram_join.cell_counts(x), ngram_join.cell_counts(y))
            assert both >= len(np.intersect1d(x, y)) and sizes == len(x) + len(y)


def test_components_of_chains(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 501)]
    r.shuffle(edges)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {100} and got[501] == 500
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- repeats ---------------------------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for i, x in rows:
        b = (x or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = collections.Counter()
    for i, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def repeats(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() + " " for _ in range(r.randint(4, 40))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(word() for _ in range(30)) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts)))
    runs = [(200, "ab" * 400), (201, "ab" * 300), (202, "z" * 1000), (203, "z" * 49), (204, "z" * 50), (205, "\0" * 80), (206, "\0" * 60), (207, None), (208, ""), (None, passages[0]), (3, passages[1])]
    r.shuffle(rows)
    return rows + runs


@pytest.mark.parametrize(("hot", "often", "bits"), [(10**6, 200, 24), (0, 200, 24), (4, 1, 24), (10**6, 2, 6)])
def test_repeats_equal_brute_force(spark, hot, often, bits, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "CELL_BITS", bits)
    monkeypatch.setattr(suffix_dedup, "PARSE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "GROUP_PHRASES", 50)
    rows = repeats(1)
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, key int, removed int")
    got = suffix_dedup.remove_repeats(df).collect()
    have = collections.Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert have == brute_repeats(rows)


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order():
    phrases = [b"banana", b"ananas", b"nan"]
    phrase, place, fresh = suffix_dedup.suffix_order(phrases, 3)
    texts = [phrases[p][q : q + 3] for p, q in zip(phrase, place, strict=True)]
    assert texts == sorted(x[i : i + 3] for x in phrases for i in range(len(x) - 2))
    assert fresh.tolist() == [i == 0 or texts[i] != texts[i - 1] for i in range(len(texts))]


def test_every_string_is_in_one_phrase():
    r = random.Random(2)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(0, 400))).encode() for _ in range(20)]
    text, place, count, _, _ = suffix_dedup.parse(texts)
    seen = collections.Counter((t, p + k) for t, p, n in zip(text.tolist(), place.tolist(), count.tolist(), strict=True) for k in range(n))
    assert seen == collections.Counter((t, p) for t, x in enumerate(texts) for p in range(len(x) - 49))


# ---- vectors -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.standard_normal(16) * 0.2).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)] + [(-40, rows[3][1], 1), (20, rows[20][1], 1)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [float("inf")] + [0.0] * 15, 1), (2080, [None] * 16, 1), (2100, [], 1), (None, rows[1][1], 1), (2120, [0.5, 0.5], 1), (2121, [0.25, 1.0], 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def brute_search(rows, every, k, scale, zero):
    held = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            held[i] = np.floor(scale * np.array(v, np.float64)) if scale else np.array(v, np.float64)
    out = {}
    for i, q in held.items():
        if i % every == 0:
            scored = sorted((-(float(q @ v)), j) for j, v in held.items() if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def by_query(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, float(r.score)))
    return out


@pytest.mark.parametrize("size", [16_384, 100])
def test_top_inner_products(table, size, monkeypatch):
    monkeypatch.setattr(vectors, "RANGE_ROWS", size)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 20)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert by_query(vectors.top_inner_products(table)) == brute_search(rows, 20, 20, 64, True)


def test_blocks_are_pruned():
    r = np.random.default_rng(2)
    centres = r.integers(-40, 40, (20, 8))
    v = np.repeat(centres, 100, 0) + r.integers(-2, 3, (2000, 8))
    ids = np.arange(2000)
    out, scored = vectors.block_search(v[::50].astype(float), ids[::50], v.astype(float), ids, 10, block=100)
    assert scored < 0.7 * 40 * 20 and len(out) == 400


def test_large_components_stay_exact():
    v = np.array([[2.0**40, 1], [2.0**40, -1], [3, 2.0**45]])
    out, _ = vectors.block_search(v[:1], np.array([0]), v, np.array([0, 1, 2]), 2)
    assert out.sort_values("score", ascending=False)["vec_id"].tolist() == [1, 2]


def test_additive_quantiser_recall(table):
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute_search(rows, 20, 20, None, False)
    got = by_query(vectors.nearest_neighbours(table, rerank=150))
    assert got.keys() == want.keys()
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert all(abs(s - dict(want[i])[j]) < 1e-12 for i in got for j, s in got[i] if j in dict(want[i]))


def test_recall_of_the_default_shape(spark):
    """Half of the vectors are not in the sample, and one in 32 is reranked."""
    x = np.random.default_rng(5).standard_normal((6_000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute_search(rows, 100, 20, None, False)
    got = by_query(vectors.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, max_train=3_000))
    assert got.keys() == want.keys() and vectors.rerank_size(6_000, 512, 20) == 188
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_rerank_size():
    assert [vectors.rerank_size(n, 512, 20) for n in (0, 30, 500, 2_000, 10_260, 16_384)] == [0, 30, 80, 80, 321, 512]


def test_estimates_that_single_precision_cannot_hold():
    x = np.random.default_rng(4).standard_normal((300, 8))
    aq = vectors.AdditiveQuantiser(books=4, words=16).fit(x)
    with np.errstate(all="ignore"):
        wide = np.concatenate([x[:20], x[:1] * 1e60])
        codes, norms = aq.encode(wide)
        found = aq.estimate(x[:5], codes, norms.astype("<f4"), np.sqrt((wide**2).sum(1)).astype("<f4"))
    assert np.isfinite(found[:, :20]).all() and (found[:, 20] == np.inf).all()
    assert np.corrcoef(found[:, :20].ravel(), (x[:5] @ x[:20].T).ravel())[0, 1] > 0.8


def test_quantiser_norms():
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8))
    aq = vectors.AdditiveQuantiser(books=4, words=16).fit(x)
    codes, norms = aq.encode(x)
    sums = sum(aq.codebooks[m][codes[:, m]] for m in range(4))
    assert np.allclose((sums**2).sum(1), norms, rtol=1e-3, atol=1e-3)
    assert np.allclose(aq.lookup(x[:5], codes), x[:5] @ sums.T, atol=1e-3)
    near = aq.lookup(x[:5], codes, norms)
    assert np.allclose(near, 2 * x[:5] @ sums.T - norms, atol=1e-2)


def test_empty_vectors(table):
    assert vectors.top_inner_products(table.limit(0)).count() == 0
    assert vectors.nearest_neighbours(table.limit(0)).count() == 0


def test_a_line_of_all_documents_and_a_phrase_without_end(spark):
    """A line in every document, before ever new words, is a few entries a task; so is a phrase that a document repeats 10^5 times."""
    r = random.Random(5)
    line = "this very line stands at the head of every single document of the table\n"
    rows = [(i, line + "".join(r.choice("abcdefgh ") for _ in range(60))) for i in range(2_000)]
    rows += [(5_000, "the same phrase, on and on; " * 100_000), (5_001, "x" + "the same phrase, on and on; " * 3), (4_999, "q" + "the same phrase, on and on; " * 3 + "!")]
    df = spark.createDataFrame([(i, i, x.encode()) for i, x in rows], "id long, key long, text binary").coalesce(1)
    entries = collections.Counter()
    for p in suffix_dedup.packed_phrases(df, 512).where("entries is not null").select("bucket", "entries").collect():
        for h in np.frombuffer(p.entries, suffix_dedup._ENTRY)["h"].tolist():
            entries[p.bucket, h] += 1
    assert max(n for (b, _), n in entries.items() if b < 512) == suffix_dedup.OFTEN + 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = collections.Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert have == brute_repeats(rows)

def test_phrases_that_share_little_more_than_a_trigger_are_settled_at_once(spark):
    """Words of 18 bytes stand in many documents, strings of 50 bytes in few: before ever new neighbours, a word is no entry of the dictionary."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(17)) + " " for _ in range(300)]
    rows = [(i, "".join(r.choice(words) for _ in range(30))) for i in range(200)]
    rows += [(1_000 + i, "".join(r.choice(words) for _ in range(4)) + rows[i][1][90 + i : 300]) for i in range(20)]
    df = spark.createDataFrame([(i, i, x.encode()) for i, x in rows], "id long, key long, text binary").coalesce(2)
    packed = suffix_dedup.packed_phrases(df, 8).toPandas()
    decided = [suffix_dedup.decide(b, parts, b >= 8) for b, parts in packed.groupby("bucket")]
    wanted = sum(len(x) for d in decided for x in d["wanted"] if x) // suffix_dedup._WANTED.itemsize
    assert wanted < 0.25 * sum(len(x) for x in packed["entries"] if x) // suffix_dedup._ENTRY.itemsize
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = collections.Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert have == brute_repeats(rows)


def test_sides_tell_all_phrases_that_share_a_string():
    """Equal strings of one trigger have equal bytes, on the left or on the right of it, that both phrases tell."""
    r = random.Random(8)
    words = ["".join(r.choice("abcd ") for _ in range(r.randint(10, 40))) for _ in range(15)]
    texts = ["".join(r.choice(words) for _ in range(12)).encode() for _ in range(60)]
    text, place, count, h, _, left, right = suffix_dedup._parse(texts, sides=True)
    assert ((left > 0) | (right > 0)).all()
    holders = collections.defaultdict(list)
    for i, (t, p, n) in enumerate(zip(text.tolist(), place.tolist(), count.tolist(), strict=True)):
        for k in range(n):
            holders[texts[t][p + k : p + k + 50]].append(i)
    shared = [(a[0], b) for a in holders.values() for b in a[1:]]
    assert len(shared) > 1_000
    assert all(h[a] == h[b] and (0 < left[a] == left[b] or 0 < right[a] == right[b]) for a, b in shared)


def test_tables_of_a_finished_step_are_deleted(spark):
    suffix_dedup.remove_repeats(spark.createDataFrame(repeats(3), "doc_id long, text string")).count()
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "strandix")
    # the one is still read, the other's strings are settled
    assert {x.name.rpartition("-")[0] for x in folder.iterdir()} & {"suffix-marks", "suffix-strings"} == {"suffix-marks"}


def test_small_batches_share_a_slice(spark):
    """A slice of phrases is filled from many Arrow batches, and batches that carry texts have few rows."""
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array([b"x" * 100])], names=["id", "key", "text"])
    assert [len(x) for x in suffix_dedup._segments(map(batch, range(50)))] == [50]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    suffix_dedup.remove_repeats(spark.createDataFrame(repeats(4), "doc_id long, text string"))
    assert int(spark.conf.get(name)) <= 2_000


def test_dictionary_rows_of_many_documents_share_a_batch(monkeypatch):
    """What is found in a partition's documents leaves the worker in one batch, not in one a document."""
    monkeypatch.setattr(suffix_dedup, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    run = suffix_dedup._strings(types.SimpleNamespace(mapInArrow=lambda run, schema: run), 8)
    asks = np.zeros(1, suffix_dedup._WANTED)
    asks["n"], asks["h"], asks["p"] = 3, 1, 5
    columns = [pa.array(range(300)), pa.array(range(300)), pa.array([b"text " + bytes([65 + i % 20]) * 60 for i in range(300)]), pa.array([[asks.tobytes()]] * 300, pa.list_(pa.binary()))]
    made = list(run([pa.RecordBatch.from_arrays(columns, names=["id", "key", "text", "wanted"]).slice(i, 10) for i in range(0, 300, 10)]))
    assert [x.num_rows for x in made] == [300]
    assert made[0].column(1).to_pylist() == list(range(300))
    assert made[0].column(4).to_pylist() == [bytes([65 + i % 20]) * 52 for i in range(300)]
