"""Archives and their index, ranked search and tokenizer alignment against brute force."""

import collections
import gzip
import hashlib
import math
import pathlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandix.llm import alignment, lexical, warc
from strandix.llm.bpe import Vocabulary

PAGES = "page_id long, url string, html string, __id string, value string, archive string"


def page_rows():
    r = random.Random(5)
    big = ["<p>" + "x" * 1200 + "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n\r\n" * 90, "é" * 500, "y" * 999, "\r" * 1000, "\n" * 1000]
    rows = [(i, r.choice(["http://a.org/x", "https://www.A.org:80/x/", "http://u@b.a.org?q=1#f", "c.org"]), r.choice([*big, "small", "", "end\r\n", "end\r", "\r\n\r\n"]), "i", "v", "a") for i in range(90)]
    return rows + [(None, "http://a.org/x", big[0], None, None, None), (7, None, None, None, None, None), (7, None, None, None, None, None), (500, "http://a\r\nb.org/", big[2], None, None, None), (500, "http://a.org/x", big[2], None, None, None), (900, "http://long.org", "z" * 3_000_000, None, None, None)]


def expected_records(rows):
    largest = {}
    for i, _, h, *_ in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -(10**18)), i)
    out = collections.Counter()
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and (h or "") in largest and largest[h or ""] != i
        out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[h or ""] if again else None] += 1
    return out


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    warc.write_archives(pages, f"file://{tmp_path}/a", captured_at=F.timestamp_seconds(F.coalesce("page_id", F.lit(0))))
    read = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    num = lambda x: None if x is None else int(x)
    assert collections.Counter((num(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, num(x.refers_to)) for x in read) == expected_records(rows)
    texts = collections.defaultdict(set)
    for i, _, h, *_ in rows:
        texts[i].add((h or "").encode())
    assert all(bytes(x.payload) in texts[num(x.page_id)] for x in read if x.record_type == "response")
    assert {x.url for x in read if x.page_id == "500"} == {"http://a%0D%0Ab.org/", "http://a.org/x"}
    # a file on its own is a whole archive: records one after another, each closed by an empty line
    for f in pathlib.Path(tmp_path, "a").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        assert not data or (data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n"))
    # a damaged payload, and a file cut short, are errors
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in pathlib.Path(tmp_path, "a").glob("*.gz"))
    for name, data in (("bad", whole.replace(b"small", b"smaLl")), ("cut", whole[:-20])):
        pathlib.Path(tmp_path, name).mkdir()
        pathlib.Path(tmp_path, name, "x.warc.gz").write_bytes(gzip.compress(data))
        with pytest.raises(Exception, match="states|within a record"):
            warc.read_archives(spark, f"file://{tmp_path}/{name}").count()


@pytest.mark.parametrize("per_range", [7, 1000])
def test_index_is_ordered_over_all_archives(spark, per_range):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(6)
    read = spark.createDataFrame([(str(i), u, None if i is None else f"2020-01-01T00:00:{i % 60:02d}Z") for i, u, *_ in rows], "page_id string, url string, captured_at string").repartition(6)
    found = warc.merged_index(read.withColumn("page_id", F.expr("try_cast(page_id as long)")), captures_a_range=per_range).orderBy("place").collect()
    assert [x.place for x in found] == list(range(len(rows)))
    keys = [(x.url_key, x.captured_at or "", -1 if x.page_id is None else x.page_id) for x in found]
    assert keys == sorted(keys)
    assert [x.previous for x in found] == [None, *(a.page_id if a.url_key == b.url_key else None for a, b in zip(found, found[1:], strict=False))]
    histories = warc.capture_histories(pages).collect()
    assert collections.Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in histories) == expected_records(rows)


def test_url_keys(spark):
    urls = ["http://a.org/x", "https://www.A.org:80/x/", "http://u@b.a.org?q=1#f", "c.org", "", None, "http://d.org/?a=b/"]
    keys = [x.k for x in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc.url_key(F.col("u")).alias("k")).collect()]
    assert keys == ["org,a)/x", "org,a)/x", "org,a,b)?q=1", "org,c)", "", "", "org,d)/?a=b"]


def test_loser_tree_merges():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 7, 8):
        runs = [sorted(r.randint(0, 9) for _ in range(r.randint(0, 6))) for _ in range(n)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_empty_tables(spark):
    assert warc.capture_histories(spark.createDataFrame([], PAGES)).count() == 0
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank_documents(docs, items).count() == 0 and lexical.rank_documents(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    aligned, pairs = alignment.align_documents(docs)
    assert aligned.count() == 0 and pairs.count() == 0


def ranked(rows, items, k):
    words = [lexical.terms_of(None if x is None else x.encode()) for _, x in rows]
    held = [i for i, w in enumerate(words) if w]
    n, total = len(held), sum(len(words[i]) for i in held)
    df = collections.Counter(t for w in words for t in set(w))
    out = collections.Counter()
    for item, text in items:
        scores = []
        for i in held:
            tf, m = collections.Counter(words[i]), 25 + 75 * len(words[i]) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in lexical.terms_of(None if text is None else text.encode()) if tf[t])
            if s > 0 and rows[i][0] is not None:
                scores.append((-s, rows[i][0]))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_matches_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 40, 200])))) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(None, rows[5][1]), (7, None), (8, ""), (9, " .,"), (10, "É é W1 w1_x"), (10, "É é W1 w1_x"), (11, "w1 " * 30000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 60])))) for i in range(25)] + [(50, None), (51, ""), (52, "nowhere"), (53, rows[3][1]), (53, rows[3][1]), (None, "w1 w2"), (54, "É")]
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 10)
    docs = spark.createDataFrame([(i, x, "e") for i, x in rows], "doc_id long, text string, segment string").repartition(3)
    asked = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, rank int")
    want = ranked(rows, items, 10)
    for small in (1 << 14, 50):
        monkeypatch.setattr(lexical, "SEGMENT_DOCS", small)
        assert collections.Counter(map(tuple, lexical.rank_documents(docs, asked).collect())) == want
    renamed = asked.select(F.col("item_id").alias("item"), "text")
    assert collections.Counter(map(tuple, lexical.rank_documents(docs, renamed, item_col="item").collect())) == want
    whole = lexical.index(docs)
    assert collections.Counter(map(tuple, lexical.rank_documents(docs, asked, segments=lexical.written(whole, "all-terms")).collect())) == want


def test_adding_stops_early_and_is_exact():
    r = np.random.default_rng(3)
    n = 4000
    p = lexical.Postings(np.arange(n), r.integers(5, 900, n), n, n * 400)
    for t in range(12):
        docs = np.sort(r.choice(n, 1500, replace=False)) if t else np.arange(40)
        p.add(t, docs, r.integers(1, 9, len(docs)))
    terms = [(t, 9000 if t == 0 else 300) for t in range(12)]
    scores, ids = p.best(terms, 10, 1)
    full = np.zeros(n, np.int64)
    for t, w in terms:
        docs, impact = p.by_document[t]
        full[docs] += w * impact
    best, found = lexical._cut(scores, ids, 10)
    order = np.lexsort((np.arange(n), -full))[:10]
    assert found.tolist() == order.tolist() and best.tolist() == full[order].tolist()
    assert len(scores) < 80  # a few candidates of 4,000 documents were completed
    assert not len(p.best(terms, 10, int(full.max()) + 1)[0])


def brute_alignment(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    left, right = Vocabulary(public_tokenizers.path("byte_bpe_50k.json")).pieces(), alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model")).bytes_of()
    per, counts = [], collections.Counter()
    for i, x in rows:
        a = tokenizer.encode(" " + x, add_special_tokens=False).ids if x else []
        b = model.encode(x) if x else []
        if not x or b"".join(left[k] for k in a) != (" " + x).encode() or b"".join(right[k] for k in b) != (" " + x).encode():
            per.append((i, [], [], [], []))
            continue
        ends = lambda ids, of: np.cumsum([len(of[k]) for k in ids]).tolist()
        ea, eb = ends(a, left), ends(b, right)
        links = [(p, q) for p, e in zip(a, ea, strict=True) for q, f in zip(b, eb, strict=True) if e == f] if len(a) < 400 else [(a[ea.index(e)], b[eb.index(e)]) for e in sorted(set(ea) & set(eb))]
        groups, low = [], 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(p) for p, y in zip(a, ea, strict=True) if low < y <= e) + "|" + ",".join(str(q) for q, y in zip(b, eb, strict=True) if low < y <= e)) if len(a) < 400 else None
            low = e
        counts.update(links)
        per.append((i, a, b, groups, links))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = collections.Counter()
    for i, a, b, groups, links in per:
        text = ";".join(groups)
        out[i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), text] += 1
    return out, counts


def alignment_texts():
    r = random.Random(8)
    bits = [" ", "  ", "\n", "\t", "a", "the", "ing", "É", "日本", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "\0", "ﬁ", "1234", "'s", "　", " ", ".", "--", "ß", "​", "é", "\r\n", "﻿", " "]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 14)))) for i in range(250)]
    rows += [(i, " ".join(r.choice(["Thanen", "heron", "of", "the,", "ution.", "x"]) for _ in range(40))) for i in range(300, 340)]
    return rows + [(None, "the of"), (5, None), (6, ""), (7, " "), (7, " "), (8, "\n"), (9, "the" * 40)]


def test_alignment_matches_whole_texts(spark, monkeypatch):
    rows = alignment_texts()
    want, counts = brute_alignment(rows)
    docs = spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "doc_id long, text string, slice string, k int").repartition(4)
    for small in (8 << 20, 300):
        monkeypatch.setattr(alignment, "SLICE", small)
        aligned, pairs = alignment.align_documents(docs)
        assert collections.Counter(map(tuple, aligned.collect())) == want
        assert {(x.a, x.b): x.links for x in pairs.collect()} == dict(counts)
    assert sum(1 for x in want if x[1] == 0) >= 3 and any(x[1] for x in want)


def test_counts_of_slices_are_not_collected(spark):
    """Counts meet their slices as rows that are sorted and may spill: no list of them is held on the JVM's heap, where a task kept up to 128 slices' at a time."""
    docs = spark.createDataFrame([(i, f"some words {i} and more") for i in range(20)], "doc_id long, text string")
    aligned, _ = alignment.align_documents(docs)
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert sorted(r.doc_id for r in aligned.collect()) == list(range(20))


def test_long_text_is_aligned_whole(spark):
    x = "".join(random.Random(2).choice("abcdefgh") for _ in range(60_000))
    (row,) = alignment.align_documents(spark.createDataFrame([(1, x + " end")], "doc_id long, text string"))[0].collect()
    assert row.n_links == row.n_groups and ",".join(g.split("|")[0] for g in row.groups.split(";")).count(",") + 1 == row.n_a


def test_transducer_states():
    pieces = [b"ab", b"c", b"a", b"bc", b"b", b""]
    t = alignment.Transducer(pieces, pieces)
    of = lambda *x: [pieces.index(p) for p in x]
    for _ in range(2):  # the second time from what is kept
        assert t.groups(of(b"ab", b"c"), of(b"a", b"bc")) == [(2, 2)]
        assert t.groups(of(b"ab", b"c"), of(b"ab", b"c")) == [(1, 1), (2, 2)]
        assert t.groups(of(b"ab"), of(b"a")) is None and t.groups(of(b"a"), of(b"b")) is None and t.groups([], of(b"a")) is None and t.groups([], []) == []
        assert t.groups(of(b"a", b""), of(b"a")) is None and t.groups(of(b"a"), of(b"a", b"")) is None
    assert (0, b"b") in t.number and (1, b"c") in t.number
