"""Scans, scorers and BPE against brute force, planted cases and odd tables."""

import base64
import hashlib
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandix.llm import bpe, licenses, mixing, pii, secrets, toxicity

ODD = ["", None, " ", "\n", "x", "é" * 40, "a" * 30_000, "0" * 20_000, "a.b@" * 500, "1 " * 3000, "word " * 5000, "\0\0", "日本語 テキスト"]


@pytest.fixture(scope="module")
def odd(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("id", T.StringType()), ("spans", T.IntegerType()), ("lang", T.StringType()), ("source", T.StringType()))])
    rows = [(i, x, "id", 1, None if i % 2 else "en", "s") for i, x in enumerate(ODD)]
    return spark.createDataFrame(rows + [(None, "secret: abcdefgh1234", None, None, None, None), rows[4], rows[4]], schema)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def b64(data):
    return base64.b64encode(data).decode()


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(x := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + x
    return bytes([tag]) + size + body


# ---- secrets ------------------------------------------------------------------------------------------


def test_secret_base_patterns():
    r = random.Random(1)
    parts = ["password", "Secret", "API_KEY", "token", ":", "=", " ", '"', "abcdefgh12", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "\n", "x"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(4000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = [("assign", *m.span()) for m in assign.finditer(x) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        got = secrets.in_code_points(x.encode(), secrets.scan(x.encode()))
        assert sorted(want) == sorted(s for s in got if s[0] in secrets.BASE_KINDS), x


def test_structures_are_confirmed():
    key = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b"")) + der(0x04, bytes(range(200)) * 2))
    part = lambda x: len(x).to_bytes(4, "big") + x
    public = part(b"ssh-ed25519") + part(bytes(range(32)))
    ssh = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(public) + part(bytes(range(120)))
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
    body = base64.urlsafe_b64encode(b'{"sub":"1"}').decode().rstrip("=")
    kinds = lambda x: {k for k, _, _ in secrets.scan(x.encode())}
    assert "der" in kinds("x " + b64(key)) and "der" in kinds("x " + key.hex()) and "ssh" in kinds("key " + b64(ssh))
    assert "token" in kinds(f"é {head}.{body}.c2lnbmF0dXJl end")
    assert "pem" in kinds("-----BEGIN PRIVATE KEY-----\n" + b64(key) + "\n-----END PRIVATE KEY-----")
    for layout in (
        der(0x30, der(0x02, b"\0") + b"".join(der(0x02, bytes(range(1, 40))) for _ in range(8))),
        der(0x30, der(0x02, b"\1") + der(0x04, bytes(range(32))) + der(0xA0, der(0x06, b"\x2a\x86\x48"))),
        der(0x30, der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x30, der(0x04, bytes(8)))) + der(0x04, bytes(range(90)))),
    ):
        assert "der" in kinds("x " + b64(layout)) and "der" in kinds("x " + layout.hex().upper())
    wrapped = re.sub("(.{64})", "\\1\n", b64(key))
    assert secrets.scan(f"dir/x{b64(key)}\nend".encode()) == [("der", 5, 5 + len(b64(key)))]
    assert secrets.scan(f"key:\n{wrapped}\nend".encode()) == [("der", 5, 5 + len(wrapped))]
    hidden = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n" + b64(bytes(range(160))) + "\n-----END RSA PRIVATE KEY-----"
    assert [s for s in secrets.scan(f"x {hidden} y".encode()) if s[0] == "pem"] == [("pem", 2, 2 + len(hidden))]
    certificate = der(0x30, der(0x30, der(0x02, bytes(range(1, 9))) + der(0x30, der(0x06, b"\x2a\x86"))) + der(0x30, der(0x06, b"\x2a\x86")) + der(0x03, bytes(range(120))))
    for no_secret in (certificate, der(0x30, der(0x30, der(0x06, b"\x2a\x86\x48")) + der(0x03, bytes(range(60)))), der(0x30, der(0x02, bytes(range(1, 20)))), public):
        assert not kinds("x " + b64(no_secret) + "\n-----BEGIN CERTIFICATE-----\n" + b64(no_secret) + "\n-----END CERTIFICATE-----") & set(secrets.METHOD_KINDS)
    assert not kinds("x " + b64(key[:-1])) & set(secrets.METHOD_KINDS)
    assert not kinds(b64(bytes(range(90)))) & set(secrets.METHOD_KINDS)
    assert not kinds(f"{body}.{body}.{body}") & set(secrets.METHOD_KINDS)


def test_keys_in_any_case_and_escaped():
    key = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b"")) + der(0x04, bytes(range(200)) * 2))
    part = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(b"public") + part(bytes(range(120)))
    mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(key.hex()))
    for value, kind in ((key.hex().upper(), "der"), (mixed, "der"), (ssh.hex().upper(), "ssh")):
        assert [s for s in secrets.scan(f"x {value} y".encode()) if s[0] in secrets.METHOD_KINDS] == [(kind, 2, 2 + len(value))]
        assert secrets.redacted(f"x {value} y".encode()) == b"x [SECRET] y"
    lines = re.sub("(.{64})", "\\1\n", b64(key))
    block = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\n"
    once = json.dumps({"key": block})
    for text in (once, once.replace("/", "\\/"), once.replace("\\n", "\\r\\n"), once.replace("\\n", "\\u000a"), json.dumps(once)):
        (span,) = [s for s in secrets.scan(text.encode()) if s[0] == "pem"]
        assert text[span[1] : span[2]].startswith("-----BEGIN") and text[span[1] : span[2]].endswith("KEY-----")
        assert b64(key)[:40].encode() not in secrets.redacted(text.encode())
    for end in ("\\n", "\\r\\n", "\\u000a"):
        text = '{"key": "' + end + b64(key) + end + '"}'
        assert [(k, text[a:b]) for k, a, b in secrets.scan(text.encode())] == [("der", b64(key))]
    assert not {k for k, _, _ in secrets.scan(("x " + key.hex().upper()[:-2]).encode())} & set(secrets.METHOD_KINDS)


def test_secrets_on_odd_rows(odd, empty):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == len(ODD) + 3 and [len(r.spans) for r in rows if r.doc_id is None] == [1]
    assert secrets.find_secrets(empty).count() == 0
    clean = secrets.redact_in_place(odd)
    assert clean.columns == odd.columns and clean.where("doc_id is null").first().text == "[SECRET]"


# ---- personal data -------------------------------------------------------------------------------------


def test_personal_data_base_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(2)
    for _ in range(6000):
        x = "".join(r.choice(["a", "1", "25", ".", "@", "-", "+", " ", "é", "4111 1111 1111 1111", "(0)"]) for _ in range(r.randint(0, 30)))
        want = [("email", *m.span()) for m in email.finditer(x)] + [("ip", *m.span()) for m in ip.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit()))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.base_spans(x) == want, x


def test_gradients_are_right():
    codes, tags = pii.training_windows([], ["some plain words"], 6)
    t = pii.Tagger(embed=5, hidden=4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    _, g = t.gradients(codes, tags)
    for k, v in t.p.items():
        at = (int(codes[0][2]), 1) if k == "E" else tuple(s // 2 for s in v.shape)
        v[at] += 1e-4
        up, _ = t.gradients(codes, tags)
        v[at] -= 2e-4
        down, _ = t.gradients(codes, tags)
        v[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_tagger_finds_variants(odd, empty):
    t = pii.Tagger()
    t.fit(*pii.training_windows([], ["the rest of it was written on the house by then"], 1500), steps=200)
    values = ["john.smith (at) example (dot) org", "(030) 123-4567", "4111/1111/1111/1111", "10 . 20 . 30 . 40"]
    found = pii.tag_texts(t, [f"please write to {v} then go on" for v in values] * 3 + ["nothing here at all"])
    assert sum(bool(x) for x in found) >= 9 and found[-1] == []
    rows = pii.find_personal_data(odd, tagger=t).collect()
    assert len(rows) == len(ODD) + 3 and pii.find_personal_data(empty, tagger=t).count() == 0


def test_windows_leave_no_mark():
    text = "x" * 500 + " call 555-123-4567 now " + "1" * 300
    (a, b), *_ = pii.regions(text)
    starts = pii.window_starts(a, b)
    covered = set()
    for s in starts:
        covered |= set(range(s, s + pii.WINDOW))
    assert set(range(a, b)) <= covered


def test_long_and_trigger_free_addresses():
    t = pii.Tagger()
    t.fit(*pii.training_windows([], ["the rest of it was written on the house by then"], 2500), steps=300)
    values = ["abcdefghijklmnoprstuvwabcdefghabc(at)example(dot)org", "smith at example dot org", "john.smith (At) example (dot) org", "smith[ at ]example.com"]
    for v in values:
        text = f"please write to {v} then go on"
        ((a, b),) = pii.regions(text)
        assert a <= 16 and b >= 16 + len(v), v
    values.pop(1)  # the network is shown this form, but not trained on it
    found = pii.tag_texts(t, [f"please write to {v} then go on" for v in values])
    assert [f for f, v in zip(found, values) if ("email", 16, 16 + len(v)) not in f] == []


def test_spans_at_edges_are_decoded_on():
    class Letters:  # tags every x as inside an address
        def decode(self, codes):
            return np.where(codes == ord("x") - 32, 2, 0).astype(np.int8)

    text = "a " * 200 + "x" * 31 + "1" + "x" * 900 + " a" * 200
    spaced = "a " * 200 + "1" + "x" * 20 + " " + "a " * 200
    assert ("email", 400, 431) in pii.tag_texts(Letters(), [text])[0] and ("email", 432, 1332) in pii.tag_texts(Letters(), [text])[0]
    assert pii.tag_texts(Letters(), [spaced, ""]) == [[("email", 401, 421)], []]


# ---- toxicity ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(4)
    words = ["the", "rather", "plain", "words", "of", "texts", "that", "are", "written", "here", "stand", "alone"]
    bad = ["idiot", "moron", "loser"]
    docs, labels = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(40)]
        y = i % 5 == 0
        if y:
            text[r.randrange(40)] = r.choice(bad)
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(y)))
    disguised = ["1d10t", "m o r o n", "l.o.s.e.r", "looooser", "m0r*n", "id!ot"]
    docs += [(1000 + i, f"the plain {w} of words", "en") for i, w in enumerate(disguised)] + [(2000, None, None), (2001, "", None), (None, "you moron", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_restores(toxic):
    docs, labels = toxic
    scorer = toxicity.train_scorer(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, scorer=scorer).collect()}
    assert all(got[i] > 0.5 for i in range(0, 400, 5)) and all(got[i] < 0.5 for i in range(400) if i % 5)
    assert sum(got[1000 + i] > 0.5 for i in range(6)) >= 5
    assert got[2000] == got[2001] < 0.5 < got[None]
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert 1 in kept and 0 not in kept and 2000 in kept and None not in kept


def test_toxicity_in_long_and_glued_tokens(toxic):
    docs, labels = toxic
    scorer = toxicity.train_scorer(docs, labels)
    stretched = ["l" + "o" * 45 + "ser", "m" + "0" * 60 + "ron", "id" + "i" * 20_000 + "ot"]
    glued = ["hey,moron", "idiot/loser", "idiot...you", "<b>idiot</b>", "<b>id!ot</b>", "plain,1d10t;words"]
    unspaced = ["therather" * 6 + "moron" + "plainwords" * 6, "therather2" * 6 + "m0ron" + "plainwords" * 6]
    missed = [x for x in stretched + glued + unspaced if scorer.score(f"the plain {x} of words") < 0.5]
    assert missed == []
    assert scorer.score("the plain " + "therather" * 20 + " rather/plain,words " + "x1" * 15_000 + " of words") < 0.5
    assert len(scorer.features("idiot/loser")) == 2


def test_restoration_equals_exhaustive_search():
    r = np.random.default_rng(6)
    model = np.log(r.dirichlet(np.ones(28), (28, 28)).transpose(2, 0, 1).transpose(1, 2, 0)).astype(np.float32)
    restorer, words = toxicity.Restorer(model), ["m0r*n", "1d!0t", "b@a@d", "l.o0se", "$+|#", "h3ll00", "a%b", "!!x", "é5"]
    for token in words:
        every = {"": (0.0, 0, 0)}
        paths = [("", 0.0)]
        for arcs in restorer.lattice(token):
            paths = [(w + c, s + cost) for w, s in paths for c, cost in arcs]
        best = {}
        for w, s in paths:
            a = b = 0
            for c in w:
                n = toxicity._number(c)
                s -= float(model[a][b][n])
                a, b = b, n
            s -= float(model[a][b][0])
            best[w] = min(s, best.get(w, 1e300))
        want = sorted((s, w) for w, s in best.items())[: restorer.keep]
        got = restorer.scored(token)
        assert [w for _, w in got] == [w for _, w in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-4), token


def test_decorated_texts_take_little_time(toxic):
    docs, labels = toxic
    scorer = toxicity.train_scorer(docs, labels)
    began = time.time()
    for x in ("***** " * 20_000, "- - - " * 20_000, "*-*-* _._ " * 10_000, "a.b.c.d " * 10_000, "x*y" * 20_000):
        assert scorer.score(x) < 0.5
    assert time.time() - began < 8


def test_toxicity_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_held_out_labels_are_not_seen(toxic, spark):
    docs, labels = toxic
    lies = labels.withColumn("toxic", F.when(toxicity.free_of("doc_id"), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a = toxicity.score_toxicity(docs, labels).orderBy("doc_id").collect()
    assert a == toxicity.score_toxicity(docs, lies).orderBy("doc_id").collect()


# ---- licences ------------------------------------------------------------------------------------------


def test_matching_statistics():
    r = random.Random(5)
    for _ in range(200):
        sequences = [[r.choice("abc") for _ in range(r.randint(1, 10))] for _ in range(3)]
        automaton, text = licenses.SuffixAutomaton(sequences), [r.choice("abcd") for _ in range(25)]
        occurs = lambda w: {(k, i + len(w)) for k, s in enumerate(sequences) for i in range(len(s) - len(w) + 1) if s[i : i + len(w)] == w}
        longest = [max((n for n in range(1, e + 1) if occurs(text[e - n : e])), default=0) for e in range(1, len(text) + 1)]
        want = [(e, n) for e, n in enumerate(longest, 1) if n >= 2 and (e == len(text) or longest[e] <= n)]
        got = list(automaton.matches(text, 2))
        assert [(e, n) for e, n, _ in got] == want
        assert all(set(automaton.ends[s]) == occurs(text[e - n : e]) for e, n, s in got)


def test_license_places_and_spans(odd, empty):
    s = licenses.LicenseScanner()
    n, places, spans = s.scan("é MIT-License, the Apache  license; GENERAL public license mit".encode())
    assert n == 10 and places == [(1, "mit"), (4, "apache"), (6, "gpl")] and spans == []
    text = licenses.TEMPLATES["mit-text"].split()
    text[20:20] = ["or", "so", "xyz"]
    found = s.scan((" ".join(["other"] * 30 + text + ["words"] * 9)).encode())[2]
    assert [x[0] for x in found] == ["mit-text"] and found[0][1] == 30 and found[0][3] > 0.9
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == len(ODD) + 3 and licenses.scan_licenses(empty).count() == 0


def test_every_copy_of_a_template_is_found():
    s = licenses.LicenseScanner()
    mit, gpl = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["gpl-text"]
    text = " ".join([mit, "one two three " * 20, mit, gpl, "four five " * 15, " ".join(mit.split()[:40]), "six", mit])
    found = s.scan(text.encode())[2]
    assert [x[0] for x in found].count("mit-text") == 4 and [x[0] for x in found].count("gpl-text") == 1
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]) if a[0] == b[0])


def test_known_runs_are_whole():
    s, r = licenses.LicenseScanner(min_match=4), random.Random(6)
    s.known = {"a", "b"}
    for _ in range(500):
        words = [r.choice("aabbc") for _ in range(r.randint(0, 30))]
        want = [(m.start(), list(m[0])) for m in re.finditer("[ab]{4,}", "".join(words))]
        assert list(s._known_runs(words)) == want


# ---- byte-pair encoding -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Vocabulary(bpe.default_vocabulary()).tokenizer


def test_words_encode_alone(tokenizer):
    r, special = random.Random(7), ("<|endoftext|>",)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "é", "1", "'s", "'", "!", " ", "　", "<|endoftext|>", "\0", "日", "²", " \n"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        words = bpe.split_words(x, special)
        assert "".join(words) == x
        assert [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(x, add_special_tokens=False).ids


def test_bpe_of_odd_rows(odd, empty, tokenizer):
    a = bpe.encode_and_decode(odd).collect()
    b = bpe.encode_and_decode(odd, broadcast_bytes=-1).collect()
    key = lambda r: (str(r.doc_id), bytes(r.ids))
    assert sorted(a, key=key) == sorted(b, key=key) and len(a) == len(ODD) + 3
    for r in a:
        if r.doc_id is not None:
            x = ODD[r.doc_id] or ""
            ids = tokenizer.encode(x, add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded == x
    assert bpe.encode_and_decode(empty).count() == 0


# ---- mixing ------------------------------------------------------------------------------------------------


def test_raked_margins(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, "w " * r.randint(1, 60) + ("@" if r.random() < 0.3 else ""), r.choice("aabc"), r.choice(["en", "de"])) for i in range(800)], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.3, "b": 0.3, "c": 0.4}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.7, "contact": 0.3}}
    profile = mixing.profiled(docs)
    cells = mixing.raked_cells(profile, targets, rounds=40, share=0.3)
    total = cells.agg(F.sum("w")).first()[0]
    for d in mixing.DIMENSIONS:
        for row in cells.groupBy(f"__{d}").agg(F.sum("w").alias("w")).collect():
            assert abs(row["w"] / total - targets[d][row[0]]) < 1e-6
    assert abs(total - 0.3 * cells.agg(F.sum("t")).first()[0]) < 1e-3 * total and cells.first()["residual"] < 1e-6
    kept = mixing.mix(docs, targets, share=0.3)
    assert kept.columns == docs.columns and 0.15 < kept.count() / 800 < 0.45


def test_goals_beyond_what_there_is(spark):
    rows = [(i, "w " * 10, "ab"[i % 10 == 0], "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = mixing.raked_cells(mixing.profiled(docs), {"source": {"a": 0.5, "b": 0.5}}, share=0.6).collect()
    assert {c["__source"]: round(c["w"], 6) for c in cells} == {"a": 500.0, "b": 100.0} and cells[0]["residual"] < 1e-9


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_margins_of_the_given_table(spark, share):
    cells = mixing.raked_cells(mixing.profiled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")), share=share).collect()
    total = sum(c["t"] for c in cells)
    assert cells[0]["residual"] < 0.01 and abs(sum(c["w"] for c in cells) - share * total) < 0.01 * share * total


def test_mixing_of_odd_rows(odd, empty):
    profile = mixing.profiled(odd)
    rows = mixing.with_probability(profile, mixing.raked_cells(profile)).collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r["__f"] <= 1 for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = c.execute(mixing.oracle_sql())
    names = [d[0] for d in want.description]
    got = mixing.op2_source_mixing(spark, path).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_digests_of_queries(spark):
    path = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in secrets.op4_secret_scan(spark, path).collect():
        base = sorted((m for m in secrets.in_code_points(text[r.doc_id].encode(), secrets.scan(text[r.doc_id].encode())) if m[0] in secrets.BASE_KINDS), key=lambda s: (s[1], secrets.KINDS[s[0]]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, f"text {i} of some words", "s" if i % 3 else "t", "en", 777, 5, 6, 7) for i in range(60)]
    names = ["doc_id", "text", "source", "lang", "__u", "__tokens", "__f", "x.y"]
    got = mixing.mix(spark.createDataFrame(rows, names), share=0.9)
    assert got.columns == names and {tuple(r)[4:] for r in got.collect()} == {(777, 5, 6, 7)} and set(map(tuple, got.collect())) <= set(rows)


def chains_by_trying(scanner, k, matches):
    """Chains of one template one after another: the best, then what stands before and behind."""
    out, todo = [], [sorted(matches)]
    while todo:
        some = todo.pop()
        score, first, last = max(((s, -f, e) for s, f, e in scanner._chains(some)), default=(0, 0, 0))
        first = -first
        if not some or score / scanner.sizes[k] < scanner.min_cover:
            continue
        out.append((scanner.labels[k], first, last, score / scanner.sizes[k]))
        todo += [[m for m in some if m[0] + m[2] <= first], [m for m in some if m[0] >= last]]
    return sorted(out, key=lambda x: x[1])


def best_cover(scanner, matches, at=None, i=-1):
    """The most words of a chain, by trying all subsequences of matches."""
    most = 0
    for j in range(i + 1, len(matches)):
        x, y, n = matches[j]
        if at is None:
            gain = n
        else:
            a, b, m = at
            if not (a < x and b < y and x <= a + m + scanner.gap and y <= b + m + scanner.gap):
                continue
            gain = n - max(0, a + m - x, b + m - y)
            if gain <= 0:
                continue
        most = max(most, gain + best_cover(scanner, matches, matches[j], j))
    return most


def test_license_chains_by_brute_force():
    r = random.Random(11)
    s = licenses.LicenseScanner({"t": " ".join(f"w{i}" for i in range(24)), "u": " ".join(f"v{i % 7}" for i in range(20))}, min_match=3, min_cover=0.3, gap=4)
    for _ in range(300):
        words = []
        for _ in range(r.randint(1, 6)):
            base = r.choice([[f"w{i}" for i in range(24)], [f"v{i % 7}" for i in range(20)], ["x"] * 6])
            a = r.randint(0, len(base) - 1)
            words += base[a : a + r.randint(1, 20)] + ["y"] * r.randint(0, 5)
        words = [w.encode() for w in words]
        held = [[], []]
        for at, run in s._known_runs(words):
            for end, n, state in s.automaton.matches(run, s.min_match):
                for k, stop in set(s.automaton.ends[state]):
                    held[k].append((at + end - n, stop - n, n))
        got = s.spans(words)
        assert got == [x for k in range(2) for x in chains_by_trying(s, k, held[k])]
        for k in range(2):
            if len(held[k]) <= 10:
                most = best_cover(s, sorted(held[k]))
                own = [x[3] for x in got if x[0] == s.labels[k]]
                assert max(own, default=0) == (most / s.sizes[k] if most / s.sizes[k] >= 0.3 else 0)


def test_many_copies_of_a_notice_are_one_pass():
    began = time.time()
    text = (licenses.TEMPLATES["mit-text"] + " ").encode() * 20_000
    assert len(licenses.LicenseScanner().scan(text)[2]) == 20_000
    assert time.time() - began < 60
