"""Secret scan with structural confirmation.

Base patterns (assignments, access keys, lower-case hex runs) are reported as they stand. Base64 runs, also over several lines or
behind a path, and hex runs of any case are candidates only: they are decoded, and reported when the bytes parse as a private key or token --
DER with nested lengths that fill the value exactly, in the layout of a PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA private key;
OpenSSH private keys, whose fields fill the data; PEM blocks whose body is one of these (its line ends may be escaped, as in JSON),
or is told to be encrypted by the block's header lines; and signed tokens whose header is a JSON object that names an algorithm.
Certificates and public keys are no secrets and not reported.

Defined results: a null text is treated as empty; an empty text has no spans; repeated rows are scanned
each on its own; a null id is passed through. Only the id and text columns are read, so other columns
of any name do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_column, map_texts

# The base patterns, and the kinds in the order in which ties are listed.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("pem", "token", "der", "ssh")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

ANY_HEX = re.compile(rb"[0-9A-Fa-f]{32,}")
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----((?:\s|\\++(?:[nrt]|u000[9aAdD]))*+(?:[A-Za-z-]+:[ \t][^\n\r\\]*+(?:\s|\\++(?:[nrt]|u000[9aAdD]))++)*+)((?:[A-Za-z0-9+/=\s]|\\++(?:[nrt/]|u000[9aAdD]))*+)-----END \1-----")
ESCAPED = re.compile(rb"\\+(?:[nrt]|u000[9aAdD])|\\+(?=/)|\s+")
BREAK = re.compile(rb"(?:[ \t]*\r?\n[ \t>#*]*|\\r?\\?n)")
LINE = re.compile(rb"[A-Za-z0-9+/]+={0,2}")
LONGEST_WRAPPED = 1 << 16  # base64 characters; longer keys do not occur
KEY_START = re.compile(rb"M[CDEFGHI]")
LEAD = re.compile(rb"[nrt]|u000[9aAdD]")
RUN = re.compile(rb"[A-Za-z0-9+/_-]{18,}={0,2}")
SIGNED = re.compile(rb"\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
KINDS = {k: i for i, k in enumerate(BASE_KINDS + METHOD_KINDS)}
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"

_B64 = bytes(c if chr(c).isalnum() and c < 128 or c in b"+/_-" else 32 for c in range(256))
_HEX = bytes(1 if chr(c) in "0123456789abcdefABCDEF" else 0 for c in range(256))


def decode64(run: bytes) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    core = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + b"=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """(start, stop) of the value of the DER element at ``at``, or None if its length does not fit in ``end``."""
    if at + 2 > end:
        return None
    n, at = data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (at, at + n) if at + n <= end else None


def der_elements(data: bytes) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the elements of a SEQUENCE that fills the data and whose lengths nest exactly all the way down."""
    if len(data) < 16 or data[0] != 0x30:
        return None
    outer = der_length(data, 0, len(data))
    if outer is None or outer[1] != len(data):
        return None
    top: list[tuple[int, int, int]] = []
    todo = [(*outer, True)]
    while todo:
        at, end, first = todo.pop()
        while at < end:
            tag, got = data[at], der_length(data, at, end)
            if got is None:
                return None
            if first:
                top.append((tag, *got))
            if tag & 0x20:
                todo.append((*got, False))
            at = got[1]
    return top


def is_der_key(data: bytes) -> bool:
    """A private key: PKCS#1 or DSA integers, PKCS#8, its encrypted form, or SEC1."""
    top = der_elements(data)
    if not top:
        return False
    tags, small = [t for t, _, _ in top], int.from_bytes(data[top[0][1] : top[0][2]], "big") if top[0][0] == 0x02 else -1
    names_algorithm = lambda k: data[top[k][1] : top[k][1] + 1] == b"\x06"
    if set(tags) == {0x02} and small in (0, 1):
        return len(tags) in (6, 9) and top[1][2] - top[1][1] >= 8 or len(tags) > 9
    if small in (0, 1) and tags[1:3] == [0x30, 0x04]:
        return names_algorithm(1) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if small == 1 and tags[1:2] == [0x04]:
        return top[1][2] - top[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
    return tags == [0x30, 0x04] and names_algorithm(0) and top[1][2] - top[1][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: the magic, then cipher, key derivation and its options, public keys and the private part, which fill the data."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 3
    while fields:
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at, fields = at + 4 + n, fields - 1
        if not fields and at <= len(data):
            keys = int.from_bytes(data[at : at + 4], "big")
            at += 4
            for _ in range(keys + 1):
                if at + 4 > len(data):
                    return False
                at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def wrapped_key(text: bytes, start: int, end: int) -> int | None:
    """Where a DER or OpenSSH key ends whose base64 begins at ``start`` and goes on over line ends past ``end``."""
    head = decode64(text[start : start + 8])
    if not head or head[0] != 0x30:
        return None
    got = der_length(head + bytes(4), 0, 1 << 33)
    need = -(-got[1] // 3) * 4 if got else 0
    if not end - start < need <= LONGEST_WRAPPED:
        return None
    chars, at = bytearray(text[start:end]), end
    while len(chars) < need:
        gap = BREAK.match(text, at)
        more = LINE.match(text, gap.end(), gap.end() + need - len(chars)) if gap else None
        if not more:
            return None
        chars += more[0]
        at = more.end()
    raw = decode64(bytes(chars))
    return at if raw and is_der_key(raw) else None


def is_token_header(data: bytes | None) -> bool:
    try:
        head = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _inner_key(text: bytes, start: int, end: int) -> tuple[int, int] | None:
    """(start, end) of a key that begins within a run, behind other characters of the alphabet, or goes on over line ends."""
    for m in KEY_START.finditer(text, start, end):
        head = decode64(text[m.start() : m.start() + 8])
        got = der_length(head + bytes(4), 0, 1 << 33) if head and len(head) >= 4 and head[0] == 0x30 else None
        if got is None:
            continue
        chars = -(-got[1] * 4 // 3)  # without padding
        if m.start() + chars <= end:
            stop = m.start() + chars
            while stop < end and text[stop] == 61:
                stop += 1
            # a key ends where its run does, or at a sign that is no base64
            if stop == end and (raw := decode64(text[m.start() : stop])) and is_der_key(raw):
                return m.start(), stop
        elif (m.start() == start or text[m.start() - 1 : m.start()] in (b"/", b"_", b"-", b"=")) and (stop := wrapped_key(text, m.start(), end)) is not None:
            return m.start(), stop
    return None


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of one text in bytes, unsorted."""
    spans: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # 32 bytes in a row hold 8 sampled positions in a row
    if b"\x01" * 8 in text[::4].translate(_HEX):
        for m in HEX.finditer(text):
            spans.append(("hex", m.start(), m.end()))
        runs = {m.span() for p in (HEX, ANY_HEX) for m in p.finditer(text)}
        for a, b in sorted(runs):
            if (b - a) % 2 == 0 and (is_der_key(raw := bytes.fromhex(text[a:b].decode())) or is_ssh_key(raw)):
                spans.append(("der" if raw[0] == 0x30 else "ssh", a, b))
    blocks = []
    if b"-----BEGIN " in text:
        for m in PEM.finditer(text):
            raw = decode64(ESCAPED.sub(b"", m[3]))
            hidden = b"ENCRYPTED" in m[2] and b"DEK-Info" in m[2] and m[1].endswith(b"PRIVATE KEY")
            if raw and (is_der_key(raw) or is_ssh_key(raw) or hidden and len(raw) % 8 == 0):
                spans.append(("pem", m.start(), m.end()))
                blocks.append(m.span())
    if max(map(len, text.translate(_B64).split()), default=0) >= 18:
        past = 0
        for m in RUN.finditer(text):
            if m.start() < past or any(a <= m.start() < b for a, b in blocks):
                continue
            # what an escaped line end puts before a run is no part of it
            start = m.start()
            if text[start - 1 : start] == b"\\" and (lead := LEAD.match(text, start)):
                start = lead.end()
            run = text[start : m.end()]
            raw = decode64(run)
            if raw is None:
                if (found := _inner_key(text, start, m.end())) is not None:
                    spans.append(("der", *found))
                    past = found[1]
                continue
            if (rest := SIGNED.match(text, m.end())) and is_token_header(raw):
                spans.append(("token", start, rest.end()))
                past = rest.end()
            elif not ANY_HEX.fullmatch(run):
                if is_der_key(raw):
                    spans.append(("der", start, m.end()))
                elif is_ssh_key(raw):
                    spans.append(("ssh", start, m.end()))
                elif (found := _inner_key(text, start, m.end())) is not None:
                    spans.append(("der", *found))
                    past = found[1]
    return spans


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans with offsets counted in code points, by start, then kind."""
    if not text.isascii():
        marks, at, points = {}, 0, 0
        for edge in sorted({x for _, a, b in spans for x in (a, b)}):
            points += len(text[at:edge].decode())
            marks[edge], at = points, edge
        spans = [(k, marks[a], marks[b]) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS[s[0]], s[2]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: every base match and every structurally confirmed key or token, offsets in code points."""

    def kernel(ids, texts):
        for i, x in zip(ids, texts, strict=True):
            found = in_code_points(x, scan(x)) if x else []
            yield i, [{"kind": k, "start": a, "end": b} for k, a, b in found]

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, kernel, f"{id_col} {kind}, spans {SPAN_TYPE}", binary=True)


def redacted(text: bytes) -> bytes:
    """The text with each span, overlapping ones as one, replaced by ``[SECRET]``."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in scan(text)):
        if b > at:
            if a >= at:
                out += [text[at:a], b"[SECRET]"]
            at = b
    return b"".join([*out, text[at:]])


def redact_in_place(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df``, with secrets in the text replaced; null texts stay null."""

    return map_column(df, text_col, lambda texts: [x if x is None else redacted(x.encode()).decode() for x in texts])


def op4_secret_scan(spark, sf_dir):
    """Digest columns from the spans of ``find_secrets``, made in SQL functions."""
    found = find_secrets(documents(spark, sf_dir))
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, part), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", part), ",").alias("spans"),
    )
