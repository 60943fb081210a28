"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans: windows around base matches of a bounded sample
(``max_windows`` windows, chosen by hash over all documents) and written-out variants of the same kinds.
A text is decoded in overlapping windows around its triggers (digits, ``@``, and ``at`` as a word of any case, or
as capitals between small letters), out to the ends of the words around them and on until the edges are outside any span. Each character takes its tag from the window in whose middle
it stands most, and spans are read from the tags of the whole text, so window borders leave no mark.

Defined results: a null text is treated as empty; an empty text has no spans; repeated rows are scanned each
on its own; a null id is passed through; other columns are never read; an empty table, or one without any
base match, trains on the written-out variants alone.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts

# Kinds in the order in which they are listed, and the base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
METHOD_KINDS = tuple(f"nn_{k}" for k in BASE_KINDS)
_KIND_RANK = {k: i for i, k in enumerate(BASE_KINDS + METHOD_KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and a run is never given back
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_SIGN = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])|(?<=[a-z0-9])AT(?=[a-z0-9])")

SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def emails(text: str):
    """Leftmost matches in one pass: the local part is the run before an ``@``, back to the match before."""
    past, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > past and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            past = m.end()
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if text.encode("utf-8", "replace").translate(None, _NOT_DIGITS):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---- the network ------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(BASE_KINDS)  # outside, then begin and inside of each kind
_OTHER, _SPACE, _SYMBOLS = 95, 96, 97
_CODE = np.full(128, _SPACE, np.int32)
_CODE[32:127] = np.arange(95)
_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(BASE_KINDS)):
    for _from in range(TAGS):
        if _from not in (2 * _k + 1, 2 * _k + 2):
            _FORBIDDEN[_from, 2 * _k + 2] = -1e4


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], _OTHER)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, one LSTM per direction, linear scores and CRF transitions; all arrays are float32."""

    def __init__(self, embed: int = 12, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * (1 / np.sqrt(shape[-2]))).astype(np.float32)
        self.hidden = hidden
        self.p = {"E": draw(_SYMBOLS, embed), "X": draw(2, embed, 4 * hidden), "H": draw(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32), "O": draw(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, :, hidden : 2 * hidden] = 1

    def _states(self, codes: np.ndarray, keep: bool):
        """Hidden states of both directions, time first; the second direction runs over the reversed window."""
        n, t = codes.shape
        h = self.hidden
        both = np.stack([codes, codes[:, ::-1]])
        x = self.p["E"][both]
        pre = np.einsum("dnte,deg->tdng", x, self.p["X"], optimize=True) + self.p["b"]
        state = cell = np.zeros((2, n, h), np.float32)
        out, tape = np.empty((t, 2, n, h), np.float32), []
        for i in range(t):
            g = pre[i] + state @ self.p["H"]
            gates = _sigmoid(g[..., : 3 * h])
            fresh = np.tanh(g[..., 3 * h :])
            before, held = state, cell
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * fresh
            squashed = np.tanh(cell)
            state = gates[..., 2 * h :] * squashed
            out[i] = state
            if keep:
                tape.append((gates, fresh, before, held, squashed))
        return both, x, out, tape

    def _scores(self, out):
        joint = np.concatenate([out[:, 0], out[::-1, 1]], axis=-1)
        return joint, joint @ self.p["O"] + self.p["o"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tag path of each window."""
        scores = self._scores(self._states(codes, False)[2])[1]
        t, n, _ = scores.shape
        moves = self.p["A"] + _FORBIDDEN
        best, back = scores[0] + _FORBIDDEN[0], np.empty((t, n, TAGS), np.int8)
        for i in range(1, t):
            through = best[:, :, None] + moves
            back[i] = through.argmax(1)
            best = through.max(1) + scores[i]
        path = np.empty((t, n), np.int8)
        path[-1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            path[i - 1] = back[i][np.arange(n), path[i]]
        return path.T

    def gradients(self, codes: np.ndarray, tags: np.ndarray):
        """Negative log-likelihood of the tags a window, and its gradients."""
        both, x, out, tape = self._states(codes, True)
        joint, scores = self._scores(out)
        t, n, _ = scores.shape
        moves = self.p["A"] + _FORBIDDEN
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + _FORBIDDEN[0]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + moves, 1) + scores[i]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(moves + (scores[i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = tags.T
        rows = np.arange(n)
        d = np.exp(alpha + beta - z[None, :, None])
        loss = z - sum(scores[i, rows, gold[i]] for i in range(t)) - sum(moves[gold[i - 1], gold[i]] for i in range(1, t))
        for i in range(t):
            d[i, rows, gold[i]] -= 1
        moved = np.zeros_like(moves)
        for i in range(1, t):
            moved += np.exp(alpha[i - 1][:, :, None] + moves + (scores[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(moved, (gold[i - 1], gold[i]), -1)
        d /= n
        g = {"A": moved / n, "O": np.einsum("tnh,tnk->hk", joint, d, optimize=True), "o": d.sum((0, 1))}
        dj, h = d @ self.p["O"].T, self.hidden
        dout = np.stack([dj[..., :h], dj[::-1, :, h:]], axis=1)
        dstate = dcell = np.zeros((2, n, h), np.float32)
        dpre = np.empty((t, 2, n, 4 * h), np.float32)
        dh = np.zeros_like(self.p["H"])
        for i in range(t - 1, -1, -1):
            gates, fresh, before, held, squashed = tape[i]
            take, keep, give = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            dstate = dstate + dout[i]
            dcell = dcell + dstate * give * (1 - squashed**2)
            raw = np.concatenate([dcell * fresh, dcell * held, dstate * squashed], -1) * gates * (1 - gates)
            dpre[i] = np.concatenate([raw, dcell * take * (1 - fresh**2)], -1)
            dh += before.transpose(0, 2, 1) @ dpre[i]
            dstate, dcell = dpre[i] @ self.p["H"].transpose(0, 2, 1), dcell * keep
        g |= {"H": dh, "b": dpre.sum((0, 2))[:, None], "X": np.einsum("dnte,tdng->deg", x, dpre, optimize=True)}
        dx = np.einsum("tdng,deg->dnte", dpre, self.p["X"], optimize=True)
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], both, dx)
        return float(loss.mean()), g

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches; returns the losses."""
        r, losses = np.random.default_rng(seed), []
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(codes), min(batch, len(codes)))
            loss, g = self.gradients(codes[pick], tags[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            clip, pace = min(1, 5 / max(norm, 1e-9)), rate * (1 - 0.9 * step / steps)
            for k, v in g.items():
                v = v * clip
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                self.p[k] -= (pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses


# ---- training windows -------------------------------------------------------------------------------

WINDOW, STRIDE, REACH = 64, 32, 24


def _variant(r: random.Random, kind: str) -> str:
    """A written-out value of a kind, in forms beyond the base patterns."""
    word = lambda a, b: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(a, b)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        at = r.choice(["@", " @ ", " (at) ", "(at)", " [at] ", "[at]", " {at} "])
        dot = r.choice([".", " . ", " (dot) ", "(dot)", " [dot] ", "[dot]"]) if at != "@" else "."
        return word(3, 8) + r.choice(["", "." + word(2, 7), num(2)]) + at + word(3, 8) + dot + r.choice(["com", "org", "net", "example", "de"])
    if kind == "ip":
        return r.choice([".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return r.choice([" ", "-", "", ".", "/"]).join(num(4) for _ in range(4))
    return r.choice([f"+{num(2)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}"])


def _noise(r: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([num(r.randint(1, 6)), f"{num(2)}.{num(2)}", f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(3)},{num(3)}", "%%%", f"${num(3)}.{num(2)}", "0x" + num(8), f"{num(2)}:{num(2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(12, 40)))])


def training_windows(real: list[tuple[str, list]], plain: list[str], count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags: the real windows with their base spans, and as many of ``count`` with variants in plain text."""
    r, codes, tags = random.Random(seed), [], []
    words = [w for x in plain for w in x.split()] or ["the", "of", "and", "on", "to", "call", "write"]

    def add(text: str, spans) -> None:
        text = text[:WINDOW].ljust(WINDOW)
        row = np.zeros(WINDOW, np.int32)
        for kind, a, b in spans:
            k = BASE_KINDS.index(kind)
            if row[max(a, 0) : max(b, 0)].any():
                continue  # of overlapping spans the first keeps its tags
            row[max(a, 0) : max(b, 0)] = 2 * k + 2
            if 0 <= a < WINDOW:
                row[a] = 2 * k + 1
            elif a < 0 < b:
                row[0] = 2 * k + 1
        codes.append(encode(text))
        tags.append(row)

    for text, spans in real:
        add(text, spans)
    for _ in range(count):
        text, spans = " ".join(r.choice(words) for _ in range(r.randint(0, 5))) + " ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.6:
                value = _variant(r, kind := r.choice(BASE_KINDS))
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = _noise(r)
            text += value + r.choice([" ", ". ", ", ", "\n"]) + " ".join(r.choice(words) for _ in range(r.randint(0, 4))) + " "
        cut = r.randint(0, max(0, min(len(text) - 20, 30)))
        add(text[cut:], [(k, a - cut, b - cut) for k, a, b in spans if b > cut])
    return np.array(codes), np.array(tags)


def train_tagger(df: DataFrame, text_col: str = "text", max_windows: int = 1500, variants: int = 2500, steps: int = 300) -> Tagger:
    """Fits a tagger on windows around base matches (the ``max_windows`` of smallest hash over all texts) and on variants."""

    def kernel(ids, texts):
        for x in texts:
            for kind, a, b in base_spans(x) if x else ():
                low = max(0, a - REACH)
                yield x[low : low + WINDOW], [{"kind": k, "start": c - low, "end": d - low} for k, c, d in base_spans(x[low : low + WINDOW + 40]) for c, d in [(c + low, d + low)] if c < low + WINDOW]

    found = map_texts(df, text_col, text_col, kernel, f"window string, spans {SPAN_TYPE}")
    rows = found.dropDuplicates(["window"]).orderBy(F.xxhash64("window"), "window").limit(max_windows).collect()
    real = [(r["window"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows]
    tagger = Tagger()
    tagger.fit(*training_windows(real, [w for w, _ in real], variants), steps=steps)
    return tagger


# ---- the scan ---------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within ``REACH`` characters of a trigger, out to the ends of words, merged.

    An address needs a full stop or ``dot``, so ``at`` is none in a text without either.
    """
    trigger = _TRIGGER if "." in text or "dot" in text.lower() else _SIGN
    return widened(text, [(max(0, m.start() - REACH), min(len(text), m.end() + REACH)) for m in trigger.finditer(text)])


def widened(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order of their starts, out to the ends of words, merged."""
    out: list[list[int]] = []
    for a, b in stretches:
        past = out[-1][1] if out else 0
        while a > past and not text[a - 1].isspace():
            a -= 1
        b = max(b, past)
        while past < b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= past:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def window_starts(a: int, b: int) -> list[int]:
    return list(range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)) if b - a > WINDOW else [a]


def tag_texts(tagger: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans of the network for each text, from overlapping windows reconciled over the whole text.

    Where a span touches the edge of what was decoded, more is decoded, twice as much each time.
    """
    todo, more = {i: found for i, x in enumerate(texts) if (found := regions(x))}, REACH
    whole: dict[int, np.ndarray] = {}
    while todo:
        whole |= _tags(tagger, texts, todo, batch)
        grown = {}
        for i, stretches in todo.items():
            tags, n, wider = whole[i], len(texts[i]), []
            for a, b in stretches:
                end = min(n, window_starts(a, b)[-1] + WINDOW)
                low = max(0, a - more) if tags[a] else a
                wider.append((low, min(n, end + more) if tags[end - 1] and end < n else b))
            if wider != stretches:
                grown[i] = widened(texts[i], wider)
        todo, more = grown, 2 * more
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, tags in whole.items():
        kinds = np.where(tags > 0, (tags + 1) // 2, 0)
        cut = np.flatnonzero((np.diff(kinds, prepend=0) != 0) | ((tags % 2 == 1) & (tags > 0)))
        for a, b in zip(cut, [*cut[1:], len(tags)], strict=False):
            if kinds[a]:
                out[i].append((BASE_KINDS[kinds[a] - 1], int(a), int(b)))
    return out


def _tags(tagger: Tagger, texts: list[str], stretches: dict[int, list[tuple[int, int]]], batch: int) -> dict[int, np.ndarray]:
    """The tag of each character of some texts, 0 outside their stretches."""
    todo = [(i, s) for i, found in stretches.items() for a, b in found for s in window_starts(a, b)]
    whole = {i: (np.zeros(len(texts[i]), np.int8), np.full(len(texts[i]), -1e9, np.float32)) for i in stretches}
    middle = -np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2)
    for at in range(0, len(todo), batch):
        part = todo[at : at + batch]
        paths = tagger.decode(np.stack([encode(texts[i][s : s + WINDOW].ljust(WINDOW)) for i, s in part]))
        for (i, s), path in zip(part, paths, strict=True):
            tags, sure = whole[i]
            n = min(WINDOW, len(texts[i]) - s)
            better = middle[:n] > sure[s : s + n]
            tags[s : s + n][better] = path[:n][better]
            sure[s : s + n][better] = middle[:n][better]
    return {i: tags for i, (tags, _) in whole.items()}


def plausible(kind: str, value: str) -> bool:
    """Whether a tagged value has the parts of its kind."""
    n = len(_digits(value))
    if kind == "email":
        return len(value) >= 8 and ("@" in value or "at" in value.lower()) and any(c in value.lower() for c in (".", "dot"))
    if any(c.isalpha() for c in value) or value[0] not in "+(0123456789":
        return False
    if kind == "ip":
        return 4 <= n <= 12 and len(parts := re.findall(r"[0-9]+", value)) == 4 and all(map(_small, parts))
    return 13 <= n <= 19 if kind == "card" else 8 <= n <= 15


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None, **training) -> DataFrame:
    """id and ``spans``: all base matches, and what the network finds beside them; offsets in code points."""
    tagger = tagger or train_tagger(df, text_col, **training)

    def kernel(ids, texts):
        texts = [x or "" for x in texts]
        for i, x, own in zip(ids, texts, tag_texts(tagger, texts), strict=True):
            base = base_spans(x)
            more = [(f"nn_{k}", a, b) for k, a, b in own if plausible(k, x[a:b]) and not x[a - 1 : a].isalnum() and not x[b : b + 1].isalnum() and not any(c < b and a < d for _, c, d in base)]
            yield i, [{"kind": k, "start": a, "end": b} for k, a, b in sorted(base + more, key=lambda s: (_KIND_RANK[s[0]], s[1]))]

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, kernel, f"{id_col} {kind}, spans {SPAN_TYPE}")


def op7_personal_data(spark, sf_dir):
    """Digest columns from the spans of ``find_personal_data``, made in SQL functions."""
    found = find_personal_data(documents(spark, sf_dir))
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, part), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", part), ",").alias("spans"),
    )
