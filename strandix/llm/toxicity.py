"""Toxicity with noisy-channel deobfuscation.

Tokens that look disguised (signs or digits among letters, long repetitions, letters spaced apart) become a
lattice of intended characters; a Viterbi search under a character trigram model, counted over all texts, gives
the likeliest restorations, and the restored text is scored by a logistic model over words. Tokens are restored
whole and in the parts between their inner signs; those too long for one word are decoded in overlapping windows.

Labels are learned only from labelled rows with ``crc32(id as text) mod 5 != 0``: at most about ``max_train`` of
them, chosen by a hash of the id (the bound applies to labelled rows only; the character model has no bound). The lexicon holds
the ``max_words`` words that tell most, and a word in fewer than 4 toxic rows, or 1 % of them, is not learned from.
Label, language, source and id never enter a score.

Defined results: null and empty texts get the score of a text without evidence; without labels of both classes every
score is 0; repeated rows are scored each on its own; a null id is never held out and never learned from; repeated
or conflicting labels each count; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_column, map_texts, written

# What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou", "?": "aeiou"}
# Letters of other scripts that look like Latin ones.
LOOKALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "т": "t", "м": "m", "к": "k", "ο": "o", "α": "a", "ι": "i", "ε": "e"}
#: Costs of the channel, as negative log-probabilities.
SUBSTITUTED, REPEATED, DROPPED, IGNORED, KEPT = 0.7, 0.5, 0.4, 2.5, 0.02
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¡¿"
_OPENING = "".join(c for c in _EDGE if c not in "@$!|*+(<")
_CLOSING = "".join(c for c in _EDGE if c not in "@$|*")
_DECORATION = re.compile(r"([^\w\s])\1+$|^([^\w\s])\2+")
_TALL = re.compile(r"(?<=[a-z])I(?=[a-z])")  # a capital i that passes for a small l
_SPACED = re.compile(r"(?<!\S)\S{1,2}(?:[ ._*-]\S(?![^\s.,;:!?])|[._*-]\S){2,}[.,;:!?]?(?!\S)")
_SYMBOLS = 28  # boundary, a to z, any other letter
_RUN = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1{2,}")
# signs that part words: those that stand for no letter, and all of them
_PARTING = re.compile("[" + re.escape("".join(c for c in _EDGE if c not in LEET)) + "]+")
_ANY_SIGN = re.compile("[" + re.escape(_EDGE) + "]+")


_LATER_BYTES = bytes(range(0x80, 0xC0))


def _code_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for c in range(26):
        table[97 + c] = table[65 + c] = c + 1
    table[128:] = 27
    return table


def trigram_rows(texts: list[bytes | None]) -> list[tuple[int, int]]:
    """(code, count) of the letter trigrams of some texts, boundaries included."""
    joint = b"  ".join(x for x in texts if x).translate(None, _LATER_BYTES)  # a character counts once
    if not joint:
        return []
    c = _code_table()[np.frombuffer(b"  " + joint + b"  ", np.uint8)].astype(np.int32)
    n = np.bincount(c[:-2] * _SYMBOLS**2 + c[1:-1] * _SYMBOLS + c[2:], minlength=_SYMBOLS**3)
    return [(int(k), int(n[k])) for k in np.flatnonzero(n)]


def character_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(character | two before it), counted over every text; a table of fixed size."""
    rows = map_texts(df, text_col, text_col, lambda _, texts: trigram_rows(texts), "code int, n long", binary=True)
    counts = np.zeros(_SYMBOLS**3)
    for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    counts = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    pair = counts.sum(0)
    back = (pair + 0.1) / (pair + 0.1).sum(1, keepdims=True)
    return np.log((counts + 2 * back[None]) / (counts.sum(2, keepdims=True) + 2)).astype(np.float32)


def _number(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


class Restorer:
    """Viterbi decoding of a disguised token into the likeliest plain spellings, exactly: no state is left out.

    The state is the last two letters; each holds its ``keep`` best spellings, which makes the first ``keep`` of all exact.
    """

    def __init__(self, model: np.ndarray, keep: int = 4):
        self.model, self.keep = model.tolist(), keep

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each sign, the characters it may stand for ('' for none) with their costs."""
        out, before = [], ""
        for c in token:
            if c.isalpha():
                plain = LOOKALIKE.get(c) or unicodedata.normalize("NFKD", c)[0]
                arcs = [(plain, KEPT)] if plain == c else [(plain, 0.3), (c, 0.3)]
            else:
                arcs = [(x, SUBSTITUTED) for x in LEET.get(c, "")]
                if not c.isdigit():
                    arcs.append(("", IGNORED if c in LEET else DROPPED))
            if c == before:
                arcs.append(("", REPEATED))
            out.append(arcs or [("", 3.0)])
            before = c
        return out

    def restore(self, token: str) -> list[str]:
        """The likeliest spellings of one token, best first."""
        return [w for _, w in self.scored(token)]

    def scored(self, token: str) -> list[tuple[float, str]]:
        """Cost and spelling, the cheapest first."""
        model, keep = self.model, self.keep
        held = {(0, 0): {"": 0.0}}
        for arcs in self.lattice(token):
            grown: dict[tuple[int, int], dict[str, float]] = {}
            for (a, b), spellings in held.items():
                for c, cost in arcs:
                    if c:
                        n = _number(c)
                        key, step = (b, n), cost - model[a][b][n]
                    else:
                        key, step = (a, b), cost
                    into = grown.setdefault(key, {})
                    for w, s in spellings.items():
                        if s + step < into.get(w := w + c, 1e300):
                            into[w] = s + step
            held = {k: v if len(v) <= keep else dict(sorted(v.items(), key=lambda x: (x[1], x[0]))[:keep]) for k, v in grown.items()}
        final: dict[str, float] = {}
        for (a, b), spellings in held.items():
            for w, s in spellings.items():
                final[w] = min(final.get(w, 1e300), s - model[a][b][0])
        return sorted((s, w) for w, s in final.items())[:keep]


def plain_word(token: str) -> str:
    """A token in lower case without signs at its edges."""
    return token.lower().strip(_EDGE)


class Scorer:
    """Counts lexicon words in plain and restored tokens; the cache holds what each token stands for."""

    CACHE = 200_000
    LONGEST = 40  # characters of a token that is restored as one word

    def __init__(self, words: list[str], weights: np.ndarray, base: float, model: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.short = {_RUN.sub(r"\1", w): i for w, i in self.index.items()}
        self.long = [w for w in words if len(w) >= 4]
        self.most = max(map(len, self.short), default=0)
        self.weights, self.base = weights, base
        self.restorer, self.cache = Restorer(model), {}

    def _found(self, token: str) -> tuple[int, ...]:
        """Lexicon words that a token, or a part of it between signs, stands for."""
        found = set(self._word(token))
        parts = {x for p in (_PARTING, _ANY_SIGN) for x in p.split(token) if len(x) >= 3 and x != token}
        for x in parts:
            found.update(self._word(x))
        return tuple(sorted(found))

    def _word(self, token: str) -> tuple[int, ...]:
        """The lexicon word that a token stands for; of a token longer than a word, those within it."""
        word = plain_word(token)
        if word in self.index:
            return (self.index[word],)
        if not word or not any(c.isalpha() for c in word):
            return ()
        core = _TALL.sub("|", _DECORATION.sub("", token)).lower().lstrip(_OPENING).rstrip(_CLOSING)
        if not core.isalpha():
            core = core if len(core) <= self.LONGEST else _LONG_RUN.sub(r"\1\1", core)
            return self._restored(core) if len(core) <= self.LONGEST else self._within(core)
        if not core.isascii():  # accents and letters of other scripts have one plain form
            core = "".join(LOOKALIKE.get(c) or unicodedata.normalize("NFKD", c)[0] for c in core)
        if core in self.index:
            return (self.index[core],)
        runs = [len(m[0]) for m in _RUN.finditer(core)]
        if runs and (max(runs) > 2 or len(runs) > 1) and (flat := _RUN.sub(r"\1", core)) in self.short:
            return (self.short[flat],)
        # all letters: the only other spellings are those with shorter runs
        if len(core) > self.LONGEST:
            return self._held({core, _LONG_RUN.sub(r"\1\1", core)}) + self._held_flat(_RUN.sub(r"\1", core))
        return ()

    def _too_long(self, token: str) -> bool:
        """Whether every spelling of a token has more letters, runs counted once, than any lexicon word."""
        n, before = 0, set()
        for arcs in self.restorer.lattice(token):
            letters = {c for c, _ in arcs}
            if "" not in letters:
                n += letters.isdisjoint(before)
                before = letters
        return n > self.most

    def _restored(self, token: str) -> tuple[int, ...]:
        if self._too_long(token):
            return ()
        for form in self.restorer.restore(token):
            if form in self.index:
                return (self.index[form],)
            if (flat := _RUN.sub(r"\1", form)) in self.short:
                return (self.short[flat],)
        return ()

    def _held(self, forms) -> tuple[int, ...]:
        """Lexicon words that stand within some spellings."""
        return tuple(sorted({self.index[w] for form in forms for w in self.long if w in form}))

    def _held_flat(self, form: str) -> tuple[int, ...]:
        """Lexicon words that stand within a spelling without runs."""
        return tuple(sorted({self.index[w] for w in self.long if len(flat := _RUN.sub(r"\1", w)) >= 4 and flat in form}))

    def _within(self, core: str) -> tuple[int, ...]:
        """Lexicon words within a long run of signs and letters, decoded in overlapping windows."""
        found: set[int] = set()
        for window in {core[at : at + self.LONGEST] for at in range(0, len(core), self.LONGEST // 2)}:
            if sum(c.isalpha() for c in window) < 2:  # rules of signs spell nothing
                continue
            hit = self.cache.get((window,))
            if hit is None:
                hit = self._remember((window,), self._held(set(self.restorer.restore(window))))
            found.update(hit)
        return tuple(sorted(found))

    def _remember(self, key, value):
        if len(self.cache) >= self.CACHE:
            self.cache.clear()
        self.cache[key] = value
        return value

    def _spaced(self, run: str) -> list[int]:
        """Lexicon words in letters that are spaced apart, which may be several words."""
        return list(self._within("".join(run.lower().split())))

    def features(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, found = self.cache, set()
        for token in set(text.split()):
            hit = cache.get(token)
            if hit is None:
                hit = self._remember(token, self._found(token))
            found.update(hit)
        if _SINGLES.search(text):
            for m in _SPACED.finditer(text):
                found.update(self._spaced(m[0]))
        return sorted(found)

    def score(self, text: str | None) -> float:
        found = self.features(text)
        return float(1 / (1 + np.exp(-(self.base + self.weights[found].sum())))) if len(self.weights) else 0.0


#: Cheap sign of letters spaced apart, before the pattern proper.
_SINGLES = re.compile(r"(?<!\S)\S[ ._*-]\S[ ._*-]\S")


def _logistic(features: list[list[int]], labels: np.ndarray, n: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and base of a lightly regularised logistic model with non-negative weights, classes weighted alike."""
    x = np.zeros((len(features), n), np.float32)
    for row, found in zip(x, features, strict=True):
        row[found] = 1
    share = labels.mean()
    cost = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(labels)
    w, b = np.zeros(n, np.float32), np.float32(0)
    for step in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - labels) * cost
        pace = 40 / (1 + step / 100)
        w = np.maximum(w - pace * (x.T @ g + 1e-5 * w), 0)
        b -= pace * g.sum()
    return w.astype(np.float64), float(b)


def train_scorer(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, max_words: int = 256) -> Scorer:
    """Learns lexicon and weights from labelled rows outside the held-out fifth, and the character model from all texts."""
    model = character_model(df, text_col)
    free = F.crc32(F.col(id_col).cast("string")) % 5 != 0
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"), free_of(id_col).alias("ok")).where("ok and y in (0, 1)").drop("ok").distinct()
    n = known.count()
    grain = 1_000_003
    bound = grain if n <= max_train else grain * max_train // n
    picked = lambda c: F.pmod(F.xxhash64(c), F.lit(grain)) < bound
    rows = df.where(free & picked(F.col(id_col))).select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
    # distinct labels picked by hash are about ``max_train`` rows at most, so they can go to every task
    sample = written(rows.join(F.broadcast(known.where(picked(F.col("k")))), "k").select("y", "text"), "toxicity-sample")

    def words(ys, texts):
        count = Counter()
        for y, x in zip(ys, texts, strict=True):
            count.update((w, y) for w in {plain_word(t) for t in set(x.split())} if len(w) >= 3) if x else None
            count["", y] += 1
        for (w, y), k in count.items():
            yield w, k * y, k * (1 - y)

    table = map_texts(sample, "y", "text", words, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = table.where("word = ''").collect()
    toxic, clean = (total[0]["t"], total[0]["c"]) if total else (0, 0)
    if not toxic or not clean:
        return Scorer([], np.zeros(0), 0.0, model)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = table.where("word <> ''").where((F.col("t") >= max(4, 0.01 * toxic)) & (odds >= 3)).orderBy((F.col("t") / toxic - F.col("c") / clean).desc(), "word").limit(max_words).collect()
    lexicon = [r["word"] for r in best]
    blank = Scorer(lexicon, np.zeros(len(lexicon)), 0.0, model)

    def features(ys, texts):
        for y, x in zip(ys, texts, strict=True):
            yield y, blank.features(x)

    held = map_texts(sample, "y", "text", features, "y int, found array<int>").groupBy("y", "found").count().orderBy("y", "found").collect()
    rows_, ys = [], []
    for r in held:
        rows_ += [list(r["found"])] * r["count"]
        ys += [r["y"]] * r["count"]
    weights, base = _logistic(rows_, np.array(ys, np.float32), len(lexicon)) if lexicon else (np.zeros(0), 0.0)
    return Scorer(lexicon, weights, base, model)


def free_of(id_col: str):
    """Whether a row may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def score_toxicity(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None, **training) -> DataFrame:
    """id, score of the restored text, and the lexicon words found in it."""
    scorer = scorer or train_scorer(df, labels, id_col, text_col, **training)
    names = list(scorer.index)

    def kernel(ids, texts):
        for i, x in zip(ids, texts, strict=True):
            found = scorer.features(x)
            p = float(1 / (1 + np.exp(-(scorer.base + scorer.weights[found].sum())))) if names else 0.0
            yield i, p, [names[k] for k in found]

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, kernel, f"{id_col} {kind}, score double, words array<string>")


def reject_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, with all their columns."""
    scorer = train_scorer(df, labels, id_col, text_col, **training)

    return map_column(df, text_col, lambda texts: [scorer.score(x) < threshold for x in texts], keep=True)


def op3_toxicity(spark, sf_dir):
    scored = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("words", ",").alias("evidence"))
