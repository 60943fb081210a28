"""Searches over vectors in blocks: exact top-k with pruned blocks, and additive quantisation with exact reranking.

Rows take part once per id: of rows with one id, the smallest vector counts. Null ids, null vectors and vectors
with null or non-finite components take no part, nor do empty vectors; vectors are compared with those of their own length.
Candidates are cut into ranges of about ``range_rows`` rows by id, queries likewise; each pair of a query range and a
candidate range is one bounded unit of work, and the best k of each unit meet in a window of k rows a unit.
An empty table gives an empty result, and other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, QUERY_ROWS, BLOCK_ROWS = 16_384, 1_024, 512


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(vec_id, v) as doubles, one row an id; zero vectors only with ``zero``."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & (F.size("v") > 0))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def in_ranges(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with the number of their id range, and how many ranges there are; bounds are quantiles of the ids."""
    n = rows.count()
    parts = max(1, -(-n // size))
    bounds = rows.agg(F.percentile_approx("vec_id", [i / parts for i in range(1, parts)], 100_000)).collect()[0][0] if parts > 1 else []
    bounds = np.array(bounds or [], np.int64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    return rows.withColumn("range", number("vec_id")), len(bounds) + 1


def packed(rows: DataFrame, prepare=None) -> DataFrame:
    """One row a range and vector length: ids and vectors in id order, as binaries, with what ``prepare`` makes of the vectors."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        v = np.stack(part["v"].to_numpy()).astype("<f8")
        extra = prepare(v) if prepare else b""
        return pd.DataFrame({"range": [key[0]], "dim": [key[1]], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "vectors": [v.tobytes()], "extra": [extra]})

    return rows.withColumn("dim", F.size("v")).groupBy("range", "dim").applyInPandas(pack, "range int, dim int, ids binary, vectors binary, extra binary")


def _unpack(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]), row["extra"]


class Ranges:
    """Candidates and queries of one search, packed by id ranges."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, every: int, zero: bool, prepare=None):
        rows = valid_vectors(df, id_col, vector_col, zero)
        candidates, self.n = in_ranges(rows, RANGE_ROWS)
        queries, self.n_queries = in_ranges(rows.where(F.col("vec_id") % every == 0), QUERY_ROWS)
        self.candidates, self.queries = packed(candidates, prepare), packed(queries)

    def best(self, unit, k: int, score_type: str) -> DataFrame:
        """Each query's k best over all units, larger scores first, then smaller ids."""
        left = self.queries.withColumnRenamed("range", "q").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))))
        right = self.candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(self.n_queries - 1))))
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

        def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
            out = [unit(_unpack(q), _unpack(c)) for _, q in queries.iterrows() for _, c in candidates.iterrows()]
            return pd.concat(out) if out else empty

        found = left.groupBy("q", "range", "dim").cogroup(right.groupBy("q", "range", "dim")).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
        first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(query_ids, vec_ids, scores) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_ids, "vec_id": vec_ids, "score": scores})


# ---- exact top-k with pruned blocks -------------------------------------------------------------------


def block_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK_ROWS) -> tuple[pd.DataFrame, int]:
    """The k candidates of largest inner product for each query, and how many (query, block) pairs were scored.

    Components are whole numbers; ``ids`` ascend. A block's bound for a query is the sum of its largest terms; each
    query takes its blocks by falling bounds, until a bound falls below its k-th score.
    """
    n, exact = len(ids), np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1]
    if exact >= 2**53 or exact * 2 >= 2 ** 62 // max(n, 1):
        return _plain_search(queries, query_ids, vectors, ids, k), len(queries) * -(-n // block)
    starts = list(range(0, n, block))
    top = np.stack([vectors[a : a + block].max(0) for a in starts])
    low = np.stack([vectors[a : a + block].min(0) for a in starts])
    bounds = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    # score and id as one number: larger scores first, then earlier rows
    best = np.full((len(queries), k), none, np.int64)
    active, scored = np.arange(len(queries)), 0
    for turn in range(len(starts)):
        kth = best[active].min(1)
        floor = np.where(kth == none, -np.inf, kth // n)
        active = active[bounds[active, order[active, turn]] >= floor]
        if not len(active):
            break
        at = order[active, turn]
        for b in np.unique(at):
            who, a = active[at == b], starts[b]
            points = (queries[who] @ vectors[a : a + block].T).astype(np.int64)
            mine = ids[a : a + block][None, :] == query_ids[who][:, None]
            keys = points * n + (n - 1 - np.arange(a, a + points.shape[1]))
            keys[mine] = none
            joint = np.concatenate([best[who], keys], 1)
            best[who] = np.partition(joint, joint.shape[1] - k, axis=1)[:, -k:]
            scored += len(who)
    row, col = np.nonzero(best != none)
    keys = best[row, col]
    return _rows(query_ids[row], ids[n - 1 - keys % n], keys // n), scored


def _plain_search(queries, query_ids, vectors, ids, k) -> pd.DataFrame:
    """For components too large for exact doubles: whole numbers of any size, the score held within 64 bits."""
    out = []
    whole = [[int(x) for x in v] for v in vectors]
    for q, i in zip(queries, query_ids, strict=True):
        q = [int(x) for x in q]
        scores = ((sum(a * b for a, b in zip(q, v, strict=True)), -j) for v, j in zip(whole, ids.tolist(), strict=True) if j != i)
        out += [(i, -j, min(max(s, -(2**63)), 2**63 - 1)) for s, j in sorted(scores, reverse=True)[:k]]
    return _rows(*map(list, zip(*out, strict=True))) if out else _rows([], [], [])


def top_inner_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and integer score: exact over floor(scale * x); queries are ids divisible by ``every``."""

    def unit(q, c):
        query_ids, queries, _ = q
        ids, vectors, _ = c
        return block_search(np.floor(scale * queries), query_ids, np.floor(scale * vectors), ids, k)[0]

    return Ranges(df, id_col, vector_col, every, zero=True).best(unit, k, "long")


def op6_block_topk(spark, sf_dir):
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# ---- additive quantisation ------------------------------------------------------------------------------


class AdditiveQuantiser:
    """Sums of one codeword from each of several full-dimensional codebooks."""

    def __init__(self, books: int = 20, words: int = 256, beam: int = 4, seed: int = 3):
        self.books, self.words, self.beam, self.seed = books, words, beam, seed
        self.codebooks = np.zeros((0, 0, 0), np.float32)

    def fit(self, sample: np.ndarray, rounds: int = 8) -> AdditiveQuantiser:
        """k-means on the residuals, book after book."""
        r = np.random.default_rng(self.seed)
        rest, books = sample.astype(np.float32), []
        for _ in range(self.books):
            c = rest[r.choice(len(rest), self.words, replace=len(rest) < self.words)].copy()
            for _ in range(rounds):
                near = (rest @ c.T * 2 - (c**2).sum(1)).argmax(1)
                sums, counts = np.zeros_like(c), np.bincount(near, minlength=self.words)
                np.add.at(sums, near, rest)
                c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
            books.append(c)
            rest = rest - c[(rest @ c.T * 2 - (c**2).sum(1)).argmax(1)]
        self.codebooks = np.stack(books)
        return self

    def encode(self, vectors: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search over the residuals, and the squared norms of the sums."""
        codes, norms = [], []
        for at in range(0, len(vectors), step):
            x = vectors[at : at + step].astype(np.float32)
            n, rest, path = len(x), x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
            for c in self.codebooks:
                cost = (c**2).sum(1) - 2 * rest @ c.T + (rest**2).sum(2)[..., None]
                flat = cost.reshape(n, -1)
                keep = min(self.beam, flat.shape[1])
                pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                beam, word = pick // len(c), pick % len(c)
                rows = np.arange(n)[:, None]
                path = np.concatenate([path[rows, beam], word[..., None].astype(np.uint8)], 2)
                rest = rest[rows, beam] - c[word]
            best = (rest**2).sum(2).argmin(1)
            codes.append(path[np.arange(n), best])
            norms.append(((x - rest[np.arange(n), best]) ** 2).sum(1))
        return np.concatenate(codes), np.concatenate(norms)

    def lookup(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """Inner products with the coded vectors, or, given norms, negative squared distances but for the query's own norm."""
        tables = np.einsum("qd,mkd->mkq", queries.astype(np.float32), self.codebooks, optimize=True)
        out = tables[0][codes[:, 0]]
        for m in range(1, len(tables)):
            out += tables[m][codes[:, m]]
        return out.T if norms is None else (2 * out - norms[:, None]).T


    def estimate(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Inner products with the coded vectors, each sum stretched to the length of the vector that it stands for.

        What single precision can't hold counts as large, so that the exact products decide.
        """
        stretch = np.where(norms > 0, lengths / np.sqrt(np.where(norms > 0, norms, 1)), 1)
        found = np.nan_to_num(self.lookup(queries, codes) * stretch, nan=np.inf, posinf=np.inf)
        found[:, ~(np.isfinite(norms) & np.isfinite(lengths))] = np.inf
        return found


def rerank_size(n: int, rerank: int, k: int) -> int:
    """How many of a unit's ``n`` vectors are reranked: ``rerank`` of a full range, the same share of a smaller one, and 4 k at least."""
    return min(n, max(4 * k, -(-rerank * n // RANGE_ROWS)))


def train_quantiser(df: DataFrame, id_col: str, vector_col: str, max_train: int = 8_192, **shape) -> AdditiveQuantiser | None:
    """Fits codebooks on the ``max_train`` vectors of smallest id hash (of the commonest length among them)."""
    rows = valid_vectors(df, id_col, vector_col, False).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_train).collect()
    if not rows:
        return None
    sizes = pd.Series([len(r["v"]) for r in rows])
    return AdditiveQuantiser(**shape).fit(np.array([r["v"] for r in rows if len(r["v"]) == sizes.mode()[0]]))


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, rerank: int = 512, max_train: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: every vector is coded; by the estimates of stretched sums, ``rerank`` of each full range are reranked by exact inner product."""
    aq = train_quantiser(df, id_col, vector_col, max_train)
    dim = aq.codebooks.shape[2] if aq else 0

    def prepare(vectors: np.ndarray) -> bytes:
        if vectors.shape[1] != dim:
            return b""
        codes, norms = aq.encode(vectors)
        lengths = np.sqrt((vectors**2).sum(1))
        return norms.astype("<f4").tobytes() + lengths.astype("<f4").tobytes() + codes.tobytes()

    def unit(q, c):
        query_ids, queries, _ = q
        ids, vectors, extra = c
        n = len(ids)
        take = rerank_size(n, rerank, k)
        if vectors.shape[1] != dim or take == n:  # vectors of another length are compared exactly, and those that are all reranked
            near = np.broadcast_to(np.arange(n), (len(queries), n))
        else:
            norms, lengths = np.frombuffer(extra, "<f4", 2 * n).reshape(2, n)
            codes = np.frombuffer(extra, np.uint8, offset=8 * n).reshape(n, -1)
            near = np.argpartition(-aq.estimate(queries, codes, norms, lengths), take - 1, axis=1)[:, :take]
        out = []
        for i, x, some in zip(query_ids, queries, near, strict=True):
            some = np.sort(some)
            some = some[ids[some] != i]
            exact = vectors[some] @ x
            best = np.lexsort((ids[some], -exact))[:k]
            out.append(_rows(np.full(len(best), i), ids[some[best]], exact[best]))
        return pd.concat(out)

    return Ranges(df, id_col, vector_col, every, zero=False, prepare=prepare).best(unit, k, "double")


def op8_additive_quantisation(spark, sf_dir):
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
