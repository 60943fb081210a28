"""Reordering weighted strings so that equal weights meet.

A string is an edge between its first and last weight, and may be turned round. Strings that follow each other without a new run share
a weight, so a walk of such strings is a trail, and the fewest walks are the fewest trails that use every edge once: half the weights of
odd degree in a connected part, at least one. They are found by joining odd weights in pairs with helper edges, walking a closed
trail of each part, and cutting it at the helpers. Strings of one pair of weights are alike to this: all but one or two of them are
walked there and back in one go. So only the distinct pairs of weights are walked, with their counts, and strings take their places by a join on
their pair and their number in it. A bounded number of pairs is walked on the driver, more by joins (``cover``).
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.storage import shared_dir, stored
from .cover import walks
from .running import running_sums

ON_DRIVER = 100_000  # distinct pairs of weights that the driver walks; more are walked by joins
SALTS = 64


def trails(edges: list[tuple[int, int, int]]) -> list[list[tuple[int, bool]]]:
    """Fewest walks over edges (id, front, back); each walk lists (id, forward)."""
    at: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)

    def add(i: int, a: int, b: int) -> None:
        at[a].append((i, b, True))
        at[b].append((i, a, False))

    for i, a, b in edges:
        add(i, a, b)
    # odd weights are paired within their connected part, which a walk over the parts tells
    seen: set[int] = set()
    helper = -1
    for start in sorted(at):
        if start in seen:
            continue
        seen.add(start)
        part, todo = [], [start]
        while todo:
            v = todo.pop()
            part.append(v)
            for _, w, _ in at[v]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        odd = sorted(v for v in part if len(at[v]) % 2)
        for a, b in zip(odd[::2], odd[1::2], strict=True):
            add(helper, a, b)
            helper -= 1
    used: set[int] = set()
    out = []
    for start in sorted(at):
        path, trail = [(start, None)], []
        while path:
            v, came = path[-1]
            while at[v] and at[v][-1][0] in used:
                at[v].pop()
            if at[v]:
                i, w, forward = at[v].pop()
                used.add(i)
                path.append((w, (i, forward)))
            else:
                path.pop()
                if came is not None:
                    trail.append(came)
        trail.reverse()
        cuts = [n for n, (i, _) in enumerate(trail) if i < 0]
        if cuts:  # a closed trail may begin right after a helper
            trail = trail[cuts[0] + 1 :] + trail[: cuts[0]]
        walk: list[tuple[int, bool]] = []
        for i, forward in trail:
            if i < 0:
                out += [walk] if walk else []
                walk = []
            else:
                walk.append((i, forward))
        out += [walk] if walk else []
    return out


def pair_runs(pairs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int, bool]], int]:
    """From (low, high, count): (low, high, first number, count, first place, from low) of runs of strings of a pair, and the number of walks.

    A run's strings are walked there and back in turn; those whose ends agree always the same way.
    """
    edges = []
    for k, (a, b, n) in enumerate(pairs):
        edges += [(2 * k + j, a, b) for j in range(1 if a == b or n % 2 else 2)]
    found, runs, done, place = trails(edges), [], {}, 0
    for walk in found:
        for i, forward in walk:
            a, b, n = pairs[i // 2]
            size = 1 if i // 2 in done else n if a == b else n - 1 + n % 2
            runs.append((a, b, done.get(i // 2, 0), size, place, forward))
            done[i // 2] = done.get(i // 2, 0) + size
            place += size
    return runs, len(found)


def _runs_of_pairs(pairs: DataFrame, on_driver: int) -> tuple[DataFrame, int, bool]:
    """(a, b, number, size, place, from_low), the number of walks, and whether pairs are within ``on_driver``: then they are walked on the driver, else by joins."""
    spark = pairs.sparkSession
    if len(pairs.limit(on_driver + 1).head(on_driver + 1)) <= on_driver:
        runs, n = pair_runs([tuple(r) for r in pairs.orderBy("low", "high").collect()])
        return spark.createDataFrame(runs, "a long, b long, number long, size long, place long, from_low boolean"), n, True
    keyed = stored(pairs.withColumns({"key": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")}), f"{shared_dir(spark)}/strandix/pairs-{uuid.uuid4().hex}")
    numbered = running_sums(keyed, "key", {"one": "p"})
    # an odd number of strings is one edge; an even one two, all but one string and that
    several = (F.col("low") != F.col("high")) & (F.col("n") % 2 == 0)
    first = numbered.select((2 * F.col("p")).alias("e"), "low", "high", F.lit(0).cast("long").alias("number"), (F.col("n") - several.cast("long")).alias("size"))
    second = numbered.where(several).select((2 * F.col("p") + 1).alias("e"), "low", "high", (F.col("n") - 1).alias("number"), F.lit(1).cast("long").alias("size"))
    edges = stored(first.unionByName(second), f"{shared_dir(spark)}/strandix/edges-{uuid.uuid4().hex}")
    found, n = walks(edges.select("e", "low", "high", "size"))
    return edges.join(found, "e").select(F.col("low").alias("a"), F.col("high").alias("b"), "number", "size", "place", "from_low"), n, False


def permutation(endpoints: DataFrame, block: int = 1 << 16, on_driver: int = ON_DRIVER) -> tuple[DataFrame, int]:
    """(string_id, new_pos, forward) from (string_id, front, back), and the number of walks.

    Distinct pairs of weights are walked on the driver up to ``on_driver`` of them, and by joins beyond. Strings are numbered within their pair
    in blocks of ids; those of a frequent pair meet its runs in a broadcast of that bound, or dealt out by a number of their own.
    """
    ends = endpoints.select("string_id", "front", F.least("front", "back").alias("low"), F.greatest("front", "back").alias("high"), F.floor(F.col("string_id") / block).alias("block"))
    counts = stored(ends.groupBy("low", "high", "block").agg(F.count("*").alias("n")), f"{shared_dir(ends.sparkSession)}/strandix/pairs-{uuid.uuid4().hex}")
    runs, n, small = _runs_of_pairs(counts.groupBy("low", "high").agg(F.sum("n").alias("n")), on_driver)
    before = F.sum("n").over(Window.partitionBy("low", "high").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("low", "high", "block", F.coalesce(before, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("low", "high", "block").orderBy("string_id")) - 1
    numbered = ends.withColumn("nth", nth).join(bases, ["low", "high", "block"]).withColumn("nth", F.col("base") + F.col("nth"))
    at = (F.col("low") == F.col("a")) & (F.col("high") == F.col("b")) & (F.col("nth") >= F.col("number")) & (F.col("nth") < F.col("number") + F.col("size"))
    if small:
        runs = F.broadcast(runs)  # two rows a pair at most
    else:
        numbered = numbered.withColumn("__salt", F.pmod(F.xxhash64("string_id"), F.lit(SALTS)).cast("int"))
        runs = runs.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at = at & (F.col("__salt") == F.col("__of"))
    step = F.col("nth") - F.col("number")
    ahead = F.col("from_low") == (step % 2 == 0)
    forward = F.when(F.col("low") == F.col("high"), F.lit(True)).otherwise((F.col("front") == F.col("low")) == ahead)
    return numbered.join(runs, at).select("string_id", (F.col("place") + step).alias("new_pos"), forward.alias("forward")), n


def accounting(endpoints: DataFrame) -> DataFrame:
    """One row: runs before, strings, walks, runs as these promise (before - strings + walks), and runs as they are after reordering."""
    order, n = permutation(endpoints)
    placed = endpoints.join(order, "string_id").select("new_pos", "num_runs", F.when(F.col("forward"), F.col("front")).otherwise(F.col("back")).alias("first"), F.when(F.col("forward"), F.col("back")).otherwise(F.col("front")).alias("last"))
    meets = placed.join(placed.select((F.col("new_pos") + 1).alias("new_pos"), F.col("last").alias("previous")), "new_pos", "left")
    out = meets.agg(F.coalesce(F.sum("num_runs"), F.lit(0)).alias("runs_before"), F.count("*").alias("num_strings"), F.count_if(F.col("previous") == F.col("first")).alias("met"))
    promised = F.col("runs_before") - F.col("num_strings") + n
    return out.select("runs_before", "num_strings", F.lit(n).cast("long").alias("num_walks"), promised.alias("runs_promised"), (F.col("runs_before") - F.col("met")).alias("runs_after"))


def write_permutation(order: DataFrame, path: str) -> None:
    """Lines ``id sign`` in the new order, the sign 1 for strings as they were and 0 for those turned round."""
    rows = order.repartitionByRange("new_pos").sortWithinPartitions("new_pos")
    rows.select(F.concat_ws(" ", F.col("string_id").cast("string"), F.col("forward").cast("int").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_permutation(spark, path: str) -> DataFrame:
    """(string_id, new_pos, forward) of a permutation file."""
    from ..sources.files import _numbered

    parts = F.split("value", " ")
    return _numbered(spark.read.text(path)).select(parts[0].cast("long").alias("string_id"), F.col("row").alias("new_pos"), (parts[1] == "1").alias("forward"))


def scan_summary(strings: DataFrame) -> DataFrame:
    """One row for strings with weights: strings, k-mers, runs that restart with each string, distinct weights, sum of weights."""
    runs = F.size("weights") - F.size(F.filter(F.arrays_zip(F.slice("weights", 1, F.size("weights") - 1).alias("a"), F.slice("weights", 2, F.size("weights")).alias("b")), lambda x: x["a"] == x["b"]))
    some = strings.where(F.size("weights") > 0).select(F.size("weights").cast("long").alias("n"), runs.cast("long").alias("runs"), "weights")
    totals = some.agg(F.count("*").alias("num_strings"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_kmers"), F.coalesce(F.sum("runs"), F.lit(0)).alias("num_runs"))
    weights = some.select(F.explode("weights").alias("w")).groupBy("w").agg(F.count("*").alias("c")).agg(F.count("*").alias("distinct_weights"), F.coalesce(F.sum(F.col("w") * F.col("c")), F.lit(0)).alias("sum_of_weights"))
    return totals.crossJoin(weights)


def apply_permutation(strings: DataFrame, order: DataFrame) -> DataFrame:
    """``strings`` (string_id, seq and, where given, weights) in their new places, turned round where the order says so."""
    joined = strings.join(order, "string_id")
    seq = F.when(F.col("forward"), F.col("seq")).otherwise(S.reverse_complement(F.col("seq")))
    out = joined.withColumn("seq", seq)
    if "weights" in strings.columns:
        out = out.withColumn("weights", F.when(F.col("forward"), F.col("weights")).otherwise(F.reverse("weights")))
    return out


def weighted_strings(dictionary) -> DataFrame:
    """string_id, seq and the weights of its k-mers in order."""
    w = dictionary.weighted_spans().groupBy("string_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kmer_id", "weights"))), lambda x: x["weights"])).alias("weights"))
    return dictionary.strings.select("string_id", "seq").join(w, "string_id")
