"""Fewest walks over the graph of weights by joins alone, for graphs of any size.

Each edge has two ends, number 2e at its low weight and 2e + 1 at its high one. At every weight the ends are joined in pairs, which makes trails: paths between
ends that are left over, and cycles. Cycles are then merged into what they meet: each takes the trail of smallest label, paths before cycles, that passes through one
of its weights, and there the pairs of all that meet are re-joined in a ring. Labels fall along these steps, so no two trails are merged twice and the number of cycles
shrinks until each connected part is one cycle or has paths only, half as many as odd weights. Places along a path come from list ranking by pointer doubling.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, stored
from .running import running_sums

BLOCK_BITS = 16  # of edges, whose ends at one weight are numbered in one task's rows


class _Tables:
    """Tables of the steps in one folder: each step's lineage ends there."""

    def __init__(self, spark):
        self.path, self.n = f"{shared_dir(spark)}/strandix/cover-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return stored(df, f"{self.path}/{self.n}")


def _joined_in_pairs(ends: DataFrame) -> DataFrame:
    """(h, v, partner): ends of each weight in order, the first with the second and so on; null for one that is left over.

    Ends of one weight are counted in blocks of edges, so a weight that most edges have is no task of its own.
    """
    block = ends.withColumn("block", F.shiftright("h", BLOCK_BITS))
    counts = block.groupBy("v", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("v").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("v", "block").orderBy("h")) - 1
    ranked = block.withColumn("nth", within).join(counts.select("v", "block", before.alias("base")), ["v", "block"]).select("h", "v", (F.col("base") + F.col("nth")).alias("nth"))
    pair = ranked.groupBy("v", F.shiftright("nth", 1).alias("pair")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    one = pair.select(F.col("lo").alias("h"), "v", F.when(F.col("lo") != F.col("hi"), F.col("hi")).alias("partner"))
    return one.unionByName(pair.where("lo <> hi").select(F.col("hi").alias("h"), "v", F.col("lo").alias("partner")))


def _labels(ends: DataFrame, tables: _Tables) -> DataFrame:
    """(e, label): the smallest edge of each edge's trail, by pointer doubling in both directions."""
    rows = tables.keep(ends.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("partner").alias("next"), F.shiftright("h", 1).alias("least")))
    span, total = 1, rows.count()
    while span < total:
        ahead = rows.select(F.col("h").alias("__h"), F.col("next").alias("__next"), F.col("least").alias("__least"))
        rows = tables.keep(rows.join(ahead, rows["next"] == ahead["__h"], "left").select("h", F.col("__next").alias("next"), F.least("least", "__least").alias("least")))
        span *= 2
        if not rows.where("next is not null").head(1):
            break
    return rows.groupBy(F.shiftright("h", 1).alias("e")).agg(F.min("least").alias("label"))


def _roots(links: DataFrame, tables: _Tables) -> DataFrame:
    """(label, root) from (label, up), each label smaller than those below it."""
    links = tables.keep(links)
    while True:
        up = links.select(F.col("label").alias("__label"), F.col("up").alias("__up"))
        further = links.join(up, links["up"] == up["__label"], "left")
        moved = tables.keep(further.select("label", F.coalesce("__up", "up").alias("up"), F.col("__up").isNotNull().alias("moved")))
        links = moved.select("label", "up")
        if not moved.where("moved").head(1):
            return links.withColumnRenamed("up", "root")


def merged_trails(edges: DataFrame, tables: _Tables) -> DataFrame:
    """(h, v, partner) of (e, low, high): pairs of ends such that each connected part has the fewest trails, and the part's last cycle is cut."""
    ends = edges.select((2 * F.col("e")).alias("h"), F.col("low").alias("v")).unionByName(edges.select((2 * F.col("e") + 1).alias("h"), F.col("high").alias("v")))
    ends = tables.keep(_joined_in_pairs(ends))
    labels = tables.keep(_labels(ends, tables))
    cycle = 1 << 60  # paths have the smaller labels
    paths = ends.where("partner is null").select(F.shiftright("h", 1).alias("e")).join(labels, "e").select("label").distinct().withColumn("path", F.lit(True))
    labels = tables.keep(labels.join(paths, "label", "left").select("e", F.when(F.col("path"), F.col("label")).otherwise(F.col("label") + cycle).alias("label")))
    while True:
        # a pair of ends of each trail at each weight, told by its smaller end, or the end of a path, which is left over there
        at = ends.where("partner is null or h < partner").withColumn("e", F.shiftright("h", 1)).join(labels, "e").groupBy("v", "label").agg(F.min("h").alias("h"))
        at = tables.keep(at)
        least = at.groupBy("v").agg(F.min("label").alias("up"))
        hooks = at.join(least, "v").where((F.col("label") >= cycle) & (F.col("up") < F.col("label"))).groupBy("label").agg(F.min(F.struct("up", "v")).alias("x")).select("label", "x.up", "x.v")
        hooks = tables.keep(hooks)
        if not hooks.head(1):
            break
        # at a weight the pairs of the trail that is taken and of those that take it are re-joined in a ring
        joining = hooks.select("v", F.col("label")).unionByName(hooks.select("v", F.col("up").alias("label")).distinct())
        ring = at.join(joining, ["v", "label"]).select("v", "h").join(ends.select("h", "partner"), "h")
        order = Window.partitionBy("v").orderBy("h")
        again = ring.select("v", "h", "partner", F.lead("h").over(order).alias("after"), F.first("h").over(order).alias("first"))
        new = again.select(F.col("partner").alias("h"), F.coalesce("after", "first").alias("__partner"))
        both = new.where("h is not null").unionByName(new.select(F.col("__partner").alias("h"), F.col("h").alias("__partner")))  # a path then ends after what it took
        new = tables.keep(both.withColumn("new", F.lit(True)))
        ends = tables.keep(ends.join(new, "h", "left").select("h", "v", F.when(F.col("new"), F.col("__partner")).otherwise(F.col("partner")).alias("partner")))
        roots = _roots(hooks.select("label", "up"), tables)
        labels = tables.keep(labels.join(roots, "label", "left").select("e", F.coalesce("root", "label").alias("label")))
    cut = ends.where("h < partner").withColumn("e", F.shiftright("h", 1)).join(labels.where(F.col("label") >= cycle), "e").groupBy("label").agg(F.min("h").alias("h")).select("h")
    cut = tables.keep(cut.join(ends.select("h", "partner"), "h").select(F.explode(F.array("h", "partner")).alias("h"), F.lit(True).alias("cut")))
    return tables.keep(ends.join(cut, "h", "left").select("h", "v", F.when(F.col("cut").isNull(), F.col("partner")).alias("partner")))


def walks(edges: DataFrame) -> tuple[DataFrame, int]:
    """(e, place, from_low) of (e, low, high, size), places counting sizes along all walks, and how many walks there are."""
    spark = edges.sparkSession
    tables = _Tables(spark)
    edges = tables.keep(edges)
    ends = merged_trails(edges.select("e", "low", "high"), tables)
    # entered at end h, an edge is left at the other one, whose partner is where the next edge is entered
    other = ends.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("partner").alias("next"))
    rows = tables.keep(other.withColumn("e", F.shiftright("h", 1)).join(edges.select("e", "size"), "e").select("h", "next", F.col("h").alias("last"), F.col("size").alias("rest")))
    while rows.where("next is not null").head(1):
        ahead = rows.select(F.col("h").alias("__h"), F.col("next").alias("__next"), F.col("last").alias("__last"), F.col("rest").alias("__rest"))
        found = rows.join(ahead, rows["next"] == ahead["__h"], "left")
        rows = tables.keep(found.select("h", F.col("__next").alias("next"), F.coalesce("__last", "last").alias("last"), (F.col("rest") + F.coalesce("__rest", F.lit(0))).alias("rest")))
    back = rows.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("last").bitwiseXOR(F.lit(1)).alias("start"))
    # of a walk's two directions that one counts whose first end has the smaller number
    chosen = tables.keep(rows.join(back, "h").where(F.col("start") < F.col("last").bitwiseXOR(F.lit(1))).select("h", "start", "rest"))
    sizes = chosen.groupBy("start").agg(F.max("rest").alias("whole"))
    bases = tables.keep(running_sums(sizes, "start", {"whole": "base"}))
    placed = chosen.join(bases, "start").select(F.shiftright("h", 1).alias("e"), (F.col("base") + F.col("whole") - F.col("rest")).alias("place"), (F.col("h") % 2 == 0).alias("from_low"))
    return tables.keep(placed), bases.count()
