"""Running sums, maxima and minima along a whole-number key, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 4_096  # of the key range


def running(df: DataFrame, key: str, sums: dict[str, str] | None = None, highest: dict[str, str] | None = None, lowest_after: dict[str, str] | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Adds, under the names given, the sum and the highest of columns over all smaller keys, and the lowest over all larger ones; keys are distinct whole numbers.

    Rows are taken together within blocks of the key range, and the blocks, whose number is fixed, among themselves. A sum of nothing is 0, a highest or lowest null.
    ``bounds`` are the smallest and the largest key, if they are known.
    """
    low, high = bounds or df.agg(F.min(key), F.max(key)).first()
    span = max(1, -(-((high or 0) - (low or 0) + 1) // BLOCKS))
    df = df.withColumn("__block", F.floor((F.col(key) - F.lit(low or 0)) / F.lit(span)).cast("long"))
    wanted = [(c, name, F.sum, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), False) for c, name in (sums or {}).items()]
    wanted += [(c, name, F.max, F.greatest, False) for c, name in (highest or {}).items()]
    wanted += [(c, name, F.min, F.least, True) for c, name in (lowest_after or {}).items()]

    def before(window, by: str, falling: bool):
        return window.orderBy(F.desc(by) if falling else by).rowsBetween(Window.unboundedPreceding, -1)

    totals = df.groupBy("__block").agg(*(fn(c).alias(f"__all_{name}") for c, name, fn, _, _ in wanted))
    totals = totals.select("__block", *(fn(f"__all_{name}").over(before(Window, "__block", falling)).alias(f"__base_{name}") for _, name, fn, _, falling in wanted))
    within = Window.partitionBy("__block")
    df = df.join(totals, "__block").withColumns({name: both(F.col(f"__base_{name}"), fn(c).over(before(within, key, falling))) for c, name, fn, both, falling in wanted})
    return df.drop("__block", *(f"__base_{name}" for _, name, *_ in wanted))


def running_sums(df: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """``running`` of sums alone."""
    return running(df, key, sums)
