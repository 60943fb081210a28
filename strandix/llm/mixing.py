"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed into cells of (source, language, topic). Goals are the tokens wanted of each source, each language and each
topic: its target share of all tokens wanted, but never more than it holds; what one can't give, the others give in proportion. Cell
weights are raked in turn to the goals of the three dimensions, a cell giving at most its tokens, for a fixed number of
rounds, and the residual, the largest difference of a goal from the tokens given, as a share of all wanted, is told with each cell. A
document's calibrated probability is its cell's weight over its cell's tokens. A document is sampled when a hash of its id, taken
as a number in [0, 1), is below that: expected sampled tokens then meet the goals, whatever the order of rows.

Targets are shares by value; without them, a dimension's shares are its token counts to the power ``temper``.
A value missing from given targets has share 0. Three dimensions can ask together what no cell weights give, as when every document of one
source is of one language; the residual then stays above 0.

Defined results: null source or language is a value of its own; a null or empty text has no tokens, and a cell without
tokens has probability 0; a null id is never sampled; repeated ids are decided alike; an empty table gives an empty result;
helper columns are prefixed, so that other columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS, ROUNDS_A_TABLE = 24, 8
ONE_TASK = 1_000_000  # cells, which one task can rake without a shuffle a step; more are dealt out by value, with the same result
FILLINGS = 6  # steps in which values that hold too little are found
SHARE = 0.5  # of all tokens, wanted in the sample

# Signs by which a text's topic is told, the first that it holds.
TOPIC_SIGNS = (("table", " | "), ("legal", "icense"), ("contact", "@"), ("config", "="), ("junk", "%%%"))


def topic_of(text: Column) -> Column:
    """The first topic whose sign the text holds; otherwise prose."""
    out = None
    for topic, sign in TOPIC_SIGNS:
        hit = F.contains(text, F.lit(sign))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise("prose")


def profiled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``df`` with the columns that the mixing needs, prefixed ``__``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    uniform = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":mix"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumns({"__source": F.col(source_col).cast("string"), "__lang": F.col(lang_col).cast("string"), "__topic": topic_of(text), "__tokens": F.regexp_count(text, F.lit(r"\S+")).cast("long"), "__u": uniform})


def _goals(cells: DataFrame, dimension: str, targets: dict[str, float] | None, wanted: float) -> DataFrame:
    """(value, goal): the tokens wanted of each value of a dimension, as far as it holds them."""
    name, raw = f"__{dimension}", F.pow("held", F.lit(TEMPER[dimension]))
    if targets is not None:
        given = [F.lit(x) for pair in targets.items() for x in pair]
        raw = F.coalesce(F.create_map(*given)[F.col("value")], F.lit(0.0)) if given else F.lit(0.0)
    values = cells.groupBy(F.col(name).alias("value")).agg(F.sum("t").cast("double").alias("held"))
    values = values.withColumn("raw", F.when(F.col("held") > 0, raw).otherwise(0.0))
    level = 0.0  # tokens a unit of raw share; grows until the values that are not exhausted give the rest
    for _ in range(FILLINGS):
        spent = F.col("held") <= F.col("raw") * level
        rest, open_ = values.agg(F.coalesce(F.sum(F.when(spent, F.col("held"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~spent, F.col("raw"))), F.lit(0.0))).first()
        if not open_:
            break
        level = (wanted - rest) / open_
    return values.select("value", F.least(F.col("held"), F.col("raw") * level).alias("goal"))


def raked_cells(profile: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """One row a cell: its tokens, its raked weight, ``__f``, weight over tokens, and the residual of all goals."""
    names = [f"__{d}" for d in DIMENSIONS]
    cells = written(profile.groupBy(*names).agg(F.sum("__tokens").alias("t")), "mixing-cells")
    count, total = cells.agg(F.count("*"), F.sum("t")).first()
    wanted = float(total or 0) * share
    if count <= ONE_TASK:
        cells = cells.coalesce(1)
    goals_of = {d: _goals(cells.select(*names, "t"), d, (targets or {}).get(d), wanted) for d in DIMENSIONS}
    for d, name in zip(DIMENSIONS, names, strict=True):
        goals = goals_of[d]
        cells = cells.join(goals.select(F.col("value").alias(f"__v_{d}"), F.col("goal").alias(f"goal_{d}")), F.col(name).eqNullSafe(F.col(f"__v_{d}"))).drop(f"__v_{d}")
    cells = written(cells.withColumns({"t": F.col("t").cast("double"), "x": F.col("t").cast("double")}), "mixing-goals")
    cells = cells.coalesce(1) if count <= ONE_TASK else cells
    for i in range(rounds):
        for d, name in zip(DIMENSIONS, names, strict=True):
            # what a cell gives ends at its tokens, while its weight may go on to grow
            now = F.sum(F.least("x", "t")).over(Window.partitionBy(name))
            cells = cells.withColumn("x", F.when(now > 0, F.col("x") * F.col(f"goal_{d}") / now).otherwise(0.0))
        if (i + 1) % ROUNDS_A_TABLE == 0 or i + 1 == rounds:
            cells = written(cells, "mixing-round")
            cells = cells.coalesce(1) if count <= ONE_TASK else cells
    cells = cells.withColumn("w", F.least("x", "t"))
    for d, name in zip(DIMENSIONS, names, strict=True):
        cells = cells.withColumn(f"off_{d}", F.abs(F.sum("w").over(Window.partitionBy(name)) - F.col(f"goal_{d}")))
    cells = written(cells, "mixing-weights")
    residual = cells.agg(F.max(F.greatest(*(F.col(f"off_{d}") for d in DIMENSIONS)))).first()[0] or 0.0
    return cells.select(*names, "t", "w", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("__f"), F.lit(residual / wanted if wanted else 0.0).alias("residual"))


def with_probability(profile: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``__f``; the cells are small, and adaptive execution broadcasts them when they measure so."""
    right = cells.select(*(F.col(f"__{d}").alias(f"__c_{d}") for d in DIMENSIONS), "__f", F.col("w").alias("__w"), F.col("residual").alias("__residual"))
    same = [F.col(f"__{d}").eqNullSafe(F.col(f"__c_{d}")) for d in DIMENSIONS]
    return profile.join(right, same[0] & same[1] & same[2], "left")


def mix(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, share: float = SHARE, **columns) -> DataFrame:
    """The sampled rows of ``df``, with all their columns, whatever their names."""
    inner = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    used = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang"} | columns
    profile = profiled(df.toDF(*inner.values()), **{k: inner[c] for k, c in used.items()})
    cells = raked_cells(profile, targets, rounds, share)
    return with_probability(profile, cells).where(F.col("__u") < F.col("__f")).select(*(F.col(inner[c]).alias(c) for c in df.columns))


def op2_source_mixing(spark, sf_dir):
    """Every document with its cell, calibrated probability and whether it is sampled."""
    profile = profiled(documents(spark, sf_dir)).select("doc_id", "__source", "__lang", "__topic", "__tokens", "__u")
    profile = written(profile, "mixing-profile")
    out = with_probability(profile, raked_cells(profile))
    return out.select(
        "doc_id",
        *(F.col(f"__{d}").alias(d) for d in DIMENSIONS),
        F.col("__tokens").alias("n_tokens"),
        F.round("__f", 6).alias("probability"),
        F.round("__w", 6).alias("cell_weight"),
        F.coalesce(F.col("__u") < F.col("__f"), F.lit(False)).alias("sampled"),
        F.round("__residual", 6).alias("residual"),
    )


def oracle_sql(table: str = "documents", rounds: int = ROUNDS, share: float = SHARE) -> str:
    """The same in DuckDB SQL, the rounds written out one after another."""
    topic = "case " + " ".join(f"when contains(coalesce(text, ''), '{sign}') then '{name}'" for name, sign in TOPIC_SIGNS) + " else 'prose' end"
    steps = [
        f"profile as (select doc_id, source, lang, {topic} topic, cast(len(regexp_extract_all(coalesce(text, ''), '\\S+')) as bigint) n_tokens, "
        f"cast(cast('0x' || substr(md5(cast(doc_id as varchar) || ':mix'), 1, 8) as ubigint) as double) / 4294967296.0 u from {table})",
        "cells as (select source, lang, topic, cast(sum(n_tokens) as double) t from profile group by all)",
    ]
    for d in DIMENSIONS:
        steps.append(f"held_{d} as (select {d} k, sum(t) h, case when sum(t) > 0 then pow(sum(t), {TEMPER[d]}) else 0 end r from cells group by {d})")
        level = "0::double"
        for i in range(FILLINGS):
            steps.append(f"level_{d}_{i} as materialized (select case when o > 0 then ((select sum(t) * {share} from cells) - c) / o else l end l from (select coalesce(sum(case when h <= r * l then h end), 0) c, coalesce(sum(case when h > r * l then r end), 0) o, any_value(l) l from held_{d}, (select {level} l)))")
            level = f"(select l from level_{d}_{i})"
        steps.append(f"goal_{d} as materialized (select k, least(h, r * l) g from held_{d}, level_{d}_{FILLINGS - 1})")
    last, n = "cells_0", 0
    steps.append("cells_0 as (select c.*, c.t x, " + ", ".join(f"g_{d}.g g_{d}" for d in DIMENSIONS) + " from cells c " + " ".join(f"join goal_{d} g_{d} on g_{d}.k is not distinct from c.{d}" for d in DIMENSIONS) + ")")
    for _ in range(rounds):
        for d in DIMENSIONS:
            n += 1
            steps.append(f"cells_{n} as materialized (select * exclude (x, s), case when s > 0 then x * g_{d} / s else 0 end x from (select *, sum(least(x, t)) over (partition by {d}) s from {last}))")
            last = f"cells_{n}"
    off = ", ".join(f"abs(sum(least(x, t)) over (partition by {d}) - g_{d})" for d in DIMENSIONS)
    steps.append(f"ended as materialized (select *, least(x, t) w, greatest({off}) off from {last})")
    steps.append(f"final as (select *, case when t > 0 then w / t else 0 end f, (select max(off) from ended) / (select sum(t) * {share} from cells) residual from ended)")
    return (
        "with " + ", ".join(steps) + " select p.doc_id, p.source, p.lang, p.topic, p.n_tokens, round(f, 6) probability, round(w, 6) cell_weight, coalesce(u < f, false) sampled, round(residual, 6) residual "
        "from profile p join final c on p.source is not distinct from c.source and p.lang is not distinct from c.lang and p.topic = c.topic"
    )
