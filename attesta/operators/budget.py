"""Prefixes by budget: rows in order until their costs add up, without a window over the whole table.

Rows are dealt into ranges of the order, each range's costs are added up, and the sums before each range come from one row a range. Only then do windows run, one for each
range. A prefix needs them only in the ranges that begin within the budget.

Null costs count as nothing. Rows that tie in the whole order are one range's, in any order. An empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.durable import written
from attesta.functions.text import token_estimate

#: Ranges, and the characters of a profile's material.
RANGES, PROFILE_CHARS = 64, 60_000


def running(rows: DataFrame, order: list[Column], cost: str, budget: int | None = None, ranges: int = RANGES) -> DataFrame:
    """rows with n (from 1) and used: how many rows, and what costs, up to and with each; with a budget, only ranges that begin within it."""
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.count("*").alias("rows"), F.sum(F.coalesce(cost, F.lit(0))).alias("cost"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of so many ranges
    sums = sums.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("cost_before"))
    if budget is not None:
        sums = sums.where((F.col("cost_before") <= budget) | (F.col("rows_before") == 0))
    within = Window.partitionBy("range").orderBy(*order)
    placed = dealt.join(F.broadcast(sums), "range")
    return placed.select(
        *rows.columns,
        (F.row_number().over(within) + F.col("rows_before")).cast("long").alias("n"),
        (F.sum(F.coalesce(cost, F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cost_before")).alias("used"),
    )


def prefix(rows: DataFrame, order: list[Column], cost: str, budget: int, first: bool = False, ranges: int = RANGES) -> DataFrame:
    """rows with n and used: all before the first that would pass the budget. With first, the first row stays whatever it costs.

    The walk stops at the row that does not fit, even if smaller ones come behind it; costs are not negative, so that is where used passes the budget.
    """
    kept = F.col("used") <= budget
    return running(rows, order, cost, budget, ranges).where(kept | (F.col("n") == 1) if first else kept)


def trail_lines(layered: DataFrame, lines: DataFrame, tokens: int, ranges: int = RANGES) -> DataFrame:
    """n, slug, line, cost, used: the trail of fresh memories (see maps.trail), for any number of them."""
    fresh = layered.where("layer = 'fresh'").join(lines, "slug")
    once = fresh.groupBy("line_no").agg(F.min(F.struct("age", "slug", "line")).alias("f")).select("f.*").withColumn("cost", token_estimate("line"))
    return prefix(once, [F.col("age"), F.col("slug")], "cost", tokens, first=True, ranges=ranges).select("n", "slug", "line", "cost", "used")


def profile_material(mem: DataFrame, chars: int = PROFILE_CHARS, ranges: int = RANGES) -> DataFrame:
    """n, slug, chars, used, text: the memories that a profile is drafted from, study notes last, until the characters are spent."""
    rows = mem.select("slug", F.coalesce("body", F.lit("")).alias("text")).withColumn("chars", F.length("text"))
    return prefix(rows, [F.col("slug").startswith("_study/"), F.col("slug")], "chars", chars, ranges=ranges).select("n", "slug", "chars", "used", "text")


def profile_prompt(material: DataFrame, index: str) -> DataFrame:
    """prompt: one row, the index and the material, which its budget bounds; no row without material."""
    part = F.concat(F.lit("=== "), "slug", F.lit(" ===\n"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"])
    one = material.agg(F.array_join(parts, "\n\n").alias("t"), F.count("*").alias("rows")).where("rows > 0")
    return one.select(F.concat(F.lit(f"=== INDEX ===\n{index}\n\n=== MEMORIES ===\n"), "t").alias("prompt"))


# What a profile must not hold, a line of a table of numbers and a score.
_TABLE = r"(?m)^\s*[-*|]?\s*[^:|\n]{1,60}[:|]\s*\d+(\.\d+)?\s*%?\s*\|?\s*$"
_SCORE = r"(?i)\b(score|weight|priority|importance|salience)\b\s*[:=]?\s*\d"


def profile_state(text: Column) -> Column:
    """struct(state, why): 'absent' (null), 'broken' (empty, or numbers about how much things matter), or 'present'."""
    found = lambda pattern: F.substring(F.trim(F.regexp_extract(text, pattern, 0)), 1, 60)
    faults = [
        (text.isNull(), "absent", F.lit("no profile")),
        (~text.rlike(r"(?U)\S"), "broken", F.lit("empty")),
        (text.rlike(_TABLE), "broken", F.concat(F.lit("a table of numbers, not sentences: "), found(_TABLE))),
        (text.rlike(_SCORE), "broken", F.concat(F.lit("a score or weight: "), found(_SCORE))),
    ]
    made = [(c, F.struct(F.lit(s).alias("state"), why.alias("why"))) for c, s, why in faults]
    sound = F.struct(F.lit("present").alias("state"), F.lit("").alias("why"))
    return functools.reduce(lambda rest, one: F.when(one[0], one[1]).otherwise(rest), reversed(made), sound)


def profile_draft(answer: Column) -> Column:
    """struct(state, why) of a model's draft: 'refused' without a heading first, else what profile_state says."""
    shape = F.coalesce(F.ltrim(answer).startswith("##"), F.lit(False))
    return F.when(shape, profile_state(answer)).otherwise(F.struct(F.lit("refused").alias("state"), F.lit("no heading first").alias("why")))
