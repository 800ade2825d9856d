"""Repair of ragged index lines: a model writes new ones, and they are merged into the index as it is by then.

The model works on a snapshot. When its lines come back, the index may have grown and memories may have changed, so a repair is a three-way merge by line equality: it replaces the first line that is still, letter for letter, the one
that was read, if the memory is still the one that was read; else it is stale and dropped, never guessed at. What the model wrote must pass the floors against the memory and the line it replaces.

An answer without TITLE and DESC, an empty memory and a null line are no repairs. Of several repairs of one line the least slug's counts. Lines that no repair names stay as they are, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import composed, credits_human, invented_numbers
from attesta.operators.maps import index_rot

#: Characters of a memory that the model sees, of a title and of a trigger.
READ, TITLE, DESC = 6000, 40, 200
_ENTRY = r"^- \[([^\]]+)\]\(([A-Za-z0-9_/-]+)\.md\) — (.+)"


def ragged(lines: DataFrame) -> DataFrame:
    """line_no, line, slug, fault: the index lines that have one. lines: line_no, line."""
    part = lambda i: F.regexp_extract("line", _ENTRY, i)
    fault = index_rot(part(1), part(3), part(2))
    return lines.select("line_no", "line", part(2).alias("slug"), fault.alias("fault")).where("slug != '' and fault is not null")


def asked(lines: DataFrame, mem: DataFrame, limit: int | None = None) -> DataFrame:
    """line_no, line, slug, fault, seen: what a model is asked about, the memory's opening with it; limit: only the first so many lines (a run's share of the work)."""
    found = ragged(lines)
    if limit is not None:
        found = found.orderBy("line_no").limit(limit)
    return found.join(mem.select("slug", F.substring("body", 1, READ).alias("seen")), "slug").where("seen != ''").select("line_no", "line", "slug", "fault", "seen")


def repairs(answered: DataFrame) -> DataFrame:
    """line, slug, seen, new, refused: each answer's line (null without a shape), and why the floors refuse it. answered: as asked(), with answer."""
    said = composed(F.col("answer"))
    rows = answered.withColumn("title", said["title"]).withColumn("desc", said["desc"]).where("title is not null and desc is not null")
    text, source = F.concat_ws("\n", "title", "desc"), F.concat_ws(" ", "seen", "line")
    numbers = invented_numbers(text, source)
    refused = F.when(F.size(numbers) > 0, F.concat(F.lit("invented number: "), F.array_join(numbers, ", "))).when(credits_human(text) & ~credits_human(source), "credits the human where the memory does not")
    new = F.concat(F.lit("- ["), F.substring("title", 1, TITLE), F.lit("]("), "slug", F.lit(".md) — "), F.substring("desc", 1, DESC))
    return rows.select("line", "slug", "seen", new.alias("new"), refused.alias("refused"))


def merged(now: DataFrame, fixes: DataFrame, mem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line_no, line: the index with the repairs that still hold; slug, outcome of each: 'fixed', 'refused', 'memory changed', 'line moved').

    now: the index as it is. mem: slug, body as they are.
    """
    bodies = mem.select("slug", F.substring("body", 1, READ).alias("body"))
    rows = fixes.join(bodies, "slug", "left").withColumn("same", F.col("body").eqNullSafe(F.col("seen")))
    first = now.where("line is not null").groupBy("line").agg(F.min("line_no").alias("line_no"))
    rows = rows.join(first, "line", "left")
    live = F.col("refused").isNull() & F.col("same") & F.col("line_no").isNotNull()
    turn = F.row_number().over(Window.partitionBy("line", live).orderBy("slug"))
    outcome = F.when(F.col("refused").isNotNull(), "refused").when(~F.col("same"), "memory changed").when(F.col("line_no").isNull() | (turn > 1), "line moved").otherwise("fixed")
    judged = rows.select("slug", "line_no", "new", outcome.alias("outcome"))
    better = judged.where("outcome = 'fixed'").select("line_no", "new")
    index = now.join(better, "line_no", "left").select("line_no", F.coalesce("new", "line").alias("line"))
    return index, judged.select("slug", "outcome")
