"""Novelty: is a candidate in the store already? It is held against its nearest three memories by a model.

The neighbours are recognition's best hits for the candidate's words. A model (a Column over topic, why, evidence and the neighbours' openings, or a call through models.answers) says COVERED, EXTENDS or NEW, and names the memory. What it
says is read strictly: anything else is NEW; a name that is no neighbour means the nearest. A candidate without neighbours is NEW, and no model is asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import recognise

NEAR, OPENING, WHY = 3, 7000, 200


def asked(cands: DataFrame) -> DataFrame:
    """q, question: what recognition is asked for each candidate (cand, topic, why, evidence array<struct<class,text>>)."""
    said = F.array_join(F.transform("evidence", lambda e: e["text"]), " ")
    return cands.select(F.col("cand").cast("string").alias("q"), F.concat_ws(" ", "topic", "why", said).alias("question"))


def neighbours(cands: DataFrame, mem: DataFrame, near: int = NEAR, scored: DataFrame | None = None) -> DataFrame:
    """cand, rank, slug, score: the memories with the highest score for each candidate, then by slug.

    Only the best ones of a candidate leave the cell in which they are counted.
    """
    rows = recognise.votes(mem, asked(cands), top=near) if scored is None else scored
    order = Window.partitionBy("q").orderBy(F.desc("score"), "slug")
    best = rows.select("q", "slug", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near)
    return best.select(F.col("q").alias("cand"), F.col("rank").cast("long").alias("rank"), "slug", "score")


def prompts(cands: DataFrame, near: DataFrame, mem: DataFrame) -> DataFrame:
    """cand, topic, why, evidence, near: array of struct(rank, slug, opening) by rank; empty without neighbours."""
    bodies = near.join(mem.select("slug", F.substring("body", 1, OPENING).alias("opening")), "slug").where("opening != ''")
    listed = bodies.groupBy("cand").agg(F.array_sort(F.collect_list(F.struct("rank", "slug", "opening"))).alias("near"))  # of NEAR rows
    rows = cands.select(F.col("cand").cast("string").alias("cand"), "topic", "why", "evidence")
    return rows.join(listed, "cand", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<rank:bigint,slug:string,opening:string>>")))


def judged(asked_: DataFrame, model: Callable[[], Column] | None = None, answer: str = "answer") -> DataFrame:
    """cand, verdict, slug, why. The answer is the model's Column over a row of prompts(), or a column that is there."""
    rows = asked_.withColumn("said", F.when(F.size("near") > 0, model() if model else F.col(answer)))
    lines = F.split("said", "\n")
    first = F.filter(F.split(F.trim(F.get(lines, F.lit(0))), r"\s+"), lambda w: w != "")
    word = F.upper(F.get(first, F.lit(0)))
    verdict = F.when(word.isin("COVERED", "EXTENDS", "NEW"), word).otherwise("NEW")
    slugs = F.transform("near", lambda n: n["slug"])
    named = F.get(F.filter(F.transform(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), lambda w: F.regexp_replace(w, "^[`,.]+|[`,.]+$", "")), lambda w: F.array_contains(slugs, w)), F.lit(0))
    why = F.substring(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " "), 1, WHY)
    some = F.size("near") > 0
    return rows.select(
        "cand",
        F.when(some, F.coalesce(verdict, F.lit("NEW"))).otherwise("NEW").alias("verdict"),
        F.when(some, F.coalesce(named, F.get(slugs, F.lit(0)))).alias("slug"),
        F.when(some, F.coalesce(why, F.lit(""))).otherwise("nothing close in the store").alias("why"),
    )
