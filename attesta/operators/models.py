"""Models are injected: a callable over a pandas Series of prompts. Nothing here depends on one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ask = Callable[[pd.Series], pd.Series]


def silent(prompts: pd.Series) -> pd.Series:
    """The default: no answer."""
    return pd.Series([None] * len(prompts), dtype=object)


def answers(rows: DataFrame, prompt: Column, ask: Ask = silent, slots: int | None = None) -> DataFrame:
    """rows with 'answer' (null for none); slots bounds how many calls run at once."""

    @F.pandas_udf("string")
    def call(p: pd.Series) -> pd.Series:
        return ask(p)

    return (rows.repartition(slots) if slots else rows).withColumn("answer", call(prompt))


def picks(answered: DataFrame, slugs: DataFrame, top: int = 3) -> DataFrame:
    """q, rank, slug of a model's picks: a JSON array of names, or else every known slug that occurs in the answer; a null slug for an answer that names nothing."""
    said = answered.where("answer is not null").select("q", "answer", F.from_json("answer", "array<string>").alias("a"))
    listed = said.where("a is not null").select("q", F.posexplode("a").alias("pos", "slug")).join(slugs.select("slug"), "slug", "left_semi").select("q", "pos", "slug")
    loose = said.where("a is null").join(slugs.select("slug"), F.col("answer").contains(F.col("slug"))).select("q", F.instr("answer", F.col("slug")).alias("pos"), "slug")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy("pos", "slug"))
    ranked = listed.union(loose).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("q", "rank", "slug")
    none = said.select("q").join(ranked.select("q"), "q", "left_anti").select("q", F.lit(1).cast("long").alias("rank"), F.lit(None).cast("string").alias("slug"))
    return ranked.union(none)
