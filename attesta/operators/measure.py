"""Measures of a store: retention, worldline, compression, intake and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import token_estimate
from attesta.operators import names


def retention(answers: DataFrame) -> DataFrame:
    """category (null for all), n, passed, score. answers: category, found, must_not_store; a fact that must not be stored passes if it is not found."""
    ok = F.coalesce("found", F.lit(False)) != F.coalesce("must_not_store", F.lit(False))
    out = answers.rollup("category").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))
    return out.select("category", "n", "passed", F.round(F.col("passed") / F.col("n"), 3).alias("score"))


def worldline(traces: DataFrame) -> DataFrame:
    """variant and its counters and means over the cases that ran.

    traces: variant, category, skipped, targets, related, anchors, obsolete, opened (arrays), thinker_calls, how, resident_tokens, elapsed_ms.
    """
    reached = F.when(F.col("category") == "unknown", F.size("opened") == 0).otherwise(F.arrays_overlap("targets", "opened"))
    t = traces.select(
        "*",
        F.coalesce(reached, F.lit(False)).alias("reached"),
        F.coalesce(F.arrays_overlap("anchors", "opened"), F.lit(False)).alias("wrong"),
        F.coalesce(F.arrays_overlap("obsolete", "opened"), F.lit(False)).alias("old"),
        F.size(F.array_intersect("related", "opened")).alias("touched"),
        F.size(F.array_except(F.array_except("opened", "targets"), "related")).alias("extra"),
    )
    ran = ~F.col("skipped")
    total = lambda c: F.coalesce(F.sum(F.when(ran, F.col(c))), F.lit(0)).cast("long")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(ran, c)), F.lit(0.0)), 1)
    return t.groupBy("variant").agg(
        F.count("*").alias("cases_total"),
        F.count_if(ran).alias("runnable"),
        F.count_if("skipped").alias("skipped"),
        F.count_if(ran & F.col("reached")).alias("target_reached"),
        F.count_if(ran & F.col("wrong")).alias("wrong_branch"),
        F.count_if(ran & F.col("old")).alias("obsolete_branch"),
        total("touched").alias("related_touched"),
        F.count_if(ran & (F.col("category") == "unknown") & F.col("reached")).alias("honest_unknown"),
        total("extra").alias("unnecessary_opens"),
        total("thinker_calls").alias("thinker_calls_total"),
        F.count_if(ran & (F.col("how") == "fastpath")).alias("fastpath_direct_total"),
        F.count_if(ran & (F.col("how") == "fastpath-cue")).alias("cue_direct_total"),
        mean(F.col("resident_tokens")).alias("resident_tokens_mean"),
        mean(F.size("opened")).alias("opened_mean"),
        mean(F.col("elapsed_ms")).alias("elapsed_ms_mean"),
    )


def compression(batches: DataFrame, memories: DataFrame) -> DataFrame:
    """source_key, raw_tokens, stored_tokens, store_ratio; memories of no recorded batch under a null key (unattributed).

    batches: source_key, raw_tokens. memories: slug, source_key, tokens.
    """
    raw = batches.groupBy("source_key").agg(F.sum("raw_tokens").alias("raw_tokens"))
    kept = memories.join(raw.select("source_key", F.lit(True).alias("known")), "source_key", "left")
    kept = kept.groupBy(F.when(F.col("known"), F.col("source_key")).alias("source_key")).agg(F.sum("tokens").alias("stored_tokens"), F.count("*").alias("memories"))
    out = raw.join(kept, raw["source_key"].eqNullSafe(kept["source_key"]), "full_outer")
    ratio = F.round(F.col("stored_tokens") / F.nullif(F.col("raw_tokens"), F.lit(0)), 3)
    return out.select(raw["source_key"], "raw_tokens", F.coalesce("stored_tokens", F.lit(0)).alias("stored_tokens"), F.coalesce("memories", F.lit(0)).alias("memories"), ratio.alias("store_ratio"))


def quiet_sessions(events: DataFrame, minutes: int = 10, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, first, last, n of each run of events with gaps below minutes: the silence behind it starts a pass."""
    span = F.session_window(F.col(ts), f"{minutes} minutes")
    runs = events.groupBy(key, span).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return runs.select(key, "first", "last", "n")


def doctor(mem: DataFrame, lines: DataFrame) -> DataFrame:
    """One row of a store's health: memories, links_resolved, links_dead, islands, not_in_index, index_orphans, hubs, tokens, tagged.

    mem: slug, body, tags (null where they can't be read). lines: line_no, line of the index.
    """
    links = names.links(mem)
    resolved = names.resolve(links.select(F.col("dst").alias("name")).distinct(), mem, names.first_titles(lines)).where("slug is not null")
    live = links.join(resolved.withColumnRenamed("name", "dst"), "dst").select("src", F.col("slug").alias("dst")).distinct()
    dead = links.join(resolved.select(F.col("name").alias("dst")), "dst", "left_anti")
    drift = names.index_drift(lines, mem)
    listed = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias("x"))
    parts = {
        "links_resolved": live.agg(F.count("*").alias("x")),
        "links_dead": listed(dead, F.concat("src", F.lit("→"), "dst")),
        "islands": listed(names.islands(live, mem), "slug"),
        "not_in_index": listed(drift.where("problem = 'not in index'"), "slug"),
        "index_orphans": listed(drift.where("problem = 'orphan'"), "slug"),
        "hubs": names.hubs(live, mem).agg(F.collect_list(F.struct("links_in", "slug")).alias("x")),
    }
    out = mem.agg(F.count("*").alias("memories"), F.sum(token_estimate("body")).alias("tokens"), F.count_if(F.size("tags") > 0).alias("tagged"))
    for name, df in parts.items():
        out = out.crossJoin(df.withColumnRenamed("x", name))  # one row each
    return out
