"""Callsigns that route to memories: receipts, the ledger, and the direct route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import fold, squeeze
from attesta.operators.recognise import containing


def receipts(issued: DataFrame, via: str) -> DataFrame:
    """digest, receipt (canonical JSON: sorted keys), slug, manifest, cues of each distinct receipt. issued: slug, manifest, cues array<struct<class, quote, text>>."""
    body = F.to_json(F.struct(F.lit(via).alias("accepted_via"), F.col("manifest").alias("evidence_manifest"), F.col("slug").alias("memory_slug"), F.col("cues").alias("routing_cues"), F.lit(1).alias("schema")))
    rows = issued.select("slug", "manifest", "cues", body.alias("receipt"))
    return rows.withColumn("digest", F.sha2("receipt", 256)).dropDuplicates(["digest"])


def verified(found: DataFrame, manifests: DataFrame, slugs: DataFrame) -> DataFrame:
    """The receipts whose digest is that of their text, whose manifest verifies and approves every cue, and whose memory exists.

    manifests: digest, approved (array of cue texts).
    """
    rows = found.where(F.sha2("receipt", 256) == F.col("digest")).join(slugs.select("slug"), "slug", "left_semi")
    both = rows.join(manifests.select(F.col("digest").alias("manifest"), "approved"), "manifest")
    return both.where(F.forall("cues", lambda c: F.array_contains("approved", c["text"]))).drop("approved")


def ledger(routes: DataFrame, folding=fold) -> DataFrame:
    """key, display, slug, slugs: each callsign's memory if it names one, else null and all of them. routes: text, slug, digest (the least digest's spelling is shown)."""
    rows = routes.select(squeeze(folding("text")).alias("key"), "slug", F.struct("digest", "text").alias("d"))
    out = rows.groupBy("key").agg(F.array_sort(F.collect_set("slug")).alias("slugs"), F.min("d").alias("d"))
    return out.select("key", F.col("d.text").alias("display"), F.when(F.size("slugs") == 1, F.get("slugs", F.lit(0))).alias("slug"), "slugs")


def word_bounded(text: Column, key: Column) -> Column:
    """A key with ASCII letters or digits occurs as a word; others are contained."""
    as_word = F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9-])\\Q"), key, F.lit("\\E(?![a-z0-9-])")))
    return F.when(key.rlike("[a-z0-9]"), as_word).otherwise(text.contains(key))


def direct(questions: DataFrame, led: DataFrame, folding=fold) -> DataFrame:
    """q, slug, cue: the one memory that the question's callsigns name; cues that name two are silence.

    Keys of several words are found by an equi-join on their first words, a key of one word by its first run of letters and digits; only one that starts with another
    character by containment.
    """
    q = questions.select("q", squeeze(folding("question")).alias("t"))
    live = led.where("slug is not null").select("key", "display", "slug")
    first = F.regexp_extract("key", r"^([a-z0-9]+)", 1)
    plain = live.withColumn("w", first)
    runs = q.select("q", "t", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    several, one = F.col("key").contains(" "), ~F.col("key").contains(" ")
    phrases = containing(q, live.where(several), "key").where(word_bounded(F.col("t"), F.col("key"))).select("q", "key", "display", "slug")
    by_word = runs.join(plain.where((F.col("w") != "") & one), "w").where(word_bounded(F.col("t"), F.col("key"))).select("q", "key", "display", "slug")
    odd = q.join(plain.where((F.col("w") == "") & one).drop("w"), word_bounded(F.col("t"), F.col("key"))).select("q", "key", "display", "slug")
    named = phrases.union(by_word).union(odd).distinct()
    single = named.groupBy("q").agg(F.countDistinct("slug").alias("n"), F.min(F.struct("key", "display", "slug")).alias("m"))
    return single.where("n = 1").select("q", "m.slug", F.col("m.display").alias("cue"))


def read_counts(reads: DataFrame) -> DataFrame:
    """slug, reads, last: of a read log (at, n array of slugs)."""
    return reads.select("at", F.explode("n").alias("slug")).groupBy("slug").agg(F.count("*").alias("reads"), F.max("at").alias("last"))


def manifests(rows: DataFrame) -> DataFrame:
    """digest, manifest: canonical JSON (keys in order) under its own SHA-256, once each."""
    names = sorted(rows.columns)
    out = rows.select(F.to_json(F.struct(*names)).alias("manifest"))
    return out.select(F.sha2("manifest", 256).alias("digest"), "manifest").dropDuplicates(["digest"])


def provenance(pointers: DataFrame, stored: DataFrame) -> DataFrame:
    """slug, key, state: 'ok', 'invalid' (no digest), 'missing', or 'tampered'. pointers: slug, key, pointer. stored: digest, manifest."""
    p = pointers.withColumn("digest", F.regexp_extract("pointer", "^sha256:([0-9a-f]{64})$", 1))
    both = p.join(stored.select("digest", F.sha2("manifest", 256).alias("real")), "digest", "left")
    state = F.when(F.col("digest") == "", "invalid").when(F.col("real").isNull(), "missing").when(F.col("real") != F.col("digest"), "tampered").otherwise("ok")
    return both.select("slug", "key", state.alias("state"))


def seeds_open(seeds: DataFrame, last: int = 30) -> DataFrame:
    """The last open seeds: row, text, topic. seeds: row, kind, text, topic, confirmed."""
    order = Window.orderBy(F.desc("row"))
    return seeds.where("kind = 'seed' and confirmed is null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= last).drop("r")
