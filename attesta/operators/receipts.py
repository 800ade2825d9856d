"""Receipts for callsigns: signed, named by their own digest, and verified against the manifest that approved them.

A receipt says that the gate accepted these cues for this memory. Its text is its fields in a fixed order, its digest the SHA-256 of that text, its mark an
HMAC of it under the store's key. Issuing is idempotent: the same receipt is one row, and one that is stored is not written again. Null cues are none; receipts without cues are not issued. A
frozen store issues nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.fixed import CUE_MAX, CUE_MIN
from attesta.functions.seal import ITEM, PART, field, hmac_sha256, signed_text
from attesta.functions.text import fold, squeeze
from attesta.sources.writer import Refused

#: What a receipt's text starts with; the second is the version of a manifest's cues.
SCHEMA, CUES_VERSION = "cue-receipt-2", 1
CUES = "array<struct<text:string,class:string,quote:string>>"


def _cues(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda c: F.concat_ws(PART, field(c["text"]), field(c["class"]), field(c["quote"]))), ITEM)


def text_of(slug: Column, manifest: Column, cues: Column, via: Column) -> Column:
    return F.concat_ws("\x1f", signed_text(SCHEMA, slug, manifest, via), _cues(cues))


def issued(rows: DataFrame, key: bytes, via: str, policy: str = "direct-allowed", held: DataFrame | None = None) -> DataFrame:
    """digest, slug, manifest, cues, via, mark of each new receipt. rows: slug, manifest, cues (CUES). held: receipts that are stored."""
    if policy == "frozen":
        raise Refused("store is frozen: routing does not grow")
    cues = F.filter(F.coalesce(F.col("cues").cast(CUES), F.array().cast(CUES)), lambda c: F.coalesce(c["text"], F.lit("")) != "")
    with_cues = rows.select("slug", "manifest", cues.alias("cues")).where(F.size("cues") > 0)
    text = text_of(F.col("slug"), F.col("manifest"), F.col("cues"), F.lit(via))
    out = with_cues.select(F.sha2(text, 256).alias("digest"), "slug", "manifest", "cues", F.lit(via).alias("via"), hmac_sha256(key, text).alias("mark")).dropDuplicates(["digest"])
    return out if held is None else out.join(held.select("digest"), "digest", "left_anti")


def checked(receipts: DataFrame, manifests: DataFrame, slugs: DataFrame, key: bytes) -> DataFrame:
    """Each receipt with 'fault': null if it proves its route, else the first check that failed.

    receipts: digest, slug, manifest, cues, via, mark. manifests: digest (of a verified manifest), memory_slug, version, approved (CUES), quotes array<struct<class,text>>.
    """
    text = text_of(F.col("slug"), F.col("manifest"), F.col("cues"), F.col("via"))
    known = slugs.select("slug", F.lit(True).alias("known")).distinct()
    papers = manifests.select(F.col("digest").alias("of"), F.lit(True).alias("proven"), "memory_slug", "version", "approved", F.transform(F.filter("quotes", lambda q: q["class"] == "USER"), lambda q: q["text"]).alias("said")).dropDuplicates(["of"])
    rows = receipts.withColumn("of", F.regexp_extract("manifest", "^sha256:([0-9a-f]{64})$", 1)).join(known, "slug", "left").join(papers, "of", "left")

    def bad_cue(c: Column) -> Column:
        name = squeeze(fold(c["text"]))
        sound = (c["class"] == "USER") & c["quote"].isNotNull() & F.length(name).between(CUE_MIN, CUE_MAX) & name.rlike(r"[\p{L}\p{N}]")
        approved = F.exists("approved", lambda a: (a["text"] == c["text"]) & (a["class"] == c["class"]) & (a["quote"] == c["quote"]))
        return ~F.coalesce(sound & F.array_contains("said", c["quote"]) & c["quote"].contains(c["text"]) & approved, F.lit(False))

    fault = (
        F.when(~F.col("digest").eqNullSafe(F.sha2(text, 256)), "not its digest")
        .when(~F.col("mark").eqNullSafe(hmac_sha256(key, text)), "not signed")
        .when(F.col("known").isNull(), "unknown memory")
        .when(F.col("proven").isNull(), "no manifest")
        .when(~F.col("version").eqNullSafe(F.lit(CUES_VERSION)), "another version")
        .when(~F.col("memory_slug").eqNullSafe(F.col("slug")), "another memory")
        .when(F.coalesce(F.size("cues"), F.lit(0)) <= 0, "no cues")
        .when(F.exists("cues", bad_cue), "cue not approved")
    )
    return rows.select(*receipts.columns, fault.alias("fault"))


def routes(sound: DataFrame) -> DataFrame:
    """text, slug, digest of every cue of receipts without a fault, as cues.ledger takes them."""
    return sound.where("fault is null").select(F.explode("cues").alias("c"), "slug", "digest").select("c.text", "slug", "digest")
