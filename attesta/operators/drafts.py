"""Drafts between the gate and the store: staged and signed, judged by a model, and poured, each once.

A draft is a row (slug, kind, manifest, body, mark). Its mark is an HMAC over its name, kind, manifest and body, so that a draft that was renamed, retyped or edited can be told; such a draft is put in quarantine and never
judged. A verdict is bound to the bytes that were judged: it carries their digest, and one that was given on other bytes is discarded. No answer is no verdict. A FIX must pass the floors again before it is
signed again. The body starts with header lines (EXTENDS, TITLE, DESC, TAGS, ...), then an empty line and the text.

Null fields count as empty texts. Two drafts of one name get numbers; of several answers to a draft one counts, the least by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.seal import hmac_sha256
from attesta.functions.text import composed, credits_human, invented_numbers, let, tag_list, tags_valid

HEADERS = ("EXTENDS", "TITLE", "DESC", "TAGS", "BELONGS_BECAUSE", "KEEP", "MAY_FADE")
_HEAD = rf"(?:(?:{'|'.join(HEADERS)}):[^\n]*\n|[ \t]*\n)*"
OUTCOMES = ("poured", "fixed", "tossed", "skipped", "quarantined", "moved", "fix unparsed", "fix refused", "refused")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def mark(key: bytes, slug: Column, kind: Column, manifest: Column, body: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(hmac_sha256(key, F.concat_ws("\n", F.lit("gate-format-v6"), part(slug), part(kind), part(manifest), _strip(part(body)))), 1, 32)


def digest() -> Column:
    """Of the bytes that a verdict is bound to."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in ("slug", "kind", "manifest", "body", "mark")]), 256)


def staged(rows: DataFrame, key: bytes, taken: DataFrame | None = None) -> DataFrame:
    """cand, slug, kind, manifest, body, mark: signed drafts under names of their own: base, base.2, base.3, ... , by cand; names in taken (slug) are passed over.

    rows: cand, slug (the wished base), kind, manifest, body.
    """
    order = Window.partitionBy("base").orderBy("cand")
    wished = rows.withColumnRenamed("slug", "base").withColumn("k", F.row_number().over(order))
    if taken is not None:
        number = F.regexp_extract("slug", r"\.(\d+)$", 1)
        held = taken.select(F.regexp_replace("slug", r"\.\d+$", "").alias("base"), F.when(number == "", 1).otherwise(number.cast("int")).alias("number")).distinct()
        # The k-th free number is k plus the taken ones below it: taken numbers in order, each with how many free ones come before it.
        before = held.withColumn("free", F.col("number") - F.row_number().over(Window.partitionBy("base").orderBy("number")))
        shift = wished.join(before, "base").where(F.col("free") < F.col("k")).groupBy("base", "k").agg(F.count("*").alias("shift"))
        wished = wished.join(shift, ["base", "k"], "left")
    else:
        wished = wished.withColumn("shift", F.lit(0))
    n = F.col("k") + F.coalesce("shift", F.lit(0))
    named = wished.withColumn("slug", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("."), n.cast("string"))))
    return named.select("cand", "slug", "kind", "manifest", "body", mark(key, F.col("slug"), F.col("kind"), F.col("manifest"), F.col("body")).alias("mark"))


def headers(body: Column) -> Column:
    """The header block at the top."""
    return F.regexp_extract(F.concat(F.ltrim(body), F.lit("\n")), f"^{_HEAD}", 0)


def header(body: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(headers(body), rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def text_of(body: Column) -> Column:
    """What stands behind the header block."""
    return _strip(F.substring(F.concat(F.ltrim(body), F.lit("\n")), F.length(headers(body)) + 1, F.length(body) + 1))


def verdict(answer: Column) -> Column:
    """struct(verdict, why, new_body, belongs_because): SKIP without an answer; of POUR, FIX and TOSS the first of these in the first line, TOSS for another shape."""
    first = F.upper(F.get(F.split(answer, "\n"), F.lit(0)))
    what = F.coalesce(*[F.when(first.contains(w), F.lit(w)) for w in ("POUR", "FIX", "TOSS")])
    why = F.regexp_extract(answer, r"(?mi)^reason[:：][ \t]*(.+)$", 1)
    parts = composed(answer)
    blank = ~F.coalesce(answer.rlike(r"(?U)\S"), F.lit(False))
    return F.struct(
        F.when(blank, "SKIP").otherwise(F.coalesce(what, F.lit("TOSS"))).alias("verdict"),
        F.when(blank, "no answer").when(what.isNull(), "another shape than asked").otherwise(F.substring(why, 1, 160)).alias("why"),
        F.when(~blank, F.nullif(parts["body"], F.lit(""))).alias("new_body"),
        F.when(~blank, parts["belongs_because"]).alias("belongs_because"),
    )


def floor(surface: Column, evidence: Column) -> Column:
    """Why a text may not be signed on its evidence (array<struct<class,text>>), or null."""
    numbers = invented_numbers(surface, F.array_join(F.transform(evidence, lambda e: e["text"]), "\n"))
    human = F.exists(evidence, lambda e: e["class"] == "USER")
    return let(numbers, lambda n: F.when(F.size(n) > 0, F.concat(F.lit("invented number: "), F.array_join(n, ", "))).when(credits_human(surface) & ~human, "credits the human with no [USER] quote"))


def drained(drafts: DataFrame, answers: DataFrame, manifests: DataFrame, key: bytes) -> DataFrame:
    """One row per draft: slug, outcome (OUTCOMES), why, kind, manifest, body and mark as they are now.

    drafts: slug, kind, manifest, body, mark. answers: slug, judged (the digest of what was judged), answer. manifests: manifest, quotes array<struct<class,text>>, verified.
    """
    one = answers.groupBy("slug").agg(F.min(F.struct("judged", "answer")).alias("a")).select("slug", "a.judged", verdict(F.col("a.answer")).alias("v"))
    papers = manifests.select("manifest", "quotes").dropDuplicates(["manifest"])
    rows = drafts.select("slug", "kind", "manifest", "body", "mark", digest().alias("now")).join(one, "slug", "left").join(papers, "manifest", "left")
    signed = F.col("mark").eqNullSafe(mark(key, F.col("slug"), F.col("kind"), F.col("manifest"), F.col("body")))
    said = F.coalesce("v.verdict", F.lit("SKIP"))
    because = F.when(F.col("v.belongs_because").isNotNull(), F.concat(F.lit("BELONGS_BECAUSE: "), "v.belongs_because", F.lit("\n"))).otherwise("")
    kept = F.regexp_replace(headers(F.col("body")), r"(?m)^[ \t]*\n", "")
    kept = F.concat(F.when(because != "", F.regexp_replace(kept, r"(?m)^BELONGS_BECAUSE:.*\n", "")).otherwise(kept), because)
    fixed = F.concat(kept, F.when(kept != "", "\n").otherwise(""), "v.new_body", F.lit("\n"))
    rows = rows.withColumn("fixed", F.when((said == "FIX") & F.col("v.new_body").isNotNull(), fixed))
    name = F.regexp_replace("slug", r"\.\d+$", "")  # a draft's number is no claim
    fault = floor(F.concat(name, F.lit("\n"), "fixed"), F.col("quotes"))
    rows = rows.withColumn("fault", F.when(F.col("quotes").isNotNull() & F.col("fixed").isNotNull(), fault))
    tags = header(F.col("body"), "TAGS")
    outcome = (
        F.when(~signed, "quarantined")
        .when(said == "SKIP", "skipped")
        .when(~F.col("judged").eqNullSafe(F.col("now")), "moved")
        .when(said == "TOSS", "tossed")
        .when((said == "FIX") & F.col("fixed").isNull(), "fix unparsed")
        .when((said == "FIX") & (F.col("quotes").isNull() | F.col("fault").isNotNull()), "fix refused")
        .when(F.col("quotes").isNull(), "refused")
        .when(tags.isNotNull() & ~tags_valid(tag_list(tags)), "refused")
        .when(said == "FIX", "fixed")
        .otherwise("poured")
    )
    rows = rows.withColumn("outcome", outcome)
    why = (
        F.when(F.col("outcome") == "quarantined", "no valid mark for its name, kind, manifest and body")
        .when(F.col("outcome") == "moved", "changed while it was judged")
        .when(F.col("outcome") == "fix unparsed", "no BODY")
        .when(F.col("outcome") == "fix refused", F.coalesce("fault", F.lit("no manifest")))
        .when(F.col("outcome") == "refused", F.when(F.col("quotes").isNull(), "no manifest").otherwise("TAGS unreadable"))
        .otherwise(F.coalesce("v.why", F.lit("no answer")))
    )
    body = F.when(F.col("outcome") == "fixed", F.col("fixed")).otherwise(F.col("body"))
    out = rows.select("slug", "outcome", why.alias("why"), "kind", "manifest", body.alias("body"), F.col("mark").alias("was"))
    return out.withColumn("mark", F.when(F.col("outcome") == "fixed", mark(key, F.col("slug"), F.col("kind"), F.col("manifest"), F.col("body"))).otherwise(F.col("was"))).drop("was")


def counts(done: DataFrame) -> DataFrame:
    """outcome, n of every outcome, zeros kept."""
    n = done.groupBy("outcome").agg(F.count("*").alias("n"))
    kinds = done.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return F.broadcast(kinds).join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def memories(done: DataFrame, store: DataFrame) -> DataFrame:
    """slug, title, description, type, meta, tags, body of what is poured, as StoreTable.upsert takes it.

    A draft that extends a memory adds its text behind that memory's body and keeps its description; several such drafts are added in the order of their names. store: slug, title, description, type, body.
    """
    body = F.col("body")
    rows = done.where("outcome in ('poured', 'fixed')").select(
        "slug", "kind", "manifest", header(body, "EXTENDS").alias("extends"), header(body, "TITLE").alias("title"), header(body, "DESC").alias("description"), text_of(body).alias("text"), F.coalesce(tag_list(header(body, "TAGS")), F.array().cast("array<string>")).alias("tags")
    )
    meta = F.create_map(F.lit("evidence_manifest"), F.concat(F.lit("sha256:"), "manifest"))
    new = rows.where("extends is null").select("slug", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", "slug").alias("description"), F.coalesce("kind", F.lit("project")).alias("type"), meta.alias("meta"), "tags", F.col("text").alias("body"))
    more = rows.where("extends is not null").groupBy("extends").agg(F.array_sort(F.collect_list(F.struct("slug", "text", "manifest", "tags"))).alias("m"))
    joined = store.select("slug", "title", "description", "type", F.col("body").alias("old")).join(more, F.col("slug") == F.col("extends"))
    text = F.array_join(F.concat(F.array(F.regexp_replace("old", r"(?U)\s+$", "")), F.transform("m", lambda x: x["text"])), "\n\n")
    last = F.element_at("m", -1)
    held = F.create_map(F.lit("evidence_manifest"), F.concat(F.lit("sha256:"), last["manifest"]))
    return new.union(joined.select("slug", "title", "description", "type", held.alias("meta"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["tags"]))).alias("tags"), text.alias("body")))
