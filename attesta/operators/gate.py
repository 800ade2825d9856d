"""The evidence gate: quotes must occur in the material, must not echo the store, and decide what a candidate may claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.durable import written
from attesta.functions.fixed import CLASSES, CUE_MAX, CUE_MIN, CUES, ENTRUSTED, FACT_AS_IDEA, FAILURE, FORGETTING_TAGS, JUDGEMENT, QUOTE_MAX, QUOTE_MIN, QUOTES, WARNING
from attesta.functions.text import fold, squeeze
from attesta.operators.recognise import checked


def haystacks(segments: DataFrame) -> DataFrame:
    """batch, cls, hay: all text of a class in a batch, in order, squeezed; a quote may span segments. A batch is bounded by intake (200,000 characters)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return segments.groupBy("batch", "cls").agg(squeeze(F.array_join(ordered, "\n")).alias("hay"))


def quotes(cands: DataFrame) -> DataFrame:
    """cand, batch, n (from 0), claimed, quote: the first QUOTES of an array of '[CLASS] text', squeezed, cut at QUOTE_MAX, without short ones."""
    each = cands.select("batch", "cand", F.posexplode(F.slice("quotes", 1, QUOTES)).alias("n", "raw"))
    tag = F.regexp_extract("raw", r"(?s)^\[(USER|TOOL|ACT|SELF|KEN|ME)\]\s*(.*)", 1)
    text = F.when(tag != "", F.regexp_extract("raw", r"(?s)^\[(USER|TOOL|ACT|SELF|KEN|ME)\]\s*(.*)", 2)).otherwise(F.col("raw"))
    claimed = F.when(tag == "KEN", "USER").when(tag == "ME", "SELF").when(tag != "", tag)
    out = each.select("batch", "cand", "n", claimed.alias("claimed"), F.substring(squeeze(text), 1, QUOTE_MAX).alias("quote"))
    return out.where(F.length("quote") >= QUOTE_MIN)


def found_in(q: DataFrame, segments: DataFrame) -> DataFrame:
    """q with found: the classes, in the order of CLASSES, whose material of the same batch contains the quote."""
    hay = haystacks(segments)
    hits = q.join(hay, "batch").where(F.col("hay").contains(F.col("quote"))).groupBy("cand", "n").agg(F.collect_set("cls").alias("f"))
    known = F.filter(F.array(*map(F.lit, CLASSES)), lambda c: F.array_contains("f", c))
    return q.join(hits, ["cand", "n"], "left").select(*q.columns, F.coalesce(F.when(F.col("f").isNotNull(), known), F.array().cast("array<string>")).alias("found"))


def _inner(text: Column) -> Column:
    """The words that stand between others of a squeezed text: where the text occurs, they are whole words there."""
    w = F.split(text, " ")
    return F.array_distinct(F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 2)))


#: Letters of the piece by which quotes of one or two words are found where there are more than FEW of them.
PIECE, FEW = 6, 64


def _pieces(word: Column, sizes: list[int]) -> Column:
    """All runs of so many letters of a word."""
    cut = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(cut, sizes))))


def echoes(q: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """The distinct quotes that some text of the store contains, verbatim after squeezing.

    A quote with words between others is looked for by the one of them that the fewest texts have; if no text has one of them, no text has the quote. Others are looked for by the first PIECE letters of their longest
    word, among the pieces of the texts' words, or, if they are FEW, in every text. Texts are never shuffled as long as the words that are asked for, and then the (text, quote) pairs that they propose, are few enough to be broadcast; containment
    decides. An empty quote is contained in any text.
    """
    quote = written(q.select("quote").distinct().where("quote is not null").select("quote", _inner(F.col("quote")).alias("inner")))
    store = texts.select(squeeze(F.coalesce(text, F.lit(""))).alias("t")).withColumn("at", F.xxhash64("t"))
    spelled = store.select("at", F.explode(F.array_distinct(F.split("t", " "))).alias("word"))
    inner = quote.select("quote", F.explode("inner").alias("word"))
    held = spelled.join(checked(inner.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rarest = inner.join(held, "word", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r")).where("r.df > 0").select("quote", "r.word")
    pairs = spelled.join(checked(written(rarest)), "word").select("at", "quote")
    longest = F.array_max(F.transform(F.split("quote", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = written(quote.where(F.size("inner") == 0).select("quote", F.substring(longest, 1, PIECE).alias("piece")))
    few = short.where("piece != ''").select("quote")
    if few.limit(FEW + 1).count() <= FEW:
        seen = store.join(F.broadcast(few), F.col("t").contains(F.col("quote"))).select("quote")  # FEW rows
    else:
        sizes = sorted(r.n for r in short.select(F.length("piece").alias("n")).distinct().collect() if r.n)  # at most PIECE
        cut = spelled.select("at", F.explode(_pieces(F.col("word"), sizes)).alias("piece"))
        pairs = pairs.union(cut.join(checked(short.where("piece != ''")), "piece").select("at", "quote"))
        seen = few.where("false")
    hits = store.join(checked(written(pairs.distinct())), "at").where(F.col("t").contains(F.col("quote"))).select("quote").union(seen).distinct()
    empty = short.where("piece = ''").select("quote").join(F.broadcast(texts.limit(1).select(F.lit(1).alias("any"))), how="left_semi")  # one row
    return hits.union(empty)


def gate(cands: DataFrame, segments: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """One row per candidate: batch, cand, disposition ('kept', 'dropped', 'idea'), why_dropped, classes, evidence, judgement, unverified_numbers.

    cands: batch, cand, kind, topic, why, quotes. store: text of every memory.
    """
    q = found_in(quotes(cands), segments)
    if store is not None:
        q = q.join(echoes(q.where(F.size("found") > 0), store).withColumn("echo", F.lit(True)), "quote", "left")
    else:
        q = q.withColumn("echo", F.lit(None).cast("boolean"))
    echo = F.coalesce("echo", F.lit(False))
    cls = F.when(F.array_contains("found", F.col("claimed")), F.col("claimed")).otherwise(F.get("found", F.lit(0)))
    good = F.when((F.size("found") > 0) & ~echo, F.struct("n", cls.alias("cls"), F.col("quote").alias("text")))
    kept = q.groupBy("cand").agg(F.array_sort(F.collect_list(good)).alias("good"), F.count_if((F.size("found") > 0) & echo).alias("echoed"))
    said = F.concat_ws(" ", F.coalesce("why", F.lit("")), F.coalesce("topic", F.lit("")))
    idea = F.lower(F.coalesce("kind", F.lit(""))) == "idea"
    rows = cands.select("batch", "cand", "kind", idea.alias("is_idea"), said.alias("said"), F.concat_ws(" ", F.coalesce("topic", F.lit("")), F.coalesce("why", F.lit(""))).alias("blob")).join(kept, "cand", "left")
    none = F.coalesce(F.size("good"), F.lit(0)) <= 0
    classes = F.array_sort(F.array_distinct(F.transform("good", lambda x: x["cls"])))
    judgement = classes == F.array(F.lit("SELF"))
    why = (
        F.when(F.col("is_idea") & F.col("blob").rlike(FACT_AS_IDEA), "a factual report dressed as an idea")
        .when(F.col("is_idea"), None)
        .when(none & (F.coalesce("echoed", F.lit(0)) > 0), "echo of text already in the store")
        .when(none, "quotes not found in the raw material")
        .when(judgement & ~F.col("said").rlike(JUDGEMENT), "turning the agent's own words into a fact")
    )
    out = rows.withColumn("why_dropped", why).withColumn("classes", F.when(~F.col("is_idea"), classes))
    disposition = F.when(F.col("why_dropped").isNotNull(), "dropped").when(F.col("is_idea"), "idea").otherwise("kept")
    live = F.col("disposition") == "kept"
    grounded = F.arrays_overlap("classes", F.array(F.lit("TOOL"), F.lit("ACT")))
    return out.withColumn("disposition", disposition).select(
        "batch",
        "cand",
        "disposition",
        "why_dropped",
        F.when(live, F.col("classes")).alias("classes"),
        F.when(live, F.transform("good", lambda x: F.struct(x["cls"].alias("class"), x["text"].alias("text")))).alias("evidence"),
        F.when(live, judgement).alias("judgement"),
        F.when(live, F.col("said").rlike(r"\d") & ~grounded).alias("unverified_numbers"),
    )


def verified_tags(rows: DataFrame, recurred_ok: bool = False) -> DataFrame:
    """key, tag, kept, basis_class, basis_quote, refused: what the evidence decides about each proposed tag.

    rows: key, tags (array, normalised), evidence array<struct<class, text>>.
    """
    quote = lambda cls, pattern=None: F.get(F.filter("evidence", lambda e: (e["class"].isin(*cls)) & (e["text"].rlike(pattern) if pattern else F.lit(True))), F.lit(0))
    t = rows.select("key", F.explode("tags").alias("tag"), quote(("USER",)).alias("user"), quote(("USER",), ENTRUSTED).alias("entrust"), quote(("TOOL", "ACT"), FAILURE).alias("fail"), quote(("USER",), WARNING).alias("warn"), F.array_min(F.transform(F.filter("evidence", lambda e: e["class"] != "SELF"), lambda e: e["class"])).alias("other"))
    tag = F.col("tag")
    refused = (
        F.when(tag.isin(*FORGETTING_TAGS), "reserved for the forgetting pass; a model may not assign it")
        .when(tag.isin("emotion-carried", "commitment") & F.col("user").isNull(), "needs the human's own words; no [USER] quote survived")
        .when((tag == "entrusted") & F.col("entrust").isNull(), "needs a [USER] quote that asks for this to be kept")
        .when((tag == "recurred") & ~F.lit(recurred_ok), "recurrence is decided against a prior memory, not proposed")
        .when((tag == "landmine") & F.coalesce("warn", "fail").isNull(), "needs an actual failure in [TOOL] output or a warning/correction in the human's words; a quiet tool line is neither")
        .when((tag == "formative") & F.col("other").isNull(), "needs more than the agent's own prose")
    )
    basis = F.when(tag.isin("emotion-carried", "commitment", "recurred"), F.col("user")).when(tag == "entrusted", F.col("entrust")).when(tag == "landmine", F.coalesce("warn", "fail"))
    out = t.withColumn("refused", refused).withColumn("basis", F.when(refused.isNull(), basis))
    kind = F.when(F.col("refused").isNull() & (tag == "formative"), F.col("other")).otherwise(F.col("basis.class"))
    return out.select("key", "tag", F.col("refused").isNull().alias("kept"), kind.alias("basis_class"), F.col("basis.text").alias("basis_quote"), "refused")


def callsigns(rows: DataFrame, folding=fold, spelling=squeeze) -> DataFrame:
    """key, n, text, quote, refused: proposed callsigns against the surviving USER quotes; the first CUES that pass are kept.

    rows: key, callsigns (array), evidence array<struct<class, text>>. spelling: the form that is gated and kept, from what was proposed.
    """
    each = rows.select("key", F.posexplode("callsigns").alias("n", "raw"), F.filter("evidence", lambda e: e["class"] == "USER").alias("user"))
    each = each.withColumn("text", spelling(F.col("raw"))).withColumn("k", folding("text"))
    hit = F.get(F.filter("user", lambda e: e["text"].contains(F.col("text"))), F.lit(0))
    why = (
        F.when(~F.col("k").rlike(r"(?U)[\p{L}\p{N}]"), "whitespace and punctuation alone do not route anywhere")
        .when(~F.length("k").between(CUE_MIN, CUE_MAX), "a callsign is 3–40 codepoints after normalisation")
        .when(hit.isNull(), "needs the human's own words: an exact substring of a surviving [USER] quote")
    )
    judged = each.withColumn("refused", why).withColumn("hit", hit)
    once = judged.withColumn("r", F.row_number().over(Window.partitionBy("key", "k", F.col("refused").isNull()).orderBy("n"))).where("refused is not null or r = 1")
    rank = F.sum(F.col("refused").isNull().cast("int")).over(Window.partitionBy("key").orderBy("n"))
    late = F.when(F.col("refused").isNull() & (rank > CUES), "at most two callsigns per memory")
    return once.withColumn("late", late).select("key", "n", "text", F.when(F.coalesce("refused", "late").isNull(), F.col("hit.text")).alias("quote"), F.coalesce("refused", "late").alias("refused"))


def class_counts(segments: DataFrame) -> DataFrame:
    """batch and the number of its segments of each class."""
    return segments.groupBy("batch").agg(*[F.count_if(F.col("cls") == c).alias(f"n_{c.lower()}") for c in CLASSES])


def recurrences(covered: DataFrame, memories: DataFrame) -> DataFrame:
    """cand, slug of covered candidates (cand, slug, source_key) whose memory (slug, origin_key, tags) came from another journal and isn't tagged yet."""
    both = covered.join(memories.select("slug", "origin_key", "tags"), "slug")
    return both.where((F.col("source_key") != F.col("origin_key")) & ~F.array_contains("tags", "recurred")).select("cand", "slug")
