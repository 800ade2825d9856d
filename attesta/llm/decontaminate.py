"""Benchmark decontamination, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A text's shingles are its runs of SHINGLE words (an item with fewer words is one
shingle), each weighted by its letters and digits. Windows of an item's size are taken where a document
holds at least one shingle of an item of that size: aligned with it, and up to SHINGLE - 1 words to either side, which is as far
as an edit at the item's ends moves the best window. Each window gets a weighted 64-bit SimHash; windows meet the items of their size in
a Hamming index of RADIUS + 1 blocks, which finds every item within RADIUS bits. What it finds is verified by the
exact weighted similarity, 2 * weight(common) / (weight(window) + weight(item)) over distinct shingles, at least SIMILAR.
At similarity SIMILAR about 13 bits differ (standard deviation 3), hence RADIUS.

The items' shingles are broadcast only while they number at most BROADCAST, and shuffled beyond; so are the keys of documents with
a common shingle. Nulls: a null text or item has no words and matches nothing; a null id is reported as null; repeated rows are
one row of the result. Extra columns are not read. Texts are taken whole; a document shorter than an item is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, fresh, small
from attesta.llm.simhash import block_keys, hamming, simhash

SHINGLE, RADIUS, SIMILAR = 5, 24, 0.8


def words(text: Column) -> Column:
    """The words; an empty array for a null or blank text."""
    w = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.when(w[0] == "", F.array().cast("array<string>")).otherwise(w)


def _shingles(w: str, k: int) -> Column:
    """(hash, weight) of each run of k words of the array column w, in order."""

    def one(i: Column) -> Column:
        run = [F.get(w, i + j) for j in range(k)]
        return F.struct(F.xxhash64(*run).alias("h"), F.length(F.concat(*run)).alias("w"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), one)
    return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<struct<h:bigint,w:int>>"))


def _places(w: str, k: int) -> Column:
    """(k, place, hash) of each run of k words of the array column w."""

    def one(i: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), i.alias("p"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h"))

    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(F.array().cast("array<struct<k:int,p:int,h:bigint>>"))


def leaks(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: id_, text_hash, item, start (word), n_words, hamming, similarity, of the best window."""
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), words(F.col(item_text)).alias("ws")).where("size(ws) > 0")
    rows = rows.select("item_id", "item", "ws", F.size("ws").alias("size"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"))
    kinds = sorted(r.k for r in rows.select("k").distinct().collect())  # at most SHINGLE
    schema = f"{id_} long, text_hash long, {item} long, start int, n_words int, hamming int, similarity double"
    if not kinds:
        return docs.sparkSession.createDataFrame([], schema)
    by_k = F.lit(None)
    for k in kinds:
        by_k = F.when(F.col("k") == k, _shingles("ws", k)).otherwise(by_k)
    rows = cut(rows.select("item_id", "item", "size", "k", by_k.alias("sh")))
    anchors = cut(rows.select("k", "size", F.posexplode("sh").alias("q", "s")).select("k", F.col("s.h").alias("h"), "q", "size").distinct())
    base = docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), words(F.col(text)).alias("ws"))
    places = [_places("ws", k) for k in kinds]
    places = F.concat(*places) if len(places) > 1 else places[0]
    cells = base.select("id", "key", F.size("ws").alias("n"), F.explode(places).alias("c")).select("id", "key", "n", "c.*")
    hits = cells.join(small(anchors), ["k", "h"])
    aligned = hits.select("id", "key", "k", "size", "n", (F.col("p") - F.col("q")).alias("at")).distinct()
    shifts = F.explode(F.array(*[F.lit(i) for i in range(1 - SHINGLE, SHINGLE)])).alias("by")
    start = F.greatest(F.lit(0), F.least(F.col("at") + F.col("by"), F.col("n") - F.col("size")))
    windows = cut(aligned.select("*", shifts).select("id", "key", "k", "size", start.alias("start")).distinct())
    here = windows.select("id", "key").distinct()
    some = docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), F.col(text).alias("text"))
    near = small(here.select(F.col("id").alias("i"), F.col("key").alias("y")))
    texts = some.join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("y")), "left_semi").dropDuplicates(["id", "key"])
    texts = texts.select(F.col("id").alias("i"), F.col("key").alias("y"), words(F.col("text")).alias("ws"))
    cutout = windows.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("y"))).select("id", "key", "k", "size", "start", F.slice("ws", F.col("start") + 1, F.col("size")).alias("ws"))
    cutout = cutout.select("id", "key", "k", "size", "start", by_k.alias("sh"))

    def printed(df: DataFrame) -> DataFrame:
        df = df.withColumn("sh", F.array_distinct("sh"))
        total = F.aggregate("sh", F.lit(0).cast("long"), lambda a, s: a + s["w"])
        df = df.withColumn("total", total)
        return df.withColumn("print", simhash(F.col("sh.h"), F.col("sh.w"), F.col("total")))

    left = cut(printed(cutout).withColumn("window", F.monotonically_increasing_id()))
    right = cut(printed(rows.select("item_id", "item", "k", "size", "sh")))
    keyed = lambda df, *c: df.select(*c, "size", "print", F.explode(block_keys(F.col("print"), radius)).alias("b")).select(*c, "size", "print", "b.*")
    found = keyed(left, "window").join(keyed(right, "item").withColumnRenamed("print", "p2"), ["size", "blocks", "bits"])
    found = found.where(hamming("print", "p2") <= radius).select("window", "item", hamming("print", "p2").alias("hamming")).distinct()
    pairs = found.join(left.drop("print", "size"), "window").join(right.select("item", "item_id", F.col("sh").alias("sh2"), F.col("total").alias("t2"), "size"), "item")
    common = F.aggregate(F.array_intersect("sh", "sh2"), F.lit(0).cast("long"), lambda a, s: a + s["w"])
    pairs = pairs.withColumn("similarity", 2.0 * common / (F.col("total") + F.col("t2"))).where(F.col("similarity") >= similar)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size", "hamming")).alias("b")
    out = pairs.groupBy("id", "key", "item", "item_id").agg(best)
    return out.select(F.col("id").alias(id_), F.col("key").alias("text_hash"), F.col("item_id").alias(item), (-F.col("b.back")).alias("start"), F.col("b.size").alias("n_words"), F.col("b.hamming").alias("hamming"), F.col("b.similarity").alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame, id_: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no item."""
    i, key = fresh(docs, "leak_id", "leak_key")
    found = leaks(docs, items, id_=id_, text=text, **how).select(F.col(id_).alias(i), F.col("text_hash").alias(key)).distinct()
    same = docs[id_].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(key))
    return docs.join(found, same, "left_anti")
