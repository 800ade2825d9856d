"""Exact dedup by deterministic block naming (after Karp, Miller and Rosenberg), in DataFrame functions only.

Every text, without white space, is cut into blocks of BLOCK code points. The distinct blocks are
sorted and named by integers; names of adjacent pairs of blocks are then named in the same way, level
by level, until each document has one name. Two texts get the same (level, name) only if they are equal:
names are given to whole contents, never to hashes, so there are no collisions.

The blocks' contents are shuffled once, after each task has folded its own repeats, to be sorted and named.
Rows find their names by the 64-bit hash of the block where all blocks of that hash are equal (which the naming
has seen), and by the content itself where not. So a block that a third of all rows have weighs one row
a task in the sort, and the thin join that hands the names out is one whose large keys Spark can split.

Nulls: a null text counts as empty; empty texts are equal to one another. A null id stays, as an id greater than
all others. Repeated rows are rows of one group. Extra columns are not read. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop_table, squeezed

#: Code points of a block.
BLOCK = 4096


def named(keys: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of keys with a column name: integers from 1, rising with columns within each sorted run."""
    return keys.select(*columns).distinct().sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id() + 1)


def identities(docs: DataFrame, block: int = BLOCK, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: row, id, points (code points of the original text), digest, level, name."""
    norm = squeezed(F.col(text))
    read = docs.select(F.col(id_).alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"), norm.alias("norm"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("norm") - 1) / block)).cast("int"))
    parts = F.transform(starts, lambda i: F.substring("norm", i * block + 1, F.lit(block)))
    cells = read.select(F.explode(parts).alias("content")).select(F.xxhash64("content").alias("hash"), "content")
    names = cut(named(cells, "hash", "content").select("hash", "name"))
    key = ["hash"]
    if not names.groupBy("hash").count().where("count > 1").isEmpty():  # blocks that differ share a hash: find names by content
        names, key = cut(named(cells, "hash", "content")), ["hash", "content"]
    by_key = F.transform(parts, lambda p: F.struct(F.xxhash64(p).alias("hash"), *([p.alias("content")] if "content" in key else [])))
    rows = cut(read.select(F.monotonically_increasing_id().alias("row"), "id", "points", F.sha2(F.encode("norm", "utf-8"), 256).alias("digest"), by_key.alias("blocks")))
    level = rows.select("row", F.size("blocks").alias("left"), F.posexplode("blocks").alias("pos", "b")).select("row", "left", "pos", "b.*")
    level = cut(level.join(names, key).select("row", "left", "pos", "name"))
    most, k, done = level.agg(F.max("left")).first()[0] or 1, 0, []
    while True:
        done.append(level.where("left = 1").select("row", F.lit(k).alias("level"), "name"))
        if most == 1:
            break
        half = F.shiftright("pos", 1)
        one = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = level.where("left > 1").groupBy("row", F.expr("(left + 1) div 2").cast("int").alias("left"), half.alias("pos")).agg(one(0).alias("a"), F.coalesce(one(1), F.lit(0)).alias("b"))
        pairs = cut(pairs)
        level = cut(pairs.join(named(pairs, "a", "b"), ["a", "b"]).select("row", "left", "pos", "name"))
        most, k = (most + 1) // 2, k + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return rows.drop("blocks").join(whole, "row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest id.
    """
    found = cut(identities(docs, block, id_, text))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("no"), "id", "row"))
    groups = found.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    out = found.join(groups, ["level", "name"])
    return out.select(F.col("id").alias(id_), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))
