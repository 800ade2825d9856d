"""Mixing sources to target weights by Pfair scheduling.

A source's documents are dealt into blocks of equal numbers of documents. With integer weights W of sum T, block j (from 0)
of a source is released at slot floor(j * T / W) and due by slot ceil((j + 1) * T / W). One block fills a slot: of the
released blocks the one due first. The weights fill every slot, so no block is ever late, and after each slot
every source's count differs from its share by less than one block.

The weights are the targets exactly (a float is a fraction), so this holds for the targets themselves, however long the schedule is.
Where T is at most a parameter the schedule repeats after T slots, and the driver lays out one period; for other targets it
lays out every block. A block has at least a given number of documents, and as many as it takes to make no more than MOST_BLOCKS blocks (and one
for each source), so the driver's schedule does not grow with the corpus. When a source has no blocks left, the others go on with their weights among themselves in a new
period (a segment), until all documents have a place: none is dropped or repeated. The driver holds
the number of documents of each source; more than MOST_SOURCES sources are an error, not a cut.

The place of a document in its source is a count, not a sort of the whole source: documents are dealt into buckets by a hash,
ranked within buckets, and offset by the sizes of the buckets before. A hot source has as many buckets as it needs.

Nulls: a null source is a source of its own; a null id is an id. Rows that repeat a (source, id) share one place. An empty
table has no schedule. A source without a target weight is an error; text and extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, fresh

MOST_SOURCES = 10_000
MOST_BLOCKS = 1 << 20
#: Documents of a bucket, on average.
BUCKET = 8192


def period(weights: list[int], most: list[int] | None = None) -> list[tuple[int, int]]:
    """One period's slots: (source, its block), by earliest deadline first; ends early when a source has had most[source] blocks."""
    total = sum(weights)
    due = lambda s, j: -(-(j + 1) * total // weights[s])
    waiting = [(0, s, 0) for s in range(len(weights))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if most is not None and j + 1 == most[s]:
            break
        heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return out


def shares(weights: list[float], parts: int) -> list[int]:
    """Integer weights near weights * parts, of no common factor."""
    total = math.fsum(weights)
    whole = [max(1, round(w * parts / total)) for w in weights]
    common = math.gcd(*whole)
    return [w // common for w in whole]


def exact(weights: list[float], parts: int) -> list[int]:
    """Integer weights in just the proportions of weights: of shares() if these are it, else of whatever size that takes."""
    given = [Fraction(w) for w in weights]
    short = shares(weights, parts)
    if all(a * short[0] == given[0] * b for a, b in zip(given, short, strict=True)):
        return short
    scale = math.lcm(*(w.denominator for w in given))
    whole = [int(w * scale) for w in given]
    common = math.gcd(*whole)
    return [w // common for w in whole]


def segments(blocks: list[int], weights: list[float], parts: int) -> list[dict]:
    """The schedule: for each segment its first slot, periods, slots of a period, and per source first block and weight, the pattern, and the
    slots in which each of its blocks is released and due."""
    left, start, out = list(blocks), 0, []
    while any(left):
        active = [s for s, n in enumerate(left) if n]
        w = exact([weights[s] for s in active], parts)
        total = sum(w)
        times = min(left[s] // x for s, x in zip(active, w, strict=True))
        slots = period(w) if times else period(w, [left[s] for s in active])
        windows = [(j * total // w[a], -(-(j + 1) * total // w[a])) for a, j in slots]
        had = [0] * len(active)
        pattern = []
        for t, (a, j) in enumerate(slots):
            pattern.append((active[a], j, t))
            had[a] = j + 1
        out.append({"slot": start, "times": max(times, 1), "length": len(slots), "pattern": pattern, "windows": windows, "sources": [(s, blocks[s] - left[s], had[i], total, w[i]) for i, s in enumerate(active) if had[i]]})
        for i, s in enumerate(active):
            left[s] -= had[i] * max(times, 1)
        start += len(slots) * max(times, 1)
    return out


def mixed(docs: DataFrame, weights: dict | None = None, block: int = 16, parts: int = 1000, power: float = 0.5, most_blocks: int = MOST_BLOCKS, id_: str = "doc_id", source: str = "source") -> DataFrame:
    """id_, source, block, segment, released, due (slots from the segment's start), slot, place; one row per distinct (source, id_).

    weights: target weight by source. block: documents of a block, or more where that makes more than most_blocks. Without it a source's weight is its number of documents to the given power.
    Ascending place is the mixture.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(source).cast("string").alias("src"), F.col(id_).cast("long").alias("id")).distinct()
    sizes = sorted(((r.src, r["count"]) for r in rows.groupBy("src").count().limit(MOST_SOURCES + 1).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give small ones a common name first")
    out_schema = f"{id_} long, {source} string, block long, segment int, released long, due long, slot long, place long"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    if weights is not None and (missing := [s for s, _ in sizes if not weights.get(s, 0) > 0]):
        raise ValueError(f"no target weight for {missing[:5]}")
    block = max(block, -(-sum(n for _, n in sizes) // most_blocks))
    target = [weights[s] if weights is not None else n**power for s, n in sizes]
    plan = segments([-(-n // block) for _, n in sizes], target, parts)
    spans, cells = [], []
    for k, g in enumerate(plan):
        spans += [(k, s, first, first + had * g["times"], had, g["slot"], g["length"]) for s, first, had, *_ in g["sources"]]
        cells += [(k, s, j, t, *window) for (s, j, t), window in zip(g["pattern"], g["windows"], strict=True)]
    spans = spark.createDataFrame(pd.DataFrame(spans, columns=["segment", "s", "first", "last", "had", "start", "length"]))
    cells = spark.createDataFrame(pd.DataFrame(cells, columns=["segment", "s", "j", "t", "from", "to"]))
    names = F.broadcast(spark.createDataFrame([(i, s) for i, (s, _) in enumerate(sizes)], "s long, name string"))  # at most MOST_SOURCES
    buckets = max(1, sum(n for _, n in sizes) // BUCKET)
    dealt = rows.join(names, rows["src"].eqNullSafe(names["name"])).withColumn("h", F.xxhash64("id", F.lit(7))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("s", "bucket").orderBy("h", "id")) - 1
    ranked = cut(dealt.select("s", "src", "id", "bucket", rank.alias("rank")))
    counts = ranked.groupBy("s", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.join(counts.select("s", "bucket", before.alias("offset")), ["s", "bucket"])
    placed = placed.select("s", "src", "id", (F.col("offset") + F.col("rank")).alias("nth")).withColumn("block", F.expr(f"nth div {block}"))
    blocks = placed.groupBy("s", "block").agg(F.count("*").alias("size"))
    at = blocks.join(spans, "s").where("block >= first and block < last")
    at = at.select("*", F.expr("(block - first) div had").alias("turn"), F.expr("(block - first) % had").alias("j")).join(cells, ["segment", "s", "j"])
    turned = F.col("turn") * F.col("length")
    at = at.select("s", "block", "segment", (turned + F.col("from")).alias("released"), (turned + F.col("to")).alias("due"), (F.col("start") + F.col("turn") * F.col("length") + F.col("t")).alias("slot"))
    out = placed.join(at, ["s", "block"])
    return out.select(F.col("id").alias(id_), F.col("src").alias(source), "block", F.col("segment").cast("int").alias("segment"), "released", "due", "slot", (F.col("slot") * block + F.col("nth") % block).alias("place"))


def in_mixed_order(docs: DataFrame, id_: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """docs, sorted by place: every row is kept, and written files hold the mixture in order."""
    place, i, s = fresh(docs, "place", "at_id", "at_source")
    where = mixed(docs, id_=id_, source=source, **how).select(F.col(id_).alias(i), F.col(source).alias(s), F.col("place").alias(place))
    joined = docs.join(where, docs[id_].eqNullSafe(where[i]) & docs[source].eqNullSafe(where[s]))
    return joined.sort(place).select(*docs.columns)
