"""Connected components of a set of links, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (id, component) for every id that has a link to another; component is the smallest id it reaches.

    Alternates the large-star and small-star steps (Kiveris and others, "Connected components in
    MapReduce and beyond"): each moves links towards the smallest neighbour, the number of links
    never grows, and the rounds needed grow with the logarithm of the graph. Every round is written to
    the shared folder. Neighbours meet only in partial minima and in joins whose large keys
    Spark can split; no neighbour list is ever gathered. Null ends and loops are no links.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.where("u != v").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(e)
        drop_table(large)
        e = after
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


#: Ids of each key that all others are compared with first.
PIVOTS = 2


def shared(cells: DataFrame) -> DataFrame:
    """The rows (columns of a key, and id) whose key more than one id has; an id has a key once."""
    key = [c for c in cells.columns if c != "id"]
    return cells.join(cells.groupBy(*key).count().where("count > 1").select(*key), key)


def grouped(
    cells: DataFrame,
    payload: DataFrame,
    near: str,
    verified: Callable[[DataFrame], DataFrame],
    *key: str,
    pivots: int = PIVOTS,
    whole: Callable[[DataFrame], tuple[DataFrame, str]] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Connected components (id, component) of the verified pairs among ids that share a key.

    cells: the columns of key, and id. payload: by id, whatever near reads: a condition on a pair of rows, {a}column and {b}column, that every
    linked pair meets. verified: from pairs (x, y) to those that are linked, as x and y.
    In each key the ids are first compared with a few pivots, components are formed, and then only ids that still lie in different
    components are compared: in each key single ids with one another and with larger components, and larger components
    pair by pair. In a group of which each member is linked to a share of the others, hardly one is left after the pivots;
    so a group of similar rows never makes all its pairs. Joins put out only pairs that meet near. whole: from the cells of the second
    comparison to the same with whatever another condition on a pair reads, and that condition, which each linked pair meets in one of its keys; if it is exact,
    joins put out linked pairs only. Only keys and ids are shuffled until rows meet; what near reads joins them last.
    """
    keys, carried = list(key), [c for c in payload.columns if c != "id"]
    cells = cut(cells.select(*keys, "id"))  # no key meets in one task: partial minima, and joins whose large keys Spark can split
    first = F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id")) for i in range(pivots)])
    led = cells.groupBy(*keys).agg(first.alias("first"))
    led = led.select(*keys, F.explode(F.array_distinct(F.transform("first", lambda p: p["id"]))).alias("id")).join(payload, "id")
    led = led.groupBy(*keys).agg(F.collect_list(F.struct("id", *carried)).alias("pivots"))  # a few of each key
    met = F.expr(f"filter(pivots, p -> p.id != id and {near.format(a='p.', b='')})")
    star = cells.join(payload, "id").join(led, keys).select("id", F.explode(F.transform(met, lambda p: p["id"])).alias("p"))
    star = star.select(F.least("id", "p").alias("x"), F.greatest("id", "p").alias("y"))
    star = cut(verified(star.distinct()).select("x", "y"))
    of_star = cut(components(star, "x", "y"))
    placed = cells.join(of_star, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    sizes = placed.groupBy(*keys, "c").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy(*keys).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(*keys)
    cut_cells = cut(placed.join(sizes.join(mixed, keys), [*keys, "c"]))
    placed = cut_cells.join(payload, "id")
    if whole is not None:
        placed, near = whole(placed)
    rest = [c for c in placed.columns if c not in (*keys, "c", "m")]
    a, b = (placed.select(*keys, "m", F.struct("c", *rest).alias(s)) for s in "ab")
    close = F.expr(near.format(a="a.", b="b."))
    one, many = F.col("m") == 1, F.col("m") > 1
    ends = [F.col("a.id").alias("x"), F.col("b.id").alias("y")]
    pairs = a.where(one).drop("m").join(b.where(one).drop("m"), keys).where(close & F.expr("a.id < b.id")).select(*ends)
    pairs = pairs.union(a.where(one).drop("m").join(b.where(many).drop("m"), keys).where(close).select(*ends))
    large = cut_cells.where(many).select(*keys, "c").distinct()
    apart = large.withColumnRenamed("c", "ca").join(large.withColumnRenamed("c", "cb"), keys).where("ca < cb")
    left, right = a.where(many).withColumn("ca", F.col("a.c")).drop("m"), b.where(many).withColumn("cb", F.col("b.c")).drop("m")
    pairs = pairs.union(apart.join(left, [*keys, "ca"]).join(right, [*keys, "cb"]).where(close).select(*ends))
    more = cut((pairs if whole is not None and exact else verified(pairs.distinct())).select("x", "y"))
    drop_table(cells)
    drop_table(cut_cells)
    # The components of the pivots' links are nodes now, by their smallest id.
    for end in "xy":
        more = more.join(of_star.select(F.col("id").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = cut(components(more, "x", "y"))
    out = of_star.select("id", F.col("component").alias("c")).join(joined.withColumnRenamed("id", "c"), "c", "left").select("id", F.coalesce("component", "c").alias("component"))
    return out.union(joined.join(of_star.select("id"), "id", "left_anti").select("id", "component"))
