"""Names: resolution of what a model or a link says to a memory, and walks over links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.fixed import RESOLVE_JACCARD
from attesta.functions.text import clean_name, links_of


def resolve_exact(names: DataFrame, slugs: DataFrame) -> DataFrame:
    """name, slug: names that are slugs as given."""
    return names.select("name", clean_name("name").alias("slug")).join(slugs.select("slug"), "slug", "left_semi").select("name", "slug")


def resolve(names: DataFrame, slugs: DataFrame, titles: DataFrame) -> DataFrame:
    """name, slug, tier: exact, then index title, then slug in any case, then the best word overlap of at least RESOLVE_JACCARD (least slug first); null without any.

    names: distinct name. slugs: slug. titles: title (lower case), slug; the first line of a title wins.
    """
    n = names.select("name", clean_name("name").alias("n")).withColumn("low", F.lower("n"))
    known = slugs.select("slug").distinct()
    exact = n.join(known.select(F.col("slug").alias("n"), F.col("slug").alias("exact")), "n", "left")
    live = titles.join(known, "slug", "left_semi").select(F.col("title").alias("low"), F.col("slug").alias("by_title"))
    low = known.groupBy(F.lower("slug").alias("low")).agg(F.max("slug").alias("by_case"))
    tiers = exact.join(live, "low", "left").join(low, "low", "left")
    rest = tiers.where("coalesce(exact, by_title, by_case) is null and n != ''")
    split = lambda c, p: F.filter(F.array_distinct(F.split(F.lower(c), p)), lambda w: w != "")
    want = rest.select("name", split("n", r"[-_\s/]+").alias("w"))
    have = known.select("slug", split("slug", r"[-_/]+").alias("w"))
    # Prefix filter: a set of a words overlaps one of b words by at least o = 2/7 (a + b) to reach 0.4, so one of its a - o + 1
    # rarest words is shared. A word that every slug has then joins nothing but the sets that it decides.
    seen = have.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = want.select("name", "w", F.explode("w").alias("word")).join(seen, "word", "left")
    rarest = ranked.groupBy("name", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))), lambda x: x["word"]).alias("rare"))
    sizes = have.select(F.size("w").alias("b")).distinct()
    need = F.ceil(F.lit(RESOLVE_JACCARD / (1 + RESOLVE_JACCARD)) * (F.size("w") + F.col("b")) - 1e-9)
    probe = rarest.crossJoin(F.broadcast(sizes)).select("name", "w", "b", F.explode(F.slice("rare", F.lit(1), F.greatest(F.lit(0), F.size("w") - need + 1).cast("int"))).alias("word"))  # few sizes
    index = have.select("slug", F.col("w").alias("v"), F.size("w").alias("b"), F.explode("w").alias("word"))
    shared = probe.join(index, ["word", "b"]).select("name", "slug", "w", "v").dropDuplicates(["name", "slug"])
    overlap = shared.select("name", "slug", (F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v"))).alias("j")).where(F.col("j") >= RESOLVE_JACCARD)
    order = Window.partitionBy("name").orderBy(F.desc("j"), "slug")
    fuzzy = overlap.withColumn("r", F.row_number().over(order)).where("r = 1").select("name", F.col("slug").alias("fuzzy"))
    out = tiers.join(fuzzy, "name", "left")
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_title").isNotNull(), "title").when(F.col("by_case").isNotNull(), "case").when(F.col("fuzzy").isNotNull(), "overlap").otherwise("none")
    return out.where("n != ''").select("name", F.coalesce("exact", "by_title", "by_case", "fuzzy").alias("slug"), tier.alias("tier"))


def links(mem: DataFrame, text: str = "body") -> DataFrame:
    """src, pos (from 1), dst: the [[links]] of each memory, in order."""
    return mem.select(F.col("slug").alias("src"), F.posexplode(links_of(F.col(text))).alias("p", "dst")).select("src", (F.col("p") + 1).alias("pos"), "dst")


def walk(picked: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """q, slug, depth: breadth first from picked (q, slug), hops times; each memory at its first depth.

    edges: src, dst (resolved). The number of joins is the number of hops, and each level leaves out what was seen.
    """
    seen = picked.select("q", "slug").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, max(0, hops) + 1):
        nxt = frontier.join(edges.select(F.col("src").alias("slug"), "dst"), "slug").select("q", F.col("dst").alias("slug")).distinct()
        frontier = nxt.join(seen.select("q", "slug"), ["q", "slug"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(frontier)
    return seen


def dead_links(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """src, dst of links whose target is no memory."""
    return edges.join(slugs.select(F.col("slug").alias("dst")), "dst", "left_anti").select("src", "dst")


def live_links(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    return edges.join(slugs.select(F.col("slug").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def islands(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """Memories without a live link in or out (a link to itself is one)."""
    live = live_links(edges, slugs)
    ends = live.select(F.col("src").alias("slug")).union(live.select("dst"))
    return slugs.select("slug").join(ends, "slug", "left_anti")


def hubs(edges: DataFrame, slugs: DataFrame, top: int = 5) -> DataFrame:
    """slug, links_in: the memories that most others link to, then by descending slug."""
    return live_links(edges, slugs).groupBy(F.col("dst").alias("slug")).agg(F.countDistinct("src").alias("links_in")).orderBy(F.desc("links_in"), F.desc("slug")).limit(top)


def titles(entries: DataFrame) -> DataFrame:
    """line_no, pos, title, slug of every link of the index lines (line_no, line)."""
    pair = lambda i: F.regexp_extract_all("line", F.lit(r"\[([^\]]+)\]\(([^)]+)\.md\)"), F.lit(i))
    both = F.posexplode(F.arrays_zip(pair(1).alias("title"), pair(2).alias("slug"))).alias("pos", "x")
    return entries.select("line_no", both).select("line_no", "pos", F.trim("x.title").alias("title"), F.trim("x.slug").alias("slug"))


def first_titles(entries: DataFrame) -> DataFrame:
    """title (lower case), slug: the first link of each title."""
    t = titles(entries).select(F.lower("title").alias("title"), F.struct("line_no", "pos", "slug").alias("s"))
    return t.groupBy("title").agg(F.min("s").alias("s")).select("title", "s.slug")


def index_drift(entries: DataFrame, slugs: DataFrame) -> DataFrame:
    """slug, problem: 'not in index', or 'orphan' for an index link to no memory."""
    named = titles(entries).select("slug").distinct()
    missing = slugs.select("slug").join(named, "slug", "left_anti").withColumn("problem", F.lit("not in index"))
    return missing.union(named.join(slugs.select("slug"), "slug", "left_anti").withColumn("problem", F.lit("orphan")))


def sectors(lines: DataFrame, slugs: DataFrame, examples: int = 3) -> DataFrame:
    """sector, first_line, n, titles: each memory in the sector of the nearest '## ' heading above the first line that names it.

    lines: line_no, line, without comments. Memories that no line names, or before any heading, are UNSECTIONED (last, first_line null).
    """
    up = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # an index is one resident file
    heading = F.nullif(F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1), F.lit(""))
    placed = lines.select("line_no", "line", heading.alias("h")).withColumn("sector", F.last("h", ignorenulls=True).over(up))
    named = titles(placed.where("h is null")).join(placed.select("line_no", "sector"), "line_no").join(slugs.select("slug"), "slug", "left_semi")
    first = Window.partitionBy("slug").orderBy("line_no", "pos")
    named = named.withColumn("r", F.row_number().over(first)).where("r = 1")
    every = slugs.select("slug").join(named, "slug", "left").select("slug", F.coalesce("sector", F.lit("UNSECTIONED")).alias("sector"), "line_no", "pos", "title")
    within = Window.partitionBy("sector").orderBy(F.col("line_no").asc_nulls_last(), "pos", "slug")
    shown = F.when((F.row_number().over(within) <= examples) & F.col("title").isNotNull(), F.struct("line_no", "pos", "title"))
    counted = every.withColumn("t", shown).groupBy("sector").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["title"]), " / ").alias("titles"))
    heads = placed.where("h is not null").groupBy("h").agg(F.min("line_no").alias("first_line"))
    out = heads.join(counted, heads["h"] == counted["sector"], "full_outer")
    return out.select(F.coalesce("sector", "h").alias("sector"), "first_line", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("titles", F.lit("")).alias("titles"))
