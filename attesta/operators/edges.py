"""Typed edges between memories, from cue words on the lines that link them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.fixed import BLOCKED, CONTINUES, EDGE_TYPES, NEXT_START, REJECTED, SUPERSEDES
from attesta.functions.text import cue_hit, cue_position, links_of


def line_edges(mem: DataFrame) -> DataFrame:
    """source, line_no, pos, name, type, cue: candidate edges of each line; the most specific cue of a line decides its type."""
    surface = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("description", "body") if c in mem.columns])
    lines = mem.select(F.col("slug").alias("source"), F.posexplode(F.split(surface, "\n")).alias("line_no", "line"))
    start = F.ltrim("line")
    nxt = F.coalesce(*[F.when(start.startswith(p), F.lit(p)) for p in NEXT_START])
    cue = {"supersedes": cue_hit(SUPERSEDES, "line"), "rejected": cue_hit(REJECTED, "line"), "blocked-by": cue_hit(BLOCKED, "line"), "next": nxt, "continues": cue_hit(CONTINUES, "line")}
    kind = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in cue.items()])
    typed = lines.select("source", "line_no", "line", kind.alias("type"), F.coalesce(*cue.values()).alias("cue")).where("type is not null")
    linked = typed.select("source", "line_no", F.posexplode(links_of(F.col("line"))).alias("pos", "name"), "type", "cue")
    # 'word (→ name)': a bare name behind the retirement word.
    bare = F.regexp_extract_all(F.substring(F.col("line"), cue_position(SUPERSEDES, "line") + 1, F.length("line")), F.lit(r"\((?:→|->)\s*([^()\n]{1,60}?)\)"), F.lit(1))
    arrows = typed.where("type = 'supersedes'").select("source", "line_no", F.posexplode(bare).alias("pos", "name"), "type", "cue")
    return linked.union(arrows.withColumn("pos", F.col("pos") + 1000))


def derive(mem: DataFrame, resolved: DataFrame, classes: DataFrame) -> DataFrame:
    """Every candidate edge with its fate: source, target, type, cue, evidence, outcome ('edge', 'unknown-target', 'self', 'not-linked', 'unevidenced').

    resolved: name, slug. classes: slug, classes of its verified manifest (absent: none). Of equal edges the first line's stays.
    """
    names = resolved.select("name", F.col("slug").alias("target"))
    cands = line_edges(mem).join(names, "name", "left")
    hood = mem.select(F.col("slug").alias("source"), F.explode(F.array_distinct(links_of(F.col("body")))).alias("name")).join(names, "name").select("source", "target", F.lit(True).alias("linked")).distinct()
    cands = cands.join(hood, ["source", "target"], "left").join(classes.select(F.col("slug").alias("source"), "classes"), "source", "left")
    needs = F.col("type").isin("supersedes", "rejected", "blocked-by")
    held = F.coalesce("classes", F.array().cast("array<string>"))
    blocked = F.get(F.filter(F.array(F.lit("USER"), F.lit("TOOL"), F.lit("ACT")), lambda c: F.array_contains(held, c)), F.lit(0))
    evidence = F.when(F.col("type") == "blocked-by", blocked).when(needs & F.array_contains(held, "USER"), "USER")
    outcome = F.when(F.col("target").isNull(), "unknown-target").when(F.col("target") == F.col("source"), "self").when(F.col("linked").isNull(), "not-linked").when(needs & evidence.isNull(), "unevidenced").otherwise("edge")
    rows = cands.withColumn("evidence", evidence).withColumn("outcome", outcome)
    first = Window.partitionBy("source", "target", "type", "outcome").orderBy("line_no", "pos")
    rows = rows.withColumn("r", F.when(F.col("outcome") == "edge", F.row_number().over(first)).otherwise(1)).where("r = 1")
    return rows.select("source", F.coalesce("target", "name").alias("target"), "type", "cue", F.when(F.col("outcome") == "edge", F.col("evidence")).alias("evidence"), "outcome")


def of(edges: DataFrame) -> DataFrame:
    """slug, direction, type, other: each edge seen from both ends."""
    out = edges.select(F.col("source").alias("slug"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    return out.union(edges.select("target", F.lit("in"), "type", "source"))


def counts(derived: DataFrame) -> DataFrame:
    """type, n: edges of each of the five types, zeros kept."""
    n = derived.where("outcome = 'edge'").groupBy("type").agg(F.count("*").alias("n"))
    kinds = derived.sparkSession.createDataFrame([(t,) for t in EDGE_TYPES], "type string")
    return F.broadcast(kinds).join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
