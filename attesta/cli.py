"""python -m attesta.cli CONFIG VERB [...]: read-only views of a store. Exit code 2 means nothing to do or nothing known."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import context, edges, maps, measure, names, recognise
from attesta.registry import ConfigError, Registry, StoreConfig
from attesta.ship import ship
from attesta.sources import store as files


def opened(spark: SparkSession, config: StoreConfig) -> tuple[DataFrame, DataFrame]:
    """(memories with title and hook from the index, index lines)."""
    mem, lines = files.memories(files.scan(spark, config.path)), files.index(spark, config.path)
    first = names.titles(lines).groupBy("slug").agg(F.min(F.struct("line_no", "pos", "title")).alias("t")).select("slug", "t.title")
    rows = mem.join(first, "slug", "left").join(files.hooks(lines), "slug", "left")
    text = lambda c, *rest: F.coalesce(c, *rest, F.lit("")).alias(c)
    return rows.select("slug", text("title", F.col("name"), F.col("slug")), text("description"), text("hook"), "type", "body", "mtime", "tags"), lines


def recall(spark: SparkSession, config: StoreConfig, question: str, hops: int = 1, top: int = 3, chars: int = 6000, total: int | None = None) -> dict:
    mem, lines = opened(spark, config)
    q = spark.createDataFrame([("q", question)], "q string, question string")
    looked = recognise.lookup(mem, q, top, config.gate)
    none = spark.createDataFrame([], "q string, slug string")
    picked = context.tiers(q, none, looked if config.fastpath else looked.limit(0), None, recognise.by_words(lines, q, top))
    links = names.links(mem)
    resolved = names.resolve(links.select(F.col("dst").alias("name")).distinct(), mem, names.first_titles(lines))
    live = links.join(resolved.withColumnRenamed("name", "dst"), "dst").where("slug is not null").select("src", F.col("slug").alias("dst"))
    walked = names.walk(picked.where("slug is not null").select("q", "slug"), live, hops).join(picked.select("q", "slug", "rank"), ["q", "slug"], "left")
    order = sorted(walked.collect(), key=lambda r: (r.depth, r.rank or 99, r.slug))  # one question's walk
    how = picked.first()["how"]
    if not order:
        return {"how": how, "included": [], "context": ""}
    ranked = spark.createDataFrame([("q", i, r.slug, question) for i, r in enumerate(order)], "q string, rank int, slug string, question string")
    done = context.assembled(ranked.join(mem.select("slug", "body"), "slug"), config.label or config.name, chars, total).first()
    return {"how": how, "included": list(done.included), "dropped_for_budget": list(done.left_out), "context": done.context}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="attesta")
    p.add_argument("config")
    p.add_argument("verb", choices=["stores", "recall", "glance", "doctor", "edges", "trail", "sectors", "weave", "prefill"])
    p.add_argument("words", nargs="*")
    p.add_argument("--store")
    a = p.parse_args(argv)
    try:
        reg = Registry.load(a.config)
        config = reg.store(a.store)
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if a.verb == "stores":
        print("\n".join(f"{s.name}\t{s.path}\t{s.write_policy}" for s in reg.stores.values()))
        return 0
    spark = SparkSession.builder.appName("attesta").getOrCreate()
    ship(spark)
    mem, lines = opened(spark, config)
    today = datetime.datetime.now(datetime.UTC).date()
    layered = maps.layers(mem, maps.ages(mem, today, when="mtime"), config.fresh_days)
    if a.verb == "recall":
        out = recall(spark, config, " ".join(a.words))
        print(json.dumps(out, ensure_ascii=False, indent=1))
        return 0 if out["included"] else 2
    if a.verb == "doctor":
        print(measure.doctor(mem, lines).toJSON().first())
        return 0
    if a.verb == "sectors":
        rows = [f"- {r.sector} — {r.n} memories" + (f" (e.g. {r.titles})" if r.titles else "") for r in names.sectors(lines, mem).orderBy(F.col("first_line").asc_nulls_last()).collect()]
    elif a.verb == "glance":
        resolved = names.resolve_exact(names.links(mem).select(F.col("dst").alias("name")).distinct(), mem)
        said = names.titles(lines).join(lines, "line_no").groupBy("slug").agg(F.min(F.struct("line_no", "line")).alias("l")).select("slug", F.regexp_replace("l.line", "^- ", "").alias("recognition"))
        rows = [r.text for r in maps.glance(mem.where(F.col("slug").isin(*a.words)), said, resolved).collect()]
    elif a.verb == "edges":
        named = names.links(mem).select(F.col("dst").alias("name")).distinct()
        held = spark.createDataFrame([], "slug string, classes array<string>")
        rows = [f"{r.source} {r.type} → {r.target}" for r in edges.derive(mem, names.resolve(named, mem, names.first_titles(lines)), held).where("outcome = 'edge'").orderBy("source", "target", "type").collect()]
    elif a.verb == "trail":
        first = names.titles(lines).join(lines, "line_no").groupBy("slug").agg(F.min(F.struct("line_no", "line")).alias("l")).select("slug", "l.*")
        rows = [r.line for r in maps.trail(layered, first).orderBy("n").collect()]
    else:
        part = lambda i: F.nullif(F.regexp_extract("line", r"^\s*-\s*\[([^\]]+)\]\(([^)]+)\.md\)\s+—\s+(.+)$", i), F.lit(""))
        n = F.size(F.regexp_extract_all("line", F.lit(r"\]\([^)]+\.md\)"), F.lit(0)))
        woven = maps.cloth(lines.select("line_no", "line", n.alias("links"), part(1).alias("title"), part(2).alias("slug"), part(3).alias("hook")), layered, config.trigger_tokens)
        if a.verb == "weave":
            rows = [r.woven for r in woven.orderBy("line_no").collect()]
        else:
            rows = [maps.prefill(woven.select("line_no", F.col("woven").alias("line")), config.name, config.label or config.name).first().text]
    print("\n".join(rows))
    return 0 if rows else 2


if __name__ == "__main__":
    sys.exit(main())
