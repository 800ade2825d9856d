"""Intake: classed segments from journals, validation of evidence lines, stops and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.fixed import BATCH_CHARS, BATCH_LEAST, CLASS_CHARS, CLASSES, ID_CHARS, LINE_BYTES, SEGMENT_CHARS, TIME_CHARS, TOOL_CHARS
from attesta.functions.text import rfc3339


def stop_after_crossing(segments: DataFrame, limit: int = BATCH_CHARS, key: str = "key", order: str = "pos", text: str = "text") -> DataFrame:
    """The rows read in one sip: all before the kept characters reach the limit, and the row that crosses it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return segments.withColumn("had", had).where(F.col("had") < limit).drop("had")


def batches(segments: DataFrame, limit: int = BATCH_CHARS, key: str = "key", order: str = "pos", text: str = "text") -> DataFrame:
    """segments with sip: the number of the stretch of about limit characters that a row falls into."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return segments.withColumn("sip", F.floor(had / limit).cast("long"))


def claims(journals: DataFrame, marks: DataFrame, budget: int = BATCH_CHARS, least: int = BATCH_LEAST) -> DataFrame:
    """key, start, end: of each journal the next stretch to reserve; those shorter than least characters wait.

    journals: key, pos, size. marks: key, pos (read up to). The reserve is the window that a sip of the same budget reads.
    """
    ahead = journals.join(marks.select("key", F.col("pos").alias("mark")), "key", "left").where(F.col("pos") > F.coalesce("mark", F.lit(-1)))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    run = ahead.withColumn("had", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("had") < budget)
    stretch = run.groupBy("key").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("size").alias("approx"))
    return stretch.where(F.col("approx") >= least)


def advanced(marks: DataFrame, moves: DataFrame) -> DataFrame:
    """key, pos: marks move forward only."""
    return marks.select("key", "pos").union(moves.select("key", "pos")).groupBy("key").agg(F.max("pos").alias("pos"))


def _get(field: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{field}", kind)


def _kind(field: str) -> Column:
    """The JSON type of a field: null if absent; numbers by size, BOOLEAN, STRING."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))


def validated(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with reason (null for a good line), cls and text of good ones.

    The checks run in a fixed order and the first failure names the reason. Types are tested before values: a JSON true is no version 1.
    """
    rows = lines.withColumn("v", F.try_parse_json(line))
    text_of = lambda f: _get(f, "string")
    absent = lambda f: _kind(f).isNull()
    string = lambda f: _kind(f) == "STRING"
    blank = lambda f: F.trim(F.regexp_replace(text_of(f), r"(?U)\s+", " ")) == ""
    cap = F.when(text_of("class") == "TOOL", TOOL_CHARS).otherwise(SEGMENT_CHARS)
    reason = (
        F.when(F.octet_length(line) > LINE_BYTES, "oversized")
        .when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "malformed")
        .when(absent("schema_version"), "missing")
        .when(~_kind("schema_version").isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (_get("schema_version", "long") != 1), "unknown_version")
        .when(absent("class"), "missing")
        .when(~string("class"), "unknown_class")
        .when(F.length(text_of("class")) > CLASS_CHARS, "oversized")
        .when(~text_of("class").isin(*CLASSES), "unknown_class")
    )
    for f in ("event_id", "session_id", "turn_id"):
        reason = reason.when(absent(f), "missing").when(~string(f), "invalid").when(blank(f), "blank").when(F.length(text_of(f)) > ID_CHARS, "oversized")
    reason = reason.when(absent("text"), "missing").when(~string("text"), "invalid").when(blank("text"), "blank").when(F.length(text_of("text")) > cap, "oversized")
    time = text_of("timestamp")
    reason = reason.when(absent("timestamp"), "missing").when(~string("timestamp"), "invalid").when(blank("timestamp"), "blank").when(F.length(time) > TIME_CHARS, "oversized").when(rfc3339(time).isNull(), "invalid")
    out = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.select(*lines.columns, "reason", F.when(good, text_of("class")).alias("cls"), F.when(good, F.trim(text_of("text"))).alias("text"), F.when(good, rfc3339(time)).alias("at"))


def skips(judged: DataFrame, samples: int = 16) -> DataFrame:
    """reason, n, samples: how often each reason was given, with the first lines of each (by line_no)."""
    bad = judged.where("reason is not null")
    order = Window.partitionBy("reason").orderBy("line_no")
    kept = F.when(F.row_number().over(order) <= samples, F.col("line_no"))
    return bad.withColumn("s", kept).groupBy("reason").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("samples"))


_PART = "struct<type:string,text:string,name:string,input:string,content:string>"


def transcript(lines: DataFrame, line: str = "line") -> DataFrame:
    """key, pos, part, cls, text of a chat transcript (key, pos, line of JSON): user text is USER (SELF in a side chain), tool results TOOL, assistant text SELF, tool use ACT."""
    event = F.from_json(line, "struct<type:string,isSidechain:boolean,message:struct<content:string>>")
    rows = lines.select("key", "pos", event.alias("e")).select("key", "pos", F.col("e.type").alias("type"), F.coalesce("e.isSidechain", F.lit(False)).alias("side"), F.col("e.message.content").alias("c"))
    parts = F.from_json("c", f"array<{_PART}>", {"mode": "PERMISSIVE"})
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("c").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("content")))
    each = rows.where("c is not null").select("key", "pos", "type", "side", F.posexplode(F.when(F.ltrim("c").startswith("["), F.coalesce(parts, plain)).otherwise(plain)).alias("part", "p"))
    inner = F.from_json("p.content", "array<struct<text:string>>")
    result = F.when(F.ltrim("p.content").startswith("["), F.array_join(F.transform(inner, lambda x: F.coalesce(x["text"], F.lit(""))), " ")).otherwise(F.col("p.content"))
    tool = F.col("p.type") == "tool_result"
    cls = F.when((F.col("type") == "user") & tool, "TOOL").when(F.col("type") == "user", F.when(F.col("side"), "SELF").otherwise("USER")).when((F.col("type") == "assistant") & (F.col("p.type") == "text"), "SELF").when((F.col("type") == "assistant") & (F.col("p.type") == "tool_use"), "ACT")
    used = F.concat("p.name", F.lit(" "), F.substring(F.coalesce("p.input", F.lit("{}")), 1, 600))
    text = F.when(cls == "ACT", used).otherwise(F.trim(F.when(tool, result).otherwise(F.col("p.text"))))
    out = each.select("key", "pos", "part", cls.alias("cls"), text.alias("text")).where("cls is not null and text != ''")
    noise = F.col("text").contains("system-reminder") | F.col("text").startswith("<local-command")
    cut = F.expr(f"substring(text, 1, case when cls = 'TOOL' then {TOOL_CHARS} else {SEGMENT_CHARS} end)")
    return out.where((F.col("cls") == "ACT") | ~noise).withColumn("text", F.when(F.col("cls") == "ACT", F.col("text")).otherwise(cut))


def archive(lines: DataFrame, start: int = -1, line: str = "line") -> DataFrame:
    """key, pos (sequence number), cls, text of a sequence archive: only text of the user's own messages is USER, only ended text blocks are SELF; the rest is dropped."""
    texts = "array<struct<type:string,text:string>>"
    data = f"struct<source:struct<kind:string>,content:{texts},chunk:struct<type:string,block:struct<type:string,text:string>>,name:string,arguments:string,message:struct<content:array<struct<type:string,content:{texts}>>>>"
    e = lines.select("key", F.from_json(line, f"struct<seq:bigint,type:string,data:{data}>").alias("e")).select("key", F.col("e.seq").alias("pos"), "e.type", "e.data").where(F.col("pos") > start)
    said = lambda c: F.transform(F.filter(c, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit("")))
    user = F.trim(F.array_join(said("data.content"), " "))
    injected = user.startswith("<system-reminder") | user.startswith("Current runtime context")
    tool = F.trim(F.array_join(F.flatten(F.transform(F.filter("data.message.content", lambda x: x["type"] == "tool-result"), lambda x: F.coalesce(said(x["content"]), F.array().cast("array<string>")))), "\n"))
    kind = F.col("type")
    cls = (
        F.when((kind == "user/message") & (F.col("data.source.kind") == "user") & ~injected, "USER")
        .when((kind == "assistant/chunk") & (F.col("data.chunk.type") == "block-end") & (F.col("data.chunk.block.type") == "text"), "SELF")
        .when(kind == "tool/call", "ACT")
        .when(kind == "tool/result", "TOOL")
    )
    act = F.concat(F.coalesce("data.name", F.lit("")), F.lit(" "), F.substring(F.coalesce("data.arguments", F.lit("")), 1, 600))
    text = F.when(cls == "USER", user).when(cls == "SELF", F.trim("data.chunk.block.text")).when(cls == "ACT", act).when(cls == "TOOL", tool)
    return e.select("key", "pos", cls.alias("cls"), text.alias("text")).where("cls is not null and text != ''")


def notes(files: DataFrame) -> DataFrame:
    """key, pos, cls, text: the paragraphs of plain text notes (key, content), as USER."""
    paras = files.select("key", F.posexplode(F.split("content", r"\n\s*\n")).alias("pos", "p"))
    return paras.select("key", F.col("pos").cast("long").alias("pos"), F.lit("USER").alias("cls"), F.substring(F.trim("p"), 1, SEGMENT_CHARS).alias("text")).where("text != ''")


def source_kind(path: Column) -> Column:
    """Which adapter reads a journal: the first that matches."""
    return F.when(path.endswith(".jsonl.zstd"), "archive").when(path.endswith(".evidence.jsonl"), "evidence").when(path.endswith(".jsonl"), "transcript").when(path.endswith(".txt") | path.endswith(".md"), "text")
