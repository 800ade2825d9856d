"""The engine's tables (memories, index, segments, candidates, questions, links) from the driver's tables.

Each adapter has a twin in SQL, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import squeeze
from attesta.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # Texts of a small file or two would all be one task's; a scan of more tasks than cores is left as it is.
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


MEM = """
mem AS (
    SELECT doc_id, 'doc-' || doc_id AS slug,
           regexp_extract(coalesce(text, ''), '^[^.\\n]*') AS title,
           split_part(coalesce(text, ''), chr(10), 1) AS hook,
           CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'feedback' WHEN 2 THEN 'project' ELSE 'reference' END AS type,
           source AS section, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day,
           coalesce(text, '') || chr(10) || 'Noted ' || CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS VARCHAR)
             || CASE WHEN doc_id % 25 <> 12 THEN ' [[doc-' || (7 * doc_id + 3) % n || ']]' ELSE '' END || CASE WHEN doc_id % 50 = 0 THEN ' [[doc-' || (n + doc_id) || ']]' ELSE '' END AS body
    FROM documents, (SELECT count(*) AS n FROM documents))"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slug, title (first sentence), hook (first line), type, section, day, body (text, a dated line, links to another but for ids of 12 modulo 25)."""
    docs = table(spark, sf_dir, "documents")
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    text = F.coalesce("text", F.lit(""))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("user", "feedback", "project", "reference"))), (F.col("doc_id") % 4 + 1).cast("int"))
    near = F.when(F.col("doc_id") % 25 != 12, F.concat(F.lit(" [[doc-"), (7 * F.col("doc_id") + 3) % F.col("n"), F.lit("]]"))).otherwise("")
    links = F.concat(near, F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(" [[doc-"), F.col("n") + F.col("doc_id"), F.lit("]]"))).otherwise(""))
    return docs.crossJoin(n).select(
        "doc_id",
        F.concat(F.lit("doc-"), "doc_id").alias("slug"),
        F.regexp_extract(text, r"^[^.\n]*", 0).alias("title"),
        F.substring_index(text, "\n", 1).alias("hook"),
        kind.alias("type"),
        F.col("source").alias("section"),
        day.alias("day"),
        F.concat(text, F.lit("\nNoted "), day.cast("string"), links).alias("body"),
    )


LINE = """
line AS (
    SELECT doc_id AS line_no, CASE
        WHEN doc_id % 10 = 1 THEN NULL
        WHEN doc_id % 10 = 0 AND next_slug IS NOT NULL THEN '- ' || section || ' — [' || title || '](' || slug || '.md)/[' || next_title || '](' || next_slug || '.md)'
        ELSE '- [' || title || '](' || slug || '.md) — ' || hook END AS line
    FROM (SELECT *, lead(slug) OVER (ORDER BY doc_id) AS next_slug, lead(title) OVER (ORDER BY doc_id) AS next_title FROM mem)),
entry AS (SELECT line_no, line FROM line WHERE line IS NOT NULL)"""


def index_lines(mem: DataFrame) -> DataFrame:
    """line_no, line: an entry line for each memory; ids divisible by ten share a grouped line with the next id."""
    nxt = mem.select((F.col("doc_id") - 1).alias("doc_id"), F.col("slug").alias("next_slug"), F.col("title").alias("next_title")).where("doc_id % 10 = 0")
    m = mem.where("doc_id % 10 != 1").join(nxt, "doc_id", "left")
    own = F.concat(F.lit("- ["), "title", F.lit("]("), "slug", F.lit(".md) — "), "hook")
    pair = F.concat(F.lit("- "), "section", F.lit(" — ["), "title", F.lit("]("), "slug", F.lit(".md)/["), "next_title", F.lit("]("), "next_slug", F.lit(".md)"))
    return m.select(F.col("doc_id").alias("line_no"), F.when((F.col("doc_id") % 10 == 0) & F.col("next_slug").isNotNull(), pair).otherwise(own).alias("line"))


QUESTION = """
question AS (
    SELECT 'b' || item_id AS q, text AS question FROM benchmark
    UNION ALL SELECT 'd' || doc_id, title FROM mem WHERE doc_id % 100 = 0)"""


def questions(spark: SparkSession, sf_dir: str, mem: DataFrame) -> DataFrame:
    """q, question: every benchmark item, and the title of every memory whose id is divisible by 100."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("q"), F.col("text").alias("question"))
    return items.union(mem.where("doc_id % 100 = 0").select(F.concat(F.lit("d"), "doc_id"), "title"))


SEGMENT = """
segment AS (
    SELECT 'conv-' || conv_id AS batch, turn AS pos, CASE role WHEN 'user' THEN 'USER' ELSE 'SELF' END AS cls, text
    FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL
    UNION ALL
    SELECT 'user-' || user_id, event_id, CASE event_type WHEN 'error' THEN 'TOOL' ELSE 'ACT' END, props
    FROM events WHERE props IS NOT NULL)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, pos, cls, text: conversation turns (system turns are injected, and dropped) and events."""
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant') and text is not null")
    turns = turns.select(F.concat(F.lit("conv-"), "conv_id").alias("batch"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "USER").otherwise("SELF").alias("cls"), "text")
    events = table(spark, sf_dir, "events").where("props is not null")
    return turns.union(events.select(F.concat(F.lit("user-"), "user_id"), "event_id", F.when(F.col("event_type") == "error", "TOOL").otherwise("ACT"), "props"))


CANDIDATE = """
candidate AS (
    SELECT 'conv-' || conv_id AS batch, conv_id * 1000 + turn AS cand,
           CASE turn % 5 WHEN 4 THEN 'idea' ELSE 'project' END AS kind,
           CASE turn % 2 WHEN 0 THEN 'the user decided' ELSE 'my judgement' END AS why,
           CASE WHEN turn % 3 = 2 THEN reverse(quote) ELSE quote END AS quote
    FROM (SELECT *, trim(regexp_replace(regexp_extract(coalesce(text, ''), '^[^.]*'), '\\s+', ' ', 'g')) AS quote
          FROM conversations WHERE role IN ('user', 'assistant')))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, cand, kind, why, quote: the first sentence of every turn; of every third turn it is fabricated (reversed)."""
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    quote = squeeze(F.regexp_extract(F.coalesce("text", F.lit("")), "^[^.]*", 0))
    return turns.select(
        F.concat(F.lit("conv-"), "conv_id").alias("batch"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("cand"),
        F.when(F.col("turn") % 5 == 4, "idea").otherwise("project").alias("kind"),
        F.when(F.col("turn") % 2 == 0, "the user decided").otherwise("my judgement").alias("why"),
        F.when(F.col("turn") % 3 == 2, F.reverse(quote)).otherwise(quote).alias("quote"),
    )


LINK = """
link AS (
    SELECT slug AS src, 1 AS pos, 'doc-' || (7 * doc_id + 3) % n AS dst FROM mem, (SELECT count(*) AS n FROM mem) WHERE doc_id % 25 <> 12
    UNION ALL
    SELECT slug, CASE WHEN doc_id % 25 <> 12 THEN 2 ELSE 1 END, 'doc-' || (n + doc_id) FROM mem, (SELECT count(*) AS n FROM mem) WHERE doc_id % 50 = 0)"""
