"""Reading a store: a folder of Markdown memories with an index, as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import normalize_tags, uncommented

#: Files that live in a store and are no memories.
RESERVED = ("MEMORY.md", "charter.md", "README.md", "persona.json", "profile.md")
STUDY = "_study"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """slug, text, mtime, path of every memory: *.md in the root and in _study, without reserved and underscored names.

    Files whose real path leaves the root are no memories (see escaping); they are known only for local stores.
    """
    out = None
    for folder, prefix in ((root, ""), (f"{root}/{STUDY}", f"{STUDY}/")):
        if not _exists(spark, folder):
            continue
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", "_metadata.file_path", "_metadata.file_modification_time")
        name = F.regexp_extract("file_path", "([^/]+)$", 1)
        rows = files.where(~name.isin(*RESERVED) & ~name.startswith("_"))
        rows = rows.select(F.concat(F.lit(prefix), F.regexp_replace(name, r"\.md$", "")).alias("slug"), F.col("value").alias("text"), F.col("file_modification_time").alias("mtime"), F.col("file_path").alias("path"))
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "slug string, text string, mtime timestamp, path string")
    gone = [n for n, _ in _outside(root)]
    return out.where(~F.col("slug").isin(*gone)) if gone else out


def _listed(root: str) -> list[tuple[str, str]]:
    out = []
    for folder, prefix in ((root, ""), (os.path.join(root, STUDY), f"{STUDY}/")):
        if os.path.isdir(folder):
            out += [(prefix + n[:-3], os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(".md") and n not in RESERVED and not n.startswith("_")]
    return out


def _outside(root: str) -> list[tuple[str, str]]:
    real = os.path.realpath(root)
    return [(s, p) for s, p in _listed(root) if os.path.commonpath([real, os.path.realpath(p)]) != real]


def escaping(spark: SparkSession, root: str) -> DataFrame:
    """slug of files that look like memories and resolve outside the store."""
    return spark.createDataFrame([(s,) for s, _ in _outside(root)], "slug string")


def hardlinked(spark: SparkSession, root: str) -> DataFrame:
    """slug of memories with a second name elsewhere; they are reported, not left out."""
    return spark.createDataFrame([(s,) for s, p in _listed(root) if os.path.exists(p) and os.stat(p).st_nlink > 1], "slug string")


def split(text: Column) -> tuple[Column, Column]:
    """(front matter, body): the front matter is what stands between a first --- and the next line that starts with ---."""
    end = F.locate("\n---", text, 4)
    has = text.startswith("---") & (end > 0)
    return F.when(has, F.substring(text, F.lit(4), end - 4)).otherwise(""), F.when(has, F.ltrim(F.substring(text, end + 4, F.length(text)), F.lit("\n"))).otherwise(text)


def front_matter(front: Column) -> Column:
    """A map of 'key: value' lines; the first of a key wins, the metadata container is no value, quotes at the ends go."""
    line = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*(\S.*)$"
    keys, values = (F.regexp_extract_all(front, F.lit(line), F.lit(i)) for i in (1, 2))
    value = lambda v: F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", "")
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), value(v).alias("v")))
    firsts = F.filter(pairs, lambda p, i: (F.array_position(keys, p["k"]) == i + 1) & (p["k"] != "metadata"))
    return F.map_from_entries(firsts)


def memories(files: DataFrame) -> DataFrame:
    """slug, name, description, type, front (map), tags (null if they can't be read), body, text, mtime."""
    front, body = split(F.col("text"))
    rows = files.select("slug", "text", "mtime", front_matter(front).alias("front"), body.alias("body"))
    return rows.select("slug", F.col("front.name").alias("name"), F.col("front.description").alias("description"), F.col("front.type").alias("type"), "front", normalize_tags(F.col("front.tags"), strict=False).alias("tags"), "body", "text", "mtime")


def index(spark: SparkSession, root: str) -> DataFrame:
    """line_no, line of the index, without comments."""
    path = f"{root}/MEMORY.md"
    if not _exists(spark, path):
        return spark.createDataFrame([], "line_no int, line string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(uncommented("value"), "\n")).alias("line_no", "line"))


def hooks(entries: DataFrame) -> DataFrame:
    """slug, hook: all prose of the lines that name a memory, links replaced by their titles, in line order."""
    prose = F.regexp_replace(F.trim(F.regexp_replace("line", r"\[([^\]]+)\]\(([^)]+)\.md\)", "$1")), r"^[-•\s]+", "")
    named = entries.select("line_no", prose.alias("prose"), F.explode(F.regexp_extract_all("line", F.lit(r"\]\(([^)]+)\.md\)"), F.lit(1))).alias("slug"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "prose"))), lambda x: x["prose"])
    return named.groupBy(F.trim("slug").alias("slug")).agg(F.trim(F.array_join(lines, " ")).alias("hook"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """digest, manifest of evidence files whose name is the SHA-256 of their bytes; others are absent."""
    folder = f"{root}/_evidence"
    if not _exists(spark, folder):
        return spark.createDataFrame([], "digest string, manifest string")
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"/([0-9a-f]{64})\.json$", 1).alias("digest"), "content")
    return files.where(F.sha2("content", 256) == F.col("digest")).select("digest", F.decode("content", "utf-8").alias("manifest"))


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log (reads, seeds, metrics, intake); lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark cases: a JSON array, or an object with 'cases'."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    whole = F.from_json("t", f"struct<cases:array<struct<{schema}>>>")["cases"]
    return text.select(F.explode(F.when(F.ltrim("t").startswith("["), F.from_json("t", f"array<struct<{schema}>>")).otherwise(whole)).alias("c")).select("c.*")


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """path, envelope (map of the comment's 'key: value' lines), body of staged drafts."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))
    comment = F.regexp_extract("value", r"(?s)^<!--(.*?)-->", 1)
    return files.select("path", front_matter(comment).alias("envelope"), F.ltrim(F.regexp_replace("value", r"(?s)^<!--.*?-->\s*", "")).alias("body"))
