"""Append-only logs that many writers share: reads, metrics, tossed drafts, seeds.

An append is a folder of its own, written first and then published by a file that must not be there; writers need no lock and a writer that is lost leaves nothing that is read. Appends that come again with the name of one that
was published change nothing. compact() makes one folder of all under the store's lock and publishes which entries it stands for; those are deleted by the next compaction, so that who reads them meanwhile can finish.

A row's place is (at, entry, row): by time, then by entry. Lines of text logs that are no JSON objects are passed over and counted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.sources.writer import StoreTable

#: Characters of a seed, of the part that names it, of a confirmation; how many open ones are listed.
SEED, NAMED, HOW, OPEN = 300, 60, 300, 30


class LogTable:
    """A log of rows (schema; 'at' is one of its columns) under a store's path."""

    def __init__(self, spark: SparkSession, path: str, name: str, schema: str):
        self.files = StoreTable(spark, f"{path.rstrip('/')}/logs/{name}")
        self.spark, self.schema = spark, schema

    def append(self, rows: DataFrame, name: str | None = None) -> bool:
        """Add rows; False if an append of that name was there."""
        name = name or uuid.uuid4().hex
        if self.files._fs.exists(self.files._p(f"entries/{name}")):
            return False
        folder = f"e-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in self.schema.split(", ")]
        placed = rows.select(*columns).withColumn("entry", F.lit(name)).withColumn("row", F.monotonically_increasing_id())
        placed.write.parquet(f"{self.files.path}/{folder}")
        self.files._step("data")
        if self.files._made(f"entries/{name}", folder):
            return True
        self.files._fs.delete(self.files._p(folder), True)
        return False

    def _state(self) -> tuple[dict, dict[str, str]]:
        """The last compaction, and the folders of the entries that it does not hold."""
        numbers = [n for n in self.files._names("compactions") if n.endswith(".json")]
        last = {"folder": None, "entries": [], "number": 0}
        for n in reversed(numbers):
            try:
                last = json.loads(self.files._text(f"compactions/{n}") or "") | {"number": int(n[:-5])}
                break
            except ValueError:
                continue  # one that was begun
        held = set(last["entries"])
        return last, {n: self.files._text(f"entries/{n}") for n in self.files._names("entries") if n not in held}

    def read(self) -> DataFrame:
        """All rows, with entry and row."""
        last, entries = self._state()
        folders = [f for f in [last["folder"], *entries.values()] if f]
        schema = f"{self.schema}, entry string, row bigint"
        return self.spark.read.schema(schema).parquet(*[f"{self.files.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def compact(self) -> int:
        """Make one folder of all entries. How many entries it took in."""
        with self.files.locked():
            last, entries = self._state()
            if not entries:
                return 0
            folder = f"c-{uuid.uuid4().hex}"
            self.read().write.parquet(f"{self.files.path}/{folder}")
            self.files._step("compacted")
            numbers = [n for n in self.files._names("compactions") if n.endswith(".json")]
            number = int(numbers[-1][:-5]) + 1 if numbers else 1
            if not self.files._made(f"compactions/{number:012d}.json", json.dumps({"folder": folder, "entries": [*last["entries"], *entries], "old": [f for f in [last["folder"], *entries.values()] if f]})):
                raise RuntimeError("another writer compacted the log without its lock")
            for f in last.get("old") or []:
                self.files._fs.delete(self.files._p(f), True)
            return len(entries)


def parsed(lines: DataFrame, schema: str, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(the rows of a text log's good lines, one row: bad, how many lines were no JSON objects)."""
    v = F.try_parse_json(line)
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rows = lines.where(good).select(F.from_json(line, schema).alias("r")).select("r.*")
    return rows, lines.agg(F.count_if(~good).alias("bad"))


# Seeds


def sown(text: Column, who: Column, topic: Column, at: Column) -> list[Column]:
    """The columns of a seed's row in the log."""
    return [F.lit("IDEA").alias("kind"), F.substring(text, 1, SEED).alias("text"), who.alias("who"), topic.alias("topic"), at.alias("at"), F.lit(None).cast("string").alias("how"), F.lit(None).cast("string").alias("memory")]


def confirmation(text: Column, how: Column, memory: Column, at: Column) -> list[Column]:
    """The columns of a confirmation's row in the log."""
    return [F.lit("CONFIRM").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("string").alias("topic"), at.alias("at"), F.substring(how, 1, HOW).alias("how"), memory.alias("memory")]


SEEDS = "kind string, text string, who string, topic string, at timestamp, how string, memory string"


def seeds(log: DataFrame) -> DataFrame:
    """text, who, topic, at, how, memory of every seed in the log, with seed (its number among those of its name): each confirmation meets the first seed of its name that is still open.

    A name is the first NAMED characters. So in the log's order, of each name, the k-th confirmation that comes while a seed is open meets the k-th seed.
    """
    place = Window.partitionBy("name").orderBy("at", "entry", "row")
    rows = log.withColumn("name", F.substring(F.coalesce("text", F.lit("")), 1, NAMED)).withColumn("up", F.when(F.col("kind") == "IDEA", 1).otherwise(-1))
    # Open seeds never fall below none: what falls below was a confirmation without a seed. The level is the sum less the lowest sum so far.
    summed = rows.withColumn("sum", F.sum("up").over(place)).withColumn("n_seed", F.sum(F.when(F.col("up") == 1, 1).otherwise(0)).over(place))
    lowest = F.least(F.lit(0), F.min("sum").over(place))
    before = F.least(F.lit(0), F.coalesce(F.min("sum").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = summed.withColumn("met", (F.col("up") == -1) & (lowest == before))
    placed = placed.withColumn("n_met", F.sum(F.col("met").cast("int")).over(place))
    ideas = placed.where("up = 1").select("name", F.col("n_seed").alias("seed"), "text", "who", "topic", "at", "entry", "row")
    told = placed.where("met").select("name", F.col("n_met").alias("seed"), "how", "memory")
    return ideas.join(told, ["name", "seed"], "left").select("seed", "text", "who", "topic", "at", "how", "memory", "entry", "row")


def open_seeds(log: DataFrame, last: int = OPEN) -> DataFrame:
    """text, who, topic, at of the last open seeds."""
    found = seeds(log).where("how is null")
    return found.orderBy(F.desc("at"), F.desc("entry"), F.desc("row")).limit(last).select("text", "who", "topic", "at")
