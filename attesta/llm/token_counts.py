"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A batch holds changes of documents: op 'insert' (n_tokens), 'delete' (n_tokens as counted before) or
'revise' (old_tokens, n_tokens). Each becomes signed numbers of documents and tokens; a batch is
summed by key, partially on each task first, so that a hot source is one row a task in the shuffle.
Totals are sums of batches, so batches commute and may be merged at any time.

A commit writes the batch's sums to a folder named by its batch id. Spark adds the _SUCCESS mark last: a batch with the
mark is never applied again, and one without it (a lost driver) is written anew. Totals read marked batches only.
compact() folds batches into a snapshot that lists them, under the same rule.

Nulls: a null source, language or version is a key of its own; a null op or an unknown one, and null counts, change
nothing. Rows repeated within a batch count each time; extra columns are not read; an empty batch commits no rows.
"""

from __future__ import annotations

import json
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.tokens import encoder

KEYS = ["source", "lang", "version"]
_SUMS = "source string, lang string, version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizer: str, version: str, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens of the whole text and the tokenizer's version."""
    rest = [c for c in docs.columns if c != text and c not in ("n_tokens", "version")]

    def count(batches):
        model = encoder(tokenizer)
        for b in batches:
            texts = b.column(len(rest)).to_pylist()
            n: list[int] = []
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars < 1 << 20):
                    chars += len(texts[stop] or "")
                    stop += 1
                n += [len(x) // model.width for x in model.encode([t or "" for t in texts[at:stop]])]
                at = stop
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*rest, "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    read = docs.select(*rest, text)
    schema = StructType([*[f for f in read.schema.fields if f.name != text], StructField("n_tokens", LongType())])
    return read.mapInArrow(count, schema).withColumn("version", F.lit(version))


def signed(changes: DataFrame) -> DataFrame:
    """Signed n_docs and n_tokens of each change."""
    n, old = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    op = F.lower("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old).otherwise(0).cast("long")
    return changes.select(*KEYS, docs.alias("n_docs"), tokens.alias("n_tokens"))


class TokenRollup:
    """A rollup kept under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[str]:
        top = self._Path(f"{self.path}/{kind}")
        if not self._fs.exists(top):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(top))
        return [n for n in names if self._fs.exists(self._Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """The newest snapshot and the batches that it holds."""
        names = [n for n in self._marked("snapshots") if n.isdigit()]
        if not names:
            return None, []
        held = self.spark.read.text(f"{self.path}/snapshots/{names[-1]}.batches").first()[0]
        return names[-1], json.loads(held)

    def committed(self) -> set[str]:
        return {unquote(n.removeprefix("b-")) for n in (*self._snapshot()[1], *self._marked("batches"))}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False where it has been applied before."""
        if batch_id in self.committed():
            return False
        name = "b-" + quote(batch_id, safe="")  # any text may be an id
        sums = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{name}")
        return True

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; keys whose documents are all gone stay out. batches: those to add to the snapshot, else all."""
        name, held = self._snapshot()
        batches = self._marked("batches") if batches is None else batches
        paths = [f"{self.path}/batches/{b}" for b in batches if b not in held]
        paths += [f"{self.path}/snapshots/{name}"] if name else []
        rows = self.spark.read.schema(_SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], _SUMS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot, then delete their folders."""
        last, old = self._snapshot()
        batches = self._marked("batches")  # one committed from now on is left to the next snapshot
        held = sorted({*old, *batches})
        name = f"{int(last or 0) + 1:08d}"
        totals = self.totals(batches)
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/snapshots/{name}.batches")
        totals.write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")
        for b in batches:
            self._fs.delete(self._Path(f"{self.path}/batches/{b}"), True)
