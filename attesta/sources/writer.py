"""Writing a store's table: revisions that appear whole or not at all.

A revision is a pointer file of its own, revisions/<number>.json, that names the folders of Parquet files it is made of. Data is written first, into a
folder that no other revision names; then the pointer is made by an exclusive create. The highest pointer that is whole is the store, so a writer that is
lost at any step leaves the revision before it in force, and no file of a revision is ever written over or deleted but by vacuum().

A revision adds a folder with the rows it changes; readers take each memory's row of the highest revision. After MERGE folders a revision
writes all rows into one. Batches that have been applied are known by a mark each, made after the pointer; the pointer names its batch too, so one that
comes again changes nothing even if its writer was lost before the mark.

One writer at a time holds the lock file, made by an exclusive create, and renews it; the lock of a writer that has not done so for LEASE seconds is taken away by
a rename, which one other writer wins.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slug string, title string, description string, hook string, type string, meta map<string,string>, tags array<string>, body string, revision bigint"
POLICIES = ("direct-allowed", "distiller-only", "frozen")
MERGE, LEASE = 16, 120.0


class Refused(PermissionError):
    """The store's write policy does not allow this."""


class LostLock(RuntimeError):
    """Another writer has taken the lock away."""


class StoreTable:
    def __init__(self, spark: SparkSession, path: str, policy: str = "direct-allowed", lease: float = LEASE):
        if policy not in POLICIES:
            raise ValueError(f"unknown write policy {policy}")
        self.spark, self.path, self.policy, self.lease = spark, path.rstrip("/"), policy, lease
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _p(self, name: str):
        return self._Path(f"{self.path}/{name}" if name else self.path)

    def _made(self, name: str, text: str) -> bool:
        """Make a file that must not be there; False if it is."""
        try:
            out = self._fs.create(self._p(name), False)
        except Exception:
            if self._fs.exists(self._p(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, name: str) -> str | None:
        try:
            stream = self._fs.open(self._p(name))
        except Exception:
            if self._fs.exists(self._p(name)):
                raise
            return None
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(folder))) if self._fs.exists(self._p(folder)) else []

    def _step(self, name: str) -> None:
        """Called between the steps of a write; tests lose the writer here."""

    # Reading

    def state(self) -> dict:
        """revision, folders, batch: of the highest pointer that is whole; and next, a number above all pointers."""
        numbers = [n for n in self._names("revisions") if n.endswith(".json")]
        for name in reversed(numbers):
            with contextlib.suppress(ValueError):
                return json.loads(self._text(f"revisions/{name}") or "") | {"next": int(numbers[-1][:-5]) + 1}
        return {"revision": 0, "folders": [], "batch": None, "next": int(numbers[-1][:-5]) + 1 if numbers else 1}

    def _rows(self, state: dict) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in state["folders"]]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        if len(folders) == 1:
            return rows
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        return rows.groupBy("slug").agg(F.max_by(F.struct(*columns), "revision").alias("r")).select("r.*")

    def read(self) -> DataFrame:
        return self._rows(self.state())

    # The lock

    def _taken_away(self) -> None:
        """Rename the lock of a writer that no longer renews it."""
        with contextlib.suppress(Exception):
            seen = self._fs.getFileStatus(self._p("LOCK")).getModificationTime()
            if time.time() - seen / 1000 > self.lease:
                away = f"LOCK.{uuid.uuid4().hex}"
                if self._fs.rename(self._p("LOCK"), self._p(away)):
                    self._fs.delete(self._p(away), False)

    @contextlib.contextmanager
    def locked(self, wait_s: float = 60):
        me, end, over = uuid.uuid4().hex, time.time() + wait_s, threading.Event()
        while not self._made("LOCK", me):
            if time.time() > end:
                raise TimeoutError(f"another writer holds {self.path}/LOCK")
            self._taken_away()
            time.sleep(0.05)

        def renew():
            while not over.wait(self.lease / 4):
                with contextlib.suppress(Exception):
                    if self._text("LOCK") == me:
                        self._fs.setTimes(self._p("LOCK"), int(time.time() * 1000), -1)

        threading.Thread(target=renew, daemon=True).start()
        try:
            yield me
        finally:
            over.set()
            if self._text("LOCK") == me:
                self._fs.delete(self._p("LOCK"), False)

    # Writing

    def _mark(self, batch: str) -> str:
        return f"batches/b-{quote(batch, safe='')}"

    def _applied(self, batch: str, state: dict) -> bool:
        if state["batch"] is not None and state["revision"]:
            self._made(self._mark(state["batch"]), str(state["revision"]))  # its writer may have been lost before the mark
        return self._fs.exists(self._p(self._mark(batch)))

    def _publish(self, me: str, rows: DataFrame, state: dict, batch: str | None, whole: bool) -> int:
        n = state["next"]
        folder = f"v{n}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._step("data")
        if self._text("LOCK") != me:
            raise LostLock(self.path)
        pointer = {"revision": n, "folders": [folder] if whole else [*state["folders"], folder], "batch": batch}
        if not self._made(f"revisions/{n:012d}.json", json.dumps(pointer)):
            raise LostLock(self.path)
        self._step("pointer")
        if batch is not None:
            self._made(self._mark(batch), str(n))
        self._step("mark")
        return n

    def _allowed(self, distilled: bool) -> None:
        if self.policy == "frozen" or self.policy == "distiller-only" and not distilled:
            raise Refused(f"the store is {self.policy}")

    def upsert(self, rows: DataFrame, batch: str | None = None, distilled: bool = False) -> int:
        """Write memories (slug and any other columns of SCHEMA but revision); new values win, metadata and tags are merged. The revision."""
        self._allowed(distilled)
        with self.locked() as me:
            state = self.state()
            if batch is not None and self._applied(batch, state):
                return state["revision"]
            new = rows.dropDuplicates(["slug"])
            old = self._rows(state)
            have = {c: F.col(f"n.{c}") for c in rows.columns}
            none = F.lit(None)
            pick = lambda c: F.coalesce(have.get(c, none), F.col(f"o.{c}"))
            both = new.alias("n").join(old.alias("o"), F.col("n.slug") == F.col("o.slug"), "left")
            empty, no_tags = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
            mine = F.coalesce(have.get("meta", none.cast("map<string,string>")), empty)
            kept = F.map_filter(F.coalesce("o.meta", empty), lambda k, v: ~F.array_contains(F.map_keys(mine), k))
            tags = F.array_sort(F.array_union(F.coalesce(have.get("tags", none.cast("array<string>")), no_tags), F.coalesce("o.tags", no_tags)))
            changed = both.select(*[pick(c).alias(c) for c in ("slug", "title", "description", "hook", "type")], F.map_concat(kept, mine).alias("meta"), tags.alias("tags"), pick("body").alias("body"), F.lit(state["next"]).cast("long").alias("revision"))
            whole = len(state["folders"]) >= MERGE
            if whole:
                changed = changed.union(old.join(new.select("slug"), "slug", "left_anti").select(changed.columns))
            return self._publish(me, changed, state, batch, whole)

    def annotate(self, marks: DataFrame, batch: str | None = None, distilled: bool = False) -> int:
        """Add tags and metadata to memories that exist (slug, tags, meta); nothing is written where nothing changes."""
        self._allowed(distilled)
        live = marks.join(self.read().select("slug"), "slug", "left_semi")
        old = self.read().select("slug", F.col("tags").alias("t"), F.col("meta").alias("m"))
        new = live.join(old, "slug").where((F.size(F.array_except("tags", "t")) > 0) | F.exists(F.map_entries("meta"), lambda e: ~F.coalesce(F.element_at("m", e["key"]) == e["value"], F.lit(False))))
        if new.isEmpty():
            return self.state()["revision"]
        return self.upsert(new.select("slug", "tags", "meta"), batch, distilled)

    def vacuum(self) -> int:
        """Delete folders that the current revision does not name, and pointers below it; readers of older revisions must be gone. How many."""
        with self.locked():
            state = self.state()
            old = [n for n in self._names("") if n.startswith("v") and n not in state["folders"]]
            old += [f"revisions/{n}" for n in self._names("revisions") if n < f"{state['revision']:012d}.json"]
            return sum(bool(self._fs.delete(self._p(n), True)) for n in old)
