"""Derived maps of a store (cloth, trail, edges, cue ledger), published only if the store is still the one that they were made from.

A map is built from one revision of the store. Its rows are written to a folder of their own; then, under the store's lock, the revision and a digest of the store's rows are compared with those
of the build, and only if both hold is a pointer made by an exclusive create. A build that lost the race writes nothing and leaves the map before it; the caller may build again. The pointer names the source (revision and digest), the
product's digest, the specification that shaped it, until when it holds, and carries an HMAC of all that. A reader gets the map only if every one of these still holds: else
it counts as absent, and one build heals it. An empty map takes the map away: what was true once is not true now. A map that equals the published one is not written again. KEPT pointers and their folders stay.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.writer import StoreTable

KEPT = 20


def digest(rows: DataFrame) -> str:
    """Of a table's rows as a set with counts: their number, and sums of two hashes of each row. Their order and files do not count."""
    columns = sorted(rows.columns)
    as_text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    halves = [F.conv(F.substring(F.sha2(as_text, 256), 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    one = rows.agg(F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(halves)]).first()
    said = json.dumps([columns, one.n, *[str((one[f"h{k}"] or 0) % (1 << 64)) for k in range(4)]])
    return hashlib.sha256(said.encode()).hexdigest()


@dataclass(frozen=True)
class Stamp:
    """What a map was made from."""

    revision: int
    source: str


class Derived:
    def __init__(self, table: StoreTable, name: str, key: bytes, spec: str = ""):
        self.table, self.name, self.key = table, name, key
        self.spec = hashlib.sha256(spec.encode()).hexdigest()

    # The record

    def _folder(self) -> str:
        return f"derived/{self.name}"

    def _mark(self, record: dict) -> str:
        said = json.dumps({k: record[k] for k in sorted(record) if k != "mark"}, separators=(",", ":"))
        return hmac.new(self.key, f"derived\n{self.name}\n{said}".encode(), hashlib.sha256).hexdigest()

    def _pointers(self) -> list[str]:
        return [n for n in self.table._names(self._folder()) if n.endswith(".json")]

    def record(self) -> dict | None:
        """The highest pointer that is whole, if its mark holds."""
        for name in reversed(self._pointers()):
            try:
                record = json.loads(self.table._text(f"{self._folder()}/{name}") or "")
            except ValueError:
                continue  # one that was begun
            good = isinstance(record, dict) and isinstance(record.get("mark"), str) and hmac.compare_digest(record["mark"], self._mark(record))
            return record if good else None
        return None

    # Building

    def source(self) -> tuple[DataFrame, Stamp]:
        """The store's rows now, and their stamp."""
        state = self.table.state()
        rows = self.table._rows(state)
        return rows, Stamp(state["revision"], digest(rows))

    def built(self, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Stamp]:
        rows, stamp = self.source()
        return build(rows), stamp

    def publish(self, rows: DataFrame, stamp: Stamp, valid_until: float | None = None) -> str:
        """'written', 'unchanged', 'removed', or 'refused' (the store has moved)."""
        folder = f"{self._folder()}/d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.table.path}/{folder}")
        made = self.table.spark.read.schema(rows.schema).parquet(f"{self.table.path}/{folder}")
        product, empty = digest(made), made.isEmpty()
        kept = False
        try:
            with self.table.locked() as me:
                _, now = self.source()
                if now != stamp:
                    return "refused"
                record = {"folder": None if empty else folder, "product": product, "revision": stamp.revision, "source": stamp.source, "spec": self.spec, "valid_until": valid_until}
                old = self.record()
                if old and {k: old[k] for k in record if k != "folder"} == {k: v for k, v in record.items() if k != "folder"} and self.is_sound(old):
                    return "unchanged"
                numbers = self._pointers()
                n = int(numbers[-1][:-5]) + 1 if numbers else 1
                self.table._step("derived")
                if self.table._text("LOCK") != me:
                    return "refused"
                kept = self.table._made(f"{self._folder()}/{n:012d}.json", json.dumps(record | {"mark": self._mark(record)})) and not empty
                self._forget()
                return "removed" if empty else "written"
        finally:
            if not kept:
                self.table._fs.delete(self.table._p(folder), True)

    def _forget(self) -> None:
        """Delete all but the last KEPT pointers, and the folders that none of these names."""
        pointers = self._pointers()
        named = set()
        for name in pointers[-KEPT:]:
            try:
                named.add(json.loads(self.table._text(f"{self._folder()}/{name}") or "")["folder"])
            except (ValueError, KeyError, TypeError):
                continue
        for name in pointers[:-KEPT]:
            try:
                old = json.loads(self.table._text(f"{self._folder()}/{name}") or "")["folder"]
            except (ValueError, KeyError, TypeError):
                old = None
            if old and old not in named:
                self.table._fs.delete(self.table._p(old), True)
            self.table._fs.delete(self.table._p(f"{self._folder()}/{name}"), False)

    # Reading

    def _rows(self, record: dict) -> DataFrame | None:
        if not record["folder"] or not self.table._fs.exists(self.table._p(record["folder"])):
            return None
        return self.table.spark.read.parquet(f"{self.table.path}/{record['folder']}")

    def is_sound(self, record: dict) -> bool:
        """Are the published rows those that were written?"""
        rows = self._rows(record)
        return rows is None and record["folder"] is None or rows is not None and digest(rows) == record["product"]

    def read(self, now: float | None = None) -> DataFrame | None:
        """The map, or None if it is absent, removed, or cannot be proven to be the product of the store as it is."""
        record = self.record()
        if record is None or record["spec"] != self.spec or record["valid_until"] is not None and (time.time() if now is None else now) > record["valid_until"]:
            return None
        _, stamp = self.source()
        if (record["revision"], record["source"]) != (stamp.revision, stamp.source) or not self.is_sound(record):
            return None
        return self._rows(record)

    def is_stale(self, now: float | None = None) -> bool:
        return self.read(now) is None

    def fresh(self, build: Callable[[DataFrame], DataFrame], valid_until: float | None = None, tries: int = 3) -> DataFrame:
        """The map; built and published first if it is stale. A build that loses the race is made again, at most tries times, and then given unpublished."""
        for _ in range(tries):
            held = self.read()
            if held is not None:
                return held
            rows, stamp = self.built(build)
            if self.publish(rows, stamp, valid_until) != "refused":
                return self.read() if self.read() is not None else rows
        return rows
