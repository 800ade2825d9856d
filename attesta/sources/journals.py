"""Journals as a Python data source: whole lines with their byte offsets, for batches and for streams.

Files are found and read through pyarrow's file systems, so a pattern may be a local path or a URI (hdfs://, s3://). The driver looks at names, sizes and at a few bytes around
the places where a batch may end; lines are read by the executors, in ranges of RANGE bytes: a line belongs to the range in which it starts.

A stream's offset holds a cursor for each file: the byte up to which it has been read, digests of the file's first bytes and of those before the cursor, and a generation. Spark writes it to the query's
checkpoint before a batch runs. A file that is shorter than its cursor, or whose digests differ, was rewritten: its generation grows and it is read from the
start. A batch ends with the line that reaches its 'chars' bytes. A last line without its line feed stays until it is finished; a line longer than
LINE_BYTES is passed over and counted as an empty one with 'oversized'. The driver looks at most SCAN bytes ahead for the end of a batch's last line; if that is longer, the batch ends before it, and a batch that would begin with it is looked for on from there the next time.

Files ending in .zst or .zstd are archives of appended zstd frames, each of whole lines: their cursor is a byte of the compressed file at the end of a frame, and frames are decompressed as a stream. A line's
pos is its frame's byte times 2**24 plus its number in the frame.

Empty files and patterns without files give no rows. A range whose file was rewritten after its batch was planned gives one row with 'rewritten'; the next batch reads the file anew.
"""

from __future__ import annotations

import glob
import hashlib
import io
import json
import os
import re
from collections.abc import Iterator

import zstandard
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from attesta.functions.fixed import BATCH_CHARS, LINE_BYTES
from attesta.ship import ship

SCHEMA = "key string, pos bigint, next bigint, line string, skipped string, generation int"

#: Bytes of a task; bytes that the driver looks ahead for the end of a long line; bytes of a digest's input.
RANGE, SCAN, ANCHOR = 64 << 20, 320 << 10, 64
_FRAME, _SKIPPABLE = 0xFD2FB528, 0x184D2A50


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _open(path: str):
    system, name = _at(path)
    return system.open_input_file(name)


def archived(path: str) -> bool:
    return path.endswith((".zst", ".zstd"))


# Finding files


def _listed(pattern: str) -> list[tuple[str, int, float]]:
    """(path, size, modified) of the files that a glob matches; hidden ones only where it names them."""
    fixed = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    if fixed == pattern:
        system, name = _at(pattern)
        found = [system.get_file_info(name)]
        prefix = pattern[: len(pattern) - len(name)] if "://" in pattern else ""
    else:
        base = fixed.rsplit("/", 1)[0] if "/" in fixed else "."
        system, name = _at(base)
        prefix = base[: len(base) - len(name)] if "://" in base else ""
        rest = pattern[len(fixed.rsplit("/", 1)[0]) + 1 :] if "/" in fixed else pattern
        match = re.compile(glob.translate(rest, recursive=True)).match
        selector = pafs.FileSelector(name, allow_not_found=True, recursive="**" in rest or "/" in rest)
        found = [f for f in system.get_file_info(selector) if match(f.path[len(name.rstrip("/")) + 1 :])]
    return [(prefix + f.path, f.size, f.mtime_ns / 1e9) for f in found if f.type == pafs.FileType.File]


def _same(path: str) -> tuple:
    """What two names of one local file share."""
    if "://" in path:
        return (path,)
    s = os.stat(path)
    return (s.st_dev, s.st_ino)


def discover(pattern: str, exclude: str | None = None) -> list[str]:
    """Journals, newest first; files that exclude matches, or that are another name of one, are left out."""
    out = {_same(p) for p, _, _ in _listed(exclude)} if exclude else set()
    return [p for p, _, _ in sorted((f for f in _listed(pattern) if _same(f[0]) not in out), key=lambda f: (-f[2], f[0]))]


# Reading lines


def lines(path: str, start: int, end: int | None = None) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """(key, offset, next offset, line, reason for skipping) of the complete lines that start from start on and before end.

    The key is the whole path, since files in different folders may share a name.
    """
    key = path if "://" in path else os.path.abspath(path)
    with _open(path) as raw_file:
        if start:  # a line that starts before is another range's
            raw_file.seek(start - 1)
        f = io.BufferedReader(raw_file, 1 << 20)
        at = start - 1 if start else 0
        before = start > 0
        while end is None or at < end:
            line_start, size, raw = at, 0, b""
            while True:  # never more than a line's bound in memory
                piece = f.readline(LINE_BYTES)
                size += len(piece)
                raw = raw + piece if size <= LINE_BYTES else b""
                if not piece or piece.endswith(b"\n"):
                    break
            at += size
            if not piece.endswith(b"\n"):
                return
            if before:
                before = False
                continue
            yield (key, line_start, at, None, "oversized") if size > LINE_BYTES else (key, line_start, at, raw.rstrip(b"\r\n").decode("utf-8", "replace"), None)


def frame_end(f, at: int, size: int) -> int | None:
    """The byte after the zstd frame that starts at byte at of f; None if the file ends before. Only headers are read."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 8:
        return None
    magic = int.from_bytes(head[:4], "little")
    if magic & 0xFFFFFFF0 == _SKIPPABLE:
        end = at + 8 + int.from_bytes(head[4:8], "little")
        return end if end <= size else None
    if magic != _FRAME:
        raise ValueError(f"no zstd frame at byte {at}")
    try:
        checked = zstandard.get_frame_parameters(head).has_checksum
        at += zstandard.frame_header_size(head)
    except zstandard.ZstdError:
        return None
    while True:
        f.seek(at)
        block = f.read(3)
        if len(block) < 3:
            return None
        b = int.from_bytes(block, "little")
        at += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
        if b & 1:
            at += 4 if checked else 0
            return at if at <= size else None


class _Part(io.RawIOBase):
    """The next so many bytes of a file."""

    def __init__(self, f, left: int):
        self._file, self._left = f, left

    def readable(self):
        return True

    def readinto(self, into):
        got = self._file.read(min(len(into), self._left))
        into[: len(got)] = got
        self._left -= len(got)
        return len(got)


def archive_lines(path: str, start: int, end: int | None = None) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """The lines of the frames of an archive from byte start to byte end, as lines() gives them; next is the byte after the frame."""
    key = path if "://" in path else os.path.abspath(path)
    with _open(path) as f:
        size = f.size() if end is None else end
        at = start
        while at < size and (stop := frame_end(f, at, size)) is not None:
            f.seek(at)
            number, held, long = 0, b"", 0
            with zstandard.ZstdDecompressor().stream_reader(_Part(f, stop - at)) as plain:
                while piece := plain.read(1 << 16):
                    *whole, held_now = piece.split(b"\n")
                    for k, one in enumerate(whole):
                        line, count = (held + one, long + len(one)) if k == 0 else (one, len(one))
                        bad = count + 1 > LINE_BYTES
                        yield key, (at << 24) + number, stop, None if bad else line.rstrip(b"\r").decode("utf-8", "replace"), "oversized" if bad else None
                        number, held, long = number + 1, b"", 0
                    long += len(held_now)
                    held = held + held_now if long <= LINE_BYTES else b""
            if long:  # a frame ends a line
                bad = long > LINE_BYTES
                yield key, (at << 24) + number, stop, None if bad else held.rstrip(b"\r").decode("utf-8", "replace"), "oversized" if bad else None
            at = stop


# Cursors


def _digest(f, start: int, end: int) -> str:
    if end <= start:
        return ""
    f.seek(start)
    return hashlib.blake2b(f.read(end - start), digest_size=8).hexdigest()


def _cursor(path: str, at: int, generation: int) -> dict:
    with _open(path) as f:
        return {"at": at, "head": _digest(f, 0, min(ANCHOR, at)), "tail": _digest(f, max(0, at - ANCHOR), at), "generation": generation}


def unchanged(path: str, cursor: dict) -> bool:
    """Is the file still the one that the cursor was set in?"""
    at = cursor["at"]
    try:
        with _open(path) as f:
            return f.size() >= at and _digest(f, 0, min(ANCHOR, at)) == cursor["head"] and _digest(f, max(0, at - ANCHOR), at) == cursor["tail"]
    except FileNotFoundError:
        return False


def _last_line(f, start: int, end: int) -> int:
    """The byte after the last line feed of f between two bytes; start if there is none."""
    at = end
    while at > start:
        low = max(start, at - LINE_BYTES)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, cursor: dict | None = None):
        super().__init__(path)
        self.path, self.start, self.end, self.cursor = path, start, end, cursor


def _ranges(path: str, start: int, end: int, cursor: dict | None = None) -> list[_Range]:
    if archived(path):
        return [_Range(path, start, end, cursor)]
    return [_Range(path, at, min(at + RANGE, end), cursor) for at in range(start, end, RANGE)]


def _read(part: _Range):
    generation = part.cursor["generation"] if part.cursor else 0
    if part.cursor and not unchanged(part.path, part.cursor):
        yield (part.path, part.start, part.end, None, "rewritten", generation)
        return
    for row in (archive_lines if archived(part.path) else lines)(part.path, part.start, part.end):
        yield (*row, generation)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.pattern, self.exclude = options["path"], options.get("exclude")

    def partitions(self):
        # Never none: Spark would then read one that does not exist.
        return [r for p in discover(self.pattern, self.exclude) for r in _ranges(p, 0, _at(p)[0].get_file_info(_at(p)[1]).size)] or [_Range("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from _read(partition)


class _Stream(DataSourceStreamReader):
    """Reads about 'chars' bytes a batch, from files in the order of their names."""

    def __init__(self, options):
        self.pattern, self.exclude, self.most = options["path"], options.get("exclude"), int(options.get("chars", BATCH_CHARS))
        self.latest = str(options.get("startingOffsets", "earliest")) == "latest"
        self.start: dict | None = None  # where the last planned batch ends; Spark tells it at a restart, too
        self.ahead: dict[str, tuple[int, int]] = {}  # of unfinished long lines: where they start, how far they are known

    def initialOffset(self):
        return self._end({}, None) if self.latest else {}

    def latestOffset(self):
        if self.start is None:
            self.start = self.initialOffset()
        return self._end(self.start, self.most)

    def _end(self, start: dict, most: int | None) -> dict:
        """The cursors after the next batch of at most about most bytes; without a bound, after all whole lines."""
        end = dict(start)
        for path in sorted(discover(self.pattern, self.exclude)):
            if most is not None and most <= 0:
                break
            cursor = start.get(path) or {"at": 0, "head": "", "tail": "", "generation": 0}
            anew = not unchanged(path, cursor)
            at, generation = (0, cursor["generation"] + 1) if anew else (cursor["at"], cursor["generation"])
            stop = self._stop(path, at, most)
            if stop > at or anew:
                end[path] = _cursor(path, stop, generation)
                most = None if most is None else most - (stop - at)
        return end

    def _stop(self, path: str, at: int, most: int | None) -> int:
        with _open(path) as f:
            size = f.size()
            if archived(path):
                stop = at
                while (most is None or stop - at < most) and stop < size and (after := frame_end(f, stop, size)) is not None:
                    stop = after
                return stop
            if most is None or size - at <= most:
                return _last_line(f, at, size)
            # The batch ends with the line that reaches its bytes.
            wanted = at + most
            known = self.ahead.get(path, (at, wanted - 1))
            here = known[1] if known[0] == at else wanted - 1
            limit = min(size, here + SCAN)
            f.seek(here)
            while here < limit:
                piece = f.read(min(LINE_BYTES, limit - here))
                found = piece.find(b"\n")
                if found >= 0:
                    self.ahead.pop(path, None)
                    return here + found + 1
                here += len(piece)
            self.ahead[path] = (at, here)
            return _last_line(f, at, wanted)

    def partitions(self, start, end):
        self.start = end
        out = []
        for path, cursor in sorted(end.items()):
            old = start.get(path)
            if old == cursor:
                continue
            out += _ranges(path, old["at"] if old and old["generation"] == cursor["generation"] else 0, cursor["at"], cursor)
        return out or [_Range("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from _read(partition)

    def commit(self, end):
        pass


class Journals(DataSource):
    """format 'journals'; options path (a glob), exclude (a glob), chars (of a stream's batch), startingOffsets (earliest, latest)."""

    @classmethod
    def name(cls):
        return "journals"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(Journals)


def evidence_line(**fields) -> str:
    """One line of the classed evidence format, version 1."""
    return json.dumps({"schema_version": 1} | fields, ensure_ascii=False)
