"""Token-id files: one concatenated id array with Elias-Fano document boundaries.

A file (little-endian) is a header, the document ids, the documents' ends as an Elias-Fano sequence, and the ids:

    4s magic "TIDS" | u2 version | u2 bytes per id | u8 documents | u8 ids | u8 null document ids | u1 sorted
    document ids: Elias-Fano above the smallest (s8 smallest, then the sequence) if sorted, else s8 each
    ends:         Elias-Fano
    ids:          u2 or u4 each

An Elias-Fano sequence of n values up to u keeps floor(log2(u/n)) low bits of each value in a packed array and the rest
in unary: about 2 + log2(u/n) bits a document, without a table of 64-bit offsets. Every SAMPLE-th set bit's position
is kept, so select(i) looks at one short run of bytes.

Tables: the executors write the files through Spark, as rows (part, shard, n_docs, n_tokens, file) of a
Parquet table, so they reach any store that Spark writes; export() puts one such row into a plain file.
Documents are dealt by ranges of the order columns and each task streams its sorted run into files of about SHARD ids.
A reader needs no earlier file: each file's base offset is a sum over the (part, shard) counts.

Nulls: a null text counts as empty and gets the end id alone. Null document ids come first. Repeated rows are separate
documents. Extra columns are not read. Texts are encoded whole; a text longer than SHARD has a file of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import shared_dir
from attesta.llm.tokens import encoder

#: Ids of a file, but for the document that crosses it.
SHARD = 1 << 18
SAMPLE = 256
#: Bytes of text of a task, on average, at most.
RANGE = 64 << 20
_HEAD = struct.Struct("<4sHHQQQB")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        parts = (v & np.uint64((1 << low_bits) - 1)).astype("<u8")
        bits = np.unpackbits(parts.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits]
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def dump(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        k = -(-n // SAMPLE)
        low, high, samples = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u8", k, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 8 * k

    def select(self, i: int) -> int:
        """Value i."""
        k, left = divmod(i, SAMPLE)
        at = int(self.samples[k])
        byte, end = at >> 3, int(self.samples[k + 1]) // 8 + 1 if k + 1 < len(self.samples) else len(self.high)
        run = self.high[byte:end]
        before = int(_ONES[run[0] & ((1 << (at & 7)) - 1)])
        counts = np.cumsum(_ONES[run])
        j = int(np.searchsorted(counts, left + before, side="right"))
        rank = left + before - (int(counts[j - 1]) if j else 0)
        bit = np.flatnonzero(np.unpackbits(run[j : j + 1], bitorder="little"))[rank]
        upper = (byte + j) * 8 + int(bit) - i
        return (upper << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return (raw >> (first & 7)) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            full = np.zeros((self.n, 64), np.uint8)
            full[:, : self.low_bits] = bits
            out |= np.packbits(full, axis=1, bitorder="little").view("<u8").reshape(-1)
        return out.astype(np.int64)


def dump(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The file of these documents; ids: of each, as bytes."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    nulls = len(doc_ids) - len(known)
    in_order = doc_ids[:nulls] == [None] * nulls and (len(known) < 2 or bool((known[1:] >= known[:-1]).all()))
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    if in_order:
        names = struct.pack("<q", int(known[0]) if len(known) else 0) + EliasFano.of((known - known[:1]).view(np.uint64)).dump()
    else:
        names = np.array([i is None for i in doc_ids], np.uint8).tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    total = int(ends[-1]) if len(ends) else 0
    return _HEAD.pack(b"TIDS", 1, width, len(doc_ids), total, nulls, in_order) + names + EliasFano.of(ends).dump() + b"".join(ids)


class TokenFile:
    """A file's documents: doc_ids, ends, and ids by document."""

    def __init__(self, raw: bytes):
        magic, version, self.width, self.n, self.total, nulls, in_order = _HEAD.unpack_from(raw)
        if (magic, version) != (b"TIDS", 1):
            raise ValueError("not a token-id file")
        at = _HEAD.size
        if in_order:
            (low,) = struct.unpack_from("<q", raw, at)
            names, at = EliasFano.load(raw, at + 8)
            self.doc_ids: list[int | None] = [None] * nulls + (names.all() + low).tolist()
        else:
            null = np.frombuffer(raw, np.uint8, self.n, at)
            self.doc_ids = [None if no else i for no, i in zip(null, np.frombuffer(raw, "<i8", self.n, at + self.n).tolist(), strict=True)]
            at += 9 * self.n
        self.ends, at = EliasFano.load(raw, at)
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.total, at)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i begins and ends, by select."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def export(raw: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(raw)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, order: list[Column] | None = None, id_: str = "doc_id", text: str = "text", shard: int = SHARD) -> None:
    """Encode every text, append end_id, and write the files in the order of the order columns (ascending id_ where there are none)."""
    from pyspark import TaskContext

    def files(batches):
        model, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], model.dtype).tobytes()
        names: list = []
        ids: list[bytes] = []
        size = 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (number, pa.int64()), (len(names), pa.int64()), (size // model.width, pa.int64()), (dump(names, ids, model.width), pa.binary()))], ["part", "shard", "n_docs", "n_tokens", "file"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars < 1 << 20):
                    chars += len(texts[stop] or "")
                    stop += 1
                for key, x in zip(keys[at:stop], model.encode([t or "" for t in texts[at:stop]]), strict=True):
                    names.append(key)
                    ids.append(x + end)
                    size += len(x) + model.width
                    if size >= shard * model.width:
                        yield full()
                        names, ids, size, number = [], [], 0, number + 1
                at = stop
        if names:
            yield full()

    keys = order or [F.col(id_)]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE + 1)
    run = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = run.mapInArrow(files, "part long, shard long, n_docs long, n_tokens long, file binary")
    out.write.option("parquet.block.size", 8 << 20).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, part, shard, position in the file."""
    files = spark.read.parquet(path)

    def documents(batches):
        for b in batches:
            for part, shard, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(raw)
                ends = f.ends.all().tolist()
                bounds = list(zip([0, *ends], ends, strict=False))
                sums = [zlib.crc32(f.ids[a:e].astype("<u4").tobytes()) for a, e in bounds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * f.n, pa.int64()), pa.array([shard] * f.n, pa.int64()), pa.array(range(f.n), pa.int64()), pa.array(f.doc_ids, pa.int64()), pa.array([a for a, _ in bounds], pa.int64()), pa.array([e - a for a, e in bounds], pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "shard", "position", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = files.select("part", "shard", "file").mapInArrow(documents, "part long, shard long, position long, doc_id long, at long, n_tokens long, ids_crc32 long")
    counts = files.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))  # a row a task
    base = counts.withColumn("w", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("w")).alias("base"))
    return docs.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "position")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Write docs as token-id files and read them back."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    write_ids(docs, path, tokenizer, end_id, order)
    return read_ids(spark, path)
