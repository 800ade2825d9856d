"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Columns (n-grams) are put into one order for all documents, rare ones first. Two sets x and y
whose Jaccard similarity reaches t overlap in at least ceil(t * max(|x|, |y|)) n-grams, so their
first |x| - ceil(t|x|) + 1 and |y| - ceil(t|y|) + 1 columns have one in common: only these cells make
candidate pairs. The product is then taken for the candidates block of columns by block of
columns: after each block a pair goes whose count so far, plus what is left of the smaller set, is
below its own bound. What remains is counted in full, so the result is exact.

Groups of similar documents are never expanded into all pairs. Equal sets are one node. In each
column the nodes are first compared with a few pivots; connected components are formed; and then
only nodes that still lie in different components are compared with one another.

The order of columns is (estimated count, hash). The estimate comes from a count-min sketch over every n-gram
of every text; its size is fixed, so it may be broadcast, and its errors change the work, not the result.

Nulls: a null text counts as empty; an empty set is linked with nothing. A null id keeps its row, has no
component and links nothing. Rows that share an id are one node each per distinct set, named by the smallest id.
Extra columns are not read. Long texts are taken whole.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop_table, small
from attesta.llm.graph import grouped, shared
from attesta.llm.textvec import Words, pieces, shingles

#: Counters of each of the sketch's two rows, and of each part in which a row is summed.
WIDTH, PART = 1 << 18, 1 << 14
#: Blocks of columns.
BLOCKS = 4
#: Parities of a set, at least, and how many times as many as columns in which similar sets of its size may differ: unlike sets differ in about half.
PARITIES, ROOM = 1024, 4
#: Longs of parities that travel with each cell, and bits by which those of unlike sets may stay below half.
CARRIED, MARGIN = 8, 32
#: Least columns of a set that tell whether a pair met in an earlier one.
EARLIER = 4
_U = np.uint64


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(20)).astype(np.int64) & (WIDTH - 1), (h >> _U(42)).astype(np.int64) & (WIDTH - 1)


def _sets(batch: pa.RecordBatch, k: int):
    """(first row, sets) for each piece of a batch's texts; a set is a sorted array of distinct hashes."""
    for first, texts in pieces(batch.column(1)):
        w = Words(texts)
        yield first, [np.unique(shingles(w.hash[w.offset[i] : w.offset[i + 1]], k)) for i in range(len(texts))]


def column_counts(docs: DataFrame, k: int, text: str = "text") -> np.ndarray:
    """The count-min sketch of all n-grams: 2 * WIDTH counters, summed part by part on the executors."""

    def sketch(batches):
        total = np.zeros(2 * WIDTH, np.int64)
        for b in batches:
            for _, texts in pieces(b.column(0)):
                w = Words(texts)
                a, c = _cells(np.concatenate([shingles(w.hash[w.offset[i] : w.offset[i + 1]], k) for i in range(len(texts))]))
                total += np.bincount(np.concatenate((a, c + WIDTH)), minlength=2 * WIDTH)
        parts = total.reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<i4" if p.max() < 2**31 else "<i8").tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(raw, "<i4" if len(raw) == 4 * PART else "<i8").astype(np.int64)
                totals[part] = totals[part] + counts if part in totals else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.astype("<i8").tobytes() for t in totals.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    parts = docs.select(text).mapInArrow(sketch, schema).repartition("part").mapInArrow(add, schema).collect()  # 2 * WIDTH counters in all
    out = np.zeros((2 * WIDTH // PART, PART), np.int64)
    for part, raw in parts:
        out[part] += np.frombuffer(raw, "<i8")
    return out.reshape(-1)


def profiles(docs: DataFrame, k: int, percent: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n (set size), key (identity of the set), head (its first columns), parity (as longs; a longer set has more)."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(column_counts(docs, k, text))

    def of(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            for at, sets in _sets(b, k):
                keys, heads, parities = ([None] * len(sets) for _ in range(3))
                for i, s in enumerate(sets):
                    if len(s):
                        keys[i] = blake2b(s.tobytes(), digest_size=16).digest()
                        a, c = _cells(s)
                        weight = np.minimum(counts.value[a], counts.value[c + WIDTH])
                        first = len(s) - -(-percent * len(s) // 100) + 1
                        heads[i] = s[np.lexsort((s, weight))[:first]].view(np.int64)
                        width = PARITIES
                        while width < ROOM * 2 * len(s) * (100 - percent) // (100 + percent):
                            width *= 2
                        parities[i] = np.packbits((np.bincount(s.view(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8)).view(np.int64)
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), n, pa.array(keys, pa.binary()), pa.array(heads, longs), pa.array(parities, longs)], ["id", "n", "key", "head", "parity"])

    return docs.select(F.col(id_).cast("long").alias("id"), text).mapInArrow(of, "id long, n long, key binary, head array<long>, parity array<long>")


def blocks(docs: DataFrame, k: int) -> DataFrame:
    """The rows of the incidence matrix, cut into BLOCKS parts by the n-gram's hash: id, n, g0, g1, ...

    docs: id, text, key; of the rows with an id, the one whose set has that key counts.
    """
    names = [f"g{j}" for j in range(BLOCKS)]
    step = (1 << 64) // BLOCKS

    def of(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, sets in _sets(b, k):
                out = []
                for row, s in enumerate(sets, at):
                    if len(s) and blake2b(s.tobytes(), digest_size=16).digest() == keys[row]:
                        ends = np.searchsorted(s, np.arange(1, BLOCKS, dtype=np.uint64) * _U(step))
                        out.append((ids[row], len(s), *(g.view(np.int64) for g in np.split(s, ends))))
                columns = list(zip(*out, strict=True)) or [[]] * (BLOCKS + 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64()] + [longs] * BLOCKS, strict=True)], ["id", "n", *names])

    return docs.mapInArrow(of, "id long, n long, " + ", ".join(f"{g} array<long>" for g in names))


def _need(percent: int) -> str:
    """The least overlap of sets of nx and ny n-grams: 100 * i >= percent * (nx + ny - i)."""
    return f"cast(ceil({percent} * (nx + ny) / {100 + percent}.0D - 1e-9) as long)"


def differing(x: str, y: str) -> str:
    """How many parities of x and y differ: no more than columns do. The longer ones are folded to as many as the shorter ones."""
    longs = PARITIES // 64
    least = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(longs))
    fold = lambda p: f"aggregate(sequence(i, size({p}) - 1, s), 0L, (a, j) -> a ^ {p}[j])"
    more = f"aggregate(transform(array(least(size({x}), size({y}))), s -> aggregate(sequence(0, s - 1), 0, (c, i) -> c + bit_count({fold(x)} ^ {fold(y)}))), 0, (c, d) -> c + d)"
    return f"if(size({x}) = {longs} and size({y}) = {longs}, {least}, {more})"


def product(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (x, y) that reach the similarity, with their overlap: block by block, and after each block only pairs that still can."""
    size = lambda s: rows.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("n").alias(f"left{s}"))
    found = pairs.join(size("x"), "x").join(size("y"), "y").withColumn("i", F.lit(0).cast("long"))
    for j in range(BLOCKS):
        side = lambda s, j=j: rows.select(F.col("id").alias(s), F.col(f"g{j}").alias(f"g{s}"))
        found = found.join(side("x"), "x").join(side("y"), "y")
        found = found.select("x", "y", "nx", "ny", *[(F.col(f"left{s}") - F.size(f"g{s}")).alias(f"left{s}") for s in "xy"], (F.col("i") + F.size(F.array_intersect("gx", "gy"))).alias("i"))
        found = found.where(f"i + least(leftx, lefty) >= {_need(percent)}")
    return found.select("x", "y", "nx", "ny", F.col("i").alias("overlap"))


class NgramJoin:
    """The candidate structure over one table of documents."""

    def __init__(self, docs: DataFrame, k: int = 3, percent: int = 90, id_: str = "doc_id", text: str = "text"):
        self.percent, self.k = percent, k
        self.texts = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
        whole = cut(profiles(docs, k, percent, id_, text))
        self.docs = cut(whole.select("id", "n", "key"))
        first = F.min(F.struct("id", "n", "head", "parity")).alias("first")
        #: One node for each distinct set: its smallest id.
        self.nodes = cut(whole.where("id is not null and n > 0").groupBy("key").agg(first).select("key", "first.*"))
        drop_table(whole)
        self.repeats = not self.docs.groupBy("id").count().where("count > 1").isEmpty()
        # Folded, the carried parities still tell of every column.
        few = lambda i: reduce(lambda a, b: a.bitwiseXOR(b), [F.col("parity")[j] for j in range(i, PARITIES // 64, CARRIED)])
        fold = lambda i: F.when(F.size("parity") == PARITIES // 64, few(i)).otherwise(F.expr(f"aggregate(sequence({i}, size(parity) - 1, {CARRIED}), 0L, (a, j) -> a ^ parity[j])"))
        #: The cells of the columns that more than one node has.
        self.columns = shared(self.nodes.select(F.explode("head").alias("gram"), "id"))
        # Similar sets of so many columns may differ in half of what is carried, as unlike ones do; theirs would only be weight.
        half = 64 * CARRIED // 2 + MARGIN
        blind = -(-half * (100 + percent) // (2 * (100 - percent)))
        #: What travels with a node's cells: its size and first parities.
        self.carried = self.nodes.select("id", "n", *[F.when(F.col("n") < blind, c).otherwise(F.lit(0)).alias(f"p{i}") for i, c in enumerate(map(fold, range(CARRIED)))])
        self.cells = self.columns.join(self.carried, "id")
        need = _need(percent).replace("nx", "{a}n").replace("ny", "{b}n")
        differ = " + ".join(f"bit_count({{a}}p{i} ^ {{b}}p{i})" for i in range(CARRIED))
        #: What similar sets meet: near sizes, and no more different parities than columns may differ.
        self.near = f"100 * least({{a}}n, {{b}}n) >= {percent} * greatest({{a}}n, {{b}}n) and (greatest({{a}}n, {{b}}n) >= {blind} or {differ} <= {{a}}n + {{b}}n - 2 * {need})"

    def product(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (x, y) of nodes, with their overlap."""
        side = lambda s: self.nodes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"p{s}"))
        near = pairs.select("x", "y").distinct().join(side("x"), "x").join(side("y"), "y")
        near = cut(near.where(f"{differing('px', 'py')} <= nx + ny - 2 * {_need(self.percent)}").select("x", "y"))
        wanted = near.select(F.col("x").alias("id")).union(near.select("y")).distinct().join(self.nodes.select("id", "key"), "id")
        texts = self.texts.join(small(cut(wanted)), "id")
        rows = cut(blocks(texts.dropDuplicates(["id", "text"]) if self.repeats else texts, self.k))
        out = cut(product(near, rows, self.percent))
        drop_table(rows)
        return out

    def links(self) -> DataFrame:
        """Every pair of distinct sets that is similar: x, y (smallest ids of the sets, x < y), nx, ny, overlap.

        A group of g mutually similar sets has g * (g - 1) / 2 such pairs; components() does not need them.
        """
        a, b = (self.cells.select("gram", F.struct(*self.carried.columns).alias(s)) for s in "ab")
        pairs = a.join(b, "gram").where("a.id < b.id").where(self.near.format(a="a.", b="b."))
        return self.product(pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")))

    def components(self) -> DataFrame:
        """id, component for each node that has a link."""
        return grouped(self.columns, self.carried, self.near, self.product, "gram", whole=self._once, exact=False)

    def _once(self, cells: DataFrame) -> tuple[DataFrame, str]:
        """The cells with their node's least columns, and near without pairs that are known to have an earlier column in common: they meet there."""
        names = [f"e{i}" for i in range(EARLIER)]
        least = cells.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("gram")), 1, EARLIER).alias("least"))  # of one node's head
        least = least.select("id", *[F.get("least", F.lit(i)).alias(e) for i, e in enumerate(names)])
        met = " or ".join(f"({{a}}{e} = {{b}}{f} and {{a}}{e} < gram)" for e in names for f in names)
        return cells.join(least, "id"), f"{self.near} and not coalesce({met}, false)"


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id_, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    join = NgramJoin(docs, k, percent, id_, text)
    nodes = cut(join.nodes.select("key", F.col("id").alias("node")))
    found = nodes.join(join.components(), F.col("node") == F.col("id"), "left").select("key", F.coalesce("component", "node").alias("c"))
    drop_table(join.nodes)
    out = join.docs.select("id", "n", "key").join(found, "key", "left")
    return out.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("c", "id")).alias("component_id"))
