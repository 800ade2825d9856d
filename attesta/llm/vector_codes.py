"""Vectors compressed to a code of one byte for each of their parts: product quantisation in whole numbers.

Each component x counts as floor(256 * x) and a vector is cut into PARTS equal parts. Each part position has a codebook of at most
ENTRIES entries. It starts as that part of the kept rows of the smallest ids; a round assigns every part to its nearest entry (squared
distance, ties to the lower index) and moves each entry to the componentwise floor of its parts' mean; entries without parts stay.

The nearest entry is found by a vantage-point tree over each codebook. A query first goes down to the leaf on its side of every shell,
which gives a first distance; then it visits every other branch that its triangle inequality cannot rule out. Distances to vantage
points and the radii of branches are whole numbers, rounded away from ruling out, and a branch whose bound equals the best distance is
visited too, since it may hold a lower index. All distances are compared as whole squares, so the answer is that of a full search.

Spark deals the vectors; every task walks a batch of them through the trees in numpy and sends one sum for each part and entry, not
rows. The driver holds one codebook (PARTS * ENTRIES entries).

Rows whose vector is null, or holds a null or non-finite component, go. So does nothing else: vectors of another length than the one of the smallest
id, of a length that PARTS does not divide, or with a component so large that a sum of squares would overflow (2**19 for 64 components) keep their row, with null
code and error, and take no part in the codebooks. A row of null id is encoded but starts no entry; of rows that
repeat an id one starts an entry, the one of the smallest vector. Fewer ids make smaller codebooks. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, lean, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf.
LEAF = 8
#: Rows that walk through the trees together.
BATCH = 8192


def _root_down(x: np.ndarray) -> np.ndarray:
    """floor(sqrt(x)) of whole numbers below 2**62, exactly."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def _root_up(x: np.ndarray) -> np.ndarray:
    r = _root_down(x)
    return r + (r * r < x)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a to every row of b, as whole numbers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


class Tree:
    """A vantage-point tree over the entries of one codebook.

    A node is ('leaf', entries) or ('split', vantage, half, inner, outer): inner holds the entries within sqrt(half) of the vantage point. Each branch
    comes with the least and the greatest distance of its entries from the vantage point, rounded down and up.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray):
        if len(own) <= LEAF:
            return ("leaf", own)
        spread = np.abs(self.entries[own] - self.entries[own].sum(0) // len(own)).sum(1)
        vantage = own[np.argmax(spread)]  # an outlying entry has the widest range of distances
        d = _squares(self.entries[own], self.entries[vantage][None])[:, 0]
        half = np.sort(d)[(len(own) - 1) // 2]
        if half == d.max():
            return ("leaf", own)  # no shell divides them
        branches = []
        for side in (d <= half, d > half):
            branches.append((_root_down(d[side].min(keepdims=True))[0], _root_up(d[side].max(keepdims=True))[0], self._grow(own[side])))
        return ("split", vantage, half, *branches)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """index and squared distance of the nearest entry to each row of q; ties to the lower index."""
        best = np.full(len(q), np.iinfo(np.int64).max)
        index = np.zeros(len(q), np.int64)
        home = np.zeros(len(q), np.int64)
        self._descend(self.top, 1, np.arange(len(q)), q, best, index, home)
        self._visit(self.top, 1, np.arange(len(q)), q, best, index, home)
        return index, best

    def _look(self, own, rows, q, best, index):
        d = _squares(q[rows], self.entries[own])
        at = d.argmin(1)  # own ascends, so the first is the lowest index
        d, i = d[np.arange(len(rows)), at], own[at]
        better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], i[better]

    def _descend(self, node, name, rows, q, best, index, home):
        """Each query in the leaf on its own side of every shell."""
        if not len(rows):
            return
        if node[0] == "leaf":
            home[rows] = name
            self._look(node[1], rows, q, best, index)
            return
        _, vantage, half, inner, outer = node
        near = _squares(q[rows], self.entries[vantage][None])[:, 0] <= half
        self._descend(inner[2], 2 * name, rows[near], q, best, index, home)
        self._descend(outer[2], 2 * name + 1, rows[~near], q, best, index, home)

    def _visit(self, node, name, rows, q, best, index, home):
        """Every other leaf that may hold an entry as near as the best one."""
        if not len(rows):
            return
        if node[0] == "leaf":
            self._look(node[1], rows[home[rows] != name], q, best, index)
            return
        _, vantage, _, inner, outer = node
        d = _squares(q[rows], self.entries[vantage][None])[:, 0]
        low, high = _root_down(d), _root_up(d)
        for child, (least, most, branch) in enumerate((inner, outer)):
            bound = np.maximum(np.maximum(low - most, least - high), 0)
            self._visit(branch, 2 * name + child, rows[bound * bound <= best[rows]], q, best, index, home)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _stacks(batches):
    """The batches, a few of them at a time as one table."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _limit(length: int) -> int:
    """The size of a whole component up to which length * (2 * size)**2 stays below 2**62."""
    return 1 << (60 - (length - 1).bit_length()) // 2


def whole(lists: pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows fit the codebooks (length, bounded components), and those rows' components as whole numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    right = sizes == length
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = flat[np.repeat(right, sizes)].reshape(-1, length)
    values = np.floor(values * SCALE)
    fits = (np.abs(values) <= _limit(length)).all(1)
    right[np.flatnonzero(right)[~fits]] = False
    return right, values[fits].astype(np.int64)


def _assign(vectors: np.ndarray, trees: list[Tree]):
    """codes and squared distances, a column for each part."""
    width = vectors.shape[1] // len(trees)
    found = [t.nearest(np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])) for p, t in enumerate(trees)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks that the smallest ids give: parts x entries x components; None without any."""
    length = rows.where("i is not null").groupBy().agg(F.min_by(F.size("v"), F.struct("i", "v")).alias("n")).first().n
    if not length or length % parts:
        return None
    fits = F.forall("v", lambda x: F.abs(F.floor(x * SCALE)) <= _limit(length))
    starts = rows.where(F.col("i").isNotNull() & (F.size("v") == length) & fits).groupBy("i").agg(F.min("v").alias("v")).orderBy("i").limit(entries)
    found = sorted(starts.collect(), key=lambda r: r.i)
    if not found:
        return None
    ints = np.floor(np.array([r.v for r in found], np.float64) * SCALE).astype(np.int64)
    return ints.reshape(len(found), parts, length // parts).transpose(1, 0, 2)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    given = rows.sparkSession.sparkContext.broadcast(books)  # parts * entries entries

    def sums(batches):
        books = given.value
        trees = [Tree(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for t in _stacks(batches):
            _, vectors = whole(t.column(0), parts * width)
            for first in range(0, len(vectors), BATCH):
                some = vectors[first : first + BATCH]
                codes, _ = _assign(some, trees)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], some[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "total"])

    part = rows.select("v").mapInArrow(sums, "p int, e int, n long, total array<long>")
    sums_of = [F.sum(F.col("total")[j].cast("decimal(20,0)")).alias(f"t{j}") for j in range(width)]
    out = books.copy()
    for r in part.groupBy("p", "e").agg(F.sum("n").alias("n"), *sums_of).collect():  # a row for each entry in use
        out[r.p, r.e] = [int(r[f"t{j}"]) // r.n for j in range(width)]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: id_, code (two hex digits a part), error, label_error (errors summed over the label), codebooks_sha256."""
    lean(vectors.sparkSession)
    rows = vectors.where(usable(F.col(vector))).select(F.col(id_).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l"))
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = moved(rows, books)
    if books is None:
        codes = rows.select("i", "l", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        named = F.lit(None).cast("string")
    else:
        given = rows.sparkSession.sparkContext.broadcast(books)

        def encode(batches):
            trees = [Tree(b) for b in given.value]
            length = parts * given.value.shape[2]
            for t in _stacks(batches):
                right, ints = whole(t.column(2), length)
                codes, errors = _assign(ints, trees)
                text, error = np.full(len(right), None, object), np.zeros(len(right), np.int64)
                text[right] = [c.tobytes().hex() for c in codes.astype(np.uint8)]
                error[right] = errors.sum(1)
                yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array(text, pa.string()), pa.array(error, mask=~right)], ["i", "l", "code", "error"])

        kind = rows.schema["l"].dataType.simpleString()
        codes = cut(rows.select("i", "l", "v").mapInArrow(encode, f"i long, l {kind}, code string, error long"))
        named = F.lit(digest(books))
    # A label may hold a third of the rows: sums are made before the shuffle, and go back by a broadcast of checked size or a join that AQE splits.
    by_label = codes.groupBy("l").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("l", "l2")
    return codes.join(small(by_label), F.col("l").eqNullSafe(F.col("l2")), "left").select(F.col("i").alias(id_), "code", "error", "label_error", named.alias("codebooks_sha256"))
