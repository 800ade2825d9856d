"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts each word from the SPAN words on either side: a vector for each neighbour's word and
position is summed into a hidden layer (tanh), and the word's probability is P(class) * P(entry | class), a softmax over classes and
one over the class's entries. A document's score is the sum of log P(word | both sides) over its words.

Vocabulary: the VOCABULARY - RARE most frequent words, by counts over all texts, are entries of their own, dealt into classes by
rank (so every class has as many). Any other word is predicted in two steps: an entry that stands for the rare words of some first bytes, and
its spelling, P(first byte | entry) * product of P(byte | byte before) with an end, from counts over all rare words of all
texts. So every string has a probability of its own, and those of one place sum to one.

Training (numpy, AdaGrad): texts are dealt by a hash of text and id into SLICES, and each slice into tasks of about TASK / SLICES bytes, sorted by it, so what a
task learns, and every score, depends on the rows alone, not on how they were stored. A round goes once over every window of the texts of its
slice; each task starts at the round's parameters and AdaGrad divisors. After the round both move by the tasks' mean change, weighted by windows; parameters
by up to LEAP times the mean, since each task saw a part only and all changed them in much the same direction. The next
slice is learned from there, so a corpus of many tasks teaches more than any of them has seen. Changes are summed as whole multiples of
1 / FIXED, so that the order of sums changes nothing, part by part on the executors. A lost task gives the same again. What is gathered grows with the
tasks, and so with the input; the driver holds the counts of the vocabulary and one set of parameters.

Nulls: a null text counts as empty, has score 0 and no words. Repeated rows count each time. An empty table gives no
rows. Extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.textvec import Words, pieces

CLASSES = 32
VOCABULARY, RARE, SPAN, SIZE = CLASSES * CLASSES, 64, 2, 16
SLICES, BATCH, RATE, LEAP = 4, 512, 0.1, 1.5
#: Bytes of text that one task sees in all slices, about; and parts of one that changes are rounded to.
TASK, FIXED = 24 << 20, 1 << 16
#: Windows of a unit of weight: sums over 2**44 windows stay in 64 bits.
WEIGHT = 1 << 10
EDGE = VOCABULARY  # the id beyond a text's ends
_OFFSETS = [*range(-SPAN, 0), *range(1, SPAN + 1)]
_END = 32


class Spelling:
    """Log-probabilities of rare words, given the entry for their first bytes."""

    def __init__(self, counts: np.ndarray):
        """counts: of each byte after each byte in rare words (after 0: at the start; the byte 32: the end)."""
        c = counts.reshape(256, 256).astype(np.float64)
        first = c[0] + 0.05
        entry = np.arange(256) % RARE
        self.first = (np.log(first) - np.log(np.bincount(entry, first, RARE))[entry]).astype(np.float32)
        self.next = np.log((c + 0.05) / (c.sum(axis=1, keepdims=True) + 0.05 * 256)).astype(np.float32)

    @staticmethod
    def count(w: Words, rare: np.ndarray) -> np.ndarray:
        pair, start, end = Spelling._pairs(w), w.start[rare], w.end[rare]
        inner = np.zeros(len(pair) + 1, np.int8)
        inner[start + 1] += 1
        inner[end + 1] -= 1
        seen = np.bincount(pair[np.cumsum(inner[:-1]).astype(bool)], minlength=1 << 16)
        return seen + np.bincount(w.buf[start], minlength=1 << 16)

    @staticmethod
    def _pairs(w: Words) -> np.ndarray:
        """For each byte, the one before it and itself, blanks as the end."""
        b = np.where((w.buf < 14) & (w.buf > 8), np.uint8(_END), w.buf).astype(np.uint16)
        pair = b.copy()
        pair[1:] |= b[:-1] << np.uint16(8)
        return pair

    def log_probability(self, w: Words, rare: np.ndarray) -> np.ndarray:
        sums = np.cumsum(self.next.reshape(-1)[self._pairs(w)], dtype=np.float64)
        start, end = w.start[rare], w.end[rare]
        return self.first[w.buf[start]] + sums[end] - sums[start]


@dataclass
class WindowNet:
    words: np.ndarray  # hashes of the frequent words, sorted
    ids: np.ndarray  # their ids
    theta: np.ndarray  # all parameters, flat
    spelling: Spelling | None = None
    root: np.ndarray | None = None  # AdaGrad's divisors, while it is trained

    SHAPES = {"vectors": (2 * SPAN, VOCABULARY + 1, SIZE), "bias": (SIZE,), "classes": (SIZE, CLASSES), "class_bias": (CLASSES,), "within": (CLASSES, SIZE, CLASSES), "within_bias": (CLASSES, CLASSES)}

    @staticmethod
    def size() -> int:
        return sum(map(prod, WindowNet.SHAPES.values()))

    @classmethod
    def new(cls, ranked: list[int]) -> WindowNet:
        """ranked: hashes of the words, most frequent first."""
        top = np.array(ranked[: VOCABULARY - RARE], np.int64).view(np.uint64)
        order = np.argsort(top)
        theta = (np.random.default_rng(5).standard_normal(cls.size()) * 0.1).astype(np.float32)
        net = cls(top[order], order + RARE, theta, root=np.full(cls.size(), 1e-3, np.float32))
        for name in ("bias", "class_bias", "within_bias"):
            net.parts()[name][...] = 0
        return net

    def parts(self, theta: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Views of the parameters."""
        theta, out, at = self.theta if theta is None else theta, {}, 0
        for name, shape in self.SHAPES.items():
            n = prod(shape)
            out[name] = theta[at : at + n].reshape(shape)
            at += n
        return out

    def encode(self, w: Words) -> np.ndarray:
        entry = (w.buf[w.start] % RARE).astype(np.int16)
        if not len(self.words):
            return entry
        at = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        return np.where(self.words[at] == w.hash, self.ids[at].astype(np.int16), entry)

    def padded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
        """Ids of all texts with EDGE around each; the places of the words; and the words."""
        w = Words(texts)
        n = np.diff(w.offset)
        where = np.arange(len(w.hash)) + np.repeat(SPAN * (np.arange(len(texts)) + 1), n)
        ids = np.full(len(w.hash) + SPAN * (len(texts) + 1), EDGE, np.int16)
        ids[where] = self.encode(w)
        return ids, where, w

    @staticmethod
    def hidden(p: dict, ids: np.ndarray, where: np.ndarray) -> np.ndarray:
        z = p["vectors"][0].take(ids[where + _OFFSETS[0]], axis=0)
        for table, o in zip(p["vectors"][1:], _OFFSETS[1:], strict=True):
            z += table.take(ids[where + o], axis=0)
        z += p["bias"]
        return np.tanh(z, out=z)

    @staticmethod
    def _by_class(c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and each class that occurs with its run."""
        order = np.argsort(c, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=CLASSES)))).tolist()
        return order, [(k, ends[k], ends[k + 1]) for k in range(CLASSES) if ends[k] < ends[k + 1]]

    def log_probability(self, ids: np.ndarray, where: np.ndarray, w: Words | None = None) -> np.ndarray:
        """Of each word at where; of rare ones with their spelling where the words are given."""
        p, out = self.parts(), np.empty(len(where))
        ones = np.ones(CLASSES, self.theta.dtype)
        for first in range(0, len(where), 1 << 13):
            x = where[first : first + (1 << 13)]
            c, j = ids[x] >> 5, ids[x] & 31  # CLASSES is 32
            order, runs = self._by_class(c)
            c, j = c[order], j[order]
            h, row = self.hidden(p, ids, x[order]), np.arange(len(x))
            a = h @ p["classes"] + p["class_bias"]
            b = p["within_bias"].take(c, axis=0)
            for k, s, e in runs:
                b[s:e] += h[s:e] @ p["within"][k]
            own = a[row, c] + b[row, j]
            total = (np.exp(a, out=a) @ ones) * (np.exp(b, out=b) @ ones)
            out[first + order] = own - np.log(total)
        if self.spelling is not None and w is not None:
            rare = np.flatnonzero(ids[where] < RARE)
            out[rare] += self.spelling.log_probability(w, rare)
        return out

    def step(self, theta: np.ndarray, square: np.ndarray, ids: np.ndarray, where: np.ndarray) -> None:
        """One AdaGrad step on the windows at where."""
        p, q, n = self.parts(theta), self.parts(square), len(where)
        order, runs = self._by_class(ids[where] >> 5)
        where = where[order]
        c, j, row = ids[where] >> 5, ids[where] & 31, np.arange(n)
        near = np.concatenate([ids[where + o] + np.int16(k * (VOCABULARY + 1)) for k, o in enumerate(_OFFSETS)])  # rows of all tables
        vectors, seen = p["vectors"].reshape(-1, SIZE), q["vectors"].reshape(-1, SIZE)
        h = vectors.take(near, axis=0).reshape(len(_OFFSETS), n, SIZE).sum(axis=0)
        h += p["bias"]
        np.tanh(h, out=h)
        both = np.empty((2, n, CLASSES), theta.dtype)  # the softmax over classes, and that within the word's class
        a, b = both
        np.matmul(h, p["classes"], out=a)
        for k, s, e in runs:
            np.matmul(h[s:e], p["within"][k], out=b[s:e])
        a += p["class_bias"]
        b += p["within_bias"].take(c, axis=0)
        np.exp(np.minimum(both, 60, out=both), out=both)
        both /= (both @ np.full(CLASSES, n, theta.dtype))[:, :, None]  # of the mean loss
        a[row, c] -= 1 / n
        b[row, j] -= 1 / n
        dh = a @ p["classes"].T
        grads = {"classes": h.T @ a, "class_bias": a.sum(axis=0), "within": np.zeros_like(p["within"]), "within_bias": np.zeros_like(p["within_bias"])}
        grads["within_bias"][[k for k, _, _ in runs]] = np.add.reduceat(b, [s for _, s, _ in runs], axis=0)
        for k, s, e in runs:
            np.matmul(h[s:e].T, b[s:e], out=grads["within"][k])
            dh[s:e] += b[s:e] @ p["within"][k].T
        h *= h
        dh -= dh * h
        grads["bias"] = dh.sum(axis=0)
        for name, g in grads.items():
            root = g * g
            q[name][...] += root
            np.sqrt(q[name], out=root)
            g /= root
            g *= RATE
            p[name][...] -= g
        order = np.argsort(near, kind="stable")
        near = near[order]
        first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
        g, at = np.add.reduceat(dh.take(order % n, axis=0), first, axis=0), near[first]
        s = seen.take(at, axis=0) + g * g
        seen[at] = s
        g /= np.sqrt(s, out=s)
        g *= RATE
        vectors[at] -= g


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (a 64-bit hash) and count, over all texts, and a row without word: the bytes of all texts. Tasks fold their own repeats first."""

    def of(batches):
        for b in batches:
            for _, texts in pieces(b.column(0)):
                w, n = np.unique(Words(texts).hash.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None, *w.tolist()], pa.int64()), pa.array([sum(map(len, texts)), *n.tolist()], pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(of, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_PART = 1 << 12


def summed(parts: DataFrame) -> DataFrame:
    """The sums of rows (part, task, sums) by part: first of some tasks, then of all."""

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for part, task, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, "<i8")
                total[part, task] = total[part, task] + x if (part, task) in total else x
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["part", "task", "sums"])

    schema = "part int, task int, sums binary"
    some = parts.select("part", F.expr("task div 64").cast("int").alias("task"), "sums").repartition("part", "task").mapInArrow(add, schema)
    return some.select("part", F.lit(0).alias("task"), "sums").repartition("part").mapInArrow(add, schema).select("part", "sums")


def trained(docs: DataFrame, slices: int = SLICES, text: str = "text", id_: str = "doc_id", task: int = TASK) -> WindowNet:
    from pyspark import TaskContext

    spark = docs.sparkSession
    counts = word_counts(docs, text).orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(VOCABULARY - RARE + 1).collect()
    net = WindowNet.new([r.word for r in counts[1:]])
    tasks, size = 1 + (counts[0].n if counts else 0) // task, WindowNet.size()
    # Copies of a text go to many slices and tasks, by their ids.
    own = [F.col(id_)] if id_ in docs.columns else []
    hashed = docs.select(F.coalesce(text, F.lit("")).alias("t"), *[c.alias("i") for c in own]).select("t", F.xxhash64("t", *["i" for _ in own]).alias("h"))
    spelled = np.zeros(1 << 16, np.int64)
    for turn in range(slices):
        given = spark.sparkContext.broadcast(net)

        def learn(batches, given=given):
            net = given.value
            theta, square, seen = net.theta.copy(), net.root * net.root, 0
            spelled = np.zeros(1 << 16, np.int64)
            for b in batches:
                for _, texts in pieces(b.column(0)):
                    ids, where, w = net.padded(texts)
                    spelled += Spelling.count(w, np.flatnonzero(ids[where] < RARE))
                    where = np.random.default_rng(len(where)).permutation(where)
                    for first in range(0, len(where), BATCH):
                        net.step(theta, square, ids, where[first : first + BATCH])
                    seen += len(where)
            if seen:
                weight = 1 + seen // WEIGHT
                change = np.concatenate((theta - net.theta, np.sqrt(square) - net.root)).astype(np.float64)
                whole = np.concatenate(([weight, 1], np.rint(change * FIXED).astype(np.int64) * weight, spelled))
                sums = [whole[i : i + _PART].astype("<i8").tobytes() for i in range(0, len(whole), _PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32()), pa.array(sums, pa.binary())], ["part", "task", "sums"])

        # The slice is chosen by other bits than the task.
        part = hashed.where(F.pmod(F.xxhash64("h"), F.lit(slices)) == turn) if slices > 1 else hashed
        dealt = part.repartition(tasks, "h").sortWithinPartitions("h").select("t")
        rows = summed(dealt.mapInArrow(learn, "part int, task int, sums binary")).collect()  # one set of parameters
        given.unpersist()
        if rows:
            whole = np.concatenate([np.frombuffer(r.sums, "<i8") for r in sorted(rows, key=lambda r: r.part)])
            weight, n = whole[:2].tolist()
            mean = whole[2 : 2 + 2 * size] / weight / FIXED
            leap = LEAP - (LEAP - 1) / n  # one task's change is taken as it is
            net = WindowNet(net.words, net.ids, (net.theta + leap * mean[:size]).astype(np.float32), root=(net.root + mean[size:]).astype(np.float32))
            spelled += whole[2 + 2 * size :]
    return WindowNet(net.words, net.ids, net.theta, Spelling(spelled))


def scored(docs: DataFrame, net: WindowNet, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_, n_words, log_probability (sum over the words), per_word (mean; null without words)."""
    given = docs.sparkSession.sparkContext.broadcast(net)

    def of(batches):
        for b in batches:
            for at, texts in pieces(b.column(1)):
                ids, where, w = given.value.padded(texts)
                sums = np.concatenate(([0.0], np.cumsum(given.value.log_probability(ids, where, w))))
                n = np.diff(w.offset)
                total = np.where(n > 0, sums[w.offset[1:]] - sums[w.offset[:-1]], 0.0)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(total), mean], [id_, "n_words", "log_probability", "per_word"])

    return docs.select(F.col(id_).cast("long").alias(id_), text).mapInArrow(of, f"{id_} long, n_words long, log_probability double, per_word double")
