"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k) = logistic(w . x - cut_k) with cut_1 < cut_2 < ...: one weight vector is shared by all thresholds.
x holds the presence of hashed features of the whole text: words, and their first 4, 6 and 8 bytes, so that unseen words of a known
stem count too. The model is fitted by gradient steps to at most MOST_TRAINED labelled rows (least hash of the id first; FOLD of
FOLDS may be held out); every text of the table is scored. expected severity = sum over k of P(grade >= k).

Nulls: a null text counts as empty and gets the scores of no features; rows with a null id or grade are not trained on; a null
id is scored. Repeated rows are scored each time; an id's equal labels count once, with one of its texts (least features). Without any labels, or with
one grade only, severity is that grade (0 without labels). Extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.textvec import Words, hash_bytes, pieces

DIM = 1 << 18
MOST_TRAINED, FOLDS, FOLD = 8000, 5, 0
STEMS = (4, 6, 8)
#: Training: passes, step size, weight decay, and features that are kept.
PASSES, RATE, DECAY, KEEP = 15, 30.0, 1e-5, 600
#: Weight of a present feature, times its inverse document frequency.
SCALE = 0.1
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    w = Words(texts)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):  # punctuation at a word's ends
        start += _TRIM[w.buf[np.minimum(start, len(w.buf) - 1)]] & (start < end)
        end -= _TRIM[w.buf[end - 1]] & (start < end)
    h = [hash_bytes(w.buf, start, end)] + [hash_bytes(w.buf, start, np.minimum(end, start + n)) + (np.uint64(n) << np.uint64(40)) for n in STEMS]
    f = np.stack([(x >> np.uint64(40)).astype(np.int64) & (DIM - 1) for x in h], axis=1)
    return [np.unique(f[a:b]) for a, b in zip(w.offset[:-1], w.offset[1:], strict=True)]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    """weights over DIM features and ascending cuts, one for each grade above the lowest."""

    weights: np.ndarray
    cuts: np.ndarray
    lowest: int = 0
    use: np.ndarray | None = None  # features of the training rows; others count nowhere

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, passes: int = PASSES, batch: int = 32, rate: float = RATE, decay: float = DECAY, keep: int = KEEP) -> OrdinalModel:
        lowest = int(grades.min()) if len(grades) else 0
        k = int(grades.max()) - lowest if len(grades) else 0
        at_least = (grades[:, None] - lowest >= np.arange(1, k + 1)).astype(float) if k else np.zeros((len(grades), 0))
        share = np.clip(at_least.mean(axis=0), 1e-3, 1 - 1e-3) if k else np.zeros(0)
        cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 0.01 * np.arange(k)) if k else np.zeros(0)
        seen = np.bincount(np.concatenate(rows), minlength=DIM) if rows else np.zeros(DIM)
        use = cls.telling(rows, grades > lowest, seen, keep)
        idf = np.where(use, np.log1p(len(rows) / np.maximum(seen, 1)), 0.0)
        rows = [r[use[r]] for r in rows]
        weights = np.zeros(DIM)
        rng = np.random.default_rng(11)
        for turn in range(passes if k else 0):
            order = rng.permutation(len(rows))
            pace = rate / (1 + turn)
            for first in range(0, len(order), batch):
                some = order[first : first + batch]
                sizes = np.array([len(rows[i]) for i in some])
                cells = np.concatenate([rows[i] for i in some])
                owner = np.repeat(np.arange(len(some)), sizes)
                value = SCALE * idf[cells]
                score = np.bincount(owner, weights[cells] * value, minlength=len(some))
                y = grades[some] - lowest
                # P(y) = F(score - cut_y) - F(score - cut_{y+1}) with cut_0 = -inf, cut_{k+1} = inf
                f = np.concatenate((np.ones((len(some), 1)), _logistic(score[:, None] - cuts[None, :]), np.zeros((len(some), 1))), axis=1)
                up, down = f[np.arange(len(some)), y], f[np.arange(len(some)), y + 1]
                p = np.maximum(up - down, 1e-9)
                slope_up, slope_down = up * (1 - up) / p, down * (1 - down) / p
                touched, where = np.unique(cells, return_inverse=True)
                g = np.bincount(where, (slope_down - slope_up)[owner] * value, minlength=len(touched)) / len(some)
                weights[touched] -= pace * (g + decay * weights[touched])
                gc = np.zeros(k + 2)
                np.add.at(gc, y, slope_up)
                np.add.at(gc, y + 1, -slope_down)
                cuts = np.maximum.accumulate(cuts - 0.02 * pace * gc[1 : k + 1] / len(some) + 1e-6 * np.arange(k))
        return cls(SCALE * weights * idf, cuts, lowest, use)

    @staticmethod
    def telling(rows: list[np.ndarray], above: np.ndarray, seen: np.ndarray, keep: int) -> np.ndarray:
        """A mask of the keep features that differ most between rows above the lowest grade and others, by chi squared."""
        n, m = len(rows), int(above.sum())
        both = np.bincount(np.concatenate([r for r, x in zip(rows, above, strict=True) if x]), minlength=DIM) if m else np.zeros(DIM)
        spread = np.maximum(seen * (n - seen) * m * (n - m), 1.0)
        chi = n * (both * float(n) - seen * float(m)) ** 2 / spread
        use = np.zeros(DIM, bool)
        use[np.lexsort((np.arange(DIM), -chi))[:keep]] = True
        return use & (chi > 0)

    def at_least(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= lowest + 1), P(grade >= lowest + 2), ... for each row."""
        kept = [r if self.use is None else r[self.use[r]] for r in rows]
        score = np.array([self.weights[r].sum() for r in kept])
        return _logistic(score[:, None] - self.cuts[None, :])


def labelled(docs: DataFrame, grades: DataFrame, most: int = MOST_TRAINED, id_: str = "doc_id", text: str = "text", grade: str = "grade") -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Ids, features and grades of at most most labelled rows."""
    g = grades.where(F.col(id_).isNotNull() & F.col(grade).isNotNull()).select(F.col(id_).cast("long").alias("i"), F.col(grade).cast("long").alias("g"))
    chosen = g.orderBy(F.xxhash64("i"), "i", "g").limit(most)
    rows = docs.select(F.col(id_).cast("long").alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").select("i", "t", "g")  # at most most rows

    def of(batches):
        for b in batches:
            for at, texts in pieces(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)), pa.array([f.astype("<i4").tobytes() for f in features(texts)], pa.binary())], ["i", "g", "f"])

    each = rows.mapInArrow(of, "i long, g long, f binary").groupBy("i", "g").agg(F.min("f").alias("f"))  # an id of many rows is one
    got = sorted(((r.i, r.g, r.f) for r in each.collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    return [r[0] for r in got], [np.frombuffer(r[2], "<i4").astype(np.int64) for r in got], np.array([r[1] for r in got], np.int64)


def fold_of(ids: list[int], folds: int = FOLDS) -> np.ndarray:
    return np.array([i * 2654435761 % 2**32 * folds >> 32 for i in ids], np.int64)


def fitted(docs: DataFrame, grades: DataFrame, hold_out: bool = True, **names) -> OrdinalModel:
    ids, rows, y = labelled(docs, grades, **names)
    use = np.flatnonzero(fold_of(ids) != FOLD) if hold_out else np.arange(len(ids))
    return OrdinalModel.fit([rows[i] for i in use], y[use])


def scored(docs: DataFrame, model: OrdinalModel, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_, severity (expected grade), grade (most probable), p_above (P(grade > lowest))."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        m = given.value
        for b in batches:
            for at, texts in pieces(b.column(1)):
                p = m.at_least(features(texts))
                each = np.concatenate((np.ones((len(p), 1)), p), axis=1) - np.concatenate((p, np.zeros((len(p), 1))), axis=1)
                columns = [pa.array(m.lowest + p.sum(axis=1)), pa.array(m.lowest + each.argmax(axis=1), pa.int64()), pa.array(p[:, 0] if p.shape[1] else np.zeros(len(p)))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *columns], [id_, "severity", "grade", "p_above"])

    return docs.select(F.col(id_).cast("long").alias(id_), text).mapInArrow(of, f"{id_} long, severity double, grade long, p_above double")
