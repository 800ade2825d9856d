"""Vector codes against a full search in plain whole numbers."""

import hashlib
import math

import numpy as np
from pyspark.sql import Row

from attesta.llm.queries import ORACLES, op12_vector_codes
from attesta.llm.vector_codes import Tree, _root_down, _root_up, vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, word for word; rows of (id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    books = [[v[p * width : (p + 1) * width] for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]

    def near(v, p):
        w = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(w, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, lab in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    return sorted((i, c, e, sums[lab], sha) for i, c, e, lab in out)


def got(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, code string, l int, i int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA)


def test_roots_are_rounded_away():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 10**12, 10**18 - 1, 10**18, 10**18 + 1, (1 << 62) - 1])
    assert _root_down(x).tolist() == [math.isqrt(v) for v in x.tolist()]
    assert _root_up(x).tolist() == [math.isqrt(v - 1) + 1 if v else 0 for v in x.tolist()]


def test_tree_finds_the_lowest_of_the_nearest():
    rng = np.random.default_rng(1)
    for spread, n, width in ((3, 64, 4), (40, 64, 4), (4000, 64, 4), (2, 64, 1), (10**6, 33, 2), (0, 64, 4), (5, 9, 3), (5, 1, 3)):
        entries = rng.integers(-spread, spread + 1, (n, width))
        queries = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (2000, width)), entries])
        d = ((queries[:, None] - entries[None]) ** 2).sum(2)
        index, best = Tree(entries).nearest(queries)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_branches_are_ruled_out(monkeypatch):
    rng = np.random.default_rng(2)
    entries = rng.integers(-1000, 1000, (64, 4))
    looked = []
    look = Tree._look
    monkeypatch.setattr(Tree, "_look", lambda self, own, rows, *a: (looked.append(len(own) * len(rows)), look(self, own, rows, *a))[1])
    Tree(entries).nearest(rng.integers(-1000, 1000, (1000, 4)))
    assert sum(looked) < 0.8 * 64 * 1000


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=32)], int(i % 3) if i % 5 else None) for i in range(150)]
    odd = [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] + [0.0] * 31, 1), (203, [float("inf")] + [0.0] * 31, None)]
    assert got(vector_codes(table(spark, rows + odd))) == brute(rows + odd)
    same = [(i, [0.25] * 32, None) for i in range(70)]
    assert got(vector_codes(table(spark, same))) == brute(same)


def test_other_shapes_nulls_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)], 1) for i in range(70)]
    plain = {r[0]: r for r in got(vector_codes(table(spark, rows)))}
    odd = vector_codes(table(spark, [*rows, (500, [1.0] * 15, 2), (501, [3e38] * 16, 2), (502, [], 2)]))
    by_id = {r[0]: r for r in got(odd.where("vec_id < 500"))}
    assert by_id == plain
    assert [(r.code, r.error, r.label_error) for r in odd.where("vec_id >= 500").collect()] == [(None, None, None)] * 3
    assert vector_codes(table(spark, [])).count() == 0 and vector_codes(table(spark, [(1, [1.0] * 15, 2)])).collect()[0].code is None
    assert vector_codes(table(spark, [(None, [1.0] * 16, 2)])).collect() == [Row(vec_id=None, code=None, error=None, label_error=None, codebooks_sha256=None)]
    twice = vector_codes(table(spark, rows + rows[:1] + [(None, rows[3][1], 7)])).collect()
    assert len(twice) == 72 and sum(r.vec_id == 0 for r in twice) == 2 and all(r.code for r in twice)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op12_vector_codes(spark, sf)) == brute(rows)


def test_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    frame = con.execute(ORACLES["op12_vector_codes"]).df()
    assert sorted(zip(frame.vec_id, frame.code, frame.error, frame.label_error, frame.codebooks_sha256, strict=True)) == got(op12_vector_codes(spark, sf))
