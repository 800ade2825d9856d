import collections

import pytest

from attesta.llm.mixing import in_mixed_order, mixed, period, segments, shares


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [97, 1, 1, 1], [7] * 13 + [1] * 9, [333, 250, 117, 100, 90, 60, 50]])
def test_period_keeps_every_source_within_a_block_of_its_share(weights):
    total, had = sum(weights), [0] * len(weights)
    for t, (s, j) in enumerate(period(weights)):
        assert j == had[s] and j * total // weights[s] <= t < -(-(j + 1) * total // weights[s])
        had[s] += 1
        assert all(abs(h * total - w * (t + 1)) < total for h, w in zip(had, weights, strict=True))
    assert had == weights


def test_shares():
    assert shares([2, 1, 1], 1000) == [2, 1, 1] and shares([1e-9, 1], 100) == [1, 100]


def test_segments_place_every_block_once():
    blocks = [1, 50, 7, 0, 333, 2]
    plan, seen, slots = segments(blocks, [1, 2, 3, 4, 5, 6], 100), collections.Counter(), set()
    for g in plan:
        first = {s: f for s, f, *_ in g["sources"]}
        had = {s: h for s, _, h, *_ in g["sources"]}
        for turn in range(g["times"]):
            for s, j, t in g["pattern"]:
                seen[s, first[s] + turn * had[s] + j] += 1
                slots.add(g["slot"] + turn * g["length"] + t)
    assert seen == {(s, j): 1 for s, n in enumerate(blocks) for j in range(n)} and slots == set(range(sum(blocks)))


def lag(rows, block, weights):
    """Largest deviation in blocks from the share of what is still there, in the first segment."""
    rows = sorted((r for r in rows if r.segment == 0), key=lambda r: r.place)
    order = list(dict.fromkeys((r.source, r.block) for r in rows))
    total, had, most = sum(weights.values()), collections.Counter(), 0
    for t, (s, _) in enumerate(order, 1):
        had[s] += 1
        most = max(most, *(abs(had[x] - t * w / total) for x, w in weights.items()))
    return most


def test_mixed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "place")
    weights = {f"src{i}": 1 + i % 4 for i in range(20)}
    rows = mixed(docs, weights, block=2).collect()
    assert len({r.place for r in rows}) == len(rows) == docs.count()
    assert lag(rows, 2, weights) < 1
    assert all(r.released <= r.slot < r.due for r in rows if r.segment == 0)
    for s in weights:  # places follow the blocks
        mine = sorted((r for r in rows if r.source == s), key=lambda r: r.place)
        assert [r.block for r in mine] == sorted(r.block for r in mine)
    order = [r.doc_id for r in in_mixed_order(docs, weights=weights, block=2).collect()]
    assert order == [r.doc_id for r in sorted(rows, key=lambda r: r.place)]


def test_mixed_edge_cases(spark):
    rows = [(1, None), (None, "a"), (2, "a"), (2, "a"), (2, "b"), *[(i, "hot") for i in range(10, 400)]]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "doc_id long, source string, block string, slot int")
    got = mixed(df, block=4).collect()
    assert len(got) == len(set(rows)) and len({r.place for r in got}) == len(got)
    assert in_mixed_order(df).count() == len(rows) and in_mixed_order(df).columns == df.columns
    assert mixed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixed(df, {"a": 1.0})


@pytest.mark.parametrize("sizes", [[2_000_000] + [int(400_000 / (i + 2)) + 1 for i in range(19)], [30_000] + [7 + i % 90 for i in range(2000)]])
def test_deviation_from_irrational_targets(sizes):
    weights = [n**0.5 for n in sizes]
    blocks = [-(-n // 16) for n in sizes]
    first = segments(blocks, weights, 1000)[0]
    total, had, most = sum(weights), [0] * len(sizes), 0.0
    slots = [(turn * first["length"] + t, s) for turn in range(first["times"]) for s, _, t in first["pattern"]]
    for t, s in slots:
        most = max(most, abs(had[s] - t * weights[s] / total), abs(had[s] + 1 - (t + 1) * weights[s] / total))  # furthest off before or after a block
        had[s] += 1
    assert len(slots) > 500 and most < 1 + 1e-6
    assert all(abs(h - len(slots) * w / total) < 1 + 1e-6 for h, w in zip(had, weights, strict=True))
