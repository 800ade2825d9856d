import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from attesta.llm import queries
from attesta.llm.exact_dedup import exact_duplicates
from attesta.llm.graph import components
from attesta.llm.ngram_join import NgramJoin, differing, ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=90):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, links = sorted(sets), set()
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.add((i, j))
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}, links


def run(spark, rows, schema="doc_id long, text string", **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, schema), **kw).collect()}


def test_components_match_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({queries.ORACLES['op1_ngram_join']})").fetchall())
    got = queries.op1_ngram_join(spark, sf).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == want


def test_chains_and_borderline_pairs(spark):
    rng = random.Random(3)
    rows, base = [], [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(60):  # neighbours are near copies, the ends of the chain are not
        base = list(base)
        base[rng.randrange(120)] = f"v{i}"
        rows.append((1000 - i, " ".join(base)))
    common = " ".join(f"c{i}" for i in range(40))
    rows += [(2000 + i, common + " " + " ".join(f"u{i}x{j}" for j in range(12))) for i in range(30)]
    want, links = brute(rows)
    assert run(spark, rows) == want
    found = NgramJoin(spark.createDataFrame(rows, "doc_id long, text string")).links().collect()
    assert {(r.x, r.y) for r in found} == links


def test_ngram_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "oNE\x0btwo"), (6, "one"), (7, long), (8, long + " end"), (9, "ÄB c d"), (10, "äB c d"), (4, "one two")]
    got = ngram_components(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n int")).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(rows)
    assert by == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (29998, 7), 8: (29999, 7), 9: (1, 9), 10: (1, 10)}
    assert ngram_components(spark.createDataFrame([(None, "a b c d"), (3, "a b c d")], "doc_id long, text string")).where("doc_id is null").first().component_id is None
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_links(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 460)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.id: r.component for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_duplicates(spark, block):
    rows = [(5, "ab c\tdefg hij"), (3, "abcdefghij"), (4, "abcdefghij "), (6, "abcdefghiJ"), (7, None), (8, " \n"), (9, ""), (10, "abc"), (11, "abcabc"), (12, "abcabcabc"), (13, "a b c"), (14, "x" * 50000), (15, " " + "x" * 50000), (None, "zz"), (16, "zz"), (17, " zz"), (18, "q"), (18, "q")]
    df = spark.createDataFrame([(*r, "c", 2) for r in rows], "doc_id long, text string, name string, level int")
    got = exact_duplicates(df, block=block).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = {}
    for norm, g in groups.items():
        for _, _, i in g:
            want[i] = (min(g)[2], len(g))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(rows)
    import hashlib

    assert {r.text_sha256 for r in got} == {hashlib.sha256(n.encode()).hexdigest() for n in groups}
    assert exact_duplicates(df.limit(0)).count() == 0


def test_blocks_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))  # every block of a length collides
    rows = [(1, "abcdef"), (2, "abcxyz"), (3, "abc def"), (4, "xyzdef")]
    got = {r.doc_id: r.keep_id for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=3).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 4}


def test_words_that_confuse_polynomial_hashes_differ(spark):
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    rows = [(1, morse + " x y"), (2, morse.translate(str.maketrans("ab", "ba")) + " x y"), (3, morse + " x y")]
    assert run(spark, rows) == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_a_large_group_just_below_the_bound_makes_few_candidates(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):  # each pair of them differs in about eight words of 150
        text = list(base)
        for j in rng.sample(range(150), 4):
            text[j] = f"e{i}x{j}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = NgramJoin(docs)
    a, b = join.cells.alias("a"), join.cells.alias("b")
    near = a.join(b, "gram").where("a.id < b.id").where(join.near.format(a="a.", b="b."))
    assert near.select("a.id", "b.id").distinct().count() < 400 * 399 / 2 / 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()} == brute(rows)[0]


def test_pairs_meet_once_and_long_sets_carry_no_parities(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in base) for _ in range(24)]
    texts += [" ".join(f"y{i}" for i in range(2900 + j)) for j in range(2)]
    join = NgramJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    carried = {r.id: r for r in join.carried.collect()}
    assert not any(carried[24][f"p{i}"] for i in range(8)) and any(carried[0][f"p{i}"] for i in range(8))

    def met(cells, near):
        a, b = (cells.selectExpr("gram", f"struct({','.join(c for c in cells.columns if c != 'gram')}) as {s}") for s in "ab")
        return [tuple(r) for r in a.join(b, "gram").where(near.format(a="a.", b="b.")).where("a.id < b.id").selectExpr("a.id", "b.id").collect()]

    every, once = met(join.cells, join.near), met(*join._once(join.cells))
    assert set(once) == set(every) and len(every) > 4 * len(set(every)) and len(once) < 2 * len(set(every))


def test_long_unlike_sets_are_told_apart_by_their_parities(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(9400)]
    like = [word() if rng.random() < 0.005 else w for w in base]
    unlike = base[:4500] + [word() for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, like, unlike))], "doc_id long, text string")
    join = NgramJoin(docs, 5, 80)
    x, y = (join.nodes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"p{s}")) for s in "xy")
    most = "nx + ny - 2 * cast(ceil(80 * (nx + ny) / 180.0D - 1e-9) as long)"
    pairs = x.join(y, F.col("x") < F.col("y")).select("x", "y", F.expr(differing("px", "py")).alias("d"), F.expr(most).alias("most"), (F.size("px") == F.size("py")).alias("same")).collect()
    assert {(r.x, r.y): r.d <= r.most for r in pairs} == {(0, 1): True, (0, 2): False, (1, 2): False}
    assert not all(r.same for r in pairs)  # folded
    assert {r.doc_id: r.component_id for r in ngram_components(docs, 5, 80).collect()} == {0: 0, 1: 0, 2: 2}
