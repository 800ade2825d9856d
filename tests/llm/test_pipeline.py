import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from attesta.llm import language
from attesta.llm.common import table
from attesta.llm.language import identified, kept
from attesta.llm.mixing import mixed
from attesta.llm.tokens import public_tokenizer
from tests.llm.test_lines_and_leaks import words
from tests.llm.test_near_copies import brute, shingle_set


def components(rows, percent, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


def holds(text, item):
    def cells(w):
        k = min(5, len(w))
        return {tuple(w[i : i + k]): sum(map(len, w[i : i + k])) for i in range(len(w) - k + 1)}

    w, x = words(text), words(item)
    b = cells(x)
    if not cells(w).keys() & b.keys():
        return False
    for s in range(max(1, len(w) - len(x) + 1)):
        a = cells(w[s : s + len(x)])
        if 2 * sum(b[c] for c in a.keys() & b.keys()) >= 0.8 * (sum(a.values()) + sum(b.values())):
            return True
    return False


def test_run_matches_brute_force(spark, sf):
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id: r.text for r in identified(docs).where(kept()).collect()}
    group = components(sorted(known.items()), 80, 5)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in known.items() if group[i] == i and not any(holds(t, x) for x in items)}
    assert {r.doc_id for r in got} == set(left) and 0 < len(left) < len(known)
    places = {r.doc_id: r.place for r in mixed(docs.where(docs.doc_id.isin(*left))).collect()}
    assert [r.doc_id for r in got] == sorted(left, key=places.get)
    t, at = Tokenizer.from_file(public_tokenizer()), 0
    for r in got:
        ids = [*t.encode(left[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_keep_odd_rows_and_columns(spark, sf):
    rows = [(1, "the cat and the dog went to the house " * 3, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "another text of the house and the dog and the cat in it", "en", None, 3), (4, "der hund und die katze gehen in das haus und bleiben dort", "de", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        ids = {r.doc_id for r in out.collect()}
        assert ids == ({1, 4, None} if name == "language" else {1, 2, 3, 4, None})
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == len(rows)
    assert brute([(1, "a b c")])[0] == {1: (1, 1)}


def test_stages_take_long_texts_repeats_ties_and_clashing_columns(spark, sf):
    long = "the cat and the dog went to the house of the man and then they came back again " * 4000
    rows = [(1, long, "en", "a", 1), (2, "the dog and the cat are in the house of the man and they are not here", "en", "a", 1), (2, "the dog and the cat are in the house of the man and they are not here", "en", "a", 1), (3, "der hund und die katze sind in dem haus und sie sind nicht hier", "de", "b", 1)]
    names = ["ll", "soft", "declared", "host", "suffix", "joint", "stays", "place", "at_id", "leak_id", "leak_key", "evidence", "segment", "k1", "id", "text_hash"]
    df = spark.createDataFrame([(*r, *([7] * len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == corpus_pipeline.COLUMNS and sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 3], name
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == 4
    found = identified(df)
    assert found.columns == [c for c in df.columns if c != "evidence"] + ["evidence"] and {r.soft for r in found.collect()} == {7}


def test_python_nodes_share_their_workers(spark, sf):
    table(spark, sf, "documents")
    assert spark.conf.get("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled") == "false"


def test_a_text_is_scored_once_for_the_sums_and_once_for_the_result(spark, sf, monkeypatch):
    plans, cut = [], language.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(language, "cut", lambda df: plans.append(plan(df)) or cut(df))
    plans.append(plan(identified(table(spark, sf, "documents"))))
    assert len(plans) == 2 and [p.count("ArrowEvalPython") for p in plans] == [1, 1], plans
