import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import language, masked_lm, queries, toxicity
from attesta.llm.textvec import Words


def test_language_of_documents(spark, sf):
    got = queries.op7_language(spark, sf.replace("0.001", "0.01")).toPandas()
    assert len(got) == 1000 and (got.text_language == got.declared).mean() > 0.97 and got.kept.mean() > 0.97


def test_language_evidence_is_fused_as_by_hand(spark):
    en = ["the quick brown fox jumps over the lazy dog and the cat"] * 8
    de = ["der schnelle braune fuchs springt ueber den faulen hund"] * 8
    rows = [(i, t, "en" if i < 8 else "de", f"h{i % 3}", "com" if i % 2 else "de") for i, t in enumerate([*en, *de])]
    rows += [(20, None, "en", "h0", "com"), (21, "12 34", None, None, None), (22, "the dog", None, "h9", "org"), (23, "xq zj", "??", "h1", "de"), (22, "the dog", None, "h9", "org")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tld string")
    model = language.TextModel.fit([r[1].encode() for r in rows[:16]], [r[2] for r in rows[:16]])
    assert model.languages == ["de", "en", "und"]
    got = language.fused(df, model, "text", F.col("lang"), F.col("source"), F.col("tld")).collect()
    assert len(got) == len(rows)
    ll = model.scores([(r[1] or "").encode() for r in rows])
    soft = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() if x.any() else None for x in ll]
    says = [r[2] if r[2] in ("en", "de") else "none" if r[2] is None else "other" for r in rows]
    total = sum(s for s in soft if s is not None)
    prior = (total + 1) / (total + 1).sum()
    at = lambda f: sum((s for r, s in zip(rows, soft, strict=True) if s is not None and f(r)), np.zeros(3))
    n = lambda f: sum(s is not None and f(r) for r, s in zip(rows, soft, strict=True))
    want = []
    for r, x, own, d in zip(rows, ll, soft, says, strict=True):
        mine = sum((s for q, s in zip(says, soft, strict=True) if s is not None and q == d), np.zeros(3))
        declared = np.log((mine + 20 / 4 * (1 + 4 * np.array([y == d for y in model.languages]))) / (total + 20))
        in_suffix, in_host = lambda q, r=r: q[4] == r[4], lambda q, r=r: q[3] == r[3] and q[4] == r[4]
        suffix = (at(in_suffix) + 20 * prior) / (n(in_suffix) + 20) if n(in_host) else prior
        host = (at(in_host) - (0 if own is None else own) + 20 * suffix) / (n(in_host) - (own is not None) + 20)
        joint = x + np.log(host) + declared
        p = np.exp(joint - joint.max())
        want.append((r[0], model.languages[joint.argmax()] if own is not None else "und", round(float(p.max() / p.sum()), 6)))
    assert sorted((r.doc_id, r.evidence.language, round(r.evidence.posterior, 6)) for r in got) == sorted(want)


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "text here", "en", "s", 3)], "doc_id long, text string, lang string, source string, evidence int")
    assert language.identified(df).count() == 1
    assert language.identified(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None, None, None)], "doc_id long, text string, lang string, source string")
    r = language.identified(none).first()
    assert r.evidence.language == "und" and not r.evidence.has_text
    long = spark.createDataFrame([(1, "wort " * 300000, "de", "a"), (2, "word " * 10, "en", "a")], none.schema)
    assert language.identified(long).count() == 2


def test_page_languages(spark, sf):
    got = queries.page_language(spark, sf).toPandas()
    assert len(got) == 50 and (got.language == got.declared).mean() > 0.9 and set(got.suffix) <= {"com", "net", "org"}


def test_toxicity_on_the_held_out_fold(spark, sf):
    d = sf.replace("0.001", "0.1")
    docs, grades = queries.table(spark, d, "documents"), queries.severity_grades(queries.table(spark, d, "labels"))
    ids, rows, y = toxicity.labelled(docs, grades)
    out = toxicity.fold_of(ids) == toxicity.FOLD
    model = toxicity.OrdinalModel.fit([r for r, o in zip(rows, out, strict=True) if not o], y[~out])
    p = model.at_least([r for r, o in zip(rows, out, strict=True) if o])
    assert (np.diff(p, axis=1) <= 0).all()
    truth, said = y[out] >= 1, p[:, 0] >= queries.TOXIC
    assert (truth & said).sum() / said.sum() > 0.9 and (truth & said).sum() / truth.sum() > 0.75
    assert 0.1 < out.mean() < 0.3


def test_ordinal_model_recovers_an_order():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(3000)]
    z = np.array([r[r < 5].size - r[(r >= 5) & (r < 10)].size for r in rows]) + rng.logistic(size=3000) * 0.5
    y = np.digitize(z, [-0.5, 0.8, 2.0])
    m = toxicity.OrdinalModel.fit(rows, y)
    assert (np.diff(m.cuts) > 0).all()
    expected = m.at_least(rows).sum(axis=1)
    assert np.corrcoef(expected, y)[0, 1] > 0.75 and abs(expected.mean() - y.mean()) < 0.15


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "bad words", 9), (2, "", 9), (3, "x " * 200000, 9), (3, "x", 9)], "doc_id long, text string, grade int")
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = toxicity.scored(docs, toxicity.fitted(docs, none)).collect()
    assert len(got) == 5 and {r.severity for r in got} == {0.0}
    one = spark.createDataFrame([(1, 2), (None, 1), (3, None)], "doc_id long, grade int")
    assert {r.severity for r in toxicity.scored(docs, toxicity.fitted(docs, one, hold_out=False)).collect()} == {2.0}
    assert toxicity.scored(docs.limit(0), toxicity.fitted(docs, one)).count() == 0


def test_gradient_of_the_window_network():
    net = masked_lm.WindowNet.new(list(range(1, 900)))
    net.theta = net.theta.astype(np.float64)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, masked_lm.VOCABULARY, 60).astype(np.int16)
    where = np.arange(2, 58)
    theta, square = net.theta.copy(), np.ones(len(net.theta))
    net.step(theta, square, ids, where)
    g = np.sqrt(square - 1) * np.sign(net.theta - theta)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 25, replace=False):
        t = []
        for d in (1e-4, -1e-4):
            other = masked_lm.WindowNet(net.words, net.ids, net.theta.copy())
            other.theta[i] += d
            t.append(-other.log_probability(ids, where).mean())
        assert (t[0] - t[1]) / 2e-4 == pytest.approx(g[i], rel=2e-2, abs=2e-5)


def test_probabilities_sum_to_one():
    net = masked_lm.WindowNet.new(list(range(1, 900)))
    ids = np.array([5, 6, 0, 7, 8], np.int16)
    total = 0.0
    for w in range(masked_lm.VOCABULARY):
        ids[2] = w
        total += np.exp(net.log_probability(ids, np.array([2]))[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_masked_lm_beats_word_frequencies_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    train, rest = docs.where("doc_id % 5 != 0"), docs.where("doc_id % 5 = 0").cache()
    net = masked_lm.trained(train)
    counts, entries, held = np.ones(masked_lm.VOCABULARY), [], []
    for rows, into in ((train, None), (rest, held)):
        for r in rows.select("text").collect():
            ids, where, _ = net.padded([r.text.encode()])
            if into is None:
                np.add.at(counts, ids[where], 1)
            else:
                into.append(ids[where])
                entries.append(net.log_probability(ids, where))
    unigram = np.log(counts / counts.sum())[np.concatenate(held)].mean()
    assert np.concatenate(entries).mean() > unigram + 0.05
    # Texts of words that nobody writes are less likely than any but a few documents.
    rng = random.Random(1)
    junk = [(-i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 12))) for _ in range(200))) for i in range(20)]
    got = masked_lm.scored(rest.select("doc_id", "text").union(spark.createDataFrame(junk, "doc_id long, text string")), net).toPandas()
    real, odd = got[(got.doc_id > 0) & (got.n_words > 20)].per_word, got[got.doc_id < 0].per_word
    assert odd.max() < real.quantile(0.1), (odd.max(), real.quantile([0.01, 0.1, 0.5]).tolist())


def test_masked_lm_scores_match_brute_force_and_do_not_depend_on_splits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    net = masked_lm.trained(docs)
    other = masked_lm.trained(docs.repartition(7))
    assert np.array_equal(net.theta, other.theta) and np.array_equal(net.spelling.next, other.spelling.next)
    p = net.parts()
    for r in masked_lm.scored(docs.where("doc_id < 12"), net).collect():
        text = (docs.where(F.col("doc_id") == r.doc_id).first().text or "").encode().lower().split()
        ids = []
        for w in text:
            h = Words([w]).hash
            ids.append(int(net.ids[np.flatnonzero(net.words == h)[0]]) if h in net.words else w[0] % masked_lm.RARE)
        around, total = [masked_lm.EDGE] * 2 + ids + [masked_lm.EDGE] * 2, 0.0
        for n, (w, i) in enumerate(zip(text, ids, strict=True)):
            near = [around[n], around[n + 1], around[n + 3], around[n + 4]]
            h = np.tanh(sum(p["vectors"][k][x] for k, x in enumerate(near)) + p["bias"])
            a, b = h @ p["classes"] + p["class_bias"], h @ p["within"][i >> 5] + p["within_bias"][i >> 5]
            total += a[i >> 5] - np.log(np.exp(a).sum()) + b[i & 31] - np.log(np.exp(b).sum())
            if i < masked_lm.RARE:
                total += net.spelling.first[w[0]] + sum(net.spelling.next[x][y] for x, y in zip(w, [*w[1:], 32], strict=True))
        assert r.n_words == len(text) and r.log_probability == pytest.approx(total, rel=1e-4, abs=1e-3)
    queried = queries.op10_masked_lm(spark, sf).where("doc_id = 3").first()
    assert queried.log_probability == pytest.approx(masked_lm.scored(docs.where("doc_id = 3"), net).first().log_probability, rel=1e-6)


def test_spelling_probabilities_sum_to_one():
    rows = Words([b"ab abc b ba aab", b"cab"])
    s = masked_lm.Spelling(masked_lm.Spelling.count(rows, np.arange(len(rows.hash))))
    assert np.exp(s.next).sum(axis=1) == pytest.approx(np.ones(256), abs=1e-4)
    assert np.bincount(np.arange(256) % masked_lm.RARE, np.exp(s.first)) == pytest.approx(np.ones(masked_lm.RARE), abs=1e-4)


def test_masked_lm_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "one", 1.0), (None, "one two", 1.0), (4, "w " * 100000, 1.0), (3, "one", 1.0)], "doc_id long, text string, per_word double")
    got = masked_lm.scored(docs, masked_lm.trained(docs)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].log_probability == 0 and by[2].per_word is None and by[3].n_words == 1 and by[4].n_words == 100000
    assert all(r.log_probability < 0 for r in got if r.n_words)
    assert masked_lm.scored(docs.limit(0), masked_lm.trained(docs.limit(0))).count() == 0


def test_masked_lm_trains_on_every_window(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h " * 2) for i in range(3000)], "doc_id long, text string").repartition(2)
    got = masked_lm.scored(docs, masked_lm.trained(docs)).first()
    assert got.n_words == 16 and got.per_word > -2.0  # an even guess among the eight is -2.08


def test_many_tasks_learn_more_than_one_of_them(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    train, held = docs.where("doc_id % 5 != 0").cache(), [r.text.encode() for r in docs.where("doc_id % 5 = 0").collect()]
    size = train.agg(F.sum(F.octet_length("text"))).first()[0]

    def quality(net):
        ids, where, words = net.padded(held)
        return net.log_probability(ids, where, words).mean()  # with spelling: vocabularies differ

    eight, whole = (masked_lm.trained(train, task=t) for t in (size // 8, size + 1))
    part = masked_lm.trained(train.where("pmod(xxhash64(doc_id), 8) = 0"), task=size)
    part, whole, eight = quality(part), quality(whole), quality(eight)
    assert whole > eight > part + (whole - part) / 3, (whole, eight, part)
    # The mean of all, taken once, is hardly better than a part.
    once = quality(masked_lm.trained(train, slices=1, task=size // 8))
    assert eight > once + (whole - part) / 4, (eight, once)


def test_toxicity_collects_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "kind words")] * 500 + [(2, "bad words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, grade int")
    ids, rows, y = toxicity.labelled(docs, labels)
    assert ids == [1, 2] and y.tolist() == [0, 1] and len(rows) == 2


def test_toxicity_scores_match_a_plain_sum_of_weights(spark, sf):
    docs = queries.table(spark, sf, "documents")
    model = toxicity.fitted(docs, queries.severity_grades(queries.table(spark, sf, "labels")), hold_out=False)
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    for r in docs.collect():
        (f,) = toxicity.features([(r.text or "").encode()])
        score = sum(float(model.weights[i]) for i in f.tolist() if model.use is None or model.use[i])
        p = [1 / (1 + np.exp(c - score)) for c in model.cuts]
        assert got[r.doc_id].p_above == pytest.approx(p[0] if p else 0.0, abs=1e-6)
        assert got[r.doc_id].severity == pytest.approx(model.lowest + sum(p), abs=1e-6)
        assert got[r.doc_id].toxic == (got[r.doc_id].p_above >= queries.TOXIC)


def test_a_rare_language_is_known_at_any_size(spark):
    en = spark.range(30000).selectExpr("id AS doc_id", "'the dog and the cat' AS text", "'en' AS lang")
    fr = spark.range(30000, 30012).selectExpr("id AS doc_id", "'le chien et la souris' AS text", "'fr' AS lang")
    model = language.fitted(en.union(fr), "text", F.col("lang"), F.col("doc_id"))
    assert model.languages == ["en", "fr", "und"]
