"""Spelling variants against plain counting and comparing."""

import random
import re
import zlib
from collections import Counter

import pytest

from attesta.llm import spelling
from attesta.llm.queries import op13_spelling_variants
from attesta.llm.spelling import Trie, rooted, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """The contract, word for word; docs of (id, text)."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    holes = {}  # a word with a letter taken out at a place: words one insertion or replacement apart share one
    for w in words:
        for i in range(len(w)):
            holes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    near = {w: {x for i in range(len(w)) for x in holes[w[:i] + w[i + 1 :]]} | holes.get(w, set()) | {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}
    near = {w: [x for x in xs if x in words and one_edit(w, x)] for w, xs in near.items()}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w] or "", words.get(form[w], 0), root(w)) for w, n in words.items())


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefé"])
def test_trie_finds_every_word_one_edit_away_once(letters):
    rnd = random.Random(1)

    def word():
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))

    for _ in range(30):
        words = sorted({word() for _ in range(60)})
        trie = Trie(words, [1] * len(words))
        for w in words + [word() for _ in range(40)]:
            assert sorted(x for x, _ in trie.near(w)) == [x for x in words if one_edit(w, x)]


def made(seed=5, docs=60):
    rnd = random.Random(seed)
    base = ["harbour", "harbor", "harbours", "weather", "weathers", "Ärzteblatt", "colour", "colours", "color", "straße", "kitten", "mitten", "bitten", "x" * 3000]
    out = []
    for i in range(docs):
        words = []
        for _ in range(80):
            w = base[min(int(rnd.expovariate(0.4)), len(base) - 1)]
            if rnd.random() < 0.1:
                at = rnd.randrange(min(len(w), 12))
                w = rnd.choice((w[:at] + w[at + 1 :], w[:at] + rnd.choice("aeé") + w[at:], w[:at] + rnd.choice("st") + w[at + 1 :]))
            words.append(rnd.choice((w, w.upper() if w.isascii() else w, w.capitalize())))
        out.append((i, rnd.choice((" ", ", ", "-", "1")).join(words)))
    return out


def test_small_shards_and_groups(spark, monkeypatch):
    docs = made()
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    whole = got(variants(table))
    assert whole == brute(docs) and any(r[3] for r in whole) and max(r[2] for r in whole) > 2
    monkeypatch.setattr(spelling, "SHARD", 7)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 3000)
    monkeypatch.setattr(spelling, "TASK", 20)
    assert got(variants(table)) == whole


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert variants(spark.createDataFrame([], schema)).count() == 0
    assert variants(spark.createDataFrame([(1, None), (2, ""), (None, "1 2 3")], schema)).count() == 0
    docs = [(None, "planet planet"), (1, "planet " * 30), (1, "planet " * 30), (2, "planets " * 5), (3, "PLANETÉ×÷ " * 5), (4, None)]
    assert got(variants(spark.createDataFrame(docs, schema))) == brute(docs)
    long = [(1, "letter " * 100_000 + "lettre " * 6)]
    assert got(variants(spark.createDataFrame(long, schema))) == brute(long)


def test_ties_take_the_smallest(spark):
    docs = [(1, "battle " * 50 + "cattle " * 50 + "rattle " * 5 + "tattle " * 49)]
    rows = {r.word: (r.n_near, r.form) for r in variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {"battle": (3, None), "cattle": (3, None), "rattle": (3, "battle"), "tattle": (3, None)}


def test_long_chains_of_forms(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in rooted(chain).collect()} == {"w21"}


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op13_spelling_variants(spark, sf)) == brute(docs)
