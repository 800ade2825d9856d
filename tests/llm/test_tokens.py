import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from attesta.llm import queries
from attesta.llm.token_counts import TokenRollup, counted
from attesta.llm.token_files import EliasFano, TokenFile, dump, export, read_ids, token_files, write_ids
from attesta.llm.tokens import Encoder, public_tokenizer

ODD = ["", " ", "  a  b", "a \n b", "a\nb\n\nc", "x\xa0 y \x85z", "it's <|endoftext|> we 've  ok ", "tab\t x", " lead", "trail ", "a　 b   c", "é à 12 3a ,,, ..", "a\x1c b \x1d", "日本 語 です", "q" * 5000 + " r", "\n\n x", "a \n\n", "ok\r\nok \rx", "w " * 3000]


def brute(rows):
    t, at, out = Tokenizer.from_file(public_tokenizer()), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_pieces_give_the_ids_of_whole_texts(spark, sf):
    e = Encoder(public_tokenizer())
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]]
    whole = [x.ids for x in e.model.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == whole


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [2**40], list(range(0, 90000, 7)), [5, 5, 6, 2**33, 2**33 + 1], [0] * 700 + [10**6] * 700])
def test_elias_fano(values):
    x = EliasFano.of(np.array(values, np.int64))
    y, end = EliasFano.load(b"ab" + x.dump(), 2)
    assert y.all().tolist() == values and [y.select(i) for i in range(len(values))] == values
    assert end == len(x.dump()) + 2
    if len(values) > 1000:
        assert 8 * len(x.dump()) < len(values) * (3 + np.log2(values[-1] / len(values) + 1)) + 400


def test_token_file_round_trip(tmp_path):
    for ids in ([None, None, -5, 3, 3, 2**60], [5, 1, None]):
        docs = [np.arange(n, dtype="<u2").tobytes() for n in range(len(ids))]
        export(dump(ids, docs, 2), str(tmp_path / "x"))
        f = TokenFile((tmp_path / "x").read_bytes())
        assert f.doc_ids == ids and [f.document(i).tobytes() for i in range(f.n)] == docs


def test_op6_matches_brute_force(spark, sf):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = queries.op6_token_ids(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_token_files_edge_cases(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (50, None), (51, "same"), (51, "same")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, part int, shard string")
    write_ids(df, str(tmp_path / "t"), public_tokenizer(), shard=50)
    got = sorted((tuple(r)[:4] for r in read_ids(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert token_files(df.limit(0), public_tokenizer()).count() == 0


def test_another_splitter_is_recognised(tmp_path):
    from tokenizers import pre_tokenizers

    t = Tokenizer.from_file(public_tokenizer())
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "t.json"))
    e = Encoder(str(tmp_path / "t.json"))
    whole = [x.ids for x in t.encode_batch(ODD, add_special_tokens=False)]
    assert not e.cuts and [np.frombuffer(x, e.dtype).tolist() for x in e.encode(ODD)] == whole


def test_rollup(spark, tmp_path):
    schema = "op string, source string, lang string, version string, n_tokens long, old_tokens long, doc_id long"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    r = TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = frame(("insert", "a", "en", "v1", 10, None, 1), ("insert", "a", "en", "v1", 5, None, 2), ("INSERT", None, None, None, 7, None, 3), (None, "a", "en", "v1", 9, 9, 4), ("odd", "a", "en", "v1", 9, 9, 4), ("insert", "a", "en", "v1", None, None, 5))
    second = frame(("delete", "a", "en", "v1", 5, None, 2), ("revise", "a", "en", "v1", 12, 10, 1), ("insert", "b", "de", "v1", 1, None, 6), ("delete", "b", "de", "v1", 1, None, 6))
    got = lambda: sorted((tuple(x) for x in r.totals().collect()), key=str)
    assert r.commit("1", first) and not r.commit("1", first)
    assert got() == sorted([("a", "en", "v1", 3, 15), (None, None, None, 1, 7)], key=str)
    assert r.commit("2", second) and not r.commit("2", second)
    want = sorted([("a", "en", "v1", 2, 12), (None, None, None, 1, 7)], key=str)
    assert got() == want
    r.compact()
    assert got() == want and not r.commit("2", second) and r.committed() == {"1", "2"}
    r.commit("3", frame(("insert", "a", "fr", "v2", 4, None, 9)))
    r.compact()
    assert got() == sorted([*want, ("a", "fr", "v2", 1, 4)], key=str)
    assert r.commit("../a b/%", first.limit(0)) and not r.commit("../a b/%", first) and "../a b/%" in r.committed()
    (tmp_path / "r/batches/b-4").mkdir()  # a driver lost before the mark
    assert r.commit("4", first.limit(0)) and len(got()) == 3


def test_op5_matches_brute_force(spark, sf):
    t = Tokenizer.from_file(public_tokenizer())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x, n = labels.get(r.doc_id), len(t.encode(r.text, add_special_tokens=False).ids)
        if x and x.toxic:
            continue
        c = want.setdefault((r.source, r.lang), [0, 0])
        c[0] += 1
        c[1] += n + bool(x and x.quality == 1)
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in queries.op5_token_counts(spark, sf).collect()}
    assert got == want


def test_counted_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a b", None)], "doc_id long, text string, n_tokens string")
    assert sorted((r.doc_id, r.n_tokens, r.version) for r in counted(df, public_tokenizer(), "v").collect()) == [(1, 0, "v"), (2, 2, "v")]


def test_new_words_of_plain_letters_meet_no_pattern(monkeypatch):
    from attesta.llm import tokens

    calls = []
    for name in ("_LETTERS", "_MARKED"):
        monkeypatch.setattr(tokens, name, lambda p, is_=getattr(tokens, name): calls.append(p) or is_(p))
    model = tokens.Encoder(tokens.public_tokenizer())
    plain = "the " + " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))
    others = ["w\u00f6rter \u03b1\u03b2\u03b3 \u4e2d\u6587 caf\u00e9, na\u00efve! \u01c0x", "a b\nc \nd, e\n\nf 12 3. x-y; " + "z" * 60 + ". " + "y" * 60, "lone. lone ; . \u2028 q", ""]
    assert model.encode([plain, *others]) == [np.array(model.model.encode(t, add_special_tokens=False).ids, model.dtype).tobytes() for t in [plain, *others]]
    assert not [p for p in calls if p in plain.split()]
