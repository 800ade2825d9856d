import datetime
import re

from attesta.functions.fixed import TOKEN_WEIGHTS
from attesta.operators import context, cues, edges, gate, intake, maps, models, names, recognise


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


CAND = "batch string, cand long, kind string, topic string, why string, quotes array<string>, callsigns array<string>"
SEG = "batch string, pos long, cls string, text string"


def test_gate(spark):
    segs = spark.createDataFrame([("b", 1, "USER", "we will ship the blue  engine\ntomorrow"), ("b", 2, "USER", "and not before"), ("b", 3, "SELF", "I think the design is sound enough"), ("b", 4, "TOOL", "error: 17 tests failed today"), ("x", 1, "USER", "another batch altogether here")], SEG)
    c = [
        (1, "fact", "engine", "shipping", ["[USER] ship the blue engine tomorrow and not"]),
        (2, "fact", "t", "w", ["ship the green engine"]),
        (3, "fact", "design", "the agent's judgement", ["[USER] the design is sound enough"]),
        (4, "fact", "design", "a fact", ["the design is sound enough"]),
        (5, "fact", "tests", "17 failed", ["[ACT] error: 17 tests failed"]),
        (6, "fact", "n", "5 engines", ["ship the blue engine tomorrow"]),
        (7, "idea", "the user", "decided to ship", []),
        (8, "Idea", "x", "maybe paint it", None),
        (9, "fact", "t", "w", ["short"]),
        (10, "fact", "t", "w", ["another batch altogether"]),
        (11, "fact", "t", "w", ["already known to the store"]),
    ]
    segs = segs.union(spark.createDataFrame([("b", 9, "USER", "this was already known to the store before")], SEG))
    cands = spark.createDataFrame([("b", i, k, t, w, q, []) for i, k, t, w, q in c], CAND)
    store = spark.createDataFrame([("it is  already known to\nthe store indeed",), (None,)], "text string")
    out = {r.cand: r for r in gate.gate(cands, segs, store).collect()}
    assert [out[i].disposition for i in range(1, 12)] == ["kept", "dropped", "kept", "dropped", "kept", "kept", "dropped", "idea", "dropped", "dropped", "dropped"]
    assert out[3].judgement and out[3].classes == ["SELF"] and out[5].classes == ["TOOL"] and not out[5].unverified_numbers and out[6].unverified_numbers
    assert out[11].why_dropped == "echo of text already in the store" and out[2].why_dropped == "quotes not found in the raw material"
    assert out[4].why_dropped == "turning the agent's own words into a fact" and out[7].why_dropped == "a factual report dressed as an idea"


def test_tags_and_callsigns(spark):
    schema = "key long, tags array<string>, evidence array<struct<class:string,text:string>>, callsigns array<string>"
    e = [("TOOL", "exit: error 3"), ("USER", "please remember this: 山小屋便り and OpenGate")]
    df = spark.createDataFrame([(1, ["commitment", "decision", "entrusted", "expired", "formative", "landmine", "recurred"], e, ["OpenGate", "山小屋便り", "opengate", "remember this", "ab", "…!!", "invented words"]), (2, ["commitment", "landmine"], [("TOOL", "all quiet")], [])], schema)
    got = rows(gate.verified_tags(df), "key", "tag", "kept", "basis_class")
    assert got == sorted([(1, "commitment", True, "USER"), (1, "decision", True, None), (1, "entrusted", True, "USER"), (1, "expired", False, None), (1, "formative", True, "TOOL"), (1, "landmine", True, "TOOL"), (1, "recurred", False, None), (2, "commitment", False, None), (2, "landmine", False, None)], key=str)
    calls = {r.text: r.refused for r in gate.callsigns(df).collect()}
    assert calls["OpenGate"] is None and calls["山小屋便り"] is None and calls["remember this"].startswith("at most two") and calls["ab"].startswith("a callsign") and calls["invented words"].startswith("needs the human") and calls["…!!"].startswith("whitespace")


MEM = "slug string, title string, hook string, body string"


def test_lookup_is_silent_unless_sure(spark):
    mem = spark.createDataFrame([("oak-shelf", "Oak shelf", "boards of four inches on iron", "the oak shelf holds jars"), ("blue-engine", "Blue engine", "ships in May", "[[oak-shelf]] engine"), ("go", "Go", "a board game", "stones"), ("red-engine", "Red engine", "ships in June", "engine")], MEM)
    q = spark.createDataFrame([("1", "what is oak-shelf?"), ("2", "tell me about the Blue engine"), ("3", "the category of mango trees"), ("4", ""), ("5", "concerts at Lisbon")], "q string, question string")
    got = {r.q: (r.verdict, r.slug) for r in recognise.lookup(mem, q, top=1).collect()}
    assert got["1"] == ("ok", "oak-shelf") and got["2"] == ("ok", "blue-engine") and got["4"] == ("untestable", None) and got["5"][0] in ("untestable", "no-confident-hit") and got["3"][1] is None
    assert ("go", "3") not in rows(recognise.cited(mem, q), "slug", "q")


def test_resolve_and_walk(spark):
    slugs = spark.createDataFrame([("oak-shelf-plan",), ("Blue-Engine",), ("a",), ("b",), ("c",)], "slug string")
    titles = spark.createDataFrame([("the blue one", "Blue-Engine"), ("ghost", "gone")], "title string, slug string")
    n = spark.createDataFrame([(x,) for x in ("oak-shelf-plan.md", "[[The Blue One]]", "blue-engine", "oak-shelf-kitchen-plan", "zzz", "ghost", " ")], "name string")
    got = {r.name: (r.slug, r.tier) for r in names.resolve(n, slugs, titles).collect()}
    assert got == {"oak-shelf-plan.md": ("oak-shelf-plan", "exact"), "[[The Blue One]]": ("Blue-Engine", "title"), "blue-engine": ("Blue-Engine", "case"), "oak-shelf-kitchen-plan": ("oak-shelf-plan", "overlap"), "zzz": (None, "none"), "ghost": (None, "none")}
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("q", "a")], "q string, slug string")
    assert rows(names.walk(start, links, 1), "slug", "depth") == [("a", 0), ("b", 1)]
    assert rows(names.walk(start, links, 5), "slug", "depth") == [("a", 0), ("b", 1), ("c", 2)]


def test_sectors_with_grouped_lines_and_unindexed_memories(spark):
    lines = spark.createDataFrame(list(enumerate(["# store", "- [A](a.md) — x", "## One", "- pair — [B](b.md)/[C](c.md)", "## Two", "- [A again](a.md) — y", "- [Gone](gone.md) — z", "## Empty"])), "line_no int, line string")
    slugs = spark.createDataFrame([(s,) for s in "abcd"], "slug string")
    got = {r.sector: (r.n, r.titles) for r in names.sectors(lines, slugs).collect()}
    assert got == {"UNSECTIONED": (2, "A"), "One": (2, "B / C"), "Two": (0, ""), "Empty": (0, "")}


def test_edges(spark):
    body = "\n".join(["superseded by [[b]]", "却下 [[b]]", "blocked, see [[c]]", "次= [[b]]", "continues [[a]]", "retired (→ c)", "continues [[nowhere]]", "廃案 (→ d)", "plain [[c]]"])
    mem = spark.createDataFrame([("a", body), ("b", ""), ("c", ""), ("d", "")], "slug string, body string")
    resolved = spark.createDataFrame([(x, x) for x in "abcd"], "name string, slug string")
    classes = spark.createDataFrame([("a", ["USER", "TOOL"])], "slug string, classes array<string>")
    out = edges.derive(mem, resolved, classes)
    got = rows(out, "target", "type", "outcome", "evidence")
    assert got == sorted([("b", "supersedes", "edge", "USER"), ("b", "rejected", "edge", "USER"), ("c", "blocked-by", "edge", "USER"), ("b", "next", "edge", None), ("a", "continues", "self", None), ("c", "supersedes", "edge", "USER"), ("nowhere", "continues", "unknown-target", None), ("d", "supersedes", "not-linked", None)], key=str)
    assert {r.outcome for r in edges.derive(mem, resolved, classes.limit(0)).where("type = 'rejected'").collect()} == {"unevidenced"}


def test_ages_and_trail(spark):
    day = datetime.date(2024, 3, 10)
    mem = spark.createDataFrame([("a", "made 2024-03-01, plan 2024-05-01", "user", None), ("b", "2024-03-11 local", "x", None), ("c", "no date", "x", datetime.datetime(2024, 3, 9)), ("d", "none", "x", datetime.datetime(2024, 1, 1)), ("e", "none", "x", datetime.datetime(2024, 1, 1, 5))], "slug string, body string, type string, mtime timestamp")
    got = dict(rows(maps.ages(mem, day, when="mtime"), "slug", "age"))
    assert got == {"a": 9, "b": 0, "c": 1, "d": float("inf"), "e": float("inf")}
    layered = maps.layers(mem, maps.ages(mem, day, when="mtime"))
    assert dict(rows(layered, "slug", "layer")) == {"a": "pinned", "b": "fresh", "c": "fresh", "d": "trigger", "e": "trigger"}
    lines = spark.createDataFrame([("b", 1, "x" * 300), ("c", 2, "y" * 100)], "slug string, line_no int, line string")
    assert [r.slug for r in maps.trail(layered, lines, tokens=50).collect()] == ["b"]
    assert len(maps.trail(layered, lines, tokens=500).collect()) == 2


def test_trims_never_lie():
    desc = "The crossing took 512.5 seconds with kx7-ab9, ⚠ past 18,200 buoys → 4.9 GB (and every captain has a story about it that goes on for hours) — nobody was hurt"
    for budget in (6, 8, 12, 16, 24):
        t = maps.trimmed(desc, "Crossing", budget)
        assert t and set(maps._canonical_numbers(t)) <= set(maps._canonical_numbers(desc)) and t.count("(") == t.count(")")
    assert maps.trimmed("short", "t") == "short"
    assert maps.salient("4.9 moor, 18.5 GB and ⚠ tin_cup") == ["18.5 GB", "moor", "and", "tin_cup", "⚠️"]
    assert len(TOKEN_WEIGHTS) == 6


def test_first_violation(spark):
    from pyspark.sql import functions as F

    desc = "crossing of kx7-ab9 took 512 s, not 640 s; 3 → 8, superseded"
    cases = [("", "empty"), ("memo", "dead word"), ("★Crossing", "restates the title"), ("crossing took 513 s, not superseded", "invented number: 513"), ("took 640 s, not 512GB, superseded", "number re-bound: 512|GB"), ("8 → 3 not superseded", "arrow reversed or invented: 8→3"), ("the user decided: not superseded", "credits the human where the line does not"), ("★ crossing not superseded", "invented marker ★"), ("crossing [[x]] not superseded", "invented link [[x]]"), ("crossing of kx7-ab not superseded", "cut or invented identifier: kx7-ab"), ("never not superseded", "negation invented: never"), ("crossing took 512 s superseded", "negation dropped"), ("crossing took 512 s, not 640 s", "retirement word dropped"), ("not superseded zzzz yyyy xxxx", "ungrounded (2-gram overlap below the floor)"), ("crossing took 512 s, not 640 s; superseded", None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = df.select("i", maps.first_violation(F.col("c"), F.lit("Crossing"), F.lit(desc)).alias("why")).orderBy("i").collect()
    assert [r.why for r in got] == [w for _, w in cases]


def test_fit_keeps_what_answers(spark):
    from pyspark.sql import functions as F

    text = "---\nname: x\n---\n\n" + "\n\n".join(["filler " * 30, "the answer is blue engine", "more filler " * 40, "blue again"])
    df = spark.createDataFrame([(text, "which blue engine?", 200), ("short", "q", 10)], "t string, q string, n int")
    out, same = (r.f for r in df.select(context.fit(F.col("t"), context.terms(F.col("q")), F.col("n")).alias("f")).collect())
    assert "the answer is blue engine" in out and "blue again" in out and out.endswith("…(trimmed)") and out.index("answer") < out.index("again")
    assert same == "short"


def test_context_ceiling(spark):
    walked = spark.createDataFrame([("q", i, f"m{i}", "what", "word " * 60) for i in range(5)], "q string, rank int, slug string, question string, body string")
    r = context.assembled(walked, "s", chars=400, total=700).first()
    assert len(r.context) <= 700 and r.included == ["m0", "m1"] and r.left_out == ["m2", "m3", "m4"]
    tiny = context.assembled(walked, "s", total=90).first()
    assert len(tiny.context) <= 90 and tiny.included == ["m0"] and "(truncated)" in tiny.context


def test_cues(spark):
    routes = spark.createDataFrame([("River Gate", "a", "1"), ("river  gate", "a", "0"), ("larch", "b", "2"), ("shared", "a", "3"), ("shared", "b", "4"), ("山小屋便り", "c", "5")], "text string, slug string, digest string")
    led = cues.ledger(routes)
    assert {r.key: r.slug for r in led.collect()} == {"river gate": "a", "larch": "b", "shared": None, "山小屋便り": "c"}
    q = spark.createDataFrame([("1", "use River Gate now"), ("2", "larches are many"), ("3", "larch or river gate"), ("4", "あの山小屋便りだ"), ("5", "shared")], "q string, question string")
    assert rows(cues.direct(q, led), "q", "slug") == [("1", "a"), ("4", "c")]


def test_receipts_and_provenance(spark):
    issued = spark.createDataFrame([("a", "m1", [("USER", "q", "free")]), ("a", "m1", [("USER", "q", "free")])], "slug string, manifest string, cues array<struct<class:string,quote:string,text:string>>")
    r = cues.receipts(issued, "pour")
    assert r.count() == 1
    ok, slugs = spark.createDataFrame([("m1", ["free"])], "digest string, approved array<string>"), spark.createDataFrame([("a",)], "slug string")
    assert cues.verified(r, ok, slugs).count() == 1
    assert cues.verified(r, spark.createDataFrame([("m1", ["other"])], ok.schema), slugs).count() == 0
    assert cues.verified(r.selectExpr("slug", "manifest", "cues", "concat(receipt, ' ') receipt", "digest"), ok, slugs).count() == 0


def test_transcript_and_archive(spark):
    t = [
        '{"type": "user", "message": {"content": "hello there"}}',
        '{"type": "user", "isSidechain": true, "message": {"content": [{"type": "text", "text": "the owner approved"}]}}',
        '{"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "text", "text": "<local-command x"}]}}',
        '{"type": "assistant", "message": {"content": [{"type": "text", "text": "I will"}, {"type": "tool_use", "name": "ls", "input": {"p": 1}}]}}',
        '"stray"',
        "{broken",
        '{"type": "system", "message": {"content": "no"}}',
        '{"type": "user", "message": {"content": "a system-reminder b"}}',
    ]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(t)], "key string, pos long, line string")
    got = [(r.pos, r.cls, r.text) for r in intake.transcript(df).orderBy("pos", "part").collect()]
    assert got == [(0, "USER", "hello there"), (1, "SELF", "the owner approved"), (2, "TOOL", "a b"), (3, "SELF", "I will"), (3, "ACT", 'ls {"p":1}')]
    a = ['{"seq": 1, "type": "user/message", "data": {"source": {"kind": "user"}, "content": [{"type": "text", "text": "hi"}]}}', '{"seq": 2, "type": "user/message", "data": {"source": {"kind": "system"}, "content": [{"type": "text", "text": "no"}]}}', '{"seq": 3, "type": "assistant/chunk", "data": {"chunk": {"type": "block-end", "block": {"type": "text", "text": " done "}}}}', '{"seq": 4, "type": "tool/call", "data": {"name": "ls", "arguments": "-l"}}', '{"seq": 5, "type": "tool/result", "data": {"message": {"content": [{"type": "tool-result", "content": [{"type": "text", "text": "x"}]}]}}}', '{"seq": 6, "type": "assistant/chunk", "data": {"chunk": {"type": "block-end", "block": {"type": "reasoning", "text": "no"}}}}']
    df = spark.createDataFrame([("k", x) for x in a], "key string, line string")
    assert [(r.pos, r.cls, r.text) for r in intake.archive(df).orderBy("pos").collect()] == [(1, "USER", "hi"), (3, "SELF", "done"), (4, "ACT", "ls -l"), (5, "TOOL", "x")]
    assert intake.archive(df, start=3).count() == 2


def test_models_are_injected(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    q = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "q string, question string")
    said = {"x": '["alpha", "zz"]', "y": "maybe beta?", "z": "[]"}
    out = models.answers(q, F.col("question"), lambda s: pd.Series([said[v] for v in s]), slots=2)
    slugs = spark.createDataFrame([("alpha",), ("beta",)], "slug string")
    assert rows(models.picks(out, slugs), "q", "rank", "slug") == [("1", 1, "alpha"), ("2", 1, "beta"), ("3", 1, None)]
    assert {r.answer for r in models.answers(q, F.col("question")).collect()} == {None}


def test_echoes_of_any_length(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    some = ["abc", "abcdef", "bcdefg", "x", "yy", "zzz", "abcdefghij", "de"]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randint(0, 9))) for _ in range(60)] + [None]
    quotes = [" ".join(rnd.choice([*some, "bc", "abcde", "ij x"]) for _ in range(rnd.randint(1, 4))) for _ in range(120)] + ["", "nothing", "abc  def", None]
    q, t = spark.createDataFrame([(x,) for x in quotes], "quote string"), spark.createDataFrame([(x,) for x in texts], "text string")
    want = {x for x in quotes if x is not None and any(x in " ".join((y or "").split()) for y in texts)}
    for few in (1000, 0):
        monkeypatch.setattr(gate, "FEW", few)
        assert sorted(r.quote for r in gate.echoes(q, t).collect()) == sorted(want)
    assert gate.echoes(q, t.where("false")).count() == gate.echoes(q.where("false"), t).count() == 0


def test_names_are_known_in_any_form(spark):
    mem = spark.createDataFrame([("full-street", "Straße", "the long road to the mill", "x"), ("other", "Other", "nothing of the kind", "y")], MEM)
    q = spark.createDataFrame([("1", "ＦＵＬＬ-ＳＴＲＥＥＴ?"), ("2", "where is the STRASSE"), ("3", "die straße")], "q string, question string")
    assert {(r.q, r.slug) for r in recognise.cited(mem, q).collect()} == {(i, "full-street") for i in "123"}
    led = cues.ledger(spark.createDataFrame([("Ｒｉｖｅｒ Straße", "a", "1")], "text string, slug string, digest string"))
    assert [r.key for r in led.collect()] == ["river strasse"]
    asked = spark.createDataFrame([("1", "to River  STRASSE now")], "q string, question string")
    assert rows(cues.direct(asked, led), "q", "slug") == [("1", "a")]
    e = spark.createDataFrame([(1, ["ﬁ"], [("USER", "the ﬁ one")])], "key long, callsigns array<string>, evidence array<struct<class:string,text:string>>")
    assert gate.callsigns(e).first().refused.startswith("a callsign")  # two letters


def test_prefill_size_is_that_of_the_text(spark):
    lines = [(1, "- [a](b.md) {{x}} — ひらカタ漢字"), (2, "{{{ }}} {"), (3, "}"), (4, None), (5, ""), (6, "、ｱé\n{{")]
    for some in (lines, lines[:1], []):
        df = spark.createDataFrame(some, "line_no long, line string")
        assert maps.prefill_size(df, "docs", "Head\n").first() == maps.prefill(df, "docs", "Head\n").select("escapes", "tokens").first()
    big = spark.createDataFrame(lines, "line_no long, line string")
    assert "collect_list" not in maps.prefill_size(big, "docs", "Head")._jdf.queryExecution().optimizedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_fallback_deals_lines_once(spark):
    lines = spark.createDataFrame([(1, "- [Oak](oak.md) — oaks, an oak"), (2, "- [Elm](elm.md) — soaked"), (3, "oak, without a link")], "line_no long, line string")
    found = recognise.by_words(lines, spark.createDataFrame([("1", "Oak oak?"), ("2", "or")], "q string, question string"))
    assert rows(found, "q", "rank", "slug", "hits") == [("1", 1, "oak", 8), ("1", 2, "elm", 2)]
    assert not re.search(r"hashpartitioning\(q#\d+L?, line_no", plan_of(found))


def test_votes_are_those_of_every_pair_and_only_the_best_leave_a_cell(spark):
    """Against a plain count over all pairs; equal memories are ranked by slug, and a question's others stay in the cell."""
    import math
    import re

    from attesta.functions.fixed import HEAD_WEIGHTS, TOKEN

    names = ["oak road", "elm lane 4", "fir 𝒳 hill", "ash end", "yew"]
    bodies = {f"m-{i:03}": (names[i % 5], f"{names[i % 5]} by the {names[(i * 7) % 5]} {i % 3}") for i in range(40)} | {"odd one": ("Straße.", "ÄÖ  x"), "none": ("", "")}
    asked = {"a": "Where is m-007 of oak road?", "b": "elm lane 4", "c": "zz", "d": "", "e": "the strasse 𝒳 hill"}
    mem = spark.createDataFrame([(s, t, b, b) for s, (t, b) in bodies.items()], "slug string, title string, hook string, body string")
    q = spark.createDataFrame(list(asked.items()), "q string, question string")

    def grams(text, n):
        t = re.sub(r"\s+", " ", text.casefold()).strip()
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    def heads(meta, opening):
        return {"word": set(re.findall(TOKEN, meta.casefold())), "char3": grams(meta, 3), "char2": grams(meta, 2), "body": grams(opening, 3)}

    held = {s: heads(f"{t} {b}", b) for s, (t, b) in bodies.items()}
    cited = {(r.q, r.slug): r.score for r in recognise.cited(mem, q).collect()}
    want = {}
    for k, text in asked.items():
        has, best = heads(text, text), max([v for (x, _), v in cited.items() if x == k], default=0)
        for s in bodies:
            score, voted = (HEAD_WEIGHTS["name"] * cited[k, s] / best, True) if (k, s) in cited else (0, False)
            for h, of_q in has.items():
                df = {g: sum(g in x[h] for x in held.values()) for g in of_q}
                idf = {g: math.log(len(bodies) / df[g]) if df[g] else math.log(len(bodies)) for g in of_q if df[g] < 3 or df[g] / len(bodies) <= 0.2}
                common = idf.keys() & held[s][h]
                score, voted = score + HEAD_WEIGHTS[h] * sum(idf[g] for g in common) / sum(idf.values()) if common else score, voted or bool(common)
            if voted:
                want[k, s] = score
    got = {(r.q, r.slug): r.score for r in recognise.votes(mem, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in want)
    few = recognise.votes(mem, q, top=3).collect()
    for k in asked:
        best = sorted((-got[x], x[1]) for x in got if x[0] == k)[:3]
        mine = [(-r.score, r.slug) for r in few if r.q == k]
        assert sorted(mine)[:3] == best and len(mine) <= 3  # one cell
    assert recognise.votes(mem.limit(0), q).count() == 0


def test_names_of_several_words_meet_texts_by_their_first_words(spark):
    """Against containment of all pairs; the join's rows are pairs that share more than a first word."""
    import random

    rnd = random.Random(2)
    some = ["a", "ab", "(ab", "b-a", "é", "éa", "abc", "ca"]
    line = lambda n: " ".join(rnd.choice(some) for _ in range(n))
    texts = {str(i): line(rnd.randint(0, 7)) for i in range(60)}
    names = sorted({line(rnd.randint(1, 5)) for _ in range(150)} | {"b ab", "c a", "a  b"})
    t = spark.createDataFrame(list(texts.items()), "q string, t string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    want = sorted((q, x) for q, text in texts.items() for x in names if " " in x and x in text)
    found = recognise.containing(t, n, "name")
    assert sorted((r.q, r.name) for r in found.collect()) == want
    asked, led = t.withColumnRenamed("t", "question"), n.where("name not like '%  %'").selectExpr("name text", "name slug", "name digest")
    bound = lambda x, text: bool(re.search(rf"(?<![a-z0-9-]){re.escape(x)}(?![a-z0-9-])", text)) if re.search("[a-z0-9]", x) else x in text
    hits = {q: [x for x in names if "  " not in x and bound(x, text)] for q, text in texts.items()}
    assert {r.q: r.slug for r in cues.direct(asked, cues.ledger(led)).collect()} == {q: x[0] for q, x in hits.items() if len(x) == 1}


def test_cited_meets_by_equal_keys_only(spark, tmp_path):
    import random

    rnd = random.Random(12)
    name = lambda: "".join(rnd.choice("ab-c/_.é山小") for _ in range(rnd.randint(2, 6)))
    long = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    slugs = sorted({name() for _ in range(150)} | {"oak-shelf", "full/oak-shelf", "山小屋", "a.b"})
    titles = [rnd.choice(["Oak shelf", "ab", "abc", "b c", "the b c", "c/a é", "", long[1000:1100], long[50:90] + " c", "x" * 40 + " b c d", "no where"]) for _ in slugs]
    texts = [" ".join(rnd.choice([*slugs, "abcé", "b", "c", "the", "c.", "xabcx"]) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    texts += ["an OAK  shelf", "the oak-shelf", "ab" + long + " cd", long[:90] + " cc", "y" + "x" * 70 + " b c dd", "x" * 39 + " b c d", None, "", texts[0]]
    mem = spark.createDataFrame([(s, t, "", "") for s, t in zip(slugs, titles, strict=True)], MEM)
    mem.write.parquet(f"{tmp_path}/mem")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "q string, question string").repartition(8).write.parquet(f"{tmp_path}/q")
    mem, q = spark.read.parquet(f"{tmp_path}/mem"), spark.read.parquet(f"{tmp_path}/q")

    def word(x, t):
        return len(x) >= 3 and re.search(rf"(?<![a-z0-9-]){re.escape(x)}(?![a-z0-9-])", t) is not None

    want = {}
    for i, t in enumerate(texts):
        t = " ".join((t or "").lower().split())
        for s, title in zip(slugs, titles, strict=True):
            base, title = s.rsplit("/", 1)[-1], re.sub(r"^\W+|\W+$", "", title.lower())
            n = word(s, t) + (base != s and re.fullmatch("[a-z0-9-]+", base) is not None and word(base, t)) + (len(title) >= 3 and title in t)
            if n:
                want[str(i), s] = n
    out = recognise.cited(mem, q)
    assert {(r.q, r.slug): r.score for r in out.collect()} == want and len(want) > 200 and out.count() == len(want)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan  # tasks would grow with the square of the tables
    # A repeated question or memory counts each title once, each slug as often as it stands there.
    twice = {(r.q, r.slug): r.score for r in recognise.cited(mem.union(mem), q).collect()}
    assert twice.keys() == want.keys() and all(want[k] <= v <= 2 * want[k] for k, v in twice.items())
