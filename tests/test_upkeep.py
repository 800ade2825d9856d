"""Signatures, receipts, drafts, prefixes by budget, novelty, quiet passes and derived maps, against plain Python."""

import datetime
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.seal import hmac_sha256
from attesta.operators import budget, drafts, novelty, receipts, tidy
from attesta.sources import logs
from attesta.sources.derived import Derived, digest
from attesta.sources.writer import Refused, StoreTable
from attesta.streaming import tracks

KEY = b"k" * 20


# Signatures


@pytest.mark.parametrize("size", [0, 1, 20, 64, 65, 200])
def test_hmac(spark, size):
    key = bytes(range(256))[:size]
    texts = ["", "a", "Straße 東京 \x00\x1f", "x" * 10_000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hmac_sha256(key, F.col("t")).alias("m")).collect()
    assert [r.m for r in rows] == [None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


# Receipts


def cue(text, quote="we call it the old mill, always", cls="USER"):
    return {"text": text, "class": cls, "quote": quote}


def paper(digest_, slug="mill", version=1, approved=None, quotes=None):
    quotes = [("USER", "we call it the old mill, always")] if quotes is None else quotes
    return (digest_, slug, version, approved if approved is not None else [cue("the old mill")], [{"class": c, "text": t} for c, t in quotes])


PAPERS = f"digest string, memory_slug string, version int, approved {receipts.CUES}, quotes array<struct<class:string,text:string>>"
WANTED = f"slug string, manifest string, cues {receipts.CUES}"


def test_receipts_are_issued_once(spark):
    rows = spark.createDataFrame([("mill", "sha256:" + "a" * 64, [cue("the old mill")])] * 2 + [("mill", "sha256:" + "b" * 64, None), ("x", None, [cue("")]), (None, None, [cue("y")])], WANTED)
    first = receipts.issued(rows, KEY, "new")
    got = first.collect()
    assert sorted((r.slug or "", r.manifest or "", len(r.cues)) for r in got) == [("", "", 1), ("mill", "sha256:" + "a" * 64, 1)]
    assert receipts.issued(rows, KEY, "new", held=first).count() == 0 and receipts.issued(rows, KEY, "extends", held=first).count() == 2
    with pytest.raises(Refused):
        receipts.issued(rows, KEY, "new", policy="frozen")


def test_fields_do_not_run_into_one_another(spark):
    rows = spark.createDataFrame([("a\x1fb", "c", [cue("x")]), ("a", "b\x1fc", [cue("x")]), (None, "c", [cue("x")]), ("\x1b0", "c", [cue("x")]), ("a", "c", [cue("x\x1dUSER")]), ("a", "c", [cue("x", "USER\x1d", None)])], WANTED)
    assert len({r.digest for r in receipts.issued(rows, KEY, "new").collect()}) == 6


@pytest.mark.parametrize(
    ("fault", "change"),
    [
        (None, {}),
        ("not its digest", {"digest": "0" * 64}),
        ("not signed", {"mark": "0" * 64}),
        ("not its digest", {"slug": "other"}),
        ("unknown memory", {"slugs": ["other"]}),
        ("no manifest", {"paper": paper("b" * 64)}),
        ("another version", {"paper": paper("a" * 64, version=2)}),
        ("another memory", {"paper": paper("a" * 64, slug="other")}),
        ("cue not approved", {"paper": paper("a" * 64, approved=[cue("old mill")])}),
        ("cue not approved", {"paper": paper("a" * 64, quotes=[("SELF", "we call it the old mill, always")])}),
        ("cue not approved", {"cue": cue("the new mill"), "paper": paper("a" * 64, approved=[cue("the new mill")])}),
        ("cue not approved", {"cue": cue("we"), "paper": paper("a" * 64, approved=[cue("we")])}),
        ("cue not approved", {"cue": cue("the old mill", "the old mill, they say"), "paper": paper("a" * 64, approved=[cue("the old mill", "the old mill, they say")])}),
    ],
)
def test_receipts_are_verified(spark, fault, change):
    made = receipts.issued(spark.createDataFrame([("mill", "sha256:" + "a" * 64, [change.get("cue", cue("the old mill"))])], WANTED), KEY, "new")
    for c in ("digest", "mark", "slug"):
        if c in change:
            made = made.withColumn(c, F.lit(change[c]))
    papers = spark.createDataFrame([change.get("paper", paper("a" * 64))], PAPERS)
    slugs = spark.createDataFrame([(s,) for s in change.get("slugs", ["mill", "other"])], "slug string")
    out = receipts.checked(made, papers, slugs, KEY)
    assert [r.fault for r in out.collect()] == [fault]
    assert receipts.routes(out).count() == (fault is None)


# Drafts


def test_drafts_take_free_names(spark):
    rows = spark.createDataFrame([(i, b, "project", "m", "text") for i, b in enumerate(["a", "b", "a", "a", "c", "a"])], "cand long, slug string, kind string, manifest string, body string")
    taken = spark.createDataFrame([("a",), ("a.3",), ("a.4",), ("c.2",), ("c.2",)], "slug string")
    assert [r.slug for r in drafts.staged(rows, KEY).orderBy("cand").collect()] == ["a", "b", "a.2", "a.3", "c", "a.4"]
    assert [r.slug for r in drafts.staged(rows, KEY, taken).orderBy("cand").collect()] == ["a.2", "b", "a.5", "a.6", "c", "a.7"]


def test_headers(spark):
    bodies = ["TITLE: a\nDESC: b c\n\nKEEP: no\ntext\n\nTITLE: not one", "plain\nTITLE: x", "\n\nEXTENDS: old\ntext", "", "TAGS:\n\n"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = rows.select(drafts.header(F.col("body"), "TITLE").alias("t"), drafts.header(F.col("body"), "EXTENDS").alias("e"), drafts.header(F.col("body"), "TAGS").alias("g"), drafts.text_of(F.col("body")).alias("x")).collect()
    assert [tuple(r) for r in got] == [("a", None, None, "text\n\nTITLE: not one"), (None, None, None, "plain\nTITLE: x"), (None, "old", None, "text"), (None, None, None, ""), (None, None, None, "")]


def test_verdicts(spark):
    answers = ["POUR\nreason: good", "I would fix this\nReason： too long\nBELONGS_BECAUSE: it matters\nBODY:\nnew\n\ntext ", "toss it", "perhaps", "", " \n", None, "TOSS or POUR", "\n pour"]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(drafts.verdict(F.col("a")).alias("v")).select("v.*").collect()
    assert [r.verdict for r in rows] == ["POUR", "FIX", "TOSS", "TOSS", "SKIP", "SKIP", "SKIP", "POUR", "TOSS"]
    assert (rows[1].why, rows[1].new_body, rows[1].belongs_because) == ("too long", "new\n\ntext", "it matters") and rows[0].new_body is None


def draft_table(spark, *bodies):
    rows = spark.createDataFrame([(i, f"d{chr(97 + i)}", "project", "m", b) for i, b in enumerate(bodies)], "cand long, slug string, kind string, manifest string, body string")
    return drafts.staged(rows, KEY).drop("cand")


PAPER = "manifest string, quotes array<struct<class:string,text:string>>"


def test_drain(spark):
    body = "TITLE: the mill\nDESC: where it stands\n\nIt stands by the river.\n"
    made = draft_table(spark, *[body] * 8, "EXTENDS: mill\n\nIt burnt down.", "TITLE: a\nTAGS: [no\n\nx", "TITLE: a\nTAGS: [\"x\"]\n\ny").orderBy("slug").collect()
    rows = [r.asDict() for r in made]
    judged = {r["slug"]: hashlib.sha256("\x1f".join(r[c] for c in ("slug", "kind", "manifest", "body", "mark")).encode()).hexdigest() for r in rows}
    says = {
        "da": "POUR",
        "db": "FIX\nBELONGS_BECAUSE: it is ours\nBODY:\nIt stands.",
        "dc": "FIX\nBODY:\nIt stands 40 m from the river.",
        "dd": "FIX\nBODY:\nThe user decided so.",
        "de": "FIX",
        "df": "TOSS",
        "dg": "POUR",
        "dh": "POUR",
        "di": "POUR",
        "dj": "POUR",
        "dk": "POUR",
    }
    rows[6]["body"] += " And more."  # edited behind its mark
    judged["dh"] = "0" * 64
    table = spark.createDataFrame([tuple(r[c] for c in ("slug", "kind", "manifest", "body", "mark")) for r in rows], "slug string, kind string, manifest string, body string, mark string")
    answers = spark.createDataFrame([(s, judged[s], a) for s, a in says.items()], "slug string, judged string, answer string")
    papers = spark.createDataFrame([("m", [("SELF", "it stands by the river")])], PAPER)
    done = drafts.drained(table, answers, papers, KEY)
    got = {r.slug: r for r in done.collect()}
    want = ["poured", "fixed", "fix refused", "fix refused", "fix unparsed", "tossed", "quarantined", "moved", "poured", "refused", "poured"]
    assert [got[f"d{chr(97 + i)}"].outcome for i in range(11)] == want
    assert "40" in got["dc"].why and "human" in got["dd"].why
    assert got["db"].body == "TITLE: the mill\nDESC: where it stands\nBELONGS_BECAUSE: it is ours\n\nIt stands.\n"
    again = done.where("slug = 'db'").select("slug", "kind", "manifest", "body", "mark")
    assert drafts.drained(again, answers.where("slug = 'none'"), papers, KEY).first().outcome == "skipped"  # its new mark holds
    assert drafts.drained(table, answers, papers.where("manifest = 'x'"), KEY).where("outcome = 'refused'").count() == 4
    assert {r.outcome: r.n for r in drafts.counts(done).collect()}["skipped"] == 0
    store = spark.createDataFrame([("mill", "Mill", "the old one", "project", "It is old.\n")], "slug string, title string, description string, type string, body string")
    poured = {r.slug: r for r in drafts.memories(done, store).collect()}
    assert set(poured) == {"da", "db", "dk", "mill"} and poured["mill"].body == "It is old.\n\nIt burnt down." and poured["mill"].description == "the old one"
    assert poured["da"].body == "It stands by the river." and poured["da"].meta == {"evidence_manifest": "sha256:m"} and poured["dk"].tags == ["x"]
    assert drafts.drained(table.where("false"), answers, papers, KEY).count() == 0


# Budgets


def test_prefixes(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), i, rnd.choice([0, 1, 5, 40, None])) for i in range(400)]
    table = spark.createDataFrame(rows, "a int, b int, cost int")
    order = [F.col("a"), F.col("b").desc()]
    used, want = 0, []
    for n, (a, b, c) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])), 1):
        used += c or 0
        want.append((a, b, n, used))
    for ranges in (1, 3, 64):
        assert sorted(((r.a, r.b, r.n, r.used) for r in budget.running(table, order, "cost", ranges=ranges).collect()), key=lambda r: r[2]) == want
    for most in (0, 1, 99, 1000, 10**6):
        assert sorted(((r.a, r.b, r.n, r.used) for r in budget.prefix(table, order, "cost", most, ranges=7).collect()), key=lambda r: r[2]) == [w for w in want if w[3] <= most]
    big = spark.createDataFrame([(1, 9), (2, 1)], "a int, cost int")
    assert budget.prefix(big, [F.col("a")], "cost", 5).count() == 0 and [r.a for r in budget.prefix(big, [F.col("a")], "cost", 5, first=True).collect()] == [1]
    assert budget.prefix(big.where("false"), [F.col("a")], "cost", 5, first=True).count() == 0


def test_profile(spark):
    mem = spark.createDataFrame([("_study/a", "s" * 30), ("b", "b" * 40), ("a", "a" * 30), ("c", "c" * 100), ("d", "d"), ("e", None)], "slug string, body string")
    assert [r.slug for r in budget.profile_material(mem, 100).orderBy("n").collect()] == ["a", "b"]  # c does not fit, so d is not read
    part = budget.profile_material(mem, 1000)
    assert [r.slug for r in part.orderBy("n").collect()] == ["a", "b", "c", "d", "e", "_study/a"]
    assert budget.profile_prompt(part, "- index").first().prompt.startswith("=== INDEX ===\n- index\n\n=== MEMORIES ===\n=== a ===\naaa")
    assert budget.profile_prompt(part.where("false"), "").count() == 0
    texts = {None: "absent", "": "broken", " \n": "broken", "## Threads\nThey like rivers.": "present", "## X\ntrading: 0.8": "broken", "| walks | 7 |": "broken", "An interest score 7 it is.": "broken", "importance: high": "present", "It began: 1990 was the year": "present"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", budget.profile_state(F.col("t")).alias("s"), budget.profile_draft(F.col("t")).alias("d")).collect()
    assert {r.t: r.s.state for r in rows} == texts and {r.t: r.d.state for r in rows if r.t and r.t.startswith("##")} == {"## Threads\nThey like rivers.": "present", "## X\ntrading: 0.8": "broken"}
    assert {r.d.state for r in rows if not (r.t or "").startswith("##")} == {"refused"}


# Novelty


def test_answers_about_novelty_are_read_strictly(spark):
    near = [{"rank": 1, "slug": "mill", "opening": "x"}, {"rank": 2, "slug": "old-mill", "opening": "y"}]
    says = ["COVERED mill\nall of it\nis there", "extends `old-mill`, it says", "EXTENDS nobody", "New", "It is COVERED", "", None, "covered\n" + "w" * 500]
    rows = spark.createDataFrame([(str(i), near, s) for i, s in enumerate(says)] + [("none", [], "COVERED mill")], "cand string, near array<struct<rank:bigint,slug:string,opening:string>>, answer string")
    got = {r.cand: (r.verdict, r.slug, r.why) for r in novelty.judged(rows).collect()}
    assert [got[str(i)][:2] for i in range(7)] == [("COVERED", "mill"), ("EXTENDS", "old-mill"), ("EXTENDS", "mill"), ("NEW", "mill"), ("NEW", "mill"), ("NEW", "mill"), ("NEW", "mill")]
    assert got["0"][2] == "all of it is there" and len(got["7"][2]) == 200 and got["none"] == ("NEW", None, "nothing close in the store")


# Quiet passes


def brute(log, until, idle, backoff, yields):
    """A watcher that looks every minute; log of (minute, kind, track, rc, counts), times in minutes, one row a minute at most."""
    running, rest, done, flags, last, waiting, stale, out = None, {}, {}, set(), None, 0, False, []
    rows = {m: r for m, *r in log}
    for now in range(until + 1):
        kind, track, rc, counts = rows.get(now, (None, None, None, None))
        counts = {k: v for k, v in (counts or {}).items() if v}
        if kind == "finished" and running and track in (None, running):
            name, running = running, None
            if name in ("weave", "payforward") and rc in {"weave": (0,), "payforward": (0, 2)}[name]:
                flags.add(name)
            if rc:
                rest[name] = now + backoff
                out.append((now, "rest" if rc == 2 else "failed", name))
            else:
                out.append((now, "done", name))
                if name == "weave":
                    counts = {"woven": 1}
                    flags -= {"trail", "payforward"}
                for k in tracks.TALLY[name]:
                    done[k] = done.get(k, 0) + counts.get(k, 0)
                if name == "distill":
                    waiting += counts.get("drafts", 0)
                if name == "drain":
                    waiting = max(0, waiting - counts.get("poured", 0) - counts.get("tossed", 0))
                    if counts.get("poured"):
                        flags.discard("weave")
                if name == "trail":
                    stale = False
        if kind == "activity":
            if yields and running:
                out.append((now, "stop", running))
                running = None
            if any(done.values()):
                out.append((now, "back", None))
            done, last = {}, now
            flags = set()
        if kind == "drafts":
            waiting = counts.get("drafts", 0)
        if kind == "stale":
            stale = True
        if last is not None and now - last >= idle and not running:
            order = ["drain" if waiting else "distill"]
            order += ["weave"] * ("weave" not in flags and done.get("poured", 0) > 0)
            order += ["trail"] * (("weave" in flags and "trail" not in flags) or stale)
            order += ["payforward"] * ("weave" in flags and "payforward" not in flags) + ["tidy"] * ("tidy" not in flags)
            track = next((t for t in order if now >= rest.get(t, 0)), None)
            if track:
                if track in ("trail", "tidy"):
                    flags.add(track)
                running = track
                out.append((now, "start", track))
    return out


T0 = datetime.datetime(2024, 1, 1)
LOG = "store string, at timestamp, kind string, track string, rc int, counts map<string,bigint>"


def made_log(seed, minutes=600):
    rnd = random.Random(seed)
    out = []
    for m in sorted(rnd.sample(range(minutes), 60)):
        kind = rnd.choices(["activity", "finished", "drafts", "stale"], [1, 4, 0.3, 0.3])[0]
        counts = {k: rnd.randrange(3) for k in ("poured", "tossed", "drafts", "paid", "trailed", "tidied", "fixed")}
        out.append((m, kind, rnd.choice([None, None, "weave", "tidy"]) if kind == "finished" else None, rnd.choice([0, 0, 0, 1, 2]) if kind == "finished" else None, counts))
    return out


def minutes(rows):
    return {s: [(round((r.at - T0).total_seconds() / 60), r.action, r.track) for r in rows if r.store == s] for s in {r.store for r in rows}}


@pytest.mark.parametrize("yields", [True, False])
def test_tracks_follow_the_watcher(spark, yields):
    logs = {f"s{seed}": made_log(seed) for seed in range(20)}
    rows = [(s, T0 + datetime.timedelta(minutes=m), k, t, rc, c) for s, log in logs.items() for m, k, t, rc, c in log]
    random.Random(3).shuffle(rows)
    got = minutes(tracks.replayed(spark.createDataFrame(rows, LOG), until=T0 + datetime.timedelta(minutes=700), idle=10, backoff=20, yields=yields).collect())
    for s, log in logs.items():
        assert got[s] == brute(log, 700, 10, 20, yields)
    assert {a for rows in got.values() for _, a, _ in rows} >= {"start", "done", "rest", "failed", "back"}


def test_odd_logs(spark):
    assert tracks.replayed(spark.createDataFrame([], LOG)).count() == 0
    rows = [(None, T0, "activity", None, None, None), ("a", None, "activity", None, None, None), ("a", T0, "nothing", None, None, None), ("b", T0, "finished", None, 0, {})]
    got = tracks.replayed(spark.createDataFrame(rows, LOG), until=T0 + datetime.timedelta(hours=1)).collect()
    assert [(r.store, r.action, r.track) for r in got] == [(None, "start", "distill")]


def test_a_stream_gives_what_the_replay_gives(spark, tmp_path):
    log = made_log(7, 300)
    rows = [("s", T0 + datetime.timedelta(minutes=m), k, t, rc, c) for m, k, t, rc, c in log]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = []
        for n, part in enumerate((rows[:25], rows[25:40], rows[40:], [("other", T0 + datetime.timedelta(minutes=400), "activity", None, None, None)])):
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
            query = tracks.watched(stream, idle=10, backoff=20).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
            assert query.foreachBatch(lambda df, n: got.extend(df.collect())).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(minutes(got)["s"], key=str) == sorted(brute(log, 400, 10, 20, True), key=str)


# Derived maps


def store_of(spark, tmp_path, **kw):
    t = StoreTable(spark, str(tmp_path / "t"), **kw)
    t.upsert(spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, title string"))
    return t


def by_title(rows):
    return rows.select("slug", F.lower("title").alias("low"))


def test_a_map_is_published_once_and_read_back(spark, tmp_path):
    m = Derived(store_of(spark, tmp_path), "low", KEY)
    assert m.read() is None and m.is_stale()
    assert m.publish(*m.built(by_title)) == "written" and m.publish(*m.built(by_title)) == "unchanged"
    assert sorted(m.read().collect()) == [("a", "a"), ("b", "b")]
    assert len([n for n in m.table._names("derived/low") if n.startswith("d-")]) == 1


def test_a_lost_race_leaves_the_old_map(spark, tmp_path):
    t = store_of(spark, tmp_path)
    m = Derived(t, "low", KEY)
    m.publish(*m.built(by_title))
    rows, stamp = m.built(by_title)
    t.upsert(spark.createDataFrame([("c", "C")], "slug string, title string"))
    assert m.publish(rows, stamp) == "refused" and m.is_stale() and m._rows(m.record()).count() == 2
    assert m.fresh(by_title).count() == 3 and not m.is_stale()


def test_only_a_proven_map_is_read(spark, tmp_path):
    t = store_of(spark, tmp_path)
    m = Derived(t, "low", KEY, spec="one")
    m.publish(*m.built(by_title), valid_until=1000.0)
    assert m.read(now=999.0) is not None and m.read(now=1001.0) is None
    assert Derived(t, "low", KEY, spec="two").is_stale(0) and Derived(t, "low", b"another", spec="one").is_stale(0)
    folder = tmp_path / "t" / m.record()["folder"]
    spark.createDataFrame([("x", "forged")], "slug string, low string").write.mode("append").parquet(str(folder))
    assert m.is_stale(999.0)
    assert m.publish(*m.built(by_title), valid_until=1000.0) == "written" and not m.is_stale(999.0)
    last = sorted((tmp_path / "t/derived/low").glob("*.json"))[-1]
    (last.parent / f".{last.name}.crc").unlink()
    record = json.loads(last.read_text())
    last.write_text(json.dumps(record | {"valid_until": None}))
    assert m.is_stale(0)
    (tmp_path / "t/derived/low/000000000009.json").write_text("{")  # one that was begun
    last.write_text(json.dumps(record))
    assert not m.is_stale(999.0)


def test_an_empty_map_takes_the_map_away(spark, tmp_path):
    t = store_of(spark, tmp_path)
    m = Derived(t, "low", KEY)
    m.publish(*m.built(by_title))
    assert m.publish(*m.built(lambda rows: by_title(rows).where("false"))) == "removed" and m.read() is None
    assert m.publish(*m.built(by_title)) == "written"


def test_old_generations_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("attesta.sources.derived.KEPT", 2)
    t = store_of(spark, tmp_path)
    m = Derived(t, "low", KEY)
    for i in range(4):
        m.publish(*m.built(lambda rows, i=i: rows.select("slug", F.lit(str(i)).alias("low"))))
    assert len(m._pointers()) == 2 and len([n for n in t._names("derived/low") if n.startswith("d-")]) == 2 and {r.low for r in m.read().collect()} == {"3"}


def test_digests_are_of_rows_as_a_set_with_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    assert digest(rows) == digest(rows.orderBy(F.desc("x")).repartition(3)) == digest(rows.select("y", "x"))
    assert len({digest(r) for r in (rows, rows.distinct(), rows.union(rows), rows.withColumnRenamed("y", "z"), rows.where("false"), rows.fillna("null"))}) == 6


# Logs and seeds


def test_logs_take_each_append_once(spark, tmp_path):
    log = logs.LogTable(spark, str(tmp_path), "reads", "at timestamp, why string")
    rows = lambda *w: spark.createDataFrame([(T0, x) for x in w], "at timestamp, why string")
    assert log.read().count() == 0 and log.compact() == 0
    assert log.append(rows("a", "b"), "one") and not log.append(rows("never"), "one") and log.append(rows("c"))

    class Lost(Exception):
        pass

    def lose(step):
        if step in ("data", "compacted"):
            raise Lost

    log.files._step = lose
    for write in (lambda: log.append(rows("lost"), "two"), log.compact):
        with pytest.raises(Lost):
            write()
    log.files._step = lambda step: None
    assert sorted(r.why for r in log.read().collect()) == ["a", "b", "c"]
    assert log.append(rows("d"), "two")
    before = log.read()
    assert log.compact() == 3 and sorted(r.why for r in before.collect()) == sorted(r.why for r in log.read().collect()) == ["a", "b", "c", "d"]
    assert not log.append(rows("never"), "two") and log.append(rows("e")) and log.compact() == 1 and log.compact() == 0
    assert sorted(r.why for r in log.read().collect()) == ["a", "b", "c", "d", "e"]
    (tmp_path / "logs/reads/compactions/000000000009.json").write_text("{")
    assert log.read().count() == 5


def test_broken_lines_are_passed_over(spark):
    lines = spark.createDataFrame([('{"at": 1, "why": "x"}',), ("{broken",), ("7",), ("",), (None,), ('{"why": null}',)], "line string")
    good, bad = logs.parsed(lines, "at bigint, why string")
    assert sorted(good.collect(), key=str) == sorted([(1, "x"), (None, None)], key=str) and bad.first().bad == 4


def test_confirmations_meet_the_first_open_seed(spark):
    rnd = random.Random(4)
    events = [(rnd.choice(["IDEA", "IDEA", "CONFIRM"]), rnd.choice(["a", "b", "n" * 60 + "one", "n" * 60 + "two", None]), i) for i in range(300)]
    rows = [(k, t, f"w{i}", "", T0 + datetime.timedelta(seconds=i), f"h{i}" if k == "CONFIRM" else None, None, "e", i) for k, t, i in events]
    rnd.shuffle(rows)
    seeds = []
    for k, t, i in events:
        if k == "IDEA":
            seeds.append([t, f"w{i}", None])
        else:
            one = next((s for s in seeds if s[2] is None and (s[0] or "")[:60] == (t or "")[:60]), None)
            if one:
                one[2] = f"h{i}"
    log = spark.createDataFrame(rows, logs.SEEDS + ", entry string, row bigint")
    assert sorted(((r.text, r.who, r.how) for r in logs.seeds(log).collect()), key=str) == sorted(map(tuple, seeds), key=str)
    still = [s[1] for s in seeds if s[2] is None]
    assert sorted(r.who for r in logs.open_seeds(log, 5).collect()) == sorted(still[-5:])


# Tidy


def test_repairs_are_merged_line_by_line(spark):
    mem = spark.createDataFrame([("a", "A", "about mills"), ("b", "B", "of 12 boats"), ("c", "C", "x"), ("d", "D", "")], "slug string, title string, body string")
    lines = spark.createDataFrame([(1, "# head"), (2, "- [a](a.md) — tiny"), (3, "- [b](b.md) — tiny"), (4, "- [c](c.md) — tiny"), (5, "- [d](d.md) — tiny"), (6, "- [a](a.md) — one can recognise this"), (7, None)], "line_no int, line string")
    found = tidy.asked(lines, mem)
    assert sorted(r.slug for r in found.collect()) == ["a", "b", "c"] and [r.slug for r in tidy.asked(lines, mem, 1).collect()] == ["a"]
    says = {"a": "TITLE: Mills\nDESC: all about mills", "b": "TITLE: Boats\nDESC: all 13 boats", "c": "TITLE: X\nDESC: something"}
    fixes = tidy.repairs(found.join(spark.createDataFrame(list(says.items()), "slug string, answer string"), "slug"))
    now = spark.createDataFrame([(1, "# head"), (2, "- [new](new.md) — came in"), (3, "- [a](a.md) — tiny"), (4, "- [a](a.md) — tiny"), (5, "- [b](b.md) — tiny"), (6, "- [c](c.md) — tiny")], "line_no int, line string")
    index, outcomes = tidy.merged(now, fixes, mem.where("slug != 'c'"))
    assert [r.line for r in index.orderBy("line_no").collect()] == ["# head", "- [new](new.md) — came in", "- [Mills](a.md) — all about mills", "- [a](a.md) — tiny", "- [b](b.md) — tiny", "- [c](c.md) — tiny"]
    assert dict(outcomes.collect()) == {"a": "fixed", "b": "refused", "c": "memory changed"}
    gone = tidy.merged(now.where("line_no < 3"), fixes, mem)[1]
    assert dict(gone.collect()) == {"a": "line moved", "b": "refused", "c": "line moved"}
