import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from attesta.sources import journals, store
from attesta.sources.writer import Refused, StoreTable
from attesta.streaming import intake as streaming


@pytest.fixture
def root(tmp_path):
    (tmp_path / "s/_study").mkdir(parents=True)
    r = tmp_path / "s"
    (r / "MEMORY.md").write_text("# t\n<!-- - [Title](its-slug.md) — trigger\n-->\n## One\n- [A](a.md) — about a\n- both — [B](b.md)/[A](a.md)\n")
    (r / "a.md").write_text('---\nname: a\ndescription: "what a is"\nmetadata:\n  type: user\n  tags: ["x", "b"]\n  type: other\n---\n\nbody [[b]]\n--- not front\n')
    (r / "b.md").write_text("no front matter")
    (r / "_study/c.md").write_text("---\nname: c\n---\nstudy")
    (r / "charter.md").write_text("no memory")
    (r / "_draft.md").write_text("no memory")
    (tmp_path / "elsewhere.md").write_text("secret")
    os.symlink(tmp_path / "elsewhere.md", r / "leak.md")
    os.link(r / "b.md", tmp_path / "b-too.md")
    return str(r)


def test_store_scan(spark, root):
    mem = store.memories(store.scan(spark, root)).orderBy("slug").collect()
    assert [m.slug for m in mem] == ["_study/c", "a", "b"]
    a = mem[1]
    assert (a.name, a.description, a.type, a.tags) == ("a", "what a is", "user", ["b", "x"]) and a.body == "body [[b]]\n--- not front\n"
    assert mem[2].body == "no front matter" and mem[2].front == {} and mem[0].body == "study"
    assert [r.slug for r in store.escaping(spark, root).collect()] == ["leak"] and [r.slug for r in store.hardlinked(spark, root).collect()] == ["b"]


def test_index_without_comments(spark, root):
    lines = store.index(spark, root)
    assert not lines.where(F.col("line").contains("its-slug")).count()
    assert {r.slug: r.hook for r in store.hooks(lines).collect()} == {"a": "A — about a both — B/A", "b": "both — B/A"}


def test_manifests_are_their_own_names(spark, root):
    import hashlib

    folder = os.path.join(root, "_evidence")
    os.mkdir(folder)
    good = json.dumps({"kind": "x"})
    for name, body in ((hashlib.sha256(good.encode()).hexdigest(), good), ("0" * 64, "tampered"), ("short", "x")):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(body)
    assert [r.manifest for r in store.manifests(spark, root).collect()] == [good]


def test_writer(spark, tmp_path):
    t = StoreTable(spark, str(tmp_path / "t"))
    assert t.read().count() == 0
    schema = "slug string, title string, body string, tags array<string>, meta map<string,string>"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert t.upsert(rows(("a", "A", "one", ["x"], {"k": "1", "o": "0"}), ("b", "B", "two", None, None)), batch="1") == 1
    assert t.upsert(rows(("a", "A", "never", None, None)), batch="1") == 1
    assert t.upsert(rows(("a", None, "three", ["y"], {"k": "2"})), batch="2") == 2
    got = {r.slug: r for r in t.read().collect()}
    assert (got["a"].title, got["a"].body, got["a"].tags, got["a"].meta, got["a"].revision) == ("A", "three", ["x", "y"], {"k": "2", "o": "0"}, 2) and got["b"].revision == 1
    marks = spark.createDataFrame([("a", ["x"], {"k": "2"}), ("nobody", ["z"], {})], "slug string, tags array<string>, meta map<string,string>")
    assert t.annotate(marks) == 2
    assert t.annotate(spark.createDataFrame([("b", ["z"], {"m": "1"})], marks.schema)) == 3
    (tmp_path / "t/v4-lost").mkdir()  # a writer lost before its pointer
    assert t.read().count() == 2 and t.upsert(rows(("c", "C", "x", None, None))) == 4 and t.read().count() == 3
    with pytest.raises(Refused):
        StoreTable(spark, str(tmp_path / "t"), "frozen").upsert(rows(("d", "", "", None, None)))
    with pytest.raises(Refused):
        StoreTable(spark, str(tmp_path / "t"), "distiller-only").annotate(marks)
    assert StoreTable(spark, str(tmp_path / "t"), "distiller-only").upsert(rows(("d", "", "", None, None)), distilled=True) == 5


@pytest.mark.parametrize("step", ["data", "pointer", "mark"])
def test_a_writer_lost_between_any_two_steps_loses_nothing(spark, tmp_path, step):
    rows = lambda *slugs: spark.createDataFrame([(s, s.upper()) for s in slugs], "slug string, title string")

    class Lost(StoreTable):
        def _step(self, name):
            if name == step:
                raise KeyboardInterrupt

    at = str(tmp_path / "t")
    StoreTable(spark, at).upsert(rows("a", "b"), batch="1")
    with pytest.raises(KeyboardInterrupt):
        Lost(spark, at).upsert(rows("c"), batch="2")
    t = StoreTable(spark, at)
    before = {r.slug for r in t.read().collect()}
    assert before == ({"a", "b"} if step == "data" else {"a", "b", "c"})
    t.upsert(rows("c"), batch="2")  # the batch comes again
    revision = t.upsert(rows("d"), batch="3")
    assert t.upsert(rows("never"), batch="2") == t.upsert(rows("never"), batch="1") == revision
    assert {r.slug for r in t.read().collect()} == {"a", "b", "c", "d"} and t.state()["revision"] == 3
    (tmp_path / "t/revisions/000000000009.json").write_text("")  # a pointer that was begun
    assert t.upsert(rows("e")) == 10 and t.read().count() == 5
    assert t.vacuum() > 0 and t.read().count() == 5


def test_the_lock_of_a_lost_writer_is_taken_away(spark, tmp_path):
    import time

    rows = spark.createDataFrame([("a", "A")], "slug string, title string")
    t = StoreTable(spark, str(tmp_path / "t"), lease=1.5)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/LOCK").write_text("someone")
    with pytest.raises(TimeoutError), t.locked(0.2):
        pass
    assert t.upsert(rows) == 1 and not (tmp_path / "t/LOCK").exists()
    with t.locked():
        time.sleep(3)  # it is renewed
        with pytest.raises(TimeoutError), StoreTable(spark, str(tmp_path / "t"), lease=1.5).locked(0.5):
            pass


def test_folders_merge(spark, tmp_path):
    t = StoreTable(spark, str(tmp_path / "t"))
    for i in range(18):
        t.upsert(spark.createDataFrame([(f"m{i % 5}", str(i), [f"t{i}"])], "slug string, title string, tags array<string>"), batch=str(i))
    assert len(t.state()["folders"]) == 2 and {r.slug: r.title for r in t.read().collect()} == {"m0": "15", "m1": "16", "m2": "17", "m3": "13", "m4": "14"}
    assert {r.slug: len(r.tags) for r in t.read().collect()} == {"m0": 4, "m1": 4, "m2": 4, "m3": 3, "m4": 3}


def line(i, text="we agreed on the blue engine", cls="USER"):
    return journals.evidence_line(event_id=f"e{i}", session_id="s", turn_id="t", **{"class": cls}, text=text, timestamp="2024-01-02T03:04:05Z") + "\n"


def test_journal_lines_stop_at_whole_ones(tmp_path):
    p = tmp_path / "a.evidence.jsonl"
    p.write_text("one\n" + "x" * 40000 + "\ntwo\nhalf")
    got = list(journals.lines(str(p), 0))
    assert [(r[3], r[4]) for r in got] == [("one", None), (None, "oversized"), ("two", None)] and got[-1][2] == p.stat().st_size - 4
    assert [r[3] for r in journals.lines(str(p), 0, 4)] == ["one"]


def test_stream_reads_each_line_once(spark, tmp_path):
    folder, sink, seen = tmp_path / "j", StoreTable(spark, str(tmp_path / "t")), []
    folder.mkdir()
    (folder / "a.evidence.jsonl").write_text("".join(line(i) for i in range(5)) + "{broken\n" + line(7)[:20])

    def spot(segments):
        return segments.select("batch", F.col("pos").alias("cand"), F.lit("fact").alias("kind"), F.lit("t").alias("topic"), F.lit("w").alias("why"), F.array("text").alias("quotes"))

    def keep(judged, number):
        rows = judged.where("disposition = 'kept'").select(F.concat(F.lit("m"), F.sha1(F.concat("batch", F.col("cand").cast("string")))).alias("slug"), F.lit("body").alias("body"))
        seen.append((number, rows.count()))
        sink.upsert(rows, batch=str(number), distilled=True)
        sink.upsert(rows, batch=str(number), distilled=True)

    def go():
        q = streaming.run(streaming.evidence(streaming.lines(spark, str(folder / "*.jsonl"), chars=400)), str(tmp_path / "c"), spot, keep)
        assert q.awaitTermination(120)

    go()
    assert sink.read().count() == 3  # a run is one sip of about 400 bytes
    go()
    assert sink.read().count() == 5
    with open(folder / "a.evidence.jsonl", "a") as f:
        f.write(line(7)[20:] + line(8))
    go()
    assert sink.read().count() == 7


def test_batch_source_and_skips(spark, tmp_path):
    (tmp_path / "a.evidence.jsonl").write_text(line(1) + line(2, cls="HUMAN") + line(3, text=" "))
    journals.register(spark)
    rows = streaming.evidence(spark.read.format("journals").option("path", str(tmp_path / "*.jsonl")).load()).orderBy("pos").collect()
    assert [r.reason for r in rows] == [None, "unknown_class", "blank"] and rows[0].at is not None


def test_quiet_closes_sessions(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    m = lambda n: at + datetime.timedelta(minutes=n)
    spark.createDataFrame([(1, m(0)), (1, m(5)), (1, m(30)), (2, m(200))], "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "e"))
    q = streaming.quiet(stream, late="1 minute").writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.n) for r in spark.table("quiet").collect()) == [(1, 1), (1, 2)]


def test_registry(tmp_path):
    from attesta.registry import ConfigError, Registry

    ok = {"stores": {"a": {"path": "a"}, "b": {"path": "b", "write_policy": "frozen", "ladder": [4, 8]}}, "modes": {"work": "b"}, "defaults": {"gate": 2}}
    r = Registry.of(ok, str(tmp_path))
    assert r.store().name == "a" and r.store("work").ladder == (4, 8) and r.store("b").gate == 2
    with pytest.raises(ConfigError):
        r.store("nobody")
    for bad in ({"odd": 1}, {"stores": {"a": {}}}, {"stores": {"a": {"path": "x", "typo": 1}}}, {"stores": {"a": {"path": "x", "gate": "high"}}}, {"stores": {"a": {"path": "x"}, "b": {"path": "x/y"}}}, {"stores": {"a": {"path": "x", "write_policy": "open"}}}, {"stores": {"a": {"path": "x"}}, "modes": {"m": "z"}}, {"stores": {"a": {"path": "x", "ladder": [8, 4]}}}):
        with pytest.raises(ConfigError):
            Registry.of(bad, str(tmp_path))


def test_views_of_a_store(spark, root, tmp_path, capsys):
    from attesta import cli

    config = tmp_path / "c.toml"
    config.write_text(f'[stores.s]\npath = "{root}"\n')
    run = lambda *a: (cli.main([str(config), *a]), capsys.readouterr().out)
    assert run("stores")[0] == 0 and run("stores", "--store", "x")[0] == 1
    code, out = run("doctor")
    d = json.loads(out)
    assert code == 0 and d["memories"] == 3 and d["not_in_index"] == ["_study/c"] and d["islands"] == ["_study/c"] and d["links_resolved"] == 1
    assert run("sectors")[1] == "- One — 2 memories (e.g. A / B)\n- UNSECTIONED — 1 memories\n"
    code, out = run("recall", "what", "about", "a?")
    assert code in (0, 2) and json.loads(out)["how"]
    assert "LINKS:\nb" in run("glance", "a")[1] and run("glance", "nobody") == (2, "\n")
    assert "[A](a.md)" in run("weave")[1] and run("edges")[0] == 2
