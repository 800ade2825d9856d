"""The journal source: ranges on executors, admission by bytes, restarts, rewritten files, archives."""

import os

import pytest
import zstandard
from pyspark.sql import functions as F

from attesta.operators import intake
from attesta.sources import journals


def run(spark, tmp_path, name="c", **options):
    """One run over what is there: the rows of each of its batches."""
    journals.register(spark)
    batches = []
    stream = spark.readStream.format("journals").options(path=str(tmp_path / "j/*"), **options).load()
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).foreachBatch(lambda df, n: batches.append((n, df.orderBy("key", "pos").collect()))).start()
    assert query.awaitTermination(120)
    return batches


def said(batches):
    return [r.line or r.skipped for _, rows in batches for r in rows]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "j").mkdir()
    return tmp_path / "j"


def test_each_line_belongs_to_one_range(tmp_path):
    p = tmp_path / "a"
    p.write_bytes(b"one\n\ntwo two\r\n" + b"y" * 40000 + b"\nfour\nhalf")
    whole = list(journals.lines(str(p), 0))
    assert [r[3] or r[4] or "" for r in whole] == ["one", "", "two two", "oversized", "four"]
    for width in (1, 2, 3, 7, 1000, 39999, 50000):
        parts = [r for at in range(0, p.stat().st_size, width) for r in journals.lines(str(p), at, at + width)] if width > 500 else [r for at in range(0, 20, width) for r in journals.lines(str(p), at, min(at + width, 20))]
        assert parts == (whole if width > 500 else whole[:4])


def test_batch_reads_ranges(spark, folder, monkeypatch):
    (folder / "a").write_text("".join(f"line {i}\n" for i in range(1000)))
    (folder / "empty").write_text("")
    monkeypatch.setattr(journals, "RANGE", 777)
    assert len(journals._Reader({"path": str(folder / "*")}).partitions()) > 10
    journals.register(spark)
    rows = spark.read.format("journals").option("path", str(folder / "*")).load()
    assert sorted(r.line for r in rows.collect()) == sorted(f"line {i}" for i in range(1000))
    assert spark.read.format("journals").option("path", str(folder / "nothing*")).load().count() == 0


def test_two_files_with_a_kill_between_batches(spark, tmp_path, folder):
    (folder / "a").write_text("".join(f"a{i}\n" for i in range(50)))
    (folder / "b").write_text("".join(f"b{i}\n" for i in range(50)) + "half")
    first = run(spark, tmp_path, chars=100)
    assert 20 <= len(said(first)) <= 40 and said(first)[0] == "a0"

    class Killed(Exception):
        pass

    def kill(df, n):
        raise Killed

    stream = spark.readStream.format("journals").options(path=str(folder / "*"), chars=100).load()
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(kill).start()
    with pytest.raises(Exception, match="Killed"):
        query.awaitTermination(120)
    got = said(first)
    for _ in range(10):
        got += said(run(spark, tmp_path, chars=100))
    assert sorted(got) == sorted([f"a{i}" for i in range(50)] + [f"b{i}" for i in range(50)])  # each once, the half line not at all
    with open(folder / "b", "a") as f:
        f.write(" done\n")
    assert said(run(spark, tmp_path, chars=100)) == ["half done"]
    assert said(run(spark, tmp_path, chars=100)) == []


def test_starting_at_the_end(spark, tmp_path, folder):
    (folder / "a").write_text("old\nold too\nhal")
    assert said(run(spark, tmp_path, startingOffsets="latest")) == []
    with open(folder / "a", "a") as f:
        f.write("f\nnew\n")
    (folder / "b").write_text("other\n")
    assert said(run(spark, tmp_path, startingOffsets="latest")) == ["half", "new", "other"]


@pytest.mark.parametrize("change", ["append", "truncate", "replace", "rewrite the end", "same size"])
def test_rewritten_files_are_read_anew(spark, tmp_path, folder, change):
    p = folder / "a"
    p.write_text("one\ntwo\nthree\n")
    assert said(run(spark, tmp_path)) == ["one", "two", "three"]
    new = {"append": "one\ntwo\nthree\nfour\n", "truncate": "one\n", "replace": "other\nlines\nin\nit\n", "rewrite the end": "one\ntwo\nthird\nfour\n", "same size": "one\ntwo\nthrea\n"}[change]
    if change == "replace":
        (folder.parent / "x").write_text(new)
        os.replace(folder.parent / "x", p)
    else:
        p.write_text(new)
    batches = run(spark, tmp_path)
    assert said(batches) == (["four"] if change == "append" else new.split())
    assert {r.generation for _, rows in batches for r in rows} == {0 if change == "append" else 1}


def test_file_rewritten_after_planning(folder):
    p = folder / "a"
    p.write_text("one\ntwo\n")
    reader = journals._Stream({"path": str(folder / "*")})
    parts = reader.partitions({}, reader.latestOffset())
    p.write_text("other\n")
    assert [r[4] for part in parts for r in reader.read(part)] == ["rewritten"]
    again = reader.partitions(reader.start, reader.latestOffset())
    assert [(r[3], r[5]) for part in again for r in reader.read(part)] == [("other", 1)]


def test_long_lines_are_passed_in_bounded_steps(folder, monkeypatch):
    monkeypatch.setattr(journals, "SCAN", 50_000)
    p = folder / "a"
    p.write_text("x" * 300_000)
    reader = journals._Stream({"path": str(folder / "*"), "chars": "1000"})
    ends = [reader.latestOffset() for _ in range(3)]
    assert ends == [{}, {}, {}] and 100_000 <= reader.ahead[str(p)][1] <= 200_000
    with open(p, "a") as f:
        f.write("\nnext\n")
    for _ in range(9):
        if end := reader.latestOffset():
            break
    rows = [r for part in reader.partitions({}, end) for r in reader.read(part)]
    assert [(r[1], r[2], r[4]) for r in rows] == [(0, 300_001, "oversized")]
    rows = [r for part in reader.partitions(reader.start, reader.latestOffset()) for r in reader.read(part)]
    assert [r[3] for r in rows] == ["next"]


def event(seq, text):
    return f'{{"seq": {seq}, "type": "user/message", "data": {{"source": {{"kind": "user"}}, "content": [{{"type": "text", "text": "{text}"}}]}}}}\n'


def test_archives(spark, tmp_path, folder):
    packed = lambda text, **kw: zstandard.ZstdCompressor(**kw).compress(text.encode())
    p = folder / "a.jsonl.zstd"
    first = packed(event(1, "we chose oak") + event(2, "no, ash")) + packed(event(3, "y" * 40_000), write_checksum=True)
    p.write_bytes(first + packed(event(4, "later"))[:-3])  # a frame that is being written
    got = run(spark, tmp_path)
    assert [(r.skipped, r.next) for _, rows in got for r in rows][-1] == ("oversized", len(first)) and len(said(got)) == 3
    p.write_bytes(first + packed(event(4, "later")))
    assert said(run(spark, tmp_path)) == [event(4, "later").strip()]
    # Written anew with one more event: all lines come again, and the sequence number tells the new one.
    p.write_bytes(packed("".join(event(i, f"t{i}") for i in range(1, 6))))
    rows = [r for _, rows in run(spark, tmp_path) for r in rows]
    assert len(rows) == 5 and len({r.pos for r in rows}) == 5
    late = intake.archive(spark.createDataFrame(rows, journals.SCHEMA).select("key", "line"), start=4).collect()
    assert [(r.pos, r.cls, r.text) for r in late] == [(5, "USER", "t5")]
    journals.register(spark)
    assert spark.read.format("journals").option("path", str(p)).load().count() == 5


def test_uris_and_patterns(folder, tmp_path):
    (folder / "deep/er").mkdir(parents=True)
    for name in ("a.md", "deep/b.md", "deep/er/c.md", "deep/.hidden.md", "d.txt"):
        (folder / name).write_text("x\n")
    os.link(folder / "a.md", tmp_path / "same.md")
    names = lambda pattern, **kw: sorted(os.path.relpath(p.removeprefix("file://"), folder) for p in journals.discover(pattern, **kw))
    assert names(f"{folder}/*.md") == ["a.md"] and names(f"{folder}/**/*.md") == ["a.md", "deep/b.md", "deep/er/c.md"]
    assert names(f"file://{folder}/**/*.md") == ["a.md", "deep/b.md", "deep/er/c.md"] and names(f"{folder}/a.md") == ["a.md"]
    assert names(f"{folder}/*/[bx].md") == ["deep/b.md"] and names(f"{folder}/*", exclude=f"{tmp_path}/same*") == ["d.txt"]
