"""Spelling variants: words one edit apart, and the form that each word should have.

Words are counted in the JVM over every whole text. The distinct words of at least LEAST code points and OFTEN occurrences are sorted, and
every sorted run is cut into shards: compact tries (each edge holds a run of letters) of at most SHARD words and SHARD_BYTES bytes, or
of one longer word. Shards go to the executors in groups of at most GROUP_BYTES, one group at a time, so what is broadcast does not grow with the vocabulary. Each task walks
its words through every shard of the group: the automaton of distance one, which has the states "no edit yet" and "edit spent", runs down the
trie depth-first, and every word in which it accepts with its edit spent is a neighbour. A task sends, for each word that has any, its neighbours' count
and its best one; the groups' counts are added and the best of their best is kept.

A word's form is its neighbour of largest n (ties: the smallest in code-point order) if that n is at least RATIO times its own. Forms have forms; roots are found by
pointer doubling, whose rounds are the logarithm of the longest chain (n grows by RATIO with each step, so chains are short).

Null and empty texts have no words; a null id enters the hash as nothing. Repeated rows count as often as they occur. An empty table gives no
rows. Extra columns are not read. A word of any length is one word.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop_table, lean, shared_dir

#: Letters of a run, and the capitals that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points and occurrences of a word; how much more frequent a form is.
LEAST, OFTEN, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a letter.
TYPO = 199
#: Words and bytes of a shard, bytes of a group of shards.
SHARD, SHARD_BYTES, GROUP_BYTES = 100_000, 2 << 20, 16 << 20
#: Words of a task.
TASK = 20_000


def runs(text: Column, id_: Column) -> Column:
    """The runs of letters of a text, in lower case; one in TYPO pairs of id and run loses a letter of it."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower()), F.lit(LETTERS), F.lit(0))
    key = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"))

    def typed(run):
        h = F.crc32(F.concat(key, run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % TYPO == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    # Shorter ones cannot become words.
    return F.transform(F.filter(found, lambda r: F.length(r) >= LEAST), typed)


def vocabulary(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the distinct words of LEAST code points and OFTEN occurrences."""
    words = docs.select(F.explode(runs(F.col(text), F.col(id_))).alias("word")).where(F.length("word") >= LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


class Trie:
    """A compact trie of sorted words. A node is [word or None, its n, {first letter: (rest of the edge, node)}]."""

    def __init__(self, words: list[str], counts: list[int]):
        self.top = self._grow(words, counts)

    @staticmethod
    def _grow(words, counts):
        top = [None, 0, {}]
        todo = [(top, 0, len(words), 0)]  # a node, the words under it, and how many letters lead to it
        while todo:
            node, low, high, depth = todo.pop()
            if len(words[low]) == depth:
                node[0], node[1] = words[low], counts[low]
                low += 1
            while low < high:
                letter, first = words[low][depth], low
                while low < high and words[low][depth] == letter:
                    low += 1
                one, last = words[first], words[low - 1]  # sorted, so what these two share all share
                end, most = depth + 1, min(len(one), len(last))
                while end < most and one[end] == last[end]:
                    end += 1
                if first == low - 1:
                    end = len(one)
                child = [None, 0, {}]
                node[2][letter] = (one[depth + 1 : end], child)
                todo.append((child, first, low, end))
        return top

    @staticmethod
    def _spent(node, word: str, at: int):
        """The node that the rest of word leads to once the edit is spent; None if there is no such word."""
        size = len(word)
        while at < size:
            edge = node[2].get(word[at])
            if edge is None or not word.startswith(edge[0], at + 1):
                return None
            at, node = at + 1 + len(edge[0]), edge[1]
        return node if at == size and node[0] is not None else None

    def near(self, word: str) -> list[tuple[str, int]]:
        """(word, n) of every word of the trie that is one insertion, deletion or replacement away, each once.

        An edit within a run of equal letters is made at the run's end, so no word is found twice.
        """
        out, size, spent = [], len(word), self._spent
        node, at = self.top, 0  # the path without an edit
        while True:
            here = word[at] if at < size else None
            if here is not None and (at + 1 == size or word[at + 1] != here):  # word[at] goes
                end = spent(node, word, at + 1)
                if end is not None:
                    out.append((end[0], end[1]))
            for letter, (rest, child) in node[2].items():
                if letter == here:
                    continue
                if here is not None and word.startswith(rest, at + 1):  # letter in place of word[at]
                    end = spent(child, word, at + 1 + len(rest))
                    if end is not None:
                        out.append((end[0], end[1]))
                if word.startswith(rest, at):  # letter comes in before word[at]
                    end = spent(child, word, at + len(rest))
                    if end is not None:
                        out.append((end[0], end[1]))
            edge = node[2].get(here)
            if edge is None:
                return out
            rest, child = edge
            at += 1
            if word.startswith(rest, at):
                at, node = at + len(rest), child
                continue
            # The path parts from the word within the edge: the edit is there or nowhere.
            j = 0
            while at + j < size and rest[j] == word[at + j]:
                j += 1
            tail, letter = rest[j + 1 :], at + j
            if letter < size:
                if word.startswith(tail, letter + 1):  # replaced
                    end = spent(child, word, letter + 1 + len(tail))
                    if end is not None:
                        out.append((end[0], end[1]))
                if (letter + 1 == size or word[letter + 1] != word[letter]) and word.startswith(rest[j:], letter + 1):  # word[letter] goes
                    end = spent(child, word, letter + 1 + len(rest) - j)
                    if end is not None:
                        out.append((end[0], end[1]))
            if word.startswith(tail, letter):  # rest[j] comes in
                end = spent(child, word, letter + len(tail))
                if end is not None:
                    out.append((end[0], end[1]))
            return out


def _pack(words: list[str], counts: list[int]) -> bytes:
    table = pa.table({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(shard: bytes) -> Trie:
    table = pa.ipc.open_stream(shard).read_all()
    return Trie(table["word"].to_pylist(), table["n"].to_pylist())


def shards(words: DataFrame, count: int) -> DataFrame:
    """size, shard: the words in order, cut into shards of at most SHARD words and SHARD_BYTES bytes."""

    def cut_up(batches):
        held, counts, size = [], [], 0
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                length = len(word.encode())
                if held and (len(held) == SHARD or size + length > SHARD_BYTES):
                    blob = _pack(held, counts)
                    yield pa.RecordBatch.from_arrays([pa.array([len(blob)]), pa.array([blob], pa.binary())], ["size", "shard"])
                    held, counts, size = [], [], 0
                held.append(word)
                counts.append(n)
                size += length
        if held:
            blob = _pack(held, counts)
            yield pa.RecordBatch.from_arrays([pa.array([len(blob)]), pa.array([blob], pa.binary())], ["size", "shard"])

    return words.select("word", "n").repartitionByRange(-(-count // SHARD), "word").sortWithinPartitions("word").mapInArrow(cut_up, "size long, shard binary")


def _groups(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards (number, size) in groups of at most GROUP_BYTES, or of one."""
    out, left = [], 0
    for number, size in sizes:
        if not out or size > left:
            out.append([])
            left = GROUP_BYTES
        out[-1].append(number)
        left -= size
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word): of every word that has neighbours, their count and the best of them."""
    spark = words.sparkSession
    lean(spark)
    count = words.count()
    schema = "word string, n_near long, best struct<less: long, word: string>"
    if not count:
        return spark.createDataFrame([], schema)
    tries = cut(shards(words, count).withColumn("number", F.monotonically_increasing_id()))
    sizes = [(r.number, r.size) for r in tries.select("number", "size").orderBy("number").collect()]  # one row for SHARD words
    dealt = words.select("word").repartition(-(-count // TASK), "word")
    path = shared_dir(spark)
    for numbers in _groups(sizes):
        blobs = [bytes(r.shard) for r in tries.where(F.col("number").isin(numbers)).select("shard").collect()]  # GROUP_BYTES
        given = spark.sparkContext.broadcast(blobs)

        def walk(batches, given=given):
            grown = [_unpack(b) for b in given.value]
            for b in batches:
                found, counts, best = [], [], []
                for word in b.column(0).to_pylist():
                    near = [x for trie in grown for x in trie.near(word)]
                    if near:
                        found.append(word)
                        counts.append(len(near))
                        best.append(min((-n, other) for other, n in near))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array(counts, pa.int64()), pa.array([{"less": a, "word": w} for a, w in best], pa.struct([("less", pa.int64()), ("word", pa.string())]))], ["word", "n_near", "best"]
                )

        dealt.mapInArrow(walk, schema).write.mode("append").parquet(path)
        given.unpersist()
    drop_table(tries)
    part = spark.read.schema(schema).parquet(path)
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form; one row a word) lead at last."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        more = ahead.where("moved").limit(1).count()
        drop_table(at)
        if not more:
            return ahead.select("word", "root")
        at = ahead.select("word", "root")


def variants(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    lean(docs.sparkSession)
    words = cut(vocabulary(docs, id_, text))
    near = words.join(neighbours(words), "word", "left")
    likely = -F.col("best.less") >= RATIO * F.col("n")
    rows = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n")))
    roots = rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
