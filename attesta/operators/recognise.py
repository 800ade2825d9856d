"""Tier zero: recognition of many questions at once over an inverted index, with an honest gate.

Document frequency and stop grams are aggregations over a long table (head, gram, ...), the gate is a window. Stop grams leave before votes are counted, which also keeps
any one gram from growing with the store: a posting list is at most STOP_SHARE of it. Votes are counted in cells of questions and memories (votes.py), and of each cell
only a question's best ones leave its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.durable import written
from attesta.functions.fixed import BODY_CHARS, GATE, HEAD_WEIGHTS, MARGIN, STOP_MIN, STOP_SHARE
from attesta.functions.text import clean_title, fold, grams, links_of, squeeze, words
from attesta.operators.votes import counted, texts, voted, worded


#: Rows of a table that is broadcast.
BROADCAST = 500_000


def checked(keys: DataFrame) -> DataFrame:
    """keys, broadcast if they are proven to be few; else joins shuffle them."""
    return F.broadcast(keys) if keys.limit(BROADCAST + 1).count() <= BROADCAST else keys


def heads(mem: DataFrame, folding=fold, body: bool = True) -> DataFrame:
    """head, gram, slug: the distinct grams of each memory's heads. mem: slug, title, hook, body (description is optional)."""
    said = [F.col(c) for c in ("title", "description", "hook") if c in mem.columns]
    meta = F.concat_ws(" ", *said)
    links = F.concat_ws(" ", links_of(F.col("body")))
    m = mem.select("slug", folding(F.concat_ws(" ", meta, links)).alias("w"), folding(meta).alias("m"), folding(F.substring("body", 1, BODY_CHARS)).alias("b"))
    spark = mem.sparkSession
    # By a number, so that the tasks are not merged again: the grams are many times the size of the text.
    m = m.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "slug")
    sets = [("word", words("w")), ("char3", grams("m", 3)), ("char2", grams("m", 2))] + ([("body", grams("b", 3))] if body else [])
    each = F.array(*[F.struct(F.lit(name).alias("head"), s.alias("grams")) for name, s in sets])
    return m.select("slug", F.explode(each).alias("h")).select("h.head", F.explode("h.grams").alias("gram"), "slug")


def frequencies(postings: DataFrame, n: Column) -> DataFrame:
    """head, gram, df, idf, is_stop; n: the number of memories."""
    df = postings.groupBy("head", "gram").agg(F.count("*").alias("df"))
    stop = (F.col("df") >= STOP_MIN) & (F.col("df") / n > STOP_SHARE)
    return df.select("head", "gram", "df", F.log(n / F.col("df")).alias("idf"), stop.alias("is_stop"))


def question_grams(questions: DataFrame, folding=fold) -> DataFrame:
    """q, head, gram."""
    q = questions.select("q", folding("question").alias("t"))
    sets = (("word", words("t")), ("char3", grams("t", 3)), ("char2", grams("t", 2)), ("body", grams("t", 3)))
    each = F.array(*[F.struct(F.lit(name).alias("head"), s.alias("grams")) for name, s in sets])
    return q.select("q", F.explode(each).alias("h")).select("q", "h.head", F.explode("h.grams").alias("gram"))


#: Characters of a name's first word, or of a name of one word, that are looked for within a word of a text; containment decides about the rest.
LED, HEAD = 32, 16
#: A question's runs of slug characters, and of others by threes.
RUNS, OTHERS = r"[a-z0-9-]+", r"(?s)(?=([^a-z0-9-]{3}))"


def digests(text: str, *names: str) -> list[Column]:
    """128 bits that stand for a text where rows meet."""
    return [F.xxhash64(F.lit(i), F.col(text)).alias(n) for i, n in enumerate(names, 1)]


def containing(texts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """texts (with a column t, squeezed) joined to the names of several words that t contains.

    Such a name starts with the end of a word in t; the words behind it are whole but for the last. An equi-join on its first three words (of the first the last LED
    characters), or fewer if it is short, comes before the comparison. Equal texts are compared once, and rows carry their digests until they meet a name.
    """
    parts = F.split(name, " ")
    first = F.right(F.get(parts, F.lit(0)), F.lit(LED))
    short = F.concat(first, F.lit(" "), F.substring(F.get(parts, F.lit(1)), 1, 2))
    key = F.when(F.size(parts) == 2, short).otherwise(F.array_join(F.concat(F.array(first), F.slice(parts, F.lit(2), F.least(F.size(parts) - 2, F.lit(2)))), " "))
    several = written(names.where(F.size(parts) > 1).select(*names.columns, first.alias("led"), key.alias("begins")))
    others = [c for c in texts.columns if c != "t"]
    texts = texts.select("*", *digests("t", "said1", "said2"))
    said = written(texts.select("said1", "said2", "t").distinct())
    ws = F.split("t", " ")
    beside = lambda i: F.slice(ws, F.lit(i), F.size(ws))
    ws = said.select("said1", "said2", F.explode(F.arrays_zip(ws.alias("w"), beside(2).alias("n1"), beside(3).alias("n2"))).alias("x")).select("said1", "said2", F.right("x.w", F.lit(LED)).alias("w"), "x.n1", "x.n2")
    ws = ws.where("w != '' and n1 is not null")
    ends = ws.select("said1", "said2", "n1", "n2", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring("w", i, F.length("w")))).alias("led"))
    ends = ends.join(checked(several.select("led").distinct()), "led", "left_semi")
    two = F.concat("led", F.lit(" "), "n1")
    keys = F.array(F.concat(two, F.lit(" "), "n2"), two, *[F.concat("led", F.lit(" "), F.substring("n1", 1, k)) for k in (1, 2)])
    keyed = ends.select("said1", "said2", F.explode(F.array_distinct(F.array_compact(keys))).alias("begins")).distinct()
    found = keyed.join(several.drop("led"), "begins").drop("begins").join(said, ["said1", "said2"]).where(F.col("t").contains(F.col(name)))
    return found.join(texts.select(*others, "said1", "said2"), ["said1", "said2"]).select(*others, "t", *names.columns)


def _inside(words: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """words (w, distinct) joined to the names of one word, three characters or more, that w contains; an equi-join on the first HEAD characters comes first."""
    # A long word is cut first, since a substring is searched for from the start.
    pieces = words.where("length(w) >= 3").select("w", F.explode(F.expr(f"transform(sequence(1, length(w), {3 * HEAD}), i -> substring(w, i, {4 * HEAD}))")).alias("piece"))
    heads = F.expr(f"flatten(transform(sequence(1, length(piece) - 2), i -> transform(sequence(3, least({HEAD}, length(piece) - i + 1)), k -> substring(piece, i, k))))")
    heads = pieces.where("length(piece) >= 3").select("w", F.explode(F.array_distinct(heads)).alias("head"))
    found = heads.join(names.withColumn("head", F.left(name, F.lit(HEAD))), "head")
    return found.where(F.col("w").contains(F.col(name))).select("w", *names.columns).distinct()


def _odd(slugs: DataFrame, runs: DataFrame, said: DataFrame) -> DataFrame:
    """q, slug of slugs with other characters than a slug's, which stand in a question as words: one run of slug characters is a run there, or three others are."""
    named = F.regexp_extract_all("s", F.lit(RUNS), F.lit(0))
    longest = F.array_max(F.transform(named, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    keyed = slugs.select("slug", "s", F.coalesce(longest, F.substring("s", 1, 3)).alias("run"))
    found = F.regexp_like("t", F.concat(F.lit("(?<![a-z0-9-])\\Q"), F.col("s"), F.lit("\\E(?![a-z0-9-])")))
    return runs.join(keyed, "run").join(said, ["t1", "t2"]).where(found).select("q", "slug")


def cited(mem: DataFrame, questions: DataFrame, folding=fold) -> DataFrame:
    """q, slug, score: 1 for the whole slug, its last part, and the title, each inside the question (the first two as words).

    A slug is found by an equi-join on the question's runs, a title by a join on its first words. Memories and questions are read once. Different titles meet different
    questions; only what is found is laid out for all memories of a title, which may be as many rows as there are memories and questions, so it is not shuffled where
    slugs and questions are different and the titles found are few.
    """
    qn = written(questions.select("q", squeeze(folding("question")).alias("t")).select("*", *digests("t", "t1", "t2")))
    m = written(mem.select("slug", folding("slug").alias("s"), clean_title(folding("title")).alias("title")).select("*", *digests("title", "n1", "n2")))
    asked, said = qn.where("t is not null").select("q", "t1", "t2"), qn.where("t is not null").select("t1", "t2", "t").distinct()
    both = F.concat(F.regexp_extract_all("t", F.lit(RUNS), F.lit(0)), F.regexp_extract_all("t", F.lit(OTHERS), F.lit(1)))
    runs = qn.select("q", "t1", "t2", F.explode(F.array_distinct(both)).alias("run"))
    base = F.regexp_extract("s", "([^/]*)$", 1)
    plain = F.length("s") >= 3
    slugs = m.where(plain & F.col("s").rlike(f"^{RUNS}$")).select("slug", F.col("s").alias("run"))
    bases = m.where((base != F.col("s")) & (F.length(base) >= 3) & base.rlike(f"^{RUNS}$")).select("slug", base.alias("run"))
    by_slug = runs.join(slugs.union(bases), "run").select("q", "slug").union(_odd(m.where(plain & ~F.col("s").rlike(f"^{RUNS}$")), runs, said))
    by_slug = written(by_slug.groupBy("q", "slug").agg(F.count("*").alias("n")))
    titled = m.where(F.length("title") >= 3)
    names, several = titled.select("title", "n1", "n2").distinct(), F.col("title").contains(" ")
    multi = containing(said, names.where(several), "title").select("t1", "t2", "n1", "n2", F.lit(True).alias("several"))
    of_text = said.select("t1", "t2", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    single = _inside(of_text.select("w").distinct(), names.where(~several), "title").join(of_text, "w").select("t1", "t2", "n1", "n2", F.lit(False).alias("several")).distinct()
    met = written(multi.union(single))
    pairs = checked(written(met.join(asked, ["t1", "t2"]).select("q", "n1", "n2", "several")))
    by_title = titled.select("slug", "n1", "n2").join(pairs, ["n1", "n2"]).select("q", "slug", "several")
    if _repeated(m, "slug") or _repeated(qn, "q"):
        votes = by_slug.union(by_title.distinct().select("q", "slug", F.lit(1).cast("long")))
        return votes.groupBy("q", "slug").agg(F.sum("n").cast("double").alias("score"))
    # At most one vote by title for a question and a slug, which is added to those by slug where both are.
    too = by_slug.join(asked, "q").join(titled.select("slug", "n1", "n2"), "slug", "left").join(met, ["t1", "t2", "n1", "n2"], "left")
    too = too.select("q", "slug", (F.col("n") + F.when(F.col("several").isNotNull(), 1).otherwise(0)).cast("double").alias("score"))
    return by_title.join(checked(by_slug.select("q", "slug")), ["q", "slug"], "left_anti").select("q", "slug", F.lit(1.0).alias("score")).union(too)


def _repeated(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().where(f"count > 1 or {key} is null").isEmpty()


def votes(mem: DataFrame, questions: DataFrame, folding=fold, body: bool = True, top: int | None = None) -> DataFrame:
    """q, slug, score (weighted sum over heads) for every memory with a vote; with top, at least each question's best ones by score and slug.

    A head's votes are divided by what the question could have reached in it: a known gram counts its
    idf, an unknown one ln(n), a stop gram nothing.
    """
    n = mem.agg(F.count("*").alias("n"))
    # A small table of questions would be one task's.
    questions = written(questions.select("q", "question").repartition(max(int(mem.sparkSession.conf.get("spark.sql.shuffle.partitions")), mem.sparkSession.sparkContext.defaultParallelism)))
    asked = question_grams(questions, folding)
    asked = written(asked if body else asked.where("head != 'body'"))
    rows = written(texts(mem, folding, body))
    counts = counted(rows).join(checked(asked.select("head", "gram").distinct()), ["head", "gram"], "left_semi").crossJoin(F.broadcast(n))  # n is one row
    stop = (F.col("df") >= STOP_MIN) & (F.col("df") / F.col("n") > STOP_SHARE)
    freq = counts.select("head", "gram", F.log(F.col("n") / F.col("df")).alias("idf"), stop.alias("is_stop"))
    known = written(asked.join(freq, ["head", "gram"], "left").crossJoin(F.broadcast(n)).where("is_stop is null or not is_stop"))
    mass = known.groupBy("q", "head").agg(F.sum(F.coalesce("idf", F.log(F.greatest(F.lit(2), F.col("n"))))).alias("mass")).where("mass > 0")
    of_head = F.element_at(F.create_map(*[F.lit(x) for pair in HEAD_WEIGHTS.items() for x in pair]), F.col("head"))
    live = known.where("idf is not null").join(mass, ["q", "head"]).select("q", "head", "gram", (F.col("idf") / F.col("mass") * of_head).alias("weight"))
    names = written(cited(mem, questions, folding))
    best = names.groupBy("q").agg(F.max("score").alias("best"))
    name = names.join(best, "q").select("q", "slug", (F.col("score") / F.col("best")).alias("name"))
    found = voted(rows, rows.count(), questions, live, name, HEAD_WEIGHTS["name"], top)
    return found.select("q", "slug", F.round("score", 9).alias("score"))


def lookup(mem: DataFrame, questions: DataFrame, top: int = 3, gate: float = GATE, folding=fold, body: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """One row per question, or per hit of one: q, verdict, reason, rank, slug, score.

    verdict 'ok' has hits; 'no-confident-hit' is silence, with the reason 'below gate' or 'margin'; 'untestable' had nothing to vote with.
    """
    rows = votes(mem, questions, folding, body, max(1, top) + 1) if scored is None else scored
    order = Window.partitionBy("q").orderBy(F.desc("score"), "slug")
    # The rank alone is bounded first, so that each task keeps its own best ones before the shuffle; the next score is looked up among the few that are left.
    best = written(rows.select("q", "slug", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= max(1, top) + 1))
    ranked = best.select("q", "slug", "score", F.col("rank").cast("long").alias("rank"), F.lead("score").over(order).alias("next")).where(F.col("rank") <= max(1, top))
    first = ranked.where("rank = 1")
    reason = F.when(F.col("score") < gate, "below gate").when((F.col("next") > 0) & (F.col("score") / F.col("next") < MARGIN), "margin")
    verdicts = questions.select("q").distinct().join(first.select("q", "score", reason.alias("reason"), F.lit(True).alias("voted")), "q", "left")
    verdict = F.when(F.col("voted").isNull(), "untestable").when(F.col("reason").isNotNull(), "no-confident-hit").otherwise("ok")
    verdicts = verdicts.select("q", verdict.alias("verdict"), "reason")
    hits = ranked.where(F.col("score") >= gate).select("q", "rank", "slug", "score")
    return verdicts.join(hits.withColumn("verdict", F.lit("ok")), ["q", "verdict"], "left").select("q", "verdict", "reason", "rank", "slug", F.round("score", 4).alias("score"))


def by_words(lines: DataFrame, questions: DataFrame, top: int = 3) -> DataFrame:
    """The fallback: q, rank, slug, hits; index lines by how often the question's terms occur in them, then by descending slug.

    Terms are runs of three or more letters or digits, in any case; of a line only the first link counts.
    """
    terms = questions.select("q", F.explode(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9]{3,}"), F.lit(0))).alias("term"))
    terms = terms.groupBy("q", "term").agg(F.count("*").alias("times"))
    named = lines.select("line_no", F.lower("line").alias("line"), F.regexp_extract("line", r"\(([^)]+)\.md\)", 1).alias("slug")).where("slug != ''")
    hits = worded(named, terms, top)  # a term in a line is inside one of its runs of letters and digits
    order = Window.partitionBy("q").orderBy(F.desc("hits"), F.desc("slug"))
    best = hits.select("q", "slug", "hits", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return best.select("q", F.col("rank").cast("long").alias("rank"), "slug", "hits")
