"""The catalogue, continued: journals, quiet passes, novelty, receipts, drafts, profiles and derived maps."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.durable import shared_dir
from attesta.operators import budget, drafts, edges, maps, names, novelty, receipts, tidy
from attesta.plans import adapters
from attesta.plans.adapters import CANDIDATE, LINE, MEM, table
from attesta.plans.catalogue import ASKED, EDGED, EST, FIRSTS, FREQ, HEADS, LAYER, NAMED, SCORED, _derived, _firsts, _layers, query
from attesta.sources import journals, logs
from attesta.sources.derived import Derived
from attesta.sources.writer import StoreTable
from attesta.streaming import intake, tracks

#: The key of the stores that these queries make.
KEY = b"a key that only this store's owner knows"


def _hmac_sql(message: str, key: bytes = KEY) -> str:
    """hmac_sha256 in DuckDB."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


# Journals


@query(
    """SELECT cls, text, n FROM (SELECT CASE role WHEN 'user' THEN 'USER' ELSE 'SELF' END AS cls, trim(text) AS text, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND length(text) <= 4000
    AND octet_length(encode(to_json({'schema_version': 1, 'event_id': 'e', 'session_id': 'conv-' || conv_id, 'turn_id': turn::VARCHAR, 'class': 'USER', 'text': text, 'timestamp': '2024-01-02T03:04:05Z'})::VARCHAR)) < 32000 GROUP BY ALL)"""
)
def journal_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a line of evidence in journals, read back through the source and judged."""
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant') and text is not null")
    cls = F.when(F.col("role") == "user", "USER").otherwise("SELF")
    said = F.struct(F.lit(1).alias("schema_version"), F.lit("e").alias("event_id"), F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("turn").cast("string").alias("turn_id"), cls.alias("class"), "text", F.lit("2024-01-02T03:04:05Z").alias("timestamp"))
    folder = shared_dir(spark)
    turns.select(F.to_json(said)).write.text(folder)
    journals.register(spark)
    rows = spark.read.format("journals").option("path", f"{folder}/*.txt").load()
    return intake.evidence(rows).where("reason is null").groupBy("cls", "text").agg(F.count("*").alias("n"))


# Quiet passes


@query()
def quiet_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's store is due: views and clicks are activity, purchases, errors and sign-ups the outcomes of runs."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "activity").otherwise("finished")
    rc = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2)
    counts = F.create_map(*[x for i, c in enumerate(("poured", "tossed", "drafts", "trailed", "paid", "tidied")) for x in (F.lit(c), F.col("event_id") % (i + 2))])
    log = e.select(F.concat(F.lit("user-"), "user_id").alias("store"), F.col("ts").alias("at"), kind.alias("kind"), F.lit(None).cast("string").alias("track"), rc.alias("rc"), counts.alias("counts"))
    done = tracks.replayed(log, until="2024-02-01", idle=60, backoff=120)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("done")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
    return done.select("store", "at", "action", "track", shown.alias("done"))


# Novelty

_CANDIDATE_QUESTION = "question AS (SELECT cand::VARCHAR AS q, concat_ws(' ', why, quote) AS question FROM candidate)"


def _evidenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.candidates(spark, sf_dir)
    return c.select("cand", F.lit(None).cast("string").alias("topic"), "why", F.array(F.struct(F.lit("USER").alias("class"), F.col("quote").alias("text"))).alias("evidence"))


def _says():
    """A rule in place of a model: a memory that contains the words covers them, the second nearest is extended by every other candidate."""
    quote = F.get("evidence", F.lit(0))["text"]
    covers = F.get(F.filter("near", lambda n: n["opening"].contains(quote)), F.lit(0))["slug"]
    second = F.coalesce(F.get("near", F.lit(1)), F.get("near", F.lit(0)))["slug"]
    other = F.when(F.col("cand").cast("long") % 2 == 0, F.concat(F.lit("EXTENDS `"), second, F.lit("`,\nIt goes\non."))).otherwise(F.lit("perhaps"))
    return F.coalesce(F.concat(F.lit("covered "), covers, F.lit("\nIt is there.")), other)


@query(
    """, ranked AS (SELECT q, slug, row_number() OVER (PARTITION BY q ORDER BY score DESC, slug) AS rank FROM scored),
near AS (SELECT q, rank, slug, left(body, 7000) AS opening FROM ranked JOIN mem USING (slug) WHERE rank <= 3),
seen AS (SELECT cand, count(n.q) AS k, min(CASE WHEN contains(opening, quote) THEN rank END) AS cov, max(CASE rank WHEN 1 THEN slug END) AS s1, max(CASE rank WHEN 2 THEN slug END) AS s2, max(CASE rank WHEN 3 THEN slug END) AS s3 FROM candidate LEFT JOIN near n ON n.q = cand::VARCHAR GROUP BY cand)
SELECT cand::VARCHAR AS cand, CASE WHEN k = 0 THEN 'NEW' WHEN cov IS NOT NULL THEN 'COVERED' WHEN cand % 2 = 0 THEN 'EXTENDS' ELSE 'NEW' END AS verdict,
    CASE WHEN k = 0 THEN NULL WHEN cov IS NOT NULL THEN CASE cov WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END WHEN cand % 2 = 0 THEN coalesce(s2, s1) ELSE s1 END AS slug,
    CASE WHEN k = 0 THEN 'nothing close in the store' WHEN cov IS NOT NULL THEN 'It is there.' WHEN cand % 2 = 0 THEN 'It goes on.' ELSE '' END AS why FROM seen""",
    MEM,
    CANDIDATE,
    _CANDIDATE_QUESTION,
    HEADS,
    FREQ,
    ASKED,
    NAMED,
    SCORED,
)
def novelty_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against its three nearest memories."""
    mem = adapters.memories(spark, sf_dir)
    cands = _evidenced(spark, sf_dir)
    return novelty.judged(novelty.prompts(cands, novelty.neighbours(cands, mem), mem), _says)


# Receipts

_RECEIPT = f"""
turn AS (SELECT conv_id * 1000 + turn AS cand, 'doc-' || (conv_id * 1000 + turn) % (SELECT count(*) FROM documents) AS slug, quote, split_part(quote, ' ', 1) AS cue
    FROM (SELECT *, trim(regexp_replace(regexp_extract(text, '^[^.]*'), '\\s+', ' ', 'g')) AS quote FROM conversations WHERE role = 'user' AND text IS NOT NULL) WHERE split_part(quote, ' ', 1) <> ''),
named AS (SELECT *, CASE cand % 10 WHEN 2 THEN 'nobody' ELSE slug END AS route, sha256(cand::VARCHAR) AS paper FROM turn),
said AS (SELECT *, 'cue-receipt-2' || chr(31) || route || chr(31) || 'sha256:' || paper || chr(31) || 'new' || chr(31) || cue || chr(29) || 'USER' || chr(29) || quote AS t FROM named),
receipt AS (SELECT *, sha256(t) AS digest, {_hmac_sql("t")} AS mark, {_hmac_sql("t", b"another")} AS forged FROM said)"""


def _receipts(spark: SparkSession, sf_dir: str):
    """Receipts of the first words of users' turns, nine in ten of them faulty in one of seven ways or sound; manifests; slugs."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    cand = F.col("conv_id") * 1000 + F.col("turn")
    docs = table(spark, sf_dir, "documents")
    n = F.broadcast(docs.agg(F.count("*").alias("n_docs")))  # one row
    quote = F.trim(F.regexp_replace(F.regexp_extract("text", "^[^.]*", 0), r"(?U)\s+", " "))
    rows = turns.crossJoin(n).select(cand.alias("cand"), F.concat(F.lit("doc-"), cand % F.col("n_docs")).alias("slug"), quote.alias("quote"), F.split(quote, " ")[0].alias("cue")).where("cue != ''")
    way = F.col("cand") % 10
    cues = F.array(F.struct(F.col("cue").alias("text"), F.lit("USER").alias("class"), "quote"))
    paper = F.sha2(F.col("cand").cast("string"), 256)
    wanted = rows.select(F.when(way == 2, "nobody").otherwise(F.col("slug")).alias("slug"), F.concat(F.lit("sha256:"), paper).alias("manifest"), cues.alias("cues"))
    sound, forged = (receipts.issued(wanted, k, "new").select("manifest", "mark") for k in (KEY, b"another"))
    held = receipts.issued(wanted, KEY, "new").drop("mark").join(sound, "manifest").join(forged.withColumnRenamed("mark", "forged"), "manifest")
    held = held.join(rows.select("cand", F.concat(F.lit("sha256:"), paper).alias("manifest")), "manifest")
    held = held.select("cand", F.when(way == 1, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"), "slug", "manifest", "cues", "via", F.when(way == 0, F.col("forged")).otherwise(F.col("mark")).alias("mark"))
    papers = rows.where(way != 3).select(
        paper.alias("digest"),
        F.when(way == 5, "doc-other").otherwise(F.col("slug")).alias("memory_slug"),
        F.when(way == 4, 2).otherwise(1).alias("version"),
        F.when(way == 6, F.array().cast(receipts.CUES)).otherwise(cues).alias("approved"),
        F.array(F.struct(F.lit("USER").alias("class"), F.col("quote").alias("text"))).alias("quotes"),
    )
    return held, papers, docs.select(F.concat(F.lit("doc-"), "doc_id").alias("slug"))


@query(
    """SELECT cand, CASE cand % 10 WHEN 1 THEN reverse(digest) ELSE digest END AS digest, CASE cand % 10 WHEN 0 THEN forged ELSE mark END AS mark,
CASE cand % 10 WHEN 1 THEN 'not its digest' WHEN 0 THEN 'not signed' WHEN 2 THEN 'unknown memory' WHEN 3 THEN 'no manifest' WHEN 4 THEN 'another version' WHEN 5 THEN 'another memory' WHEN 6 THEN 'cue not approved'
ELSE CASE WHEN length(cue) BETWEEN 3 AND 40 AND regexp_matches(cue, '[\\p{L}\\p{N}]') THEN NULL ELSE 'cue not approved' END END AS fault FROM receipt""",
    _RECEIPT,
)
def receipts_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed receipts, and what is wrong with those that prove no route."""
    return receipts.checked(*_receipts(spark, sf_dir), KEY).select("cand", "digest", "mark", "fault")


# Drafts

_DRAFT = """
spelt AS (SELECT cand, translate(batch, '0123456789', 'abcdefghij') AS batch, quote FROM candidate),
base AS (SELECT cand, batch, quote, 'TITLE: ' || batch || chr(10) || 'DESC: from a turn' || chr(10) || CASE cand % 17 WHEN 0 THEN 'TAGS: [9 9]' || chr(10) ELSE '' END || chr(10) || quote || chr(10) AS body, sha256(quote) AS manifest,
    row_number() OVER (PARTITION BY batch ORDER BY cand) AS k FROM spelt),
draft AS (SELECT *, batch || CASE k WHEN 1 THEN '' ELSE '.' || k END AS slug FROM base)"""


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft of every candidate, some edited after they were signed or after they were judged, and a rule's answers to them."""
    c = adapters.candidates(spark, sf_dir).select("cand", F.translate("batch", "0123456789", "abcdefghij").alias("batch"), "quote")  # a number in a name would be a claim
    way = lambda n: F.col("cand") % n
    tags = F.when(way(17) == 0, "TAGS: [9 9]\n").otherwise("")
    body = F.concat(F.lit("TITLE: "), "batch", F.lit("\nDESC: from a turn\n"), tags, F.lit("\n"), "quote", F.lit("\n"))
    made = drafts.staged(c.select("cand", F.col("batch").alias("slug"), F.lit("project").alias("kind"), F.sha2("quote", 256).alias("manifest"), body.alias("body")), KEY)
    made = made.withColumn("body", F.when(way(7) == 0, F.concat("body", F.lit("more"))).otherwise(F.col("body")))
    judged = F.when(way(11) == 0, F.lit("other bytes")).otherwise(drafts.digest())
    fixed = F.concat(F.lit("FIX\nreason: too much\nBODY:\nshorter"), F.when(way(3) == 0, " by 98765").otherwise(""))
    answer = F.when(way(5) == 0, "POUR\nreason: good").when(way(5) == 1, fixed).when(way(5) == 2, "no shape at all").when(way(5) == 3, " ").otherwise("FIX\nreason: unsure")
    answers = made.select("slug", judged.alias("judged"), answer.alias("answer"))
    papers = c.where(way(13) != 0).select(F.sha2("quote", 256).alias("manifest"), F.array(F.struct(F.lit("USER").alias("class"), F.col("quote").alias("text"))).alias("quotes"))
    known = c.where(way(13) == 0).select(F.sha2("quote", 256).alias("manifest"))
    return drafts.drained(made.drop("cand"), answers, papers.join(known, "manifest", "left_anti"), KEY)


_LOST = "lost AS (SELECT DISTINCT manifest FROM draft WHERE cand % 13 = 0)"
_OUTCOME = """
outcome AS (SELECT slug, cand, body, quote, batch, CASE WHEN cand % 7 = 0 THEN 'quarantined' WHEN cand % 5 = 3 THEN 'skipped' WHEN cand % 11 = 0 THEN 'moved' WHEN cand % 5 = 2 THEN 'tossed' WHEN cand % 5 = 4 THEN 'fix unparsed'
    WHEN cand % 5 = 1 AND (gone OR cand % 3 = 0 OR cand % 17 = 0) THEN 'fix refused' WHEN gone THEN 'refused' WHEN cand % 17 = 0 THEN 'refused' WHEN cand % 5 = 1 THEN 'fixed' ELSE 'poured' END AS outcome
    FROM (SELECT *, manifest IN (SELECT manifest FROM lost) AS gone FROM draft))"""
_DRAFTS = (CANDIDATE, _DRAFT, _LOST, _OUTCOME)


@query("SELECT slug, outcome FROM outcome", *_DRAFTS)
def drain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each draft: poured, fixed, tossed, or left and why."""
    return _drained(spark, sf_dir).select("slug", "outcome")


@query("SELECT k.outcome, count(outcome.slug) AS n FROM unnest(['poured', 'fixed', 'tossed', 'skipped', 'quarantined', 'moved', 'fix unparsed', 'fix refused', 'refused']) AS k(outcome) LEFT JOIN outcome USING (outcome) GROUP BY k.outcome", *_DRAFTS)
def drain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.counts(_drained(spark, sf_dir))


@query("SELECT slug, batch AS title, 'from a turn' AS description, CASE outcome WHEN 'fixed' THEN 'shorter' ELSE quote END AS body FROM outcome WHERE outcome IN ('poured', 'fixed')", *_DRAFTS)
def drain_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that the drain pours."""
    store = adapters.memories(spark, sf_dir).select("slug", "title", F.lit("").alias("description"), "type", "body")
    return drafts.memories(_drained(spark, sf_dir), store).select("slug", "title", "description", "body")


# Profiles and derived maps


@query("SELECT n, slug, chars, used FROM (SELECT row_number() OVER w AS n, slug, length(body) AS chars, sum(length(body)) OVER (ORDER BY slug ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM mem WINDOW w AS (ORDER BY slug)) WHERE used <= 60000", MEM)
def profile_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that a profile is drafted from."""
    return budget.profile_material(adapters.memories(spark, sf_dir)).select("n", "slug", "chars", "used")


@query("SELECT doc_id, slug, sum(length(text)) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM (SELECT doc_id, 'doc-' || doc_id AS slug, coalesce(text, '') AS text, n_chars FROM documents)")
def running_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters all documents up to each one have, the short ones first: a running sum over the whole table, no task of which sees all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("slug"), "n_chars", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return budget.running(docs, [F.col("n_chars"), F.col("doc_id")], "chars").select("doc_id", "slug", "used", "n")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'absent' WHEN NOT regexp_matches(text, '[^\\s]') THEN 'broken' WHEN regexp_matches(text, '(?m)^\\s*[-*|]?\\s*[^:|\\n]{1,60}[:|]\\s*\\d+(\\.\\d+)?\\s*%?\\s*\\|?\\s*$') OR regexp_matches(text, '(?i)\\b(score|weight|priority|importance|salience)\\b\\s*[:=]?\\s*\\d') THEN 'broken' ELSE 'present' END AS state FROM (SELECT doc_id, text || CASE doc_id % 9 WHEN 3 THEN chr(10) || 'trading: 0.8' WHEN 4 THEN ' Priority 7.' WHEN 5 THEN chr(10) || 'It began in 1999: a year.' ELSE '' END AS text FROM documents)")
def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document, some with a table of numbers or a score behind it, may be a profile."""
    more = F.when(F.col("doc_id") % 9 == 3, "\ntrading: 0.8").when(F.col("doc_id") % 9 == 4, " Priority 7.").when(F.col("doc_id") % 9 == 5, "\nIt began in 1999: a year.").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", budget.profile_state(F.concat("text", more))["state"].alias("state"))


@query(
    f""", once AS (SELECT age, slug, line, {EST.format("line")} AS cost FROM (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY age, slug) AS r FROM layered JOIN first_line USING (slug) WHERE layer = 'fresh') WHERE r = 1),
run AS (SELECT row_number() OVER w AS n, slug, sum(cost) OVER (ORDER BY age, slug ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM once WINDOW w AS (ORDER BY age, slug)),
map AS (SELECT n, slug, used FROM run WHERE n = 1 OR used <= 2000)
SELECT 'first' AS read, n, slug, used FROM map UNION ALL SELECT 'after a lost race', n, slug, used FROM map UNION ALL SELECT 'rebuilt', n, slug, used FROM map""",
    MEM,
    LINE,
    LAYER,
    FIRSTS,
)
def trail_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail as a published map: built and read; a build that the store overtakes is refused and the map before it becomes stale; built again."""
    mem = adapters.memories(spark, sf_dir)
    store = StoreTable(spark, shared_dir(spark))
    store.upsert(mem.select("slug", "title", "hook", "type", "body"))
    trail = Derived(store, "trail", KEY, spec="2000 tokens")

    def build(rows: DataFrame) -> DataFrame:
        now = mem.drop("type", "body").join(rows.where("type != 'note'").select("slug", "type", "body"), "slug")
        return maps.trail(_layers(now), _firsts(now), 2000).select("n", "slug", "used")

    def seen(rows: DataFrame | None, read: str) -> DataFrame:
        if rows is None:
            raise RuntimeError(f"the map is stale: {read}")
        return rows.select(F.lit(read).alias("read"), "n", "slug", "used")

    first = seen(trail.fresh(build), "first")
    rows, stamp = trail.built(build)
    if trail.publish(rows, stamp) != "unchanged":
        raise RuntimeError("an equal map was written again")
    store.upsert(spark.createDataFrame([("note-1", "note", "a note that is in no index")], "slug string, type string, body string"))
    if trail.publish(rows, stamp) != "refused" or not trail.is_stale():
        raise RuntimeError("a map of an older store was published")
    held = seen(trail._rows(trail.record()), "after a lost race")
    return first.union(held).union(seen(trail.fresh(build), "rebuilt"))


# Maps: what leads on, and which one fits

_TRAIL = f"""
once AS (SELECT age, slug, line, {EST.format("line")} AS cost FROM (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY age, slug) AS r FROM layered JOIN first_line USING (slug) WHERE layer = 'fresh') WHERE r = 1),
run AS (SELECT row_number() OVER w AS n, slug, sum(cost) OVER (ORDER BY age, slug ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM once WINDOW w AS (ORDER BY age, slug)),
map AS (SELECT n, slug, used FROM run WHERE n = 1 OR used <= 20000)"""


@query(
    """, next AS (SELECT row_number() OVER (ORDER BY n, target, type) AS r, source, target, type FROM map JOIN derived ON source = slug WHERE outcome = 'edge' AND type IN ('continues', 'next'))
SELECT r, '↳ ' || source || ' ' || type || ' → ' || target AS line FROM next WHERE r <= 3""",
    MEM,
    LINE,
    LAYER,
    FIRSTS,
    EDGED,
    _TRAIL,
)
def trail_onward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edges that lead on from the trail."""
    mem = adapters.memories(spark, sf_dir)
    rows = maps.trail(_layers(mem), _firsts(mem), 20_000)
    return maps.onward(rows, _derived(spark, sf_dir).where("outcome = 'edge'"))


@query(f"SELECT source, full_tokens, CASE WHEN full_tokens <= 2000 THEN 'full' WHEN full_tokens // 3 <= 8000 THEN 'woven' ELSE 'constellation' END AS mode FROM (SELECT source, sum({EST.format('text')})::BIGINT AS full_tokens FROM documents GROUP BY source)")
def resident_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a store: whether its whole index, its woven map (here a third of it) or its sectors fit the window."""
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(maps.token_estimate("text")).alias("full_tokens"))
    return t.select("source", "full_tokens", maps.resident_mode(F.col("full_tokens"), F.floor(F.col("full_tokens") / 3), 40_000).alias("mode"))


# Tidy

_RAG = """
entries AS (SELECT doc_id AS line_no, slug, CASE doc_id % 6 WHEN 0 THEN 'T' ELSE slug END AS t, CASE doc_id % 3 WHEN 0 THEN 'tiny' ELSE 'a trigger that one can recognise' END AS d, body FROM mem),
was AS (SELECT line_no, slug, '- [' || t || '](' || slug || '.md) — ' || d AS line, d, body FROM entries),
fix AS (SELECT line_no, slug, line, CASE WHEN line_no % 4 = 1 THEN 'refused' WHEN line_no % 5 = 2 THEN 'memory changed' WHEN line_no % 7 = 3 THEN 'line moved' ELSE 'fixed' END AS outcome FROM was WHERE d = 'tiny' AND line_no % 11 <> 4)"""


@query(
    """SELECT was.line_no, CASE WHEN outcome = 'fixed' THEN '- [Better](' || was.slug || '.md) — what it is about' WHEN was.line_no % 7 = 3 THEN was.line || ' (seen)' ELSE was.line END AS line, outcome FROM was LEFT JOIN fix USING (line_no)""",
    MEM,
    _RAG,
)
def tidy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged index lines repaired by a rule, while every seventh line and every fifth memory change."""
    mem = adapters.memories(spark, sf_dir)
    way = lambda n: F.col("line_no") % n
    title = F.when(F.col("doc_id") % 6 == 0, "T").otherwise(F.col("slug"))
    desc = F.when(F.col("doc_id") % 3 == 0, "tiny").otherwise("a trigger that one can recognise")
    was = mem.select(F.col("doc_id").alias("line_no"), F.concat(F.lit("- ["), title, F.lit("]("), "slug", F.lit(".md) — "), desc).alias("line"))
    answer = F.when(way(11) == 4, "no shape").when(way(4) == 1, "TITLE: Better\nDESC: 987654321 things").otherwise("TITLE: Better\nDESC: what it is about")
    fixes = tidy.repairs(tidy.asked(was, mem).withColumn("answer", answer))
    now = was.withColumn("line", F.when(way(7) == 3, F.concat("line", F.lit(" (seen)"))).otherwise(F.col("line")))
    later = mem.select("slug", F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("new "), "body")).otherwise(F.col("body")).alias("body"))
    index, outcomes = tidy.merged(now, fixes, later)
    slugs = mem.select("slug", F.col("doc_id").alias("line_no"))
    return index.join(outcomes.join(slugs, "slug").drop("slug"), "line_no", "left")


# Logs


@query("SELECT user_id AS slug, count(*) AS reads, max(ts) AS last FROM events GROUP BY user_id")
def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads from a log that three writers append to, one of them twice, compacted in between."""
    log = logs.LogTable(spark, shared_dir(spark), "reads", "at timestamp_ntz, why string, n array<bigint>")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("why"), F.array("user_id").alias("n"))
    for k in (0, 1, 0):
        log.append(e.where(f"event_id % 3 = {k}"), f"writer-{k}")
    if log.compact() != 2:
        raise RuntimeError("an append that came again was taken")
    log.append(e.where("event_id % 3 = 2"))
    return log.read().select("at", F.explode("n").alias("slug")).groupBy("slug").agg(F.count("*").alias("reads"), F.max("at").alias("last"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = s.conv_id AND c.turn = s.turn + 1) THEN 'told' END AS how, substr(left('#' || conv_id || ':' || turn || ' ' || coalesce(text, ''), 300), length('#' || conv_id || ':' || turn || ' ') + 1) AS text
FROM conversations s WHERE turn % 2 = 0"""
)
def seeds_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second turn sows an idea; the turn behind every fourth confirms it."""
    turns = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn"))
    key = F.concat(F.lit("#"), F.col("conv_id"), F.lit(":"))
    named = lambda turn, text: F.concat(key, turn.cast("string"), F.lit(" "), F.coalesce(text, F.lit("")))
    sow = turns.where("turn % 2 = 0").select(*logs.sown(named(F.col("turn"), F.col("text")), F.col("role"), F.lit(""), at))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("was"))
    tell = turns.where("turn % 4 = 1").join(before, ["conv_id", "turn"]).select(*logs.confirmation(named(F.col("turn") - 1, F.col("was")), F.lit("told"), F.lit(None).cast("string"), at))
    log = logs.LogTable(spark, shared_dir(spark), "seeds", logs.SEEDS)
    log.append(sow, "sown")
    log.append(tell, "confirmed")
    found = logs.seeds(log.read())
    place = F.unix_seconds("at")
    shown = F.regexp_replace("text", r"^#\d+:\d+ ", "")
    return found.select((F.expr("unix_seconds(at) div 1000")).alias("conv_id"), (place % 1000).alias("turn"), "how", shown.alias("text"))
