"""Text functions of the memory engine, as Column expressions.

Java's \\s, \\d and \\w are ASCII unless a pattern starts with (?U); the patterns here say which they mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.fixed import (
    ARROW,
    CODE_LIKE,
    DEAD_WORDS,
    HUMAN_CREDIT,
    MARKERS,
    NEGATION_EN,
    NEGATION_JA,
    NUMBER,
    TAG_SHAPE,
    TOKEN,
    TOKEN_WEIGHTS,
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: a lambda would otherwise evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column | str) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def fold(text: Column | str) -> Column:
    """Unicode compatibility composition, then case folding, within the JVM: ICU's, which Spark brings, called by reflection. ASCII is lower-cased.

    A projection's function: Spark takes reflection for non-deterministic, so it belongs in select, not in a join's condition.
    """
    t = _c(text)
    icu = lambda of, method, x: F.reflect(F.lit(f"com.ibm.icu.{of}"), F.lit(method), x, F.lit(True))
    return F.when(t.rlike(r"[^\x00-\x7f]"), icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", t))).otherwise(F.lower(t))


def words(folded: Column | str) -> Column:
    """The distinct word tokens of a folded text: ports, words with dotted versions, numbers, katakana runs."""
    return F.array_distinct(F.regexp_extract_all(_c(folded), F.lit(TOKEN), F.lit(0)))


def grams(folded: Column | str, n: int) -> Column:
    """The set of character n-grams of a folded, squeezed text, without the gram of spaces only."""

    def cells(chars: Column) -> Column:  # an array, since a substring is searched for from the start
        runs = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))
        return F.when(F.size(chars) >= n, F.array_remove(F.array_distinct(runs), " " * n)).otherwise(F.array().cast("array<string>"))

    return F.coalesce(let(F.split(squeeze(folded), ""), cells), F.array().cast("array<string>"))


def clean_title(folded: Column | str) -> Column:
    return F.regexp_replace(_c(folded), r"(?U)^[^\w]+|[^\w]+$", "")


def token_estimate(text: Column | str) -> Column:
    """Tokens by script: a weight for each character, summed and truncated."""
    t = F.coalesce(_c(text), F.lit(""))
    counts = {name: F.regexp_count(t, F.lit(pattern)) for name, pattern, _ in TOKEN_WEIGHTS if pattern}
    rest = F.greatest(F.lit(0), F.length(t) - sum(counts.values(), F.lit(0)))
    total = F.lit(0.0)
    for name, pattern, weight in TOKEN_WEIGHTS:
        total = total + (counts[name] if pattern else rest) * F.lit(weight)
    return total.cast("int")


def window_share(text: Column | str, window_tokens: int) -> Column:
    return token_estimate(text) / F.lit(float(max(1, window_tokens)))


def script(text: Column | str) -> Column:
    """'ja', 'en', 'mixed' or 'other', by the letters that occur."""
    ja, en = F.regexp_count(_c(text), F.lit("[぀-ヿ一-鿿]")) > 0, F.regexp_count(_c(text), F.lit("[A-Za-z]")) > 0
    return F.when(ja & en, "mixed").when(ja, "ja").when(en, "en").otherwise("other")


# Names and tags


def clean_name(name: Column | str) -> Column:
    """Without white space, brackets and quotes at the ends, and one trailing .md."""
    inner = F.regexp_replace(F.trim(F.coalesce(_c(name), F.lit(""))), r"""^[\[\]()`"' ]+|[\[\]()`"' ]+$""", "")
    return F.regexp_replace(inner, r"\.md$", "")


def tag_list(tags: Column | str) -> Column:
    """An array of raw tags from a JSON array or a list separated by commas or spaces."""
    t = F.trim(_c(tags))
    listed = F.filter(F.split(t, r"[,\s]+"), lambda x: x != "")
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.isNull(), F.array().cast("array<string>")).otherwise(listed)


def tags_valid(raw: Column) -> Column:
    return raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & F.trim(x).rlike(TAG_SHAPE))


def normalize_tags(tags: Column | str, strict: bool = True) -> Column:
    """Sorted distinct tags; an invalid one raises, or gives null if not strict."""
    raw = tag_list(tags)
    clean = F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.trim(x))))
    bad = F.raise_error(F.concat(F.lit("not a list of tags: "), F.coalesce(_c(tags), F.lit("null")))).cast("array<string>") if strict else F.lit(None).cast("array<string>")
    return F.when(tags_valid(raw), clean).otherwise(bad)


def annotations(front: Column | str) -> Column:
    keys = ("belongs_because", "keep", "may_fade")
    return F.map_filter(_c(front), lambda k, v: k.isin(*keys) & (v != ""))


def links_of(text: Column | str) -> Column:
    """Targets of [[name]] links: 1 to 60 characters, without spaces or an ideographic full stop."""
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(r"\[\[([^\]]{1,60})\]\]"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: (x != "") & ~x.contains(" ") & ~x.contains("。"))


def safe_slug(raw: Column | str) -> Column:
    """Lower-case letters, digits and single dashes, at most 60; a digest where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(_c(raw), F.lit("")))), r"\.md$", ""), r"[^a-z0-9-]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", ""), 1, 60), "-+$", "")
    return F.when(s == "", F.concat(F.lit("m-"), F.substring(F.sha2(F.coalesce(_c(raw), F.lit("")), 256), 1, 12))).otherwise(s)


def index_line(title: Column | str, slug: Column | str, hook: Column | str) -> Column:
    return F.concat(F.lit("- ["), _c(title), F.lit("]("), _c(slug), F.lit(".md) — "), _c(hook))


def uncommented(index: Column | str) -> Column:
    return F.regexp_replace(_c(index), r"(?s)<!--.*?-->", "")


# Numbers


def _number_text(text: Column) -> Column:
    """Full-width digits and signs become ASCII, and a dash between digits becomes a minus sign."""
    ascii_ = F.translate(text, "０１２３４５６７８９．，＋－：／−", "0123456789.,+-:/-")
    return F.regexp_replace(ascii_, "(?<=\\d)\\s?[–—]\\s?(?=\\d)", "-")


def number_tokens(text: Column | str) -> Column:
    """Numbers in order: a sign is kept, thousands commas and closing punctuation are not, E is e."""
    found = F.regexp_extract_all(_number_text(_c(text)), F.lit(NUMBER), F.lit(0))
    one = lambda t: F.regexp_replace(F.replace(F.regexp_replace(t, "[,.:/-]+$", ""), F.lit("E"), F.lit("e")), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    return F.transform(found, one)


def invented_numbers(text: Column | str, evidence: Column | str) -> Column:
    """Distinct numbers of text, in order, that evidence does not have. A signed number needs its sign; an unsigned one a magnitude."""
    exact = number_tokens(evidence)
    plain = F.transform(exact, lambda t: F.regexp_replace(t, "^[+-]+", ""))
    listed = F.regexp_replace(_number_text(_c(text)), r"(?m)^\s*\d+[.)]\s+", "")

    def bad(held: Column) -> Column:
        known = lambda t: F.when(t.rlike("^[+-]"), F.array_contains(held["e"], t)).otherwise(F.array_contains(held["p"], t))
        return F.array_distinct(F.filter(number_tokens(listed), lambda t: ~known(t)))

    return let(F.struct(exact.alias("e"), plain.alias("p")), bad)


# Floors on what a model wrote


def credits_human(text: Column | str) -> Column:
    pattern = "|".join(f"(?:{p})" for p in HUMAN_CREDIT)
    return F.coalesce(_c(text), F.lit("")).rlike(f"(?iU){pattern}")


def grounded_share(trigger: Column | str, source: Column | str) -> Column:
    """Share of the trigger's character pairs, white space removed, that the source has."""

    def share(t: Column, d: Column) -> Column:
        pairs = let(F.split(t, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1))))
        hits = F.size(F.filter(pairs, lambda g: d.contains(g))) / (F.length(t) - 1)
        return F.when(F.length(t) == 0, 0.0).when(F.length(t) == 1, d.contains(t).cast("double")).otherwise(hits)

    both = F.struct(F.regexp_replace(_c(trigger), r"(?U)\s+", "").alias("t"), F.regexp_replace(_c(source), r"(?U)\s+", "").alias("d"))
    return let(both, lambda x: share(x["t"], x["d"]))


def negations(text: Column | str) -> Column:
    """Negation words that occur, English ones at word boundaries and in any case."""
    t = _c(text)
    en = F.filter(F.array(*map(F.lit, NEGATION_EN)), lambda w: F.regexp_like(F.lower(t), F.concat(F.lit("(?<![a-z'])\\Q"), w, F.lit("\\E(?![a-z'])"))))
    ja = F.filter(F.array(*map(F.lit, NEGATION_JA)), lambda w: t.contains(w))
    return F.array_sort(F.concat(en, ja))


def identifiers(text: Column | str) -> Column:
    """Code-like tokens: with a digit, an inner mark, or two capitals."""
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(CODE_LIKE), F.lit(0)), lambda x: F.regexp_replace(x, r"[./+-]+$", ""))
    like = lambda x: x.rlike(r"\d") | x.rlike(r"[A-Za-z0-9][-_./+][A-Za-z0-9]") | (F.regexp_count(x, F.lit("[A-Z]")) >= 2)
    return F.array_distinct(F.filter(found, like))


def arrows(text: Column | str) -> Column:
    """'before>after' of each arrow."""
    pair = lambda i: F.regexp_extract_all(_c(text), F.lit(ARROW), F.lit(i))
    return F.array_distinct(F.zip_with(pair(1), pair(2), lambda a, b: F.concat(a, F.lit(">"), b)))


def markers_restored(source: Column | str, trigger: Column | str) -> Column:
    out = _c(trigger)
    for mark, written in MARKERS:
        out = F.when(_c(source).contains(mark) & ~out.contains(mark), F.concat(F.lit(written), out)).otherwise(out)
    return out


def dead_word(text: Column | str) -> Column:
    return F.lower(_c(text)).isin(*DEAD_WORDS)


def cue_hit(cues: tuple[str, ...], line: Column | str) -> Column:
    """The first cue in the line: ASCII cues in any case, others exactly."""
    line = _c(line)
    inside = lambda w: F.lower(line).contains(w) if w.isascii() else line.contains(w)
    return F.coalesce(*[F.when(inside(w), F.lit(w)) for w in cues])


def cue_position(cues: tuple[str, ...], line: Column | str) -> Column:
    """Place (from 0) of the first occurrence of any cue, -1 without one."""
    line = _c(line)
    at = [F.nullif(F.instr(F.lower(line) if w.isascii() else line, w), F.lit(0)) for w in cues]
    return F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.lit(0)) - 1


# Digests, templates, dates


def etag(text: Column | str) -> Column:
    return F.substring(F.sha1(_c(text)), 1, 16)


def braces_escaped(text: Column | str) -> Column:
    """struct(text, n): template braces made safe, and how many there were."""
    t = _c(text)
    twice = F.replace(F.replace(t, F.lit("{{"), F.lit("{ {")), F.lit("}}"), F.lit("} }"))
    n = sum(((F.length(t) - F.length(F.replace(t, F.lit(b), F.lit("")))) / 2 for b in ("{{", "}}")), F.lit(0)).cast("int")
    return F.struct(twice.alias("text"), n.alias("n"))


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column | str) -> Column:
    """The time, or null: a zone is required; dates alone, leap seconds and offsets with seconds are not times."""
    return F.when(_c(text).rlike(RFC3339), F.try_to_timestamp(F.upper(_c(text))))


def iso_dates(text: Column | str) -> Column:
    """Dates 20YY-MM-DD that exist."""
    return F.filter(F.transform(F.regexp_extract_all(_c(text), F.lit(r"(20\d\d-\d\d-\d\d)"), F.lit(1)), lambda d: F.expr("null").cast("date") if d is None else F.try_to_date(d)), lambda d: d.isNotNull())


def composed(out: Column | str) -> Column:
    """What a composer wrote: struct(slug, title, desc, body, belongs_because, keep, may_fade, tags); null for a line that is absent."""
    line = lambda key: F.nullif(F.trim(F.regexp_extract(_c(out), rf"(?mi)^{key}:[ \t]*(.*)$", 1)), F.lit(""))
    body = F.trim(F.regexp_extract(_c(out), r"(?s)(?:^|\n)BODY:\s*(.*)$", 1))
    return F.struct(line("SLUG").alias("slug"), line("TITLE").alias("title"), line("DESC").alias("desc"), body.alias("body"), line("BELONGS_BECAUSE").alias("belongs_because"), line("KEEP").alias("keep"), line("MAY_FADE").alias("may_fade"), line("TAGS").alias("tags"))
