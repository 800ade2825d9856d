"""Language ID by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over languages and 'und' (no language seen in training):

- the text: a hashed byte-trigram model; a text gives at most WEIGHT trigrams' worth of evidence, since neighbouring trigrams repeat one another;
- the declared language (an html lang attribute, a metadata column): how often a declaration goes with each language;
- the address suffix (the last label of the host name): the parent of its hosts' priors;
- the host: its own share of each language, smoothed towards its suffix, and that towards the whole corpus.

The last three are grouped sums, over all rows, of the texts' own posteriors; a row's own share is taken out of its host's
sums. Sums are partial on each task, so a hot host is one row a task. The trigram model is fitted to a bounded sample of
each declared language (all its rows, or about MOST_TRAINED of them, of least hash), and languages are counted over all rows, so which ones are known
does not depend on the size of the table. More than MOST_LANGUAGES declared languages are an error, not a cut; everything else covers all rows.

Nulls: a null text counts as empty; a text without letters is 'und' and rejected. A null declaration, host or suffix
is a value like others. Ties go to the language first in the alphabet. Repeated rows count each time. An empty
table gives no rows. Extra columns are kept by identified(), whatever their names, and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, fresh, small
from attesta.llm.textvec import PIECE, let_go

#: Rows of a declared language, on average; and declared languages.
MOST_TRAINED = 4000
MOST_LANGUAGES = 100
WEIGHT = 60.0
#: Rows' worth of a parent's shares in a host's and a suffix's; and of an even spread in a declaration's.
SMOOTH = 20.0
DIM = 1 << 15
#: Posterior below which a row is rejected.
LEAST = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
UND = "und"


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter of all texts, and offsets of each text's."""
    buf = np.frombuffer(b"  " + b"  ".join(texts).lower() + b"  ", np.uint8)
    buf = np.where(_LETTER[buf], buf, np.uint8(32))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 2))) + 2
    mid = np.flatnonzero(buf != 32)
    b = buf.astype(np.uint32)
    h = ((b[mid - 1] | b[mid] << np.uint32(8) | b[mid + 1] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(17)
    return h.astype(np.int64), np.searchsorted(mid, begins)


def _pieces(texts: list[bytes]):
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > PIECE // 4:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


@dataclass
class TextModel:
    """Log-probabilities of trigrams: DIM by languages, the last one 'und'."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray], rows: dict[str, int], least: int = 5) -> TextModel:
        """counts: of trigrams, by language; languages with fewer than least rows are left out if others have as many."""
        names = sorted(x for x in counts if rows[x] >= least) or sorted(counts)
        table = np.zeros((DIM, len(names) + 1), np.float32)
        for k, name in enumerate(names):
            table[:, k] = np.log((counts[name] + 0.05) / (counts[name].sum() + 0.05 * DIM))
        table[:, -1] = -np.log(DIM) + 1  # a little more than an even spread: trigrams of any one language keep to few cells
        return cls([*names, UND], table)

    @classmethod
    def fit(cls, texts: list[bytes], languages: list[str], least: int = 5) -> TextModel:
        counts: dict[str, np.ndarray] = {}
        for t, x in zip(texts, languages, strict=True):
            counts[x] = counts.get(x, 0) + np.bincount(_trigrams([t])[0], minlength=DIM)
        return cls.of_counts(counts, {x: languages.count(x) for x in counts}, least)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Tempered log-likelihoods, texts by languages; zeros where a text has no letters."""
        out = []
        for run in _pieces(texts):  # a few working arrays of each letter
            h, at = _trigrams(run)
            sums = np.zeros((len(h) + 1, self.table.shape[1]))
            np.cumsum(self.table[h], axis=0, dtype=np.float64, out=sums[1:])
            n = np.diff(at)[:, None]
            out.append((sums[at[1:]] - sums[at[:-1]]) * np.minimum(1.0, WEIGHT / np.maximum(n, 1)))
        return np.concatenate(out) if out else np.zeros((0, self.table.shape[1]))


def fitted(rows: DataFrame, text: str, declared: Column, key: Column) -> TextModel:
    """The text model from about MOST_TRAINED rows of each declared language, those whose key has the least hash (all rows where there are fewer)."""
    some = rows.where(key.isNotNull() & declared.isNotNull() & (F.length(text) > 0)).select(F.xxhash64(key).alias("h"), declared.alias("d"), F.col(text).alias("t"))
    sizes = {r.d: r["count"] for r in some.groupBy("d").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} declared languages")
    # A language's share of the hashes, which are even; a sample needs no order of a language's rows.
    lasts = [(d, -(1 << 63) + min((1 << 64) - 1, MOST_TRAINED * (1 << 64) // n)) for d, n in sizes.items()]
    last = F.broadcast(rows.sparkSession.createDataFrame(lasts, "d string, last long"))

    def count(batches):
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                cell, n = np.unique(_trigrams([t])[0], return_counts=True)
                cell, n = np.append(cell, -1), np.append(n, 1)  # -1 counts rows
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(n), pa.string()), pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["d", "cell", "n"])

    cells = some.join(last, "d").where("h <= last").select("d", "t").mapInArrow(count, "d string, cell long, n long").groupBy("d", "cell").agg(F.sum("n").alias("n"))
    got = cells.toArrow()  # at most DIM + 1 cells a language
    d, cell, n = np.array(got.column("d").to_pylist(), object), got.column("cell").to_numpy(), got.column("n").to_numpy()
    counts = {}
    for x in sizes:
        some = (d == x) & (cell >= 0)
        if (d == x).any():
            counts[x] = np.bincount(cell[some], n[some].astype(float), DIM)
    return TextModel.of_counts(counts, sizes)


def fused(rows: DataFrame, model: TextModel, text: str, declared: Column, host: Column, suffix: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The columns of rows (all where none are named) and one more, 'evidence': struct(language, posterior, text_language, has_text).

    Where the text is not among them each text is scored once: rows are written with their scores. Else it is scored for the sums and again for
    the result, which takes less than writing the texts.
    Without a suffix a host's parent is the whole table.
    """
    names, k = model.languages, len(model.languages)
    given = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def scores(texts: pa.Array) -> pa.Array:
        let_go()
        table = given.value.scores([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(range(0, table.size + 1, k), pa.int32()), pa.array(table.ravel()))

    # Else the filter on its results would be pushed below it with a call of its own: texts scored twice, two workers a task.
    scores = scores.asNondeterministic()
    columns = rows.columns if columns is None else columns
    ll, soft, d, h, s, hn, hp, sp, joint, s2, h2 = fresh(rows.select(*columns), "ll", "soft", "declared", "host", "suffix", "hn", "hp", "sp", "joint", "of_suffix", "of_host")
    known = F.when(declared.isin(names[:-1]), declared).when(declared.isNull() | (declared == ""), F.lit("none")).otherwise(F.lit("other"))
    col = lambda c: F.col(f"`{c}`")
    own_suffix = F.lit("") if suffix is None else F.coalesce(suffix, F.lit(""))
    base = rows.select(*map(col, columns), known.alias(d), F.coalesce(host, F.lit("")).alias(h), own_suffix.alias(s), scores(col(text)).alias(ll))
    if text not in columns:
        base = cut(base)
    expo = F.transform(col(ll), lambda x: F.exp(x - F.array_max(col(ll))))
    shares = F.when(F.exists(col(ll), lambda x: x != 0), F.transform(expo, lambda x: x / F.aggregate(expo, F.lit(0.0), lambda a, b: a + b)))
    sums = [F.sum(col(soft)[i]).alias(f"p{i}") for i in range(k)]
    # A row for each host: every other sum is of these.
    groups = cut(base.select(d, h, s, shares.alias(soft)).where(col(soft).isNotNull()).groupBy(F.col(d).alias("d"), F.col(s).alias("s"), F.col(h).alias("h")).agg(F.count("*").alias("n"), *sums))
    # A declaration is one of the languages, 'none' or 'other'.
    by_declared = {r["d"]: [r[f"q{i}"] for i in range(k)] for r in groups.groupBy("d").agg(*[F.sum(f"p{i}").alias(f"q{i}") for i in range(k)]).collect()}
    totals = np.array([*by_declared.values(), np.zeros(k)]).sum(axis=0)
    prior = (totals + 1) / (totals + 1).sum()
    values = [*names[:-1], "none", "other"]
    says = {v: np.log((np.array(by_declared.get(v, np.zeros(k))) + SMOOTH / len(values) * (1 + 4 * (np.array(names) == v))) / (totals + SMOOTH)) for v in values}
    hosts = groups.groupBy("s", "h").agg(F.sum("n").alias("hn"), *[F.sum(f"p{i}").alias(f"h{i}") for i in range(k)])
    parent = [F.lit(float(prior[i])) for i in range(k)]
    if suffix is not None:
        hosts = hosts.join(groups.groupBy("s").agg(F.sum("n").alias("sn"), *[F.sum(f"p{i}").alias(f"s{i}") for i in range(k)]), "s")
        parent = [(F.col(f"s{i}") + SMOOTH * float(prior[i])) / (F.col("sn") + SMOOTH) for i in range(k)]
    hosts = small(hosts.select(F.col("s").alias(s2), F.col("h").alias(h2), F.col("hn").alias(hn), F.array(*[f"h{i}" for i in range(k)]).alias(hp), F.array(*parent).alias(sp)))
    joined = base.withColumn(soft, shares).join(hosts, (col(s) == col(s2)) & (col(h) == col(h2)), "left")
    own = lambda i: F.coalesce(col(soft)[i], F.lit(0.0))
    has_text = col(soft).isNotNull()
    declared_log = F.create_map(*[x for v in values for x in (F.lit(v), F.array(*[F.lit(float(p)) for p in says[v]]))])

    def total(i: int) -> Column:
        above = F.coalesce(col(sp)[i], F.lit(float(prior[i])))
        share = (F.coalesce(col(hp)[i], F.lit(0.0)) - own(i) + SMOOTH * above) / (F.coalesce(col(hn), F.lit(0)) - F.when(has_text, 1.0).otherwise(0.0) + SMOOTH)
        return F.coalesce(col(ll)[i], F.lit(0.0)) + F.log(F.greatest(share, F.lit(1e-12))) + declared_log[col(d)][i]

    languages = F.array(*map(F.lit, names))
    first = lambda c: F.when(has_text, languages[(F.array_position(col(c), F.array_max(col(c))) - 1).cast("int")]).otherwise(F.lit(UND))
    evidence = F.struct(
        first(joint).alias("language"),
        (1.0 / F.aggregate(F.transform(col(joint), lambda x: F.exp(x - F.array_max(col(joint)))), F.lit(0.0), lambda a, b: a + b)).alias("posterior"),
        first(ll).alias("text_language"),
        has_text.alias("has_text"),
    )
    return joined.withColumn(joint, F.array(*[total(i) for i in range(k)])).select(*map(col, columns), evidence.alias("evidence"))


def identified(docs: DataFrame, model: TextModel | None = None, id_: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", columns: list[str] | None = None) -> DataFrame:
    """docs (or the given columns of them) and 'evidence', in place of a column of that name; the lang column is the declaration, the source the host."""
    rows = docs.drop(*[c for c in docs.columns if c.lower() == "evidence"])
    declared = F.nullif(F.lower(F.trim(F.col(lang))), F.lit(""))
    model = model or fitted(rows, text, declared, F.col(id_))
    return fused(rows, model, text, declared, F.col(source).cast("string"), columns=columns)


def kept() -> Column:
    return (F.col("evidence.language") != UND) & (F.col("evidence.posterior") >= LEAST)


def page_languages(pages: DataFrame) -> DataFrame:
    """page_id, declared, host, suffix, language, posterior: of raw web pages, by html lang attribute and address."""
    drop = r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", F.regexp_replace(html, drop, " ").alias("text"), F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit("")).alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))
    model = fitted(rows, "text", F.col("declared"), F.col("page_id"))
    found = fused(rows, model, "text", F.col("declared"), F.col("host"), F.col("suffix"), ["page_id", "declared", "host", "suffix"])
    return found.select("page_id", "declared", "host", "suffix", "evidence.language", "evidence.posterior")
