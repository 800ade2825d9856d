"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import masked_lm, toxicity
from attesta.llm.common import cut, shared_dir, table
from attesta.llm.decontaminate import leaks
from attesta.llm.exact_dedup import exact_duplicates
from attesta.llm.language import identified, kept, page_languages
from attesta.llm.line_dedup import line_groups
from attesta.llm.main_text import main_texts
from attesta.llm.mixing import mixed
from attesta.llm.ngram_join import ngram_components
from attesta.llm.spelling import variants
from attesta.llm.token_counts import TokenRollup, counted
from attesta.llm.token_files import token_files
from attesta.llm.tokens import public_tokenizer
from attesta.llm.vector_codes import vector_codes


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_groups(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; toxic ones deleted; those of good quality recounted with an end id; a batch sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    n = cut(counted(docs, public_tokenizer(), "byte_bpe_50k").select("doc_id", "source", "lang", "version", "n_tokens"))
    labelled = n.join(labels, "doc_id")
    none = F.lit(None).cast("long")
    rollup = TokenRollup(spark, shared_dir(spark))
    rollup.commit("load", n.select("source", "lang", "version", F.lit("insert").alias("op"), "n_tokens", none.alias("old_tokens")))
    gone = labelled.where("toxic = 1").select("source", "lang", "version", F.lit("delete").alias("op"), "n_tokens", none.alias("old_tokens"))
    rollup.commit("toxic", gone)
    rollup.commit("recount", labelled.where("toxic = 0 and quality = 1").select("source", "lang", "version", F.lit("revise").alias("op"), (F.col("n_tokens") + 1).alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))
    rollup.commit("toxic", gone)
    return rollup.totals()


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=2)
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(table(spark, sf_dir, "documents"), columns=["doc_id", "lang"])
    return docs.select("doc_id", F.col("lang").alias("declared"), "evidence.language", "evidence.posterior", "evidence.text_language", kept().alias("kept"))


#: P(grade above 0) from which a text is called toxic; a document of few toxic words has little weight in all.
TOXIC = 0.3


def severity_grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0).alias("grade"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, severity_grades(table(spark, sf_dir, "labels")), hold_out=False)
    return toxicity.scored(docs, model).withColumn("toxic", F.col("p_above") >= TOXIC)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "hamming", "similarity")


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.scored(docs, masked_lm.trained(docs))


def op11_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_source_mix,
        op3_line_dedup,
        op4_exact_dedup,
        op5_token_counts,
        op6_token_ids,
        op7_language,
        op8_toxicity,
        op9_decontamination,
        op10_masked_lm,
        op11_tag_path_text,
        op12_vector_codes,
        op13_spelling_variants,
        page_language,
    )
}


def _codes_sql(rounds: int = 2) -> str:
    """Codes of the 64-component vectors by a full search in each round."""
    four = [f"w{j}" for j in range(4)]
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"part AS (SELECT vec_id, label, p, {', '.join(f'v[4 * p + {j + 1}] AS {w}' for j, w in enumerate(four))} FROM kept, range(16) AS t(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {', '.join(four)} FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64))",
    ]
    for k in range(rounds + 1):
        square = " + ".join(f"(part.{w} - b.{w}) * (part.{w} - b.{w})" for w in four)
        steps.append(f"near{k} AS (SELECT vec_id, label, p, min(({square}) * 64 + b.e) AS best, {', '.join(f'any_value(part.{w}) AS {w}' for w in four)} FROM part JOIN book{k} AS b USING (p) GROUP BY vec_id, label, p)")
        if k < rounds:
            moved = ", ".join(f"coalesce(CAST(floor(n.{w} / n.c) AS BIGINT), b.{w}) AS {w}" for w in four)
            steps.append(
                f"book{k + 1} AS (SELECT b.p, b.e, {moved} FROM book{k} AS b LEFT JOIN (SELECT p, best % 64 AS e, count(*) AS c, {', '.join(f'CAST(sum({w}) AS DOUBLE) AS {w}' for w in four)} FROM near{k} GROUP BY ALL) AS n ON n.p = b.p AND n.e = b.e)"
            )
    steps.append(f"codes AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label)")
    named = f"(SELECT sha256(string_agg(concat_ws(',', {', '.join(four)}), ',' ORDER BY p, e)) FROM book{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {named} AS codebooks_sha256 FROM codes"


ORACLES = {
    "op12_vector_codes": _codes_sql(),
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach AS r JOIN edge AS e ON e.a = r.b),
        low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id
    """,
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS raw,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        r AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
}
