"""The queries of this subpackage: opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, mixing, ngram_join, ordinal_quality, packing, pii, quality_cascade, toxicity, warc
from .common import read

#: The key of op9's surrogates where spark.fluxweave.surrogateKey is unset: public, so fit for test tables only.
PUBLIC_KEY = "test tables only"


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_windows(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(read(spark, sf_dir, "documents")).drop("failed_rule")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.fluxweave.surrogateKey", None) or PUBLIC_KEY
    return pii.replace(read(spark, sf_dir, "documents"), key.encode())


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_source_mix, op2_line_dedup, op3_warc, op4_quality_cascade, op5_exact_dedup, op6_ordinal_quality, op7_packing, op8_toxicity, op9_pii_surrogates, op10_ngram_join)
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
        ), windows AS (
            SELECT doc_id, text, pos, [line, lead(line, 1) OVER w, lead(line, 2) OVER w] AS win, lead(pos, 2) OVER w AS last FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows
            WHERE last IS NOT NULL AND regexp_matches(win[1] || ' ' || win[2] || ' ' || win[3], '[^\x20\x09-\x0D]')
        ), gone AS (
            SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE nth > 1
        ), left_over AS (
            SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
            FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(l.text, '')) AS text_md5
        FROM documents d LEFT JOIN left_over l USING (doc_id)""",
    "op4_quality_cascade": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup,
                   count(*) FILTER (WHERE regexp_matches(line, '^[ \t]*[-*•·]')) AS bullets,
                   count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), spans AS (
            SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS span FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, span) AS n FROM spans) WHERE n > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
        ), tops AS (
            SELECT doc_id, max(n) AS top, count(*) AS kinds, sum(n) FILTER (WHERE w = upper(w) AND w <> lower(w)) AS up,
                   sum(n) FILTER (WHERE regexp_matches(w, '\p{L}')) AS letters
            FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY doc_id, w) GROUP BY doc_id
        ), pairs AS (
            SELECT doc_id, max(n) AS top_pair FROM (
                SELECT doc_id, a, b, count(*) AS n FROM (SELECT doc_id, unnest(words[:-2]) AS a, unnest(words[2:]) AS b FROM d) GROUP BY ALL
            ) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(top, 0) AS top, coalesce(up, 0) AS up, coalesce(letters, 0) AS letters, coalesce(kinds, 0) AS kinds,
                   coalesce(top_pair, 0) AS top_pair, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses
            FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN tops t USING (doc_id)
            LEFT JOIN pairs p USING (doc_id)
        ), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 2 * n_words <= word_chars AND word_chars <= 20 * n_words AND 4 * n_symbols <= n_words
               AND 10 * n_dup_lines <= 6 * n_lines AND 2 * up <= n_words AND 10 * top <= 3 * n_words
               AND 10 * bullets <= 9 * n_lines AND 10 * ellipses <= 3 * n_lines AND 10 * letters >= 6 * n_words
               AND kinds * kinds >= n_words AND 10 * top_pair <= 2 * n_words AS kept
        FROM b""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
