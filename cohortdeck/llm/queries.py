"""The registered queries of the operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortdeck.llm import (
    bpe,
    damage,
    decontamination,
    divergence,
    html,
    langid,
    lengths,
    lines,
    minhash,
    outliers,
    packing,
    quality,
    secrets,
)
from cohortdeck.llm.common import staged, table
from cohortdeck.llm.tokens import split_pattern, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rules and the robust outlier verdict."""
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, and where."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_secret_ledger", secrets.sql_of())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each a path with one version, on a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents")
    history = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    found = secrets.findings(history, staged(secrets.scan_unseen(history), "blob-ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[rule.kind for rule in secrets.BASE_RULES]))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in secrets.BASE_RULES]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


LINE_DEDUP_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM cut),
first AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN first USING (k) GROUP BY doc_id"""


@query("op4_line_dedup", LINE_DEDUP_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


@query("op5_length_histogram")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals and quantiles per language, and for every context limit what it keeps and cuts."""
    histogram = staged(lengths.length_histogram(table(spark, sf_dir, "documents"), ["lang"]), "length-histogram")
    sums = staged(lengths.suffix_sums(histogram, ["lang"]), "length-sums")
    return lengths.with_quantiles(sums, [0.5, 0.9, 0.99, 1.0], ["lang"])


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id"""


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and the verdict."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_near_duplicates", NEAR_DUPLICATES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.language_of_each(table(spark, sf_dir, "documents"))


@query("op10_harmonic_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, one row per piece."""
    return packing.digest(packing.harmonic_pack(table(spark, sf_dir, "documents")))


@query("op11_source_divergence", divergence.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and the terms it overuses."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", damage.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, audit and a hash of the repaired rows of every damaged conversation."""
    return damage.repair_digest(table(spark, sf_dir, "conversations"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    found = bpe.round_trip(docs, path, split_pattern())
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents to packed sequences."""
    return corpus_pipeline.run(spark, sf_dir)
