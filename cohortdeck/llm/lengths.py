"""Exact token counts: one histogram of encoded lengths answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches
from cohortdeck.llm.tokens import encoder, tokenizer_path


def encoded_lengths(docs: DataFrame, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """One row per document: ``by`` and n_tokens; a null text has none."""
    file = path or tokenizer_path()
    kept = docs.select(*[F.col(c) for c in by], F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(file)
        for batch in batches:
            column = batch.schema.get_field_index("__text")
            n = [len(model.ids(text.as_py())) for text in batch.column(column)]
            rest = [batch.column(i) for i in range(column)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], [*by, "n_tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    return map_batches(kept, run, ", ".join([*fields, "n_tokens bigint"]))


def length_histogram(docs: DataFrame, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Documents per group and encoded length, summed before the shuffle: as many rows as lengths differ."""
    return encoded_lengths(docs, by, path).groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: Sequence[str] = (), block: int = 1024) -> DataFrame:
    """What any context limit keeps, per group, from (by, n_tokens, n_docs).

    Adds, for the limit at each row's length: docs_at_least and tokens_at_least (suffix
    sums, this length included), docs_below, tokens_below, tokens_total, docs_total, and
    truncated_tokens, the tokens left when every document is cut at this length.  For any
    limit from this length up to the next one that occurs, ``tokens_upto + limit *
    docs_above`` tokens are left, so the rows answer every limit exactly.

    Sums run in blocks of ``block`` lengths, and the block totals (one row per block) are
    summed again, so that no group's histogram goes through one task.
    """
    block_key = F.floor(F.col("n_tokens") / F.lit(block))
    cells = histogram.withColumn("__block", block_key).withColumn("__tokens", F.col("n_tokens") * F.col("n_docs"))
    keys = [*by]
    inside = Window.partitionBy(*keys, "__block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("__block").desc())
    above = above.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    totals = cells.groupBy(*keys, "__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    later = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)],
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__docs_later"),
        F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__tokens_later"),
        F.sum("__d").over(whole).alias("docs_total"),
        F.sum("__t").over(whole).alias("tokens_total"),
    )
    same = F.col("__block") == F.col("__b")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = cells.join(later, same)
    at_least = F.sum("n_docs").over(inside) + F.col("__docs_later")
    tokens = F.sum("__tokens").over(inside) + F.col("__tokens_later")
    return (
        joined.withColumn("docs_at_least", at_least)
        .withColumn("tokens_at_least", tokens)
        .withColumn("docs_below", F.col("docs_total") - F.col("docs_at_least"))
        .withColumn("tokens_below", F.col("tokens_total") - F.col("tokens_at_least"))
        .withColumn("truncated_tokens", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least"))
        .withColumn("docs_above", F.col("docs_at_least") - F.col("n_docs"))
        .withColumn("tokens_upto", F.col("tokens_below") + F.col("n_tokens") * F.col("n_docs"))
        .select(
            *keys, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_below", "tokens_below",
            "docs_total", "tokens_total", "truncated_tokens", "docs_above", "tokens_upto",
        )
    )


def limit_totals(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Truncated totals for a list of limits, one row per group and limit.

    A limit takes the suffix sums of the smallest length above it; above all lengths
    nothing is cut.  The result has by, max_tokens, docs_cut, truncated_tokens.
    """
    answers = []
    for limit in limits:
        longer = F.col("n_tokens") > limit
        docs = F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), F.lit(0))
        tokens = F.coalesce(F.max(F.when(longer, F.col("tokens_at_least"))), F.lit(0))
        kept = F.max("tokens_total") - tokens + docs * F.lit(limit)
        answers.append(F.struct(F.lit(limit).alias("max_tokens"), docs.alias("docs_cut"), kept.alias("truncated_tokens")))
    found = sums.groupBy(*by).agg(F.array(*answers).alias("__answers"))
    return found.select(*by, F.inline("__answers"))


def length_quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed, per group."""
    upto = F.col("docs_below") + F.col("n_docs")
    picks = [
        F.min(F.when(upto >= F.ceil(F.lit(share) * F.col("docs_total")), F.col("n_tokens"))).alias(f"q{round(share * 1000):03d}")
        for share in shares
    ]
    return sums.groupBy(*by).agg(*picks)


def with_quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``sums`` with its group's ``length_quantiles`` in each row; null is a group like others."""
    found = length_quantiles(sums, shares, by)
    names = [c for c in found.columns if c not in by]
    if not by:
        return sums.select("*", *[found.select(name).scalar().alias(name) for name in names])
    given = found.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *names)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return sums.join(given, same).select(*sums.columns, *names)
