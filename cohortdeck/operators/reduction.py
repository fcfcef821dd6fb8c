"""Semi- and anti-joins of a raw log with a selective population, with the log reduced while it is scanned.

The population's keys become bits of a table of 64-bit words.  The table is sent to the
scan only if its size, which is bounded beforehand and measured once stored, is small and
the bits are sparse; a row whose bit isn't set can have no partner and isn't moved.  An exact
join of what is left follows, so the rows never depend on the bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortdeck.operators.joins import with_keys, without_keys
from cohortdeck.sources.tables import staged

WORD_BITS = 64
BITS_PER_KEY = 16  # a key without a partner is let through once in 16 or less often


def _place(keys: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(bits - 1)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(WORD_BITS - 1).cast("int"))


def suspects(log: DataFrame, population: DataFrame, keys: Sequence[str], most_words: int = 4_000_000) -> tuple[DataFrame, DataFrame, Column | None]:
    """The log with a column ``_hit``, the stored distinct keys, and the test for rows that may have a partner.

    The test is None, and the log as it was, when the words would be more than
    ``most_words`` (of 16 bytes each) at 16 bits a key.  Keys that hold a null have no partner.
    """
    known = population.select(*keys).dropna().distinct()
    stored = staged(known, "population-keys")
    bits = WORD_BITS
    while bits < stored.count() * BITS_PER_KEY:
        bits *= 2
    if bits > most_words * WORD_BITS:
        return log, stored, None
    place = _place(keys, bits)
    words = stored.groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(_bit(place)).alias("_bits"))
    # At most most_words rows, see above.
    marked = log.join(F.broadcast(words), F.shiftright(_place(keys, bits), 6) == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(_place(keys, bits))) != 0, F.lit(False))
    for key in keys:
        hit = hit & F.col(key).isNotNull()
    return marked.withColumn("_hit", hit).drop("_word", "_bits"), stored, F.col("_hit")


def reduced_semi_join(log: DataFrame, population: DataFrame, keys: Sequence[str], most_words: int = 4_000_000) -> DataFrame:
    """Rows of ``log`` whose key is in ``population``; null keys are in nothing.  Repeated rows stay repeated."""
    marked, stored, test = suspects(log, population, keys, most_words)
    left = marked if test is None else marked.filter(test)
    return with_keys(left, stored, keys).select(*log.columns)


def reduced_anti_join(log: DataFrame, population: DataFrame, keys: Sequence[str], most_words: int = 4_000_000) -> DataFrame:
    """Rows of ``log`` whose key isn't in ``population``; rows with a null key stay.

    The log is scanned for the rows without a bit, which stay in place, and for the others.
    """
    marked, stored, test = suspects(log, population, keys, most_words)
    if test is None:
        return without_keys(log, stored, keys)
    return marked.filter(~test).select(*log.columns).unionAll(without_keys(marked.filter(test), stored, keys).select(*log.columns))
