"""The damaged conversations that the repair query starts from, its digests, and its SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches, staged
from cohortdeck.llm.repairs import repair

# What the remainder of a row's checksum by 20 does to it.
DROP, EMPTY, UNSTOP, REPEAT, REROLE = range(5)
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage each row's checksum decides; nulls are one space."""
    or_space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(or_space["conv_id"], F.lit(":"), or_space["turn"])) % 20
    text = F.when(F.col("fate") == EMPTY, "").when(F.col("fate") == UNSTOP, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        conversations.select("conv_id", "turn", or_space["role"].alias("role"), or_space["text"].alias("text"), fate.alias("fate"))
        .filter(F.col("fate") != DROP)
        .select(
            "conv_id", "turn", F.when(F.col("fate") == REROLE, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.when(F.col("fate") == REPEAT, 2).otherwise(1).cast("bigint").alias("copies"),
        )
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a conversation over its rows, which come together and in order."""
    conv: tuple | None = None
    done: list[tuple] = []
    running = kind = None

    def out() -> pa.RecordBatch:
        rows = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.string()), strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(rows, ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for own, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != (own,):
                if conv is not None:
                    done.append((*conv, running.hexdigest()))
                conv, running = (own,), hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        if len(done) > 10_000:
            yield out()
    if conv is not None:
        done.append((*conv, running.hexdigest()))
        yield out()


def repair_digest(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: counts of faults, least cost, audit and a hash of the repaired rows."""
    found, turns = repair(damaged(conversations))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    hashes = map_batches(turns, _hashed, f"conv_id {kind}, repaired_sha256 string")
    ids = staged(conversations.select("conv_id").distinct(), "conversations")
    known = found.join(hashes, found["conv_id"].eqNullSafe(hashes["conv_id"]), "left").select(
        found["conv_id"].alias("found_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
    whole = ids.join(known, ids["conv_id"].eqNullSafe(known["found_id"]), "left").drop("found_id")
    return whole.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": EMPTY_HASH})


def _sql() -> str:
    """The same by a recursive query that carries the best (cost, audit) of each state as one text."""

    def plus(state: str, cost: str | int, letter: str) -> str:
        return f"(lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}')"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN stays AND initial = '{initial}' THEN {plus(state, 'dear', 'K')} END"

    def rerole(state: str) -> str:
        return f"CASE WHEN stays THEN {plus(state, '2 + dear', 'R')} END"

    to_user = ", ".join(f"{keep(x, 'u')}, {rerole(x)}" for x in ("n", "s", "a"))
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]),
        lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT) % 20 AS fate
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE fate <> 0),
placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial,
    dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'clean' END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY k) AS before
  FROM placed),
todo AS (SELECT *, fault IN ('clean', 'truncated') AS stays, (fault = 'truncated')::INTEGER AS dear FROM judged),
sums AS (
  SELECT c, any_value(conv_id) AS conv_id, max(k) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM todo GROUP BY c),
best AS (
  SELECT c, 0::BIGINT AS k, '000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM sums
  UNION ALL
  SELECT c, k, {plus('n', 3, 'D')}, least({plus('s', 3, 'D')}, {keep('n', 's')}),
    least({plus('u', 3, 'D')}, {to_user}), least({plus('a', 3, 'D')}, {keep('u', 'a')}, {rerole('u')})
  FROM (
    SELECT c, t.k, stays, dear, initial, n, s, u, least(a, {plus('u', 2, 'I')}) AS a
    FROM (SELECT c, k, n, s, least(u, {plus('n', 2, 'I')}, {plus('s', 2, 'I')}, {plus('a', 2, 'I')}) AS u, a FROM best) b
    JOIN todo t USING (c) WHERE t.k = b.k + 1)),
audits AS (
  SELECT c, least(n, a, {plus('u', 2, 'I')}, {plus(plus('s', 2, 'I'), 2, 'I')}) AS found FROM best JOIN sums USING (c) WHERE k = last),
letters AS (
  SELECT c, unnest(string_split(substr(found, 10), '')) AS letter, unnest(range(1, length(found) - 8)) AS j FROM audits WHERE length(found) > 9),
lined AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY c ORDER BY j) AS k,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY c ORDER BY j) AS place
  FROM letters),
repaired AS (
  SELECT l.c, j, letter, place, role, text,
    bool_or(letter = 'K' AND place = 1 AND initial = 's') OVER (PARTITION BY l.c) AS headed
  FROM lined l LEFT JOIN todo t ON t.c = l.c AND t.k = l.k AND letter <> 'I'),
hashes AS (
  SELECT c, sha256(coalesce(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - headed::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) FILTER (letter <> 'D'), '')) AS digest
  FROM repaired GROUP BY c),
whole AS (SELECT sums.*, found, digest FROM sums JOIN audits USING (c) LEFT JOIN hashes USING (c))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(found, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(found, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""


SQL = _sql()
