"""Secret scans over a ledger of blobs: each content is scanned once per rule version, findings return to all paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# What counts as a secret, in the order kinds are listed.  The lengths of
# access and hex stand in their patterns: a run too short holds no longer one, so nothing
# else is found than by matching any length and dropping short matches.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
LEDGER = "blob binary, scanned array<string>, spans array<struct<kind: string, start: int, stop: int>>"


STRETCH = 256  # matches walked at once: a list that grows by one is copied each time


def blob_id(content: Column) -> Column:
    """The content's address; a null content is an empty one."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points, end exclusive.

    What lies between the matches and the matches themselves alternate, so their lengths
    give the places.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.regexp_extract_all(text, pattern, 0)
    held = F.transform(matches, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
    parts = F.arrays_zip(
        F.slice(between, 1, F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("size"), held.alias("held")
    )
    kind = F.lit(rule.kind).alias("kind")
    none = F.array().cast("array<struct<kind: string, start: int, stop: int>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        stop = start + part["size"]
        span = F.array(F.struct(kind, start.alias("start"), stop.alias("stop")))
        spans = F.when(part["held"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    def stretches(all_parts: Column) -> Column:
        """The spans of each ``STRETCH`` matches, counted from the stretch's beginning, and where it ends."""
        first = F.sequence(F.lit(1), F.size(all_parts), F.lit(STRETCH))
        return F.transform(first, lambda k: F.aggregate(F.slice(all_parts, k, STRETCH), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def placed(found: Column) -> Column:
        begins = F.aggregate(
            found, F.array(F.lit(0)), lambda before, one: F.concat(before, F.array(F.element_at(before, -1) + one["at"]))
        )
        moved = F.zip_with(found, F.slice(begins, 1, F.size(found)), lambda one, at: F.transform(
            one["spans"], lambda s: F.struct(kind, (s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"))
        ))
        return F.flatten(moved)

    # Lambda variables hold what was computed once; a plain expression would be computed per stretch.
    walked = F.element_at(F.transform(F.transform(F.array(parts), stretches), placed), 1)
    return F.when(F.rlike(text, pattern), walked).otherwise(none)


def scan_unseen(history: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows (blob, scanned, spans) for contents and rule versions that ``ledger`` lacks.

    ``history`` holds every version of every path: path, version, content.  Each different
    content is scanned at one place, the smallest path and version that has it, and only
    by rules whose version it hasn't met.  Contents themselves move once, to the list of
    those places; which content is where is decided on their addresses.
    """
    places = history.select("path", "version", blob_id(F.col("content")).alias("blob"))
    blobs = places.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("place"))
    tags = F.array(*[F.lit(rule.tag) for rule in rules])
    if ledger is not None:
        seen = ledger.select("blob", F.explode("scanned").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        tags = F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>")))
    wanted = blobs.select("blob", F.col("place.path").alias("__path"), F.col("place.version").alias("__version"), tags.alias("scanned"))
    wanted = wanted.filter(F.size("scanned") > 0)
    at = F.col("path").eqNullSafe(F.col("__path")) & F.col("version").eqNullSafe(F.col("__version"))
    # Two rows of one path and version may differ in content, so the address decides.
    texts = history.select("path", "version", F.coalesce("content", F.lit("")).alias("content")).join(wanted, at)
    texts = texts.filter(blob_id(F.col("content")) == F.col("blob"))
    spans = [
        F.when(F.array_contains("scanned", rule.tag), rule_spans(F.col("content"), rule)).otherwise(
            F.array().cast("array<struct<kind: string, start: int, stop: int>>")
        )
        for rule in rules
    ]
    found = texts.select("blob", "scanned", F.concat(*spans).alias("spans"))
    return found.dropDuplicates(["blob"]) if ledger is None else found.dropDuplicates(["blob", "scanned"])


def findings(history: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """path, version and spans (sorted by start, then kind as listed, then end) of every row of ``history``.

    Only spans of the given rules' kinds count.  Rows without findings have an empty
    array.  A content that very many paths share is joined like any other row; the ledger
    has it once.
    """
    kinds = [rule.kind for rule in rules]
    own = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    rank = F.create_map(*[F.lit(x) for i, kind in enumerate(kinds) for x in (kind, i)])
    listed = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    ordered = F.array_sort(F.transform(listed, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["stop"], s["kind"])))
    own = own.select("blob", F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["stop"])).alias("spans"))
    places = history.select("path", "version", blob_id(F.col("content")).alias("blob"))
    none = F.array().cast("array<struct<kind: string, start: int, stop: int>>")
    return places.join(own, "blob", "left").select("path", "version", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def sql_of(rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> str:
    """The query over ``documents`` as SQL: no ledger, every text scanned by itself."""
    parts = []
    for rank, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
  length(m[i]) AS n, length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least} AS held
FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents))"""
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    text = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank, s + n)"
    return f"""WITH found AS ({" UNION ALL ".join(parts)}), kept AS (SELECT * FROM found WHERE held)
SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (rank < {len(base)}), '')) AS base_sha256, coalesce({text}, '') AS spans
FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id"""
