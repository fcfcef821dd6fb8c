"""How far the sources of a language drift apart in their words: audits per pair of sources and per term.

Every (lang, source) group gives each kept term of its language a smoothed share
``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; two shares differ by
``f = floor((p - q)^2 / (p + q))``.  A pair of sources is worth the sum of ``f`` over all
kept terms, most of which occur in few sources.  So the sum is split:

* every term as if it occurred in neither source: ``V f(z, z')``, one row a pair;
* a correction per term that one of them has, from the histogram of the counts a source
  has, against the zero share of each other source;
* a correction per term that both have, from a frequent-pattern tree.  A term's row is the
  list of its nonzero (source, count) items in a fixed order of the language's sources;
  rows are inserted with multiplicities into a tree of shared beginnings, and a node adds
  its pair correction with each of its ancestors once, times the rows below it.

The tree is spread by ranges of sorted rows: rows that begin alike meet in a task, which
walks them with one branch of the tree in memory.  A node cut by the border of two ranges
counts its rows in both, which changes no sum.

Nulls in text, lang or source are the empty string.  Every row of the table is a document,
repeated rows too.  A text without terms still makes its group.  A language without kept
terms has pairs of value 0.  An empty table has no rows.  Only the columns text, lang and
source are read, so others can't clash.  A term's row is as long as the sources that have
it, and a task holds sums of pairs of sources: both are of the size of the result's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches, staged

SCALE = 1_000_000_000
COUNTS = "lang string, term string, docs bigint, n bigint, items array<struct<source:string,n:bigint>>"
SUMS = "lang string, a int, b int, value bigint"

# Terms are what remains between these ASCII bytes; capital letters A-Z become small.
_FOLD = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 * (0x41 <= b <= 0x5A) for b in range(256))


def _sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about ``most`` bytes of a binary column, a long value alone."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and term of a slice: documents, occurrences, and occurrences by source.

    Each group of the slice also gives a row of the empty term, which no text can hold.
    """
    for batch in _sliced(batches, 2):
        langs, lang_of = _codes(batch.column(0))
        sources, source_of = _codes(batch.column(1))
        marks = np.unique(lang_of * len(sources) + source_of)
        yield from _rows(langs, sources, pa.array([""]), marks // len(sources), marks % len(sources), marks * 0, marks * 0, marks * 0)
        folded = pa.array([value.as_py().translate(_FOLD) for value in batch.column(2)], pa.large_binary())
        lists = pc.ascii_split_whitespace(folded.cast(pa.large_string()))
        found = lists.flatten()
        real = pc.greater(pc.binary_length(found), 0)  # blanks at an end of a text make an empty piece
        words = found.filter(real).dictionary_encode()
        if not len(words):
            continue
        code = words.indices.to_numpy().astype(np.int64)
        doc = pc.list_parent_indices(lists).filter(real).to_numpy()
        # One row per document and term, then per language, term and source.
        in_doc, times = np.unique(doc * len(words.dictionary) + code, return_counts=True)
        doc, code = np.divmod(in_doc, len(words.dictionary))
        key = (lang_of[doc] * len(words.dictionary) + code) * len(sources) + source_of[doc]
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[first], np.add.reduceat(times, first)
        docs = np.diff(first, append=len(times))
        word, source = np.divmod(key, len(sources))
        lang, code = np.divmod(word, len(words.dictionary))
        yield from _rows(langs, sources, words.dictionary, lang, source, code, docs, n)


def _codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _rows(langs, sources, terms, lang, source, code, docs, n) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS`` from sorted (lang, term, source) columns."""
    starts = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    ends = np.append(starts[1:], len(lang))
    for at in range(0, len(starts), 50_000):
        s, e = starts[at : at + 50_000], ends[at : at + 50_000]
        lo, hi = s[0], e[-1]
        items = pa.StructArray.from_arrays([sources.take(pa.array(source[lo:hi])), pa.array(n[lo:hi])], ["source", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(s, hi) - lo, pa.int32()), items)
        columns = [
            langs.take(pa.array(lang[s])),
            terms.take(pa.array(code[s])).cast(pa.string()),
            pa.array(np.add.reduceat(docs[lo:hi], s - lo)),
            pa.array(np.add.reduceat(n[lo:hi], s - lo)),
            lists,
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "n", "items"])


def term_counts(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, term, n_lang, source, n) for the kept terms, and (lang, '', 0, source, 0) for every group."""
    texts = docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    per_term = (
        map_batches(texts, _counted, COUNTS)
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.flatten(F.collect_list("items")).alias("items"))
        .filter((F.col("docs") >= least_docs) | (F.col("term") == ""))
    )
    return (
        per_term.select("lang", "term", "n_lang", F.explode("items").alias("item"))
        .groupBy("lang", "term", F.col("item.source").alias("source"))
        .agg(F.first("n_lang").alias("n_lang"), F.sum("item.n").alias("n"))
    )


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (N + 2 V))``, exact for counts beyond what a long times 10^9 can hold; null without terms."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + whole)


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(cells: DataFrame) -> DataFrame:
    """One row a group: its place among its language's sources, its zero share ``z``, and the totals of both.

    Small sources come first, as their few different counts make long shared beginnings.
    """
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = cells.filter(F.col("term") != "").groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    known = totals.join(kept, "lang", "left").fillna(0, ["terms", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("total", "source"))
    return known.withColumn("place", place).withColumn("z", share(F.lit(0), F.col("total"), F.col("terms")))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections of the tree of sorted rows, summed over the task."""
    sums: dict[tuple[int, int], int] = {}
    branch: list[list[int]] = [[], [], [], []]  # place, share, zero share and rows below, from the root down
    places, shares, zeros, below = branch
    above: list[list[int]] = [[], [], []]  # the ancestors of finished nodes, one after the other
    nodes: list[tuple[int, int, int, int, int]] = []
    lang = None

    def settle() -> None:
        if not nodes:
            return
        depth, *node = np.array(nodes, np.int64).T
        node_place, node_share, node_zero, rows = (np.repeat(x, depth) for x in node)
        place, p, z = (np.array(x, np.int64) for x in above)
        value = _gap(p, node_share) - _gap(p, node_zero) - _gap(z, node_share) + _gap(z, node_zero)
        pairs, where = np.unique(place << 32 | node_place, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, where, value * rows)
        for pair, value in zip(pairs.tolist(), total.tolist(), strict=True):
            key = pair >> 32, pair & 0xFFFFFFFF
            sums[key] = sums.get(key, 0) + value
        nodes.clear()
        for part in above:
            part.clear()

    def close(depth: int) -> None:
        """Finish the nodes below ``depth``."""
        while len(places) > depth:
            place, p, z, rows = (part.pop() for part in branch)
            if places:
                below[-1] += rows
                nodes.append((len(places), place, p, z, rows))
                for part, values in zip(above, branch, strict=False):
                    part += values
        if len(above[0]) > 500_000:
            settle()

    def out() -> Iterator[pa.RecordBatch]:
        settle()
        if sums:
            a, b = zip(*sums, strict=True)
            columns = [[lang] * len(a), list(a), list(b), list(sums.values())]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        names, paths, rows = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        items = paths.flatten()
        place, p, z = (items.field(k).to_pylist() for k in range(3))
        ends = np.cumsum([len(x) for x in paths]).tolist()
        start = 0
        for name, end, times in zip(names, ends, rows, strict=True):
            if name != lang or len(sums) > 200_000:
                close(0)
                yield from out()
                lang = name
            own, same = end - start, 0
            while same < own and same < len(places) and places[same] == place[start + same] and shares[same] == p[start + same]:
                same += 1
            close(same)
            places += place[start + same : end]
            shares += p[start + same : end]
            zeros += z[start + same : end]
            below += [0] * (own - same)
            below[-1] += times
            start = end
    close(0)
    yield from out()


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_corrections(items: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms both sources have add beyond one of them having them alone.

    ``items`` has a row per kept term and source that has it: lang, term, place, p, z.
    """
    path = F.array_sort(F.collect_list(F.struct("place", "p", "z"))).alias("path")
    rows = items.groupBy("lang", "term").agg(path).filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    ranges = staged(rows, "term-rows").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return map_batches(ranges, _walked, SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank of the audit."""
    cells = staged(term_counts(docs, least_docs), "term-counts")
    groups = staged(groups_of(cells), "term-groups")
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    items = (
        cells.filter(F.col("n") > 0).join(groups, ["lang", "source"])
        .select("lang", "source", "term", "place", p.alias("p"), q.alias("q"), "z")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        items.filter(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    )

    own = groups.select("lang", "place", "z", "terms")
    other = groups.select("lang", F.col("place").alias("other"), F.col("z").alias("other_z"))
    a, b = F.least("place", "other").alias("a"), F.greatest("place", "other").alias("b")
    nowhere = (
        own.join(other, "lang").filter(F.col("place") < F.col("other"))
        .select("lang", a, b, F.coalesce(F.col("terms") * gap(F.col("z"), F.col("other_z")), F.lit(0)).alias("value"))
    )
    alike = items.groupBy("lang", "place", "p", "z").agg(F.count(F.lit(1)).alias("times"))
    alone = (
        alike.join(other, "lang").filter(F.col("place") != F.col("other"))
        .select("lang", a, b, (F.col("times") * (gap(F.col("p"), F.col("other_z")) - gap(F.col("z"), F.col("other_z")))).alias("value"))
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    summed = nowhere.unionByName(alone).unionByName(tree_corrections(items)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("to"))
    names = groups.select("lang", F.col("place").alias("a"), "source")
    others = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    pairs = (
        both.select("lang", "to.a", "to.b", "value").join(names, ["lang", "a"]).join(others, ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(by_value))
    )
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
w AS (SELECT lang, source, r, unnest(found) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counted AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n, count(*) OVER (PARTITION BY g.lang, g.source) AS v,
    sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS p FROM grid),
of_lang AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM grid GROUP BY lang, term),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
scored AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM scored QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10"""
