"""Near duplicates: one-permutation hashing, banded buckets, star-shaped candidate edges, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortdeck.llm.common import map_batches, staged
from cohortdeck.llm.shingles import mixed, shingle_set

BINS = 256
PROBES = 64  # places looked up at once for a neighbour of an empty bin
NO_ID = -(1 << 63)  # stands for a null id: the smallest
SLOT_BITS = 21  # shingles are counted in so many slots, only to put rare ones first


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation hashing with optimal densification: ``BINS`` minima of one hash.

    The top byte of a shingle's number names its bin, the smallest number stays.  An
    empty bin takes the value of the first filled bin in a random order of its own.
    """
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    values = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    values[bins[first]] = shingles[first]
    filled[bins[first]] = True
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    block = 0
    while len(empty):
        tries = np.arange(block * PROBES, (block + 1) * PROBES, dtype=np.uint64)[:, None]
        places = (mixed(tries * np.uint64(BINS) + empty.astype(np.uint64) + np.uint64(1)) >> np.uint64(56)).astype(np.int64)
        good = filled[places]
        found = good.any(axis=0)
        source[empty[found]] = places[good.argmax(axis=0)[found], np.flatnonzero(found)]
        empty = empty[~found]
        block += 1
    return values[source]


def band_keys(shingles: np.ndarray, rows: int) -> np.ndarray:
    """One number per band of ``rows`` bins; documents of one number share a bucket."""
    bands = BINS // rows
    table = signature(shingles)[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + table[:, k])
    return key


def with_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string"))


def features(docs: DataFrame, rows: int) -> DataFrame:
    """id, n (set size), s1, s2 (a digest of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(band_keys(found, rows).astype(np.int64) if len(found) else np.zeros(0, np.int64))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ends = np.cumsum([0, *map(len, bands)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), keys],
                ["id", "n", "s1", "s2", "bands"],
            )

    return map_batches(with_id(docs), run, "id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>")


def shingle_arrays(docs: DataFrame) -> DataFrame:
    """id and the whole sorted set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()).astype(np.int64) for text in batch.column(1).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "s"])

    return map_batches(docs.select("id", "text"), run, "id bigint, s array<bigint>")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``edges`` whose whole sets have at least ``percent`` per cent in common."""
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot (the top bits) occur in ``sets``: one array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            np.add.at(counts, (flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["slot", "n"])

    found = map_batches(sets.select("s"), run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int32)
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 31) - 1)
    return counts


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """token, id, label, reach, n, indexed: the shingles by which a set (id, label, s) meets those it may link to.

    Shingles are put in one order for all sets, those of rare slots first, and ``reach``
    is how many of the set's n come from this one on.  Two sets whose first common
    shingle is this one have at most the smaller ``reach`` in common, so no link is lost
    by leaving out what comes after the first ``n - percent * n + 1``, whatever the
    order.  ``indexed`` are those that a set of no fewer shingles can be met by.
    """
    sent = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, label, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                tokens = found.values.to_numpy(zero_copy_only=False)
                slots = (tokens.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                n = len(tokens)
                first = np.lexsort((tokens, sent.value[slots]))[: n + percent * n // -100 + 1]
                k = len(first)
                indexed = np.arange(k) < n + 2 * percent * n // -(100 + percent) + 1
                reach = n - np.arange(k)
                columns = [tokens[first], np.full(k, id_.as_py()), np.full(k, label.as_py()), reach, np.full(k, n)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array(indexed)], ["token", "id", "label", "reach", "n", "indexed"]
                )

    schema = "token bigint, id bigint, label bigint, reach bigint, n bigint, indexed boolean"
    return map_batches(sets.select("id", "label", "s"), run, schema)


def possible_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Every (a, b) of different labels in ``sets`` (id, label, s) that no bound rules out.

    Sets of one label are never paired: lists of a shingle are compared by label first,
    with the best bound of each label, and only labels that may link by their sets.
    """
    entries = staged(rare_first(sets, percent), "rare-shingles")
    several = entries.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("indexed").alias("met"))
    lists = staged(entries.join(several.filter("met and least < most").select("token"), "token"), "rare-lists")
    enough = lambda x, y: (100 + percent) * F.least(f"reach_{x}", f"reach_{y}") >= percent * (F.col(f"n_{x}") + F.col(f"n_{y}"))
    named = lambda rows, x: rows.select("token", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "token"])
    short = lists.filter("indexed").drop("indexed")
    best = lambda rows: rows.groupBy("token", "label").agg(F.max("reach").alias("reach"), F.min("n").alias("n"))
    labels = named(best(short), "x").join(named(best(lists), "y"), "token").filter((F.col("label_x") != F.col("label_y")) & enough("x", "y"))
    labels = labels.select("token", "label_x", "label_y")
    pairs = labels.join(named(short, "x"), ["token", "label_x"]).join(named(lists.drop("indexed"), "y"), ["token", "label_y"])
    pairs = pairs.filter((F.col("n_x") <= F.col("n_y")) & enough("x", "y"))
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node reachable over ``links`` (a, b), by passing minima on and jumping.

    Only sums leave a node (the minimum of its neighbours), so a node with a great many
    links is no heavier than others.  Every round is written to the shared folder, in files
    by the number of links: with few of them a round costs few tasks.
    """
    both = staged(links.union(links.select("b", "a")).toDF("node", "near").distinct(), "links")
    most = both.count()  # there are no more nodes than that
    labels = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), "labels", most)
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("theirs")), "near")
        least = near.groupBy("node").agg(F.min("theirs").alias("theirs"))
        low = labels.join(least, "node").select("node", "label", F.least("label", "theirs").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        further = low.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("further", "low")).alias("next"))
        passed = staged(further, "labels", most)
        labels = passed.select("node", F.col("next").alias("label"))
        if passed.filter("next < label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 75, rows: int = 5) -> DataFrame:
    """Groups of documents whose sets of five-word shingles have ``percent`` per cent in common.

    Rows of equal sets are one class, represented by its smallest id.  Classes that share
    one of 51 buckets of five bins become candidates: two sets of 0.75 miss all buckets
    once in a million.  Each bucket proposes a star, its smallest member with each other
    one, so candidates number as many as members; pairs proposed by several buckets count
    once, and each is confirmed on the whole sets.  Buckets whose members are then still
    in different groups propose further stars around other members, until a round finds
    no link.  What is in buckets that still span groups is then settled exactly: all pairs
    of different groups there are compared but those that a bound on their common shingles
    rules out.

    One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id
    reachable), kept (doc_id = component_id).  Null, empty and blank texts have no
    shingles and no links.  A null doc_id counts as the smallest id and comes back null.
    Rows that share a doc_id are one document with several texts.  Other columns are not
    read.
    """
    rows_of = staged(features(docs, rows), "shingle-features")
    classes = rows_of.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    members = staged(rows_of.drop("bands").join(classes, ["s1", "s2"], "left").select("id", "n", "rep"), "shingle-classes")
    reps = members.filter("id = rep").select("id").distinct()
    buckets = rows_of.join(reps, "id", "left_semi").select(F.explode("bands").alias("key"), F.col("id").alias("rep")).distinct()
    shared = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    buckets = staged(buckets.join(shared.select("key", "low"), "key"), "shingle-buckets")

    ends = buckets.select(F.col("rep").alias("id")).distinct()
    sets = staged(shingle_arrays(with_id(docs).join(ends, "id", "left_semi")).distinct(), "shingle-sets")
    tried = staged(buckets.filter("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "shingle-stars")
    same_id = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    links = staged(confirmed(tried, sets, percent).union(same_id), "shingle-links")
    groups = components(links)
    # A bucket is settled once all its members are in the group of its smallest one, which
    # the pairs tried so far tell; only the others go on.
    label = lambda c: groups.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    apart = tried.join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.col("a").alias("low"), F.col("b").alias("rep"))
    unsettled = buckets.join(apart, ["low", "rep"], "left_semi").select("key").distinct()
    buckets = staged(buckets.join(unsettled, "key", "left_semi"), "shingle-buckets")
    held = buckets.count()  # no round proposes more pairs than that
    turn = 0
    while held:
        turn += 1
        named = buckets.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        named = named.select("key", "rep", F.coalesce("label", "rep").alias("label"))
        centre = named.groupBy("key").agg(
            F.min("label").alias("least"), F.max("label").alias("most"),
            F.min(F.struct(F.xxhash64("key", "rep", F.lit(turn)).alias("order"), "rep", "label")).alias("centre"),
        )
        open_stars = named.join(centre.filter("least < most"), "key").filter(F.col("label") != F.col("centre.label"))
        stars = open_stars.select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()
        fresh = staged(stars.join(tried, ["a", "b"], "left_anti"), "shingle-stars", held)
        more = staged(confirmed(fresh, sets, percent), "shingle-links")
        tried = tried.union(fresh)
        if not more.isEmpty():
            links = links.union(more)
            groups = components(links)
            continue
        left = named.join(centre.filter("least < most").select("key"), "key").select(F.col("rep").alias("id"), "label").distinct()
        rest = staged(sets.join(left, "id"), "unsettled-sets")
        fresh = staged(possible_pairs(rest, percent).join(tried, ["a", "b"], "left_anti"), "unsettled-pairs")
        more = staged(confirmed(fresh, sets, percent), "shingle-links")
        if not more.isEmpty():
            links = links.union(more)
            groups = components(links)
        break

    found = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "id")
    blank = lambda c: F.when(c != NO_ID, c)
    return found.select(
        blank(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), blank(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
