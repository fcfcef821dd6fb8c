"""Quality rules: text statistics, and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortdeck.llm.common import BLANKS, staged

SPAN = 8  # words in a window
# The statistics, the scale below which differences in one mean nothing, all in the transformed unit.
FLOORS = {"x_word": 0.06, "x_symbol": 0.06, "x_upper": 0.08, "x_line": 0.2, "x_repeat": 0.2}
X = tuple(FLOORS)
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
UNIT = 1024  # vectors are whole numbers of 1/1024, so their sums don't depend on their order
STARTS = 3
FINE = 16  # distance classes per doubling
CHI_MEDIAN = 4.351  # median of chi-square with five degrees of freedom


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, __n_lines and __n_upper to (doc_id, lang, source, text).

    A repeated window is found inside the row: windows are hashed, and only texts in
    which a hash recurs sort them to learn where.
    """
    blank = "[" + "".join(f"\\x{ord(c):02X}" for c in BLANKS) + "]"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("__t"))
    d = d.withColumn("__w", F.filter(F.split("__t", f"{blank}+"), lambda w: w != ""))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.rlike(x, F.lit(blank.replace("[", "[^", 1)))))
    d = d.select(
        "doc_id", "lang", "source", F.size("__w").alias("__n"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
        F.length(F.array_join("__w", "")).alias("__c"), F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).alias("__s"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).alias("__u"), F.size("__l").alias("__n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).alias("__d"),
    )
    hashed = lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(SPAN)])
    windows = F.transform(F.sequence(F.lit(0), F.col("__n") - SPAN), hashed)
    d = d.withColumn("__v", F.when(F.col("__n") >= SPAN, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.array_sort(F.transform("__v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    empty = F.array().cast("array<struct<x: bigint, i: int>>")
    d = d.withColumn("__p", F.when(F.size(F.array_distinct("__v")) < F.size("__v"), placed).otherwise(empty))
    same = lambda s, k: s["x"].eqNullSafe(F.get(F.col("__p"), k)["x"])
    twice = F.filter("__p", lambda s, i: same(s, i - 1) | same(s, i + 1))
    d = d.withColumn("__r", F.array_sort(F.transform(twice, lambda s: s["i"])))
    steps = F.sequence(F.lit(1), F.size("__r") - 1)
    gap = lambda sum_, i: sum_ + F.least(F.lit(SPAN), F.get(F.col("__r"), i) - F.get(F.col("__r"), i - 1))
    covered = F.when(F.size("__r") == 0, 0).when(F.size("__r") == 1, SPAN).otherwise(F.aggregate(steps, F.lit(SPAN), gap))
    counts = {"n_words": "__n", "word_chars": "__c", "n_symbols": "__s", "n_dup_lines": "__d"}
    return d.select(
        "doc_id", "lang", "source", *[F.col(c).cast("bigint").alias(name) for name, c in counts.items()],
        covered.cast("bigint").alias("n_repeat_words"), "__n_lines", F.col("__u").alias("__n_upper"),
    )


def with_vector(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics: a logarithm of mean word length, square roots of shares."""
    share = lambda part, whole: F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.lit(1), F.col(whole))))
    values = {
        "x_word": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        "x_symbol": share("n_symbols", "word_chars"),
        "x_upper": share("__n_upper", "word_chars"),
        "x_line": share("n_dup_lines", "__n_lines"),
        "x_repeat": share("n_repeat_words", "n_words"),
    }
    return stats.withColumns({name: F.round(value * UNIT).cast("bigint") for name, value in values.items()})


def keyed(vectors: DataFrame) -> DataFrame:
    """One row per document and level: its language and source, its language, everything."""
    keys = [F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("1"), F.to_json(F.struct("lang"))), F.lit("0")]
    return vectors.select(*X, F.explode(F.array(*keys)).alias("key"))


def quartiles(rows: DataFrame) -> DataFrame:
    """key, n, and per statistic its median and a scale from its quartiles: exact, from counts per value."""
    cells = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(X)])).alias("c"))
    counts = cells.groupBy("key", "c.i", "c.x").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("key", "i").orderBy("x"))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("m").over(Window.partitionBy("key", "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("x")))
    each = ranked.groupBy("key", "i").agg(F.first("n").alias("n"), at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    scales = [F.greatest(pick(i, "scale"), F.lit(FLOORS[x] * UNIT)).alias(f"s{i}") for i, x in enumerate(X)]
    return each.groupBy("key").agg(F.max("n").alias("n"), *[pick(i, "mid").alias(f"c{i}") for i in range(len(X))], *scales)


def first_distances(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Squared distances in three orders to start from: by sum of squares, largest and sum of standardised differences."""
    met = rows.join(centres, "key")
    z = [F.abs(F.col(x) - F.col(f"c{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    orders = [total([v * v for v in z]), F.pow(F.greatest(*z), F.lit(2)), F.pow(total(z), F.lit(2))]
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), d.alias("d2")) for k, d in enumerate(orders)])).alias("o")
    return met.select("key", "n", *X, starts).select("key", "n", *X, "o.start", "o.d2")


def distances(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Squared Mahalanobis distances, by the triangular factor of each covariance."""
    met = rows.join(shapes, "key")
    for i, x in enumerate(X):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{j}") * F.col(f"__y{j}") for j in range(i)], F.col(x) - F.col(f"c{i}"))
        met = met.withColumn(f"__y{i}", rest / F.col(f"l{i}{i}"))
    return met.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(len(X))]))


def distance_class() -> Column:
    return F.floor(F.log2(F.col("d2") + F.lit(1e-3)) * FINE)


def concentrated(found: DataFrame, share: float) -> DataFrame:
    """Mean and covariance factor of the nearest ``share`` of each (key, start): one concentration step.

    Moments are summed per distance class before the shuffle, so the step reads the rows
    once and no key's rows meet in a task; the classes up to the one that reaches the
    share are then added up.
    """
    moments = [F.sum(x).alias(f"m{i}") for i, x in enumerate(X)]
    moments += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    cells = found.groupBy("key", "start", distance_class().alias("cell")).agg(F.max("n").alias("n"), F.count("*").alias("h"), *moments)
    before = F.sum("h").over(Window.partitionBy("key", "start").orderBy("cell")) - F.col("h")
    near = cells.withColumn("before", before).filter(F.col("before") < F.col("n") * share)
    sums = [c for c in cells.columns if c[0] in "mp"]
    total = near.groupBy("key", "start").agg(F.max("n").alias("n"), F.sum("h").alias("h"), *[F.sum(c).alias(c) for c in sums])
    mean = [(F.col(f"m{i}") / F.col("h")).alias(f"c{i}") for i in range(len(X))]
    spread = [
        (F.col(f"p{i}{j}") / F.col("h") - F.col(f"m{i}") / F.col("h") * (F.col(f"m{j}") / F.col("h"))
         + F.lit((FLOORS[X[i]] * UNIT) ** 2 if i == j else 0.0)).alias(f"v{i}{j}")
        for i, j in PAIRS
    ]
    shapes = total.select("key", "start", "n", *mean, *spread)
    for i, j in PAIRS:
        inner = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"v{i}{j}"))
        shapes = shapes.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(1.0))) if i == j else inner / F.col(f"l{j}{j}"))
    size = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(len(X))])
    return shapes.select("key", "start", "n", *[f"c{i}" for i in range(len(X))], *[f"l{i}{j}" for i, j in PAIRS], size.alias("size"))


def estimates(vectors: DataFrame, share: float, steps: int) -> DataFrame:
    """key, n, centre, covariance factor and stretch: the smallest determinant that concentration from three starts finds.

    ``stretch`` brings the median squared distance of the key's documents to that of a
    normal distribution; it is at least 1.
    """
    rows = keyed(vectors)
    # Stored first, so that its size is known when the join is planned.
    centres = staged(quartiles(rows), "mcd-centres")
    shapes = staged(concentrated(first_distances(rows, centres), share), "mcd-step")
    for _ in range(steps):
        shapes = staged(concentrated(distances(rows, shapes), share), "mcd-step")
    best = shapes.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("size", "start"))).filter("place = 1")
    best = staged(best.drop("place", "size", "start"), "mcd-best")
    cells = distances(rows, best).groupBy("key", distance_class().alias("cell")).agg(F.max("n").alias("n"), F.count("*").alias("h"))
    upto = F.sum("h").over(Window.partitionBy("key").orderBy("cell"))
    middle = cells.withColumn("upto", upto).filter(F.col("upto") * 2 >= F.col("n")).groupBy("key").agg(F.min("cell").alias("cell"))
    stretch = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.col("cell") / FINE) / CHI_MEDIAN)
    return staged(best.join(middle.select("key", stretch.alias("stretch")), "key"), "mcd")


def quality_rules(
    docs: DataFrame, least_words: int = 20, most_repeated: int = 30, share: float = 0.75, steps: int = 4, enough: int = 100, cut: float = 25.0
) -> DataFrame:
    """Text statistics of every row of ``docs`` (doc_id, text, lang, source) and whether it is kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` per cent
    of them in repeated windows.  Others are judged by the squared Mahalanobis distance
    of five transformed statistics (mean word length and the shares of symbols, capitals,
    repeated lines and repeated words) from a robust centre: the minimum covariance
    determinant estimate of the documents of the same language and source, of the
    language if those are fewer than ``enough``, else of all.  Each estimate has floors
    in its diagonal (FLOORS), as most clean documents have none of what is counted.  A
    distance beyond ``cut`` rejects; with five statistics it lies far outside what clean
    documents reach.

    All in built-in functions.  Null and empty texts have zero words and fail the base
    rule.  Null languages and sources are keys of their own.  Rows that share an id are
    judged each; other columns are not read.
    """
    vectors = staged(with_vector(text_statistics(docs)), "text-statistics")
    shapes = estimates(vectors, share, steps)
    # Which estimate serves which language and source is decided on that small list.
    levels = vectors.select("lang", "source").distinct()
    options = [F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("1"), F.to_json(F.struct("lang"))), F.lit("0")]
    named = levels.select("lang", "source", F.explode(F.array(*options)).alias("key")).join(shapes.select("key", "n"), "key")
    fit = named.filter((F.col("n") >= enough) | (F.col("key") == "0")).groupBy("lang", "source").agg(F.max("key").alias("key"))
    use = staged(fit.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "key"), "mcd-use")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    judged = distances(vectors.join(use, same), shapes.drop("n"))
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    distance = F.col("d2") / F.col("stretch")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        distance.alias("distance"), (~base_failed & (distance <= cut)).alias("kept"),
    )
