"""Main text of web pages: markup names the regions, a suffix array per host finds what its pages repeat."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from cohortdeck.llm.common import map_batches, staged
from cohortdeck.llm.shingles import FACTOR, mixed

# Possessive, so a page of broken tags takes no longer than others.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?>\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements whose content is no text, that break blocks, that are no part of
# an article, that are one, that have no content; and names that mark what isn't the article.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "head", "title", "textarea", "select", "button", "object"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}
ARTICLE = {"article", "main"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|header|"
    r"masthead|menus?|navbar|nav|navigation|newsletter|notices?|popup|promo\w*|related|search|share|sharing|sidebar|social|sponsor\w*|"
    r"subscribe|toolbar|widgets?)(?:$|[\s_-])",
    re.I,
)
SILENCE, MARKED, PLAIN, MAIN = 0, 1, 2, 3


def kind_of(name: str, attributes: str, above: int, in_article: bool) -> int:
    """The region that an element opens."""
    if above in (SILENCE, MARKED):
        return SILENCE if name in SILENT else above
    if name in SILENT:
        return SILENCE
    marks = " ".join(filter(None, (a or b or c for a, b, c in NAMES.findall(attributes))))
    if name in ASIDE or (name == "header" and not in_article) or (marks and ASIDE_NAMES.search(marks)):
        return MARKED
    return MAIN if name in ARTICLE else above


def text_blocks(html: str | None) -> list[tuple[int, str]]:
    """(region, text) of a page's blocks in order: references decoded, white space single, none of it empty.

    An end tag closes what is open inside its element; without its start it does
    nothing.  What a page leaves open ends with the page.
    """
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    open_: list[tuple[str, int]] = [("", PLAIN)]
    named: Counter[str] = Counter()  # what is open, by name and by region
    regions: Counter[int] = Counter()

    def start(name: str, kind: int) -> None:
        open_.append((name, kind))
        named[name] += 1
        regions[kind] += 1

    def close_block() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            blocks.append((open_[-1][1], text))
        held.clear()

    at, page = 0, html or ""
    while at < len(page):
        tag = TAG.search(page, at)
        stop = tag.start() if tag else len(page)
        if stop > at and open_[-1][1] != SILENCE:
            held.append(page[at:stop])
        if not tag:
            break
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if name in BREAKS or name in SILENT:
            close_block()
        if tag.group(1):
            while named[name]:
                last, kind = open_.pop()
                named[last] -= 1
                regions[kind] -= 1
                if last == name:
                    break
        elif name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
            start(name, SILENCE)
        elif name not in EMPTY and not tag.group(3).rstrip().endswith("/"):
            start(name, kind_of(name, tag.group(3), open_[-1][1], regions[MAIN] > 0))
    close_block()
    return [(kind, text) for kind, text in blocks if kind != SILENCE]


def repeated(tokens: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a run of ``least`` tokens or more that occurs on two pages.

    A suffix array of the streams laid end to end, sorted by prefix doubling to the depth
    ``least``: neighbours of equal rank share that many tokens, and longer repeats are
    chains of them.  Streams are kept apart by tokens of their own.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < least:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < least:
        step = min(depth, least - depth)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        order = np.lexsort((later, rank))
        new = np.r_[0, (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        depth += step
    order = np.lexsort((pages, rank))
    ranks, owners = rank[order], pages[order]
    starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    ends = np.r_[starts[1:], n]
    shared = np.repeat(owners[starts] != owners[ends - 1], ends - starts)
    edges = np.zeros(n + 1, np.int64)
    places = order[shared]
    np.add.at(edges, places, 1)
    np.add.at(edges, np.minimum(places + least, n), -1)
    return np.cumsum(edges[:n]) > 0


def unique_words(words: list[str], covered: np.ndarray, least: int) -> list[str]:
    """The words of a block without its covered runs.

    A repeat that spans blocks may end within the next one; what it covers there goes if
    it is the whole block or long in itself.
    """
    left, run = [], []
    for word, gone in [*zip(words, covered), ("", False)]:
        if gone:
            run.append(word)
            continue
        if len(run) < min(least, len(words)):
            left += run
        run = []
        left.append(word)
    return left[:-1]


def windows(words: list[str], least: int) -> np.ndarray:
    """A number for every run of ``least`` words, the same for the same words."""
    count = len(words) - least + 1
    if count < 1:
        return np.zeros(0, np.int64)
    codes = np.fromiter((xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    total = np.full(count, least, np.uint64)
    for k in range(least):
        total = total * FACTOR + codes[k : count + k]
    return mixed(total).view(np.int64)


def host_texts(pages: pd.DataFrame, least: int, known: np.ndarray | None = None) -> list[str]:
    """The main text of each page of (a part of) a host, from its blocks.

    All blocks outside articles form the page's stream, menus and footers with them, as
    they show what repeats.  A page with an article region is that region.  Of other
    pages the plain blocks stay, without the runs that another page has too.  ``known``
    are the ``windows`` that pages of the whole host repeat.
    """
    names: dict[str, int] = {}
    tokens, owners, blocks_of = [], [], []
    ids = pd.factorize(pages["page_id"])[0]
    for row, (kinds, texts) in enumerate(zip(pages["kinds"], pages["texts"])):
        owner = ids[row] if ids[row] >= 0 else len(ids) + row
        own = []
        for kind, text in zip(kinds, texts):
            words = text.split() if kind != MAIN else []
            own.append((kind, text, words, len(tokens)))
            tokens += [names.setdefault(word, len(names)) for word in words]
            owners += [owner] * len(words)
        tokens.append(-1 - row)
        owners.append(owner)
        blocks_of.append(own)
    covered = repeated(np.array(tokens, np.int64), np.array(owners, np.int64), least)
    if known is not None and len(known):
        for own in blocks_of:
            if own and all(kind != MAIN for kind, *_ in own):
                found_at = own[0][3] + np.flatnonzero(np.isin(windows([w for block in own for w in block[2]], least), known))
                for k in range(least):
                    covered[found_at + k] = True
    found = []
    for own in blocks_of:
        main = [text for kind, text, _, _ in own if kind == MAIN]
        if not main:
            runs = (unique_words(words, covered[at : at + len(words)], least) for kind, _, words, at in own if kind == PLAIN)
            main = [" ".join(run) for run in runs if run]
        found.append(" ".join(main))
    return found


def host_of_url() -> Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host and the blocks of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_blocks(html.as_py()) for html in batch.column(3)]
            kinds = pa.array([[k for k, _ in blocks] for blocks in found], pa.list_(pa.int32()))
            texts = pa.array([[t for _, t in blocks] for blocks in found], pa.list_(pa.string()))
            columns = [*batch.columns[:3], kinds, texts]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "kinds", "texts"])

    source = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), host_of_url().alias("host"), F.col("html").cast("string"))
    return map_batches(source, run, "page_id bigint, url string, host string, kinds array<int>, texts array<string>")


def repeated_windows(pages: DataFrame, least: int) -> DataFrame:
    """dealt, window: the runs of ``least`` tokens that two pages of a host have, for each part that may need them.

    ``pages`` (page_id, host, kinds, texts, dealt) are those of large hosts.  Runs are
    summed per part before they meet those of other parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, host, kinds, texts, dealt in zip(*(batch.column(k).to_pylist() for k in range(5))):
                found = np.unique(windows([w for k, t in zip(kinds, texts) if k != MAIN for w in t.split()], least))
                n = len(found)
                columns = [pa.array([x] * n, pa.string()) for x in (host, dealt)]
                columns += [pa.array(found), pa.array([id_] * n, pa.int64()), pa.array([MAIN not in kinds] * n, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["host", "dealt", "window", "page_id", "open"])

    schema = "host string, dealt string, window bigint, page_id bigint, open boolean"
    each = map_batches(pages.select("page_id", "host", "kinds", "texts", "dealt"), run, schema)
    nulls = F.sum(F.col("page_id").isNull().cast("bigint"))  # every page without an id is one of its own
    parts = each.groupBy("host", "window", "dealt").agg(
        F.min("page_id").alias("least"), F.max("page_id").alias("most"), nulls.alias("nulls"), F.max("open").alias("open")
    )
    parts = staged(parts, "host-windows")
    whole = parts.groupBy("host", "window").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("nulls").alias("nulls"))
    several = (F.col("nulls") > 1) | ((F.col("nulls") > 0) & F.col("least").isNotNull()) | (F.col("least") < F.col("most"))
    return parts.filter("open").select("host", "window", "dealt").join(
        whole.filter(F.coalesce(several, F.lit(False))).select("host", "window"), ["host", "window"]
    ).select("dealt", "window")


def main_texts(pages: DataFrame, least: int = 8, part_chars: int = 2_000_000) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html).

    Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and
    reader comments are told by elements and by class, id and role names.  Per host, a
    suffix array over the token streams of its pages finds runs of at least ``least``
    tokens that two pages have; they go from pages whose article isn't marked.  A marked
    article stays whole, also where other pages have the same words.

    Pages of a host that has more than ``part_chars`` letters of html are dealt at random
    into parts of about that size, each with an array of its own; the runs that pages of
    different parts share are found by numbers of all runs of ``least`` tokens, summed
    over the host, so the result is that of one array.  Null and empty html give an empty text.  Pages without a host are one
    host.  Rows that share a page_id are one page.  Other columns are not read.
    """
    blocks = page_blocks(pages)
    sizes = pages.select(host_of_url().alias("host"), F.length("html").alias("size"))
    # Stored first: few hosts are that large, and a known size lets the join leave pages where they are.
    large = staged(sizes.groupBy("host").agg(F.ceil(F.sum("size") / part_chars).alias("parts")).filter("parts > 1"), "large-hosts")
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    # One key, so that a host's parts can't be taken to be together when they are dealt out.
    dealt = lambda rows: rows.withColumn("dealt", F.concat_ws("#", part.cast("string"), "host"))
    in_large = page_blocks(pages.withColumn("host", host_of_url()).join(large.select("host"), "host", "left_semi"))
    known = repeated_windows(dealt(in_large.join(large, "host")), least)

    def texts(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        found = host_texts(group, least, shared["window"].to_numpy(np.int64))
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": found})

    kept = dealt(blocks.join(large, "host", "left")).select("page_id", "url", "kinds", "texts", "dealt")
    return kept.groupBy("dealt").cogroup(known.groupBy("dealt")).applyInPandas(texts, "page_id bigint, url string, text string")
