"""Main text of web pages, with a suffix array over the pages of a host.

A page is cut into blocks of text. The token streams of a host's pages are concatenated, sorted by suffix, and runs
of at least ``RUN`` tokens that also stand on another page are boilerplate. For a host of more than ``SHARD`` pages
the runs are found by a shuffle of the hashes of their ``RUN`` tokens instead, so that no host makes a large task: the
result is the same. Blocks that lie in an article keep their text; other blocks lose what such runs cover, and keep
their unique runs. Blocks in menus, headers, footers, side bars, forms, adverts, notices and comments are never part of
the text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import broadcast_if_small, map_columns, salted_join, written

SHARD, RUN = 256, 8

# Element names, and words of class, id or role that mark what isn't main text.
RAW = "script style noscript template svg math iframe object canvas textarea select title video audio head".split()
ASIDE = "nav header footer aside form menu dialog button label fieldset".split()
BLOCK = "address article blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul aside".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|breadcrumbs?|menu|navbar|nav|navigation|sidebar|side|widget|footer|masthead|header|comments?|commentlist|discussion|replies|respond|disqus|share|sharing|social|related|recommended|login|signup|search)(?:$|[\s_-])", re.I)
ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert", re.I)

#: Inside an article only these names count, as whole words of a container's class or id: all else there is its text.
CERTAIN = set("ad ads advert advertisement advertising adsbygoogle ad-container ad-slot ad-banner banner-ad cookie-banner cookie-notice cookie-consent notice sidebar side-bar menu nav navbar breadcrumb breadcrumbs comments comment-list commentlist comment-section comments-section comments-area disqus_thread respond newsletter newsletter-signup".split())
CONTAINERS = set("div section ul ol dl table center details span".split())

# A quotation mark opens a string only right after an equals sign; elsewhere it is a character as any other.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
INSIDE, OUTSIDE, DROPPED = 0, 1, 2


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element begins a part that isn't main text."""
    if name in ASIDE:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key in ("class", "id") and (name in CONTAINERS and not CERTAIN.isdisjoint(value.lower().split()) if inside else MARKS.search(value)):
            return True
        if key == "role" and ROLES.search(value) or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of every block of text in page order: inside an article, outside of any, or in a dropped part.

    An article or main element that opens inside an unclosed dropped element ends it. White space of a block is one
    blank; character references are decoded. Headers and footers are dropped wherever they stand, those of an article
    with them. The time goes with the page's length, whatever is left open in it.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int]] = []  # name, whether it begins a dropped part, and since how many articles
    names: Counter = Counter()  # of the stack
    here: list[str] = []
    page = page or ""
    at, dropped, articles, opened = 0, 0, 0, 0

    def end_block() -> None:
        text = " ".join("".join(here).split())
        here.clear()
        if text:
            out.append((DROPPED if dropped else INSIDE if articles else OUTSIDE, text))

    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            here.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            here.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            here.append(" ")
            continue
        if name in BLOCK or name in RAW:
            end_block()
        if m[1]:
            if names[name]:
                end_block()
                while stack:
                    open_, bad, when = stack.pop()
                    names[open_] -= 1
                    dropped -= bad and when == opened
                    articles -= open_ in ("article", "main")
                    if open_ == name:
                        break
        elif name in RAW:
            if not m[3].endswith("/"):
                end = RAW_END[name].search(page, at) if name != "head" else re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = len(page) if end is None else end.start() if end[0].lower().startswith("<body") else end.end()
        elif name not in VOID and not m[3].endswith("/"):
            if name in ("article", "main") and not articles:
                opened, dropped = opened + 1, 0  # what was dropped before ends here
            bad = _marked(name, m[3], articles > 0)
            if name in BLOCK or bad:
                if name not in BLOCK:
                    end_block()
                dropped += bad
                articles += name in ("article", "main")
                names[name] += 1
                stack.append((name, bad, opened))
    end_block()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, part: np.ndarray | None = None, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of ``run`` or more that also stands on another page.

    The suffixes are sorted by prefix doubling up to ``run`` tokens; neighbours that agree on that many form a
    class. No run goes over the end of a ``part`` (by default, of a page).
    """
    part = page if part is None else part
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < run:
        return covered
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    while length < run:
        step = min(length, run - length)
        right = np.full(n, -1, np.int64)
        right[: n - step] = rank[step:]
        pair = rank * (n + 2) + right + 1
        _, rank = np.unique(pair, return_inverse=True)
        length += step
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = part[: n - run + 1] == part[run - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return covered
    suffixes = at[np.lexsort((page[at], rank[at]))]
    kind, owner = rank[suffixes], page[suffixes]
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    last = np.append(first[1:], len(kind)) - 1
    shared = np.repeat(owner[first] != owner[last], last - first + 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, suffixes[shared], 1)
    np.add.at(edge, suffixes[shared] + run, -1)
    return np.cumsum(edge[:n]) > 0


def main_texts(pages: list[list[tuple[int, str]]], names: list[str | None] | None = None) -> list[str]:
    """The text of each page of a host. Pages of one name are one page: copies don't repeat each other.

    A block outside of articles is dropped if runs, which may go over its ends, cover it all; else it loses only
    runs that lie within it.
    """
    words = [[text.split(" ") for _, text in page] for page in pages]
    flat = [w for page in words for block in page for w in block]
    numbers: dict[str, int] = {}
    tokens = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), np.int64, len(flat))
    counts = [sum(map(len, page)) for page in words]
    known: dict[str, int] = {}
    number = [len(pages) + k if names is None or names[k] is None else known.setdefault(names[k], k) for k in range(len(pages))]
    owner, row = np.repeat(number, counts), np.repeat(np.arange(len(pages)), counts)
    block = np.repeat(np.arange(sum(map(len, words))), [len(b) for page in words for b in page])
    across, within = repeated(tokens, owner, row), repeated(tokens, owner, block)
    out, at = [], 0
    for page, split in zip(pages, words, strict=True):
        end = at + sum(map(len, split))
        out.append(_kept(page, split, across[at:end], within[at:end]))
        at = end
    return out


def _kept(page: list[tuple[int, str]], split: list[list[str]], across: np.ndarray, within: np.ndarray) -> str:
    kept, at = [], 0
    for (place, text), parts in zip(page, split, strict=True):
        whole, inner = across[at : at + len(parts)].all(), within[at : at + len(parts)]
        at += len(parts)
        if place == INSIDE:
            kept.append(text)
        elif place == OUTSIDE and not whole:
            kept.append(" ".join(w for w, g in zip(parts, inner, strict=True) if not g) if inner.any() else text)
    return "\n".join(kept)


def page_runs(split: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``run`` tokens of a page; those of runs within one block, under another hash; and where
    the latter are among the former. A run's place is its place in the first array."""
    flat = [w for block in split for w in block]
    n = len(flat) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in flat), np.uint64, len(flat))
    value = np.zeros(n, np.uint64)
    for j in range(run):
        value = value * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    block = np.repeat(np.arange(len(split)), [len(b) for b in split])
    inner = np.flatnonzero(block[:n] == block[run - 1 :])
    return value.view(np.int64), (value[inner] * np.uint64(0x94D049BB133111EB) + np.uint64(1)).view(np.int64), inner


def _covered(n: int, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + run] -= 1
    return np.cumsum(edge[:n]) > 0


def text_with_runs(page: list[tuple[int, str]], shared: np.ndarray) -> str:
    """The text of a page whose hashes of runs on other pages are known."""
    if all(place != OUTSIDE for place, _ in page):
        return "\n".join(text for place, text in page if place == INSIDE)
    split = [text.split(" ") for _, text in page]
    n = sum(map(len, split))
    whole, within, places = page_runs(split)
    return _kept(page, split, _covered(n, np.flatnonzero(np.isin(whole, shared))), _covered(n, places[np.isin(within, shared)]))


def _packed(blocks: list[tuple[int, str]]) -> bytes:
    return zlib.compress("\x1e".join(f"{place}{text}" for place, text in blocks).encode("utf-8", "surrogatepass"), 3)


def _unpacked(raw: bytes) -> list[tuple[int, str]]:
    text = zlib.decompress(raw).decode("utf-8", "surrogatepass")
    return [(int(x[0]), x[1:]) for x in text.split("\x1e")] if text else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = SHARD) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``.

    Null or empty html and pages without main text give an empty text; null urls form a host of their own; repeated
    rows stay, and rows of one url don't repeat each other; very long pages are read whole; other columns are ignored;
    empty in, empty out. The packed blocks are shuffled by host; those of hosts of more than ``shard``
    pages are written, and the hashes of their runs shuffled.
    """
    ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    large = pages.groupBy(host.alias("host")).count().filter(F.col("count") > shard)
    large = written(large.select("host"), "hosts")
    some, large = not large.isEmpty(), broadcast_if_small(large, 100_000)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks_of(x) for x in batch.column(3).to_pylist()]
        asks = [any(place == OUTSIDE for place, _ in x) for x in found]
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([_packed(x) for x in found], pa.binary()), pa.array(asks, pa.bool_())], names=["id", "url", "host", "blocks", "asks"])

    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    schema = f"id {kinds[id_col]}, url {kinds[url_col]}, host string, blocks binary, asks boolean"
    small = named.join(large, "host", "left_anti") if some else named
    packed = map_columns(small, ["id", "url", "host", "html"], schema, pack)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = main_texts([_unpacked(b) for b in pdf["blocks"]], pdf["url"].tolist())
        return pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    result = f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"
    out = packed.drop("asks").groupBy("host").applyInPandas(run, result)
    if some:
        many = map_columns(named.join(large, "host", "left_semi"), ["id", "url", "host", "html"], schema, pack)
        out = out.unionByName(_large_hosts(many, result))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _large_hosts(packed: DataFrame, result: str) -> DataFrame:
    """(id, url, host, blocks) -> (id, url, text, n_chars). A run is repeated if pages of two names, or a page
    without a name and any other one, have it; the join that hands repeated runs back to their pages is salted."""
    owner = F.when(F.col("url").isNotNull(), F.xxhash64("url"))
    rows = written(packed.select("*", F.xxhash64("id", "url", "blocks").alias("row"), owner.alias("owner"), F.xxhash64("host").alias("site")), "large-hosts")

    # Only blocks outside articles can lose a run: sites and runs without one decide nothing.
    sites = broadcast_if_small(rows.filter("asks").select("site").distinct(), 100_000)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, asked = [], []
        for blocks in batch.column(3).to_pylist():
            page = _unpacked(blocks)
            split = [text.split(" ") for _, text in page]
            whole, within, places = page_runs(split)
            outside = np.repeat([place == OUTSIDE for place, _ in page], [len(b) for b in split]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(outside)])
            touches = total[RUN : RUN + len(whole)] > total[: len(whole)]
            keys = np.concatenate([whole, within])
            wanted = np.concatenate([whole[touches], within[touches[places]]])
            found.append(np.unique(keys))
            asked.append(np.isin(found[-1], wanted))
        take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        columns = [batch.column(k).take(take) for k in range(3)]
        return pa.record_batch([*columns, pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(asked), pa.bool_())], names=["row", "owner", "site", "run", "asked"])

    runs = map_columns(rows.join(sites, "site", "left_semi"), ["row", "owner", "site", "blocks"], "row long, owner long, site long, run long, asked boolean", emit)
    seen = runs.groupBy("site", "run").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count_if(F.col("owner").isNull()).alias("unnamed"), F.max("asked").alias("asked"))
    shared = seen.filter("asked and (low <> high or unnamed > 1 or (unnamed = 1 and low is not null))").select("site", "run")
    runs = runs.filter("asked").select("site", "run", "row")
    lists = salted_join(runs, shared, ["site", "run"], ["row"]).groupBy("row").agg(F.collect_set("run").alias("shared"))
    # A page without a block outside articles has nothing to lose, and stays where it is.
    empty = F.array().cast("array<long>")
    asked = rows.filter("asks").join(lists, "row", "left").select("id", "url", "blocks", F.coalesce("shared", empty).alias("shared"))
    known = rows.filter("not asks").select("id", "url", "blocks", empty.alias("shared")).unionByName(asked)

    def text(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_with_runs(_unpacked(b), np.array(s, np.int64)) for b, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return map_columns(known, ["id", "url", "blocks", "shared"], result, text)
