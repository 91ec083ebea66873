"""Main text of web pages: page structure, and long token runs that a host repeats over its pages.

A page is parsed into blocks, each in the article, in a part that is never article (menus, headers, footers, forms,
comments and so on, by element, role and class), or elsewhere. A run of ``RUN`` words is
boilerplate by how many distinct contents (pages with equal block lists are one) of the whole host hold it:

* outside an article, the words of runs that at least ``REPEATED`` contents hold outside their articles are removed and
  the unique runs are kept, unless that would take all of a page's text;
* inside an article, only a block that is covered whole, by runs on at least ``ON_MOST`` of the host's contents (and
  ``MANY`` contents), goes, and only if such blocks are less than half of the article's words: articles may share lines
  and passages, or be copies of each other, alike or nearly.

A host is cut into groups of about ``PAGES`` pages by content hash, so a host with a third of all pages is many groups
and no task holds a host. The first copy of a content in each map task goes to the content's own group, which counts
it; further copies are dealt out by page and counted nowhere, so a hot content is no hot task. A host that is one group
is counted there, by sorting the suffixes of its words by their first ``RUN`` words (by doubling). The groups of a
larger host send their counts per run hash to buckets of hashes, which return the sums to the groups that hold the run.
A run that is only inside articles and on less than ``FEW`` of a group's contents (``SURELY`` at least) isn't sent:
contents are dealt at random, so a run on half of the host's is missing by this with a probability below 1e-15.

Defined cases: a null html has no text; null and odd addresses are one host; equal pages are pages of their own; an
unclosed or cut-off tag is markup, not text; a head without an end tag ends where its content must; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairground.llm import tokens
from fairground.llm.registry import query

PAGES = 256
RUN = 6
REPEATED = 3
ON_MOST, MANY = 0.5, 10
FEW, SURELY = 0.125, 128
BUCKET_PAGES, BUCKETS = 10_000, 48  # pages of all hosts to a bucket of run hashes; least number of buckets
SMALL_HOSTS = 1_000_000  # rows of host counts that may be broadcast
CHROME, ELSEWHERE, ARTICLE = 0, 1, 2

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head nav footer aside form script style noscript template svg math iframe object button select textarea dialog menu canvas audio video map".split())
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("""nav navbar navigation menu sidebar footer header masthead breadcrumb breadcrumbs ad ads advert adverts advertisement
advertisements adsense banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices
newsletter subscribe subscription signup share sharing social comment comments disqus respond replies related recommended commentlist topbar menubar
recommendations widget pagination pager toolbar copyright login search skip disclaimer""".split())
_PREFIXES = frozenset(("has", "with", "no", "is", "without"))
_COMMENT = frozenset(("comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"))
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td tr th".split())
_SPACE = re.compile(r"\s+")


def _labels(attrs: dict[str, str]) -> set[str]:
    """The tell-tale words of class names and the id: the first or last part of a name, unless it says has-, with-, no-."""
    out = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if parts and parts[0] not in _PREFIXES:
            out.update((parts[0], parts[-1]))
    return out


class _Blocks(HTMLParser):
    """Collects blocks. What encloses the present place is kept as counts, so deep nesting costs no more than its tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, dropped ("", "tag", "class" or "comment"), is article]
        self.tags: Counter[str] = Counter()  # open elements by tag
        self.around = [0, 0, 0]  # open elements that are dropped; dropped and inline; an article
        self.out: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.linked = self.length = 0
        self.zone_at = ELSEWHERE

    def _count(self, element: list, step: int) -> None:
        tag, dropped, article = element
        self.tags[tag] += step
        self.around[0] += step * bool(dropped)
        self.around[1] += step * bool(dropped and tag in _INLINE)
        self.around[2] += step * article

    def _pop(self, k: int) -> None:
        for element in self.open[k:]:
            self._count(element, -1)
        del self.open[k:]

    def _zone(self) -> int:
        return CHROME if self.around[0] else ARTICLE if self.around[2] else ELSEWHERE

    def flush(self) -> None:
        body = _SPACE.sub(" ", "".join(self.text)).strip()
        if body:
            zone = self.zone_at
            # a list of links outside an article is a menu
            if zone == ELSEWHERE and 2 * self.linked > self.length:
                zone = CHROME
            self.out.append((zone, body))
        self.text, self.linked, self.length = [], 0, 0

    def _end_head(self) -> None:
        """Closes an open head, whose end tag may be left out."""
        self.flush()
        self._pop(next(k for k, e in enumerate(self.open) if e[0] == "head"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.tags["head"] and (tag == "body" or (self.open[-1][0] == "head" and tag not in _IN_HEAD)):
            self._end_head()
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in _INLINE:
            self.flush()
            if tag in _CLOSES_P:
                self._close_open("p")
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self._close_open(tag, within=("ul", "ol", "dl", "table"))
        if tag in _VOID:
            return
        attrs = dict(attrs)
        labels = _labels(attrs)
        inside = self.around[2] > 0
        dropped = ""
        if labels & _COMMENT:
            dropped = "comment"
        elif tag in ("article", "main"):
            for e in self.open if self.around[0] else ():  # a wrapper that is named after one of its parts
                if e[1] == "class":
                    self._count(e, -1)
                    e[1] = ""
                    self._count(e, 1)
        elif tag in _NEVER or (tag == "header" and not inside):
            dropped = "tag"
        elif "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            dropped = "tag"
        elif tag not in ("html", "body") and ((attrs.get("role") or "").lower() in _ROLES or labels & (_NAMES - {"header"} if inside else _NAMES)):
            dropped = "class"
        self.open.append([tag, dropped, tag in ("article", "main") or (attrs.get("role") or "").lower() in ("main", "article")])
        self._count(self.open[-1], 1)

    def _close_open(self, tag: str, within: tuple[str, ...] = ()) -> None:
        if not self.tags[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                self._pop(k)
                return
            if name in within or (name not in _INLINE and name != tag and not within):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if not self.tags[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag in _INLINE and self.open[k][0] not in _INLINE:
                return  # a stray end of an inline element closes no block

    def handle_data(self, data: str) -> None:
        if self.tags["head"] and self.open[-1][0] == "head" and not data.isspace():
            self._end_head()
        if self.around[1]:
            return  # a dropped element inside a block leaves the block whole
        zone = self._zone()
        if not self.text or zone != self.zone_at:
            if self.text and zone != self.zone_at:
                self.flush()
            self.zone_at = zone
        self.text.append(data)
        if not data.isspace():
            self.length += len(data)
            if self.tags["a"]:
                self.linked += len(data)


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order."""
    parser = _Blocks()
    parser.feed(re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", html))
    parser.close()
    parser.flush()
    return parser.out


def _digest(*parts: object) -> int:
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # a number per content of this task
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            found = [blocks(h or "") for h in some.column("html").to_pylist()]
            zones = pa.array([[z for z, _ in b] for b in found], pa.list_(pa.int32()))
            texts = pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))
            part, copy, digests = [], [], []
            for host, parts, spread, b in zip(*(some.column(c).to_pylist() for c in ("host", "parts", "spread")), found):
                d = _digest(host, b)
                copy.append(parts > 1 and d in seen)
                if parts > 1:
                    seen.add(d)
                part.append((spread if copy[-1] else d) % parts)
                digests.append(d)
            own = [some.column(c) for c in ("page_id", "url", "host", "parts")]
            more = [pa.array(part, pa.int32()), pa.array(copy, pa.bool_()), pa.array(digests, pa.int64()), zones, texts]
            yield pa.RecordBatch.from_arrays([*own, *more], names=["page_id", "url", "host", "parts", "part", "copy", "digest", "zones", "texts"])


def sorted_runs(word: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``run`` words are on the same page, and the rank of each one's run among all runs.

    Ranks come from sorting by 1, 2, 4, … words, so equal rank means equal words, whatever the hash.
    """
    rank, width = np.unique(word, return_inverse=True)[1], 1
    at = np.arange(len(word))
    while width < run:
        step = min(width, run - width)
        at = np.arange(len(rank) - step)
        rank = np.unique(rank[at] * (rank.max() + 1) + rank[at + step], return_inverse=True)[1]
        width += step
    ok = page[: len(rank)] == page[run - 1 : run - 1 + len(rank)]
    return np.flatnonzero(ok), rank[ok]


def _covered(at: np.ndarray, n: int, run: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + run, -1)
    return np.cumsum(change[:-1]) > 0


def _long_stretches(mask: np.ndarray) -> np.ndarray:
    """The mask without stretches shorter than a run, unless it is all set: a repeated run that ends a few words into
    a block took nothing of its own there."""
    if mask.all():
        return mask
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out = np.zeros_like(mask)
    for lo, hi in edges.reshape(-1, 2):
        out[lo:hi] = hi - lo >= RUN
    return out


class _Stream:
    """A group's pages laid end to end as words."""

    def __init__(self, pages: list[tuple[np.ndarray, list[str]]]) -> None:
        self.pages = pages
        self.data, self.offsets = tokens.column(pa.array(["\n".join(t) for _, t in pages], pa.large_string()))
        self.starts, self.ends, self.page = tokens.words(self.data, self.offsets)
        self.hashes = tokens.hashes(self.data, self.starts, self.ends)
        line = np.cumsum(self.data == 10)
        self.first = np.searchsorted(self.page, np.arange(len(pages) + 1))
        self.which = line[self.starts] - np.where(self.offsets[:-1] > 0, line[np.maximum(self.offsets[:-1], 1) - 1], 0)[self.page] if len(self.starts) else self.starts

    def outside(self, at: np.ndarray) -> np.ndarray:
        """Whether the runs at these positions have no word in an article."""
        inside = np.zeros(len(self.starts) + 1, np.int64)
        for k, (zones, _) in enumerate(self.pages):
            a, b = self.first[k], self.first[k + 1]
            if b > a:
                inside[a + 1 : b + 1] = zones[self.which[a:b]] == ARTICLE
        inside = np.cumsum(inside)
        return inside[at + RUN] == inside[at]


def _spread(rank: np.ndarray, content: np.ndarray, size: int) -> np.ndarray:
    """Per rank, how many distinct contents hold it."""
    width = int(content.max(initial=0)) + 1
    return np.bincount(np.unique(rank * width + content) // width, minlength=size)


def _host_key(host: str) -> np.uint64:
    return np.uint64(_digest(host) & (2**64 - 1))


def _keys(stream: _Stream, host: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run together with its host, and its position."""
    run, at = tokens.windows(stream.hashes, stream.page, RUN)
    return tokens.mix(run + _host_key(host)).view(np.int64), at


def host_counts(pages: list[tuple[np.ndarray, list[str]]], digests: list[int], copy: np.ndarray, host: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group of a larger host: run keys, on how many of the group's own contents each is, on how many outside
    articles. The host's own key stands for all contents. A run that only copies hold has zeros."""
    last = {d: k for k, d in enumerate(digests)} | {d: k for k, (d, c) in enumerate(zip(digests, copy)) if not c}
    some = sorted(last.values())
    own = ~copy[some]
    stream = _Stream([pages[k] for k in some])
    key, at = _keys(stream, host)
    out = stream.outside(at)
    names, rank = np.unique(key, return_inverse=True)
    page = stream.page[at]
    mine = own[page]
    n_all = _spread(rank[mine], page[mine], len(names))
    n_out = _spread(rank[mine & out], page[mine & out], len(names))
    total = int(own.sum())
    send = np.full(len(names), total < SURELY) | (n_all >= FEW * total)
    send[rank[out | ~mine]] = True
    return np.append(names[send], _host_key(host).view(np.int64)), np.append(n_all[send], total), np.append(n_out[send], total)


def unique_text(pages: list[tuple[np.ndarray, list[str]]], digests: list[int] | None = None, host: str | None = None,
                counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[str]:
    """The main text of each of a host's pages (zones, block texts).

    ``counts`` has the run keys, in order, and numbers of contents on the whole of ``host`` if the pages are only some.
    """
    stream = _Stream(pages)
    n = len(stream.starts)
    frequent = often = np.zeros(n, bool)
    if counts is not None:
        names, on_all, on_out = counts
        key, at = _keys(stream, host)
        total = on_all[names == _host_key(host).view(np.int64)].sum()
        if len(at) and len(names):
            place = np.minimum(np.searchsorted(names, key), len(names) - 1)
            found = names[place] == key
            frequent = _covered(at[found & (on_out[place] >= REPEATED) & stream.outside(at)], n, RUN)
            often = _covered(at[found & (on_all[place] >= max(MANY, ON_MOST * total))], n, RUN)
    elif n > RUN and len(pages) > 1:
        at, rank = sorted_runs(stream.hashes, stream.page)
        if len(at):
            digests = [_digest(list(zip(z.tolist(), t))) for z, t in pages] if digests is None else digests
            content = np.unique(np.array(digests, np.int64), return_inverse=True)[1]
            out, page, size = stream.outside(at), content[stream.page[at]], int(rank.max()) + 1
            frequent = _covered(at[out & (_spread(rank[out], page[out], size)[rank] >= REPEATED)], n, RUN)
            often = _covered(at[_spread(rank, page, size)[rank] >= max(MANY, ON_MOST * (content.max() + 1))], n, RUN)
    texts = []
    for k, (zones, own) in enumerate(pages):
        has_article = bool((zones == ARTICLE).any())
        a, b = stream.first[k], stream.first[k + 1]
        which = stream.which[a:b]
        main = [i for i in range(len(own)) if zones[i] == (ARTICLE if has_article else ELSEWHERE)]
        span = {i: (a + np.searchsorted(which, i), a + np.searchsorted(which, i + 1)) for i in main}
        if has_article:
            gone = {i for i, (lo, hi) in span.items() if hi > lo and often[lo:hi].all()}
            words = {i: hi - lo for i, (lo, hi) in span.items()}
            if 2 * sum(words[i] for i in gone) >= sum(words.values()):
                gone = set()  # a copy of other articles
            keep = [own[i] for i in main if i not in gone]
        else:
            keep = []
            for i, (lo, hi) in span.items():
                body = own[i]
                if frequent[lo:hi].any():
                    cut = _long_stretches(frequent[lo:hi])
                    body = " ".join(w for w, g in zip(body.split(" "), cut) if not g)
                if body:
                    keep.append(body)
            keep = keep or [own[i] for i in main]
        texts.append("\n\n".join(keep))
    return texts


def _group_pages(pdf: pd.DataFrame) -> list[tuple[np.ndarray, list[str]]]:
    return [(np.asarray(z), list(t)) for z, t in zip(pdf["zones"], pdf["texts"])]


def _counts(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "host", "part", "keys", "n_all", "n_out"]
        if pdf["parts"].iloc[0] < 2:
            return pd.DataFrame(columns=names, dtype=object)
        host, part = pdf["host"].iloc[0], pdf["part"].iloc[0]
        keys, n_all, n_out = host_counts(_group_pages(pdf), pdf["digest"].tolist(), pdf["copy"].to_numpy(bool), host)
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        some = np.split(order, edges)
        return pd.DataFrame(
            [(bucket[s[0]], host, part, keys[s], n_all[s].astype(np.int32), n_out[s].astype(np.int32)) for s in some], columns=names
        )

    return run


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of a bucket's runs over all groups, back to the groups that hold them; without those that decide nothing."""
    names, place = np.unique(np.concatenate(pdf["keys"].tolist()), return_inverse=True)
    n_all, n_out = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    np.add.at(n_all, place, np.concatenate(pdf["n_all"].tolist()))
    np.add.at(n_out, place, np.concatenate(pdf["n_out"].tolist()))
    use = (n_all >= MANY) | (n_out >= REPEATED)
    rows, i = [], 0
    for host, part, keys in zip(pdf["host"], pdf["part"], pdf["keys"]):
        at = place[i : i + len(keys)]
        i += len(keys)
        at = at[use[at]]
        if len(at):
            rows.append((host, part, names[at], n_all[at], n_out[at]))
    return pd.DataFrame(rows, columns=["host", "part", "keys", "n_all", "n_out"], dtype=object)


def _host_group(pdf: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame(columns=["page_id", "url", "text"], dtype=object)
    counts = None
    if pdf["parts"].iloc[0] > 1:
        columns = [np.concatenate([np.zeros(0, np.int64), *sums[c].tolist()]) for c in ("keys", "n_all", "n_out")]
        order = np.argsort(columns[0])
        counts = tuple(c[order] for c in columns)
    text = unique_text(_group_pages(pdf), pdf["digest"].tolist(), pdf["host"].iloc[0], counts)
    return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text})


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: key, url, text (empty if none)."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    counts = pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"))
    hosts, total = counts.agg(F.count("*"), F.coalesce(F.sum("n_pages"), F.lit(0))).first()
    if hosts <= SMALL_HOSTS:
        counts = F.broadcast(counts)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    rows = rows.join(counts, "host").select(
        "page_id", "url", "host", F.ceil(F.col("n_pages") / PAGES).cast("int").alias("parts"), F.xxhash64("page_id", "url").alias("spread"), "html"
    )
    kind = dict(rows.dtypes)["page_id"]
    parsed = rows.mapInArrow(
        _parse, f"page_id {kind}, url string, host string, parts int, part int, copy boolean, digest long, zones array<int>, texts array<string>"
    )
    # both readers take every column, so the plan shuffles the pages once
    groups = parsed.groupBy("host", "part")
    found = "host string, part int, keys array<long>, n_all array<{0}>, n_out array<{0}>"
    counted = groups.applyInPandas(_counts(max(BUCKETS, total // BUCKET_PAGES)), f"bucket long, {found.format('int')}")
    sums = counted.groupBy("bucket").applyInPandas(_sums, found.format("long"))
    out = groups.cogroup(sums.groupBy("host", "part")).applyInPandas(_host_group, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(key), F.col("url").alias(url), "text")


@query("op4_html_text")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    out = main_text(spark.read.parquet(f"{sf}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
