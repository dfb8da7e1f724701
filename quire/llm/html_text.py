"""Operator 2: main text of web pages, with repeated runs of tokens over each host's pages.

A page is read into blocks. Blocks inside elements that say what they are
(nav, header, footer, aside, form, script, style, adverts, notices, reader
comments) go. Where a page marks its article (article, main, role=main) its
blocks are the text. Blocks that nothing marks are decided by the host: what
strings of RUN tokens that occur in SEVERAL different token streams of its
unmarked pages cover is boilerplate, and the rest stays.

Streams are counted, not pages: copies of a page have one stream, and streams
whose sets of 3-token shingles are alike by NEAR count as one (a print version,
another date). They are found by SEEDS minima of their shingles' hashes: of the
streams of a host that share one, each is compared with the first, so a host
with a third of all pages costs no pairs; near copies that share no minimum with
a like first stream count as two. What fewer streams share, such as a quotation
or the boilerplate of a host of two pages, stays.

The token streams of a host are concatenated in shards of about SHARD tokens (one
for most hosts), and each shard sorts its suffixes by prefix doubling to RUN
tokens: suffixes of equal rank share a string of RUN tokens, and their streams'
groups are counted there. A host of one shard is decided so; the shards of a
larger one send each string's groups, SEVERAL at most, to be counted together.
What the strings found cover is then cut out page by page.

Defined cases: null html and empty html give an empty text; a null url has the
host ""; a page cut off inside a tag loses that tag; unclosed elements end with
the page; repeated rows are pages of one stream; an empty table gives
an empty result; a very long page is parsed whole and, if unmarked, a shard of
its own; other columns are dropped, whatever they are called.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saver, saver
from .words import mix

#: Tokens of a repeated string; a power of two.
RUN = 8
#: Tokens of a shard of a host's suffix array.
SHARD = 400_000
#: Different streams of a host that make a string boilerplate: an article and a page that quotes it are two.
SEVERAL = 3
SHINGLE, SEEDS, SKETCH, NEAR = 3, 8, 64, 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z/][^<>]*$",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head nav footer aside form menu dialog button title".split())
_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup comment comments disqus reply replies respond "
    "related share sharing social widget toolbar pagination pager skip login search copyright masthead".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: An end tag that a new start tag implies: p before any block, li, dt, dd, tr, td before their like.
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _role(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(boilerplate, article) of an element; inside: an article is open."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)} if "=" in attributes else {}
    role = found.get("role", "").lower()
    if tag in _DROP or role in _ROLES or "hidden" in attributes.split() or found.get("aria-hidden") == "true":
        return True, False
    if tag == "header" and not inside:
        return True, False
    names = {w for k in ("class", "id") for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found.get(k, "")).lower())}
    if names & _WORDS and tag not in ("html", "body", "article", "main") and not (names & {"content", "article", "post", "entry"} and names & {"header"}):
        return True, False
    return False, tag in ("article", "main") or role == "main"


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The page's blocks in order without marked boilerplate, and whether they are of a marked article."""
    out: list[tuple[str, bool]] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    drop = article = 0
    at = 0
    page = page or ""

    def flush() -> None:
        if part:
            if text := _SPACE.sub(" ", "".join(part)).strip():
                out.append((text, article > 0))
            part.clear()

    def pop(k: int) -> None:
        nonlocal drop, article
        while len(stack) > k:
            tag, dropped, marked = stack.pop()
            if tag in _BLOCK:
                flush()
            drop -= dropped
            article -= marked

    for m in _TOKEN.finditer(page):
        if m.start() > at and not drop:
            part.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag in ("br", "p") and not any(t == tag for t, _, _ in stack):
                part.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                # An inline end tag doesn't close the blocks around it.
                if stack[k][0] in _BLOCK and tag not in _BLOCK:
                    break
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" or t in _LIKE.get(tag, ()):
                    pop(k)
                    break
                if t in _BLOCK and t not in ("tr", "td", "th") or tag in ("table",):
                    break
            flush()
        if tag in _VOID or m[5]:
            if tag == "br":
                part.append(" ")
            continue
        dropped, marked = _role(tag, m[4] or "", article > 0)
        stack.append((tag, dropped, marked))
        drop += dropped
        article += marked
    if at < len(page) and not drop:
        part.append(html.unescape(page[at:]))
    pop(0)
    flush()
    own = [t for t, a in out if a]
    return (own, True) if own else ([t for t, _ in out], False)


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, _blocks, _marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(h.as_py()) for h in b.column("html")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([m for _, m in found], pa.bool_())], names=["page_id", "url", "_blocks", "_marked"])

    schema = pages.select("page_id", "url").schema
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{columns}, _blocks array<string>, _marked boolean")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def _hashes(tokens: str, n: int) -> Column:
    """Hashes of the runs of n tokens."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(n)]))


def near_streams(streams: DataFrame) -> DataFrame:
    """(host, _stream, _group) of (host, _stream, t): streams of a host that are nearly alike share a group where they share a first stream."""
    sets = streams.select("host", "_stream", F.array_distinct(_hashes("t", SHINGLE)).alias("s"))
    seeds = F.array(*[F.struct(F.lit(k).alias("k"), F.array_min(F.transform("s", lambda x, k=k: F.xxhash64(x, F.lit(k)))).alias("m")) for k in range(SEEDS)])
    rows = sets.select("host", "_stream", F.slice(F.array_sort("s"), 1, SKETCH).alias("s"), F.inline(seeds))
    first = rows.groupBy("host", "k", "m").agg(F.min(F.struct("_stream", "s")).alias("f"))
    both = F.slice(F.array_sort(F.array_union("s", "f.s")), 1, SKETCH)
    alike = F.size(F.array_intersect(F.array_intersect("s", "f.s"), both)) >= F.lit(NEAR) * F.size(both)
    return rows.join(first, ["host", "k", "m"]).groupBy("host", "_stream").agg(F.min(F.when(alike, F.col("f._stream")).otherwise(F.col("_stream"))).alias("_group"))


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first ``depth`` codes, ranks): by prefix doubling; codes are 0 and up, depth a power of two."""
    _, rank = np.unique(codes, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while step < depth:
        after = np.full(len(rank), 0, np.int64)
        after[: max(len(rank) - step, 0)] = rank[step:] + 1  # a suffix that ends comes first
        _, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        rank, step = rank.astype(np.int64), step * 2
    return np.argsort(rank, kind="stable"), rank


def _streams(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of token streams one after another: (token hashes, stream of each, place in it, which places start a string of ``run`` tokens)."""
    tokens = [t.split(" ") for t in texts]
    size = np.array([len(t) for t in tokens], np.int64)
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(x, len(known)) for t in tokens for x in t], np.int64)
    hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in known], np.uint64)[codes]
    stream = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(stream)) - np.repeat(np.cumsum(size) - size, size)
    return hashes, stream, at, at + run <= size[stream]


def _heads(hashes: np.ndarray, run: int) -> np.ndarray:
    """64-bit hashes of the strings of ``run`` tokens from each place; those that leave their stream mean nothing."""
    padded = np.concatenate([hashes, np.zeros(run, np.uint64)])
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(run):
        acc += mix(padded[k : k + len(hashes)] ^ np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return mix(acc)


def _repeats(run: int):
    """(host, shards, h, group): strings of a shard and the groups of streams they occur in, SEVERAL at most each."""

    def found(g: pa.Table) -> pa.Table:
        hashes, stream, _, whole = _streams(g["t"].to_pylist(), run)
        order, rank = suffix_order(np.unique(hashes, return_inverse=True)[1], run)
        order = order[whole[order]]
        named = g["_group"].to_numpy()
        group = np.unique(named, return_inverse=True)[1][stream[order]]
        # One row per (string, group): both are in order within a run of equal suffixes.
        groups = int(group.max(initial=0)) + 1
        own, first = np.unique(rank[order] * groups + group, return_index=True)
        ranks = own // groups
        start = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(ranks)])
        nth = np.arange(len(ranks)) - np.repeat(start, count)
        shards = g["shards"][0].as_py()
        use = (nth < SEVERAL) & (np.repeat(count, count) >= (SEVERAL if shards == 1 else 1))
        at = order[first[use]]
        h, n = _heads(hashes, run)[at].view(np.int64), len(at)
        return pa.table({"host": pa.array([g["host"][0].as_py()] * n, pa.string()), "shards": pa.array([shards] * n, pa.int64()), "h": pa.array(h), "_group": pa.array(named[stream[at]], pa.int64())})

    return found


def _covered(run: int):
    def made(host: str, streams: list[int], runs: list[list[list[int]]]) -> pa.Table:
        return pa.table({"host": pa.array([host] * len(streams), pa.string()), "_stream": pa.array(streams, pa.int64()), "_runs": pa.array(runs, pa.list_(pa.list_(pa.int64())))})

    def found(key: tuple, g: pa.Table, repeated: pa.Table) -> pa.Table:
        if not g.num_rows or not repeated.num_rows:
            return made("", [], [])
        hashes, stream, at, whole = _streams(g["t"].to_pylist(), run)
        hit = np.flatnonzero(whole & np.isin(_heads(hashes, run).view(np.int64), repeated["h"].to_numpy()))
        if not len(hit):
            return made("", [], [])
        opens = np.r_[True, (hit[1:] > hit[:-1] + run) | (stream[hit[1:]] != stream[hit[:-1]])]
        start, last = hit[opens], hit[np.r_[opens[1:], True]]
        runs: dict[int, list[list[int]]] = {}
        for s, a, b in zip(stream[start].tolist(), at[start].tolist(), (at[last] + run).tolist()):
            runs.setdefault(s, []).append([a, b])
        ids = g["_stream"].to_pylist()
        return made(g["host"][0].as_py(), [ids[s] for s in runs], list(runs.values()))

    return found


def repeated_runs(unmarked: DataFrame, save: Saver, run: int = RUN) -> DataFrame:
    """(host, _stream, _runs): token ranges that strings of ``run`` tokens of SEVERAL different streams of the host cover."""
    pages = unmarked.select("host", "_stream", F.array_join("_blocks", " ").alias("t"))
    streams = save(pages.groupBy("host", "_stream").agg(F.first("t").alias("t")).withColumn("n", F.size(F.split("t", " "))).where(F.col("n") >= run))
    near = near_streams(streams.select("host", "_stream", F.split("t", " ").alias("t")))
    hosts = streams.groupBy("host").agg(F.ceil(F.sum("n") / SHARD).alias("shards"))
    placed = save(streams.join(near, ["host", "_stream"]).join(hosts, "host").withColumn("shard", F.pmod("_stream", "shards")))
    strings = placed.groupBy("host", "shard").applyInArrow(_repeats(run), "host string, shards bigint, h bigint, _group bigint")
    counted = strings.distinct().groupBy("host", "shards", "h").count().where(F.col("count") >= SEVERAL)
    repeated = counted.select("host", "h", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    found = placed.groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard")).applyInArrow(_covered(run), "host string, _stream bigint, _runs array<array<bigint>>")
    return save(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_blocks without the tokens that _runs cover; a block without any goes."""
    for b in batches:
        out = []
        for own, runs in zip(b.column("_blocks").to_pylist(), b.column("_runs").to_pylist()):
            if runs:
                gone = {i for start, end in runs for i in range(start, end)}
                left, at = [], 0
                for block in own:
                    tokens = block.split(" ")
                    if kept := [t for k, t in enumerate(tokens, at) if k not in gone]:
                        left.append(" ".join(kept))
                    at += len(tokens)
                own = left
            out.append(own)
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.list_(pa.string())), pa.array([False] * len(out))], names=["page_id", "url", "_blocks", "_marked"])


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars, in_article (whether the page marks its article), n_blocks."""
    save = saver(pages.sparkSession)
    parsed = save(_parsed(pages))  # read several times, parsed once
    every = parsed.where("_marked").select("page_id", "url", "_blocks", "_marked")
    unmarked = parsed.where("not _marked").select("page_id", "url", "_blocks", host_of(F.col("url")).alias("host"), F.xxhash64(F.split(F.array_join("_blocks", " "), " ")).alias("_stream"))
    if not unmarked.isEmpty():
        rest = unmarked.join(repeated_runs(unmarked, save, run), ["host", "_stream"], "left").select("page_id", "url", "_blocks", "_runs")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.select("page_id", "url").schema)
        every = every.unionByName(rest.mapInArrow(_cut, f"{columns}, _blocks array<string>, _marked boolean"))
    text = F.array_join("_blocks", "\n\n")
    return every.select(
        "page_id",
        "url",
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        F.col("_marked").alias("in_article"),
        F.size("_blocks").cast("long").alias("n_blocks"),
    )
