"""Main text of web pages: page structure, and a host suffix array over what structure leaves open.

A page is cut into blocks. Blocks in an article (or main) element are its main text; blocks in menus, headers, footers, sidebars,
notices, adverts, forms, comments and other page furniture, by element, role, class or id, are dropped; the rest is open.
A page without main text is made of its open blocks: the token streams of a host's pages are put end to end, their suffixes
ordered (by prefix doubling), and runs of at least ``RUN`` tokens that begin in distinct pages are boilerplate; unique
runs stay. Runs that repeat inside an article aren't removed: an article that quotes or copies another is still the page's main text.
A host's pages are dealt into groups of about ``PAGES`` by a hash of the page's id, so that a hot host is many tasks. Each group orders its own
suffixes; the distinct runs of all groups of a host, by a 128-bit key, are then merged, so that a run repeats where two pages of the host
have it, in whatever groups they are.

Cases: null and empty html, and pages of furniture only, give the empty text; unclosed elements and a page cut short end with the page;
repeated rows are distinct pages of equal id and don't count as repetition of each other; a null url is a host of its own; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import staged

RUN = 8
PAGES = 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that don't break a block.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
#: Elements that are page furniture, and words of class and id (or roles) that mark it.
_FURNITURE = {"nav", "footer", "aside", "form", "head", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "fieldset", "input"} | _RAW
_MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup overlay modal newsletter subscribe "
    "subscription signup login sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs topbar footer header masthead comment comments commentlist disqus respond replies "
    "share sharing social related recommended widget toolbar pagination pager copyright skip search".split()
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_SPLIT = re.compile(r"[^a-z]+")

MAIN, OPEN, NONE = 2, 1, 0


def _is_furniture(tag: str, raw: str, in_main: bool) -> bool:
    if tag in _FURNITURE:
        return True
    if tag == "header":
        return not in_main  # an article's own header bears its headline
    if not raw or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTR.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if not _MARKS.isdisjoint(_SPLIT.split(value)):
                return True
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of each block, in page order, furniture left out."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the role inside
    role, at, n = OPEN, 0, len(page)

    def close() -> None:
        if parts:
            if role != NONE and (text := " ".join("".join(parts).split())):
                out.append((role, text))
            parts.clear()

    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:  # never: a lone < is a token
            break
        at = m.end()
        if (text := m[5]) is not None:
            if role != NONE:
                parts.append(html.unescape(text))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in _INLINE or stack[k][1] != (stack[k - 1][1] if k else OPEN):
                        close()
                    del stack[k:]
                    role = stack[-1][1] if stack else OPEN
                    break
            else:
                if tag not in _INLINE:
                    close()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in _INLINE:
            close()
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # these end one another
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        role = stack[-1][1] if stack else OPEN
                        break
                    if stack[k][0] not in _INLINE and stack[k][0] not in ("p", "li", "dt", "dd", "td", "th"):
                        break
        if tag in _VOID or m[4]:
            continue
        inner = role
        if role != NONE:
            if _is_furniture(tag, m[3], role == MAIN):
                inner = NONE
            elif tag in ("article", "main"):
                inner = MAIN
        if inner != role:
            close()
        stack.append((tag, inner))
        role = inner
    close()
    return out


def _ordered(streams: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each stream; for each token the rank of the ``run`` tokens from it, -1 where the stream ends before; and for each
    rank whether two streams have it: the suffixes of all streams in order, by doubling."""
    size = np.array([len(s) for s in streams], np.int64)
    n = int(size.sum())
    stream = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(n)
    rank, _ = pd.factorize(np.array([t for s in streams for t in s], object))
    rank, have = rank.astype(np.int64), 1
    while have < run:
        step = min(have, run - have)
        after = np.where(left > step, rank[np.minimum(np.arange(n) + step, n - 1)] + 1, 0)
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        have += step
    full = left >= run
    low, high = np.full(n, n), np.full(n, -1)
    np.minimum.at(low, rank[full], stream[full])
    np.maximum.at(high, rank[full], stream[full])
    return size, np.where(full, rank, -1), low < high


def _covered(size: np.ndarray, rank: np.ndarray, repeats: np.ndarray, run: int) -> list[np.ndarray]:
    """Which tokens of each stream lie in a run whose rank repeats."""
    hit = np.flatnonzero((rank >= 0) & repeats[rank])
    mark = np.zeros(len(rank) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + run, -1)
    return np.split(np.cumsum(mark[:-1]) > 0, np.cumsum(size)[:-1])


def repeated_runs(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """Which tokens of each stream a string of ``run`` tokens covers that another stream has too."""
    size, rank, many = _ordered(streams, run)
    return _covered(size, rank, many, run)


def _run_keys(host: str, streams: list[list[str]], rank: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of all distinct runs, and 128-bit keys (two numbers) of each run and its host."""
    tokens = [t for s in streams for t in s]
    full = np.flatnonzero(rank >= 0)
    ranks, first = np.unique(rank[full], return_index=True)
    keys = b"".join(hashlib.blake2b("\n".join([*tokens[p : p + run], host]).encode(), digest_size=16).digest() for p in full[first].tolist())
    return ranks, np.frombuffer(keys, np.int64).reshape(-1, 2) if keys else np.zeros((0, 2), np.int64)


def _unique_text(open_blocks: list[str], covered: np.ndarray, run: int) -> str:
    """The blocks without their covered stretches. A stretch counts where it is a whole block or ``run`` tokens of one, so that a
    notice doesn't take along the common words at the start of the next block."""
    out, at = [], 0
    for b in open_blocks:
        tokens = b.split()
        c = covered[at : at + len(tokens)]
        at += len(tokens)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
        gone = np.zeros(len(tokens), bool)
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            gone[i:j] = j - i >= min(run, len(tokens))
        out += [w for w, g in zip(tokens, gone, strict=True) if not g]
    return " ".join(out)


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, main, open): main text, and the open blocks."""

    def run(batches):
        for batch in batches:
            main, rest, host = [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = blocks(page or "")
                main.append(" ".join(t for r, t in got if r == MAIN))
                rest.append([t for r, t in got if r == OPEN])
                m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
                host.append(m[1].rpartition("@")[2].lower() if m else "")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(host, pa.string()), pa.array(main, pa.string()), pa.array(rest, pa.list_(pa.string()))], names=["page_id", "url", "host", "main", "open"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, host string, main string, open array<string>")


def extract(pages: DataFrame, run: int = RUN, most: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    parsed = _parsed(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    done = parsed.where("main != ''").select("page_id", "url", F.col("main").alias("text"))
    # only pages with open blocks go on, without their main text; hosts of many are dealt out, all rows of an id to one group
    loose = staged(parsed.where("main = '' or size(open) > 0").select("page_id", "url", "host", (F.col("main") == "").alias("wanted"), "open"), "pages")
    hosts = loose.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    dealt = loose.join(hosts.select("host", F.ceil(F.col("n") / most).alias("k")), "host").withColumn("deal", F.pmod(F.xxhash64("page_id"), F.col("k")))

    def streams(table: pa.Table) -> tuple[list, list, dict, list[int], list[list[str]]]:
        open_, ids = table.column("open").to_pylist(), table.column("page_id").to_pylist()
        first = {i: k for k, i in reversed(list(enumerate(ids)))}
        own = [k for k, i in enumerate(ids) if first[i] == k]  # a repeated row isn't another page
        return open_, ids, first, own, [[w for b in open_[k] for w in b.split()] for k in own]

    def runs(table: pa.Table) -> pa.Table:
        *_, own = streams(table)
        _, rank, many = _ordered(own, run)
        ranks, keys = _run_keys(table.column("host")[0].as_py(), own, rank, run)
        host, deal = (pa.array([table.column(c)[0].as_py()] * len(ranks), table.schema.field(c).type) for c in ("host", "deal"))
        return pa.table({"host": host, "deal": deal, "high": pa.array(keys[:, 0]), "low": pa.array(keys[:, 1]), "many": pa.array(many[ranks])})

    def cleaned(table: pa.Table, repeated: pa.Table | None = None) -> pa.Table:
        open_, ids, first, own, pages = streams(table)
        size, rank, repeats = _ordered(pages, run)
        if repeated is not None:  # what repeats on the whole host
            known = set(zip(repeated.column("high").to_pylist(), repeated.column("low").to_pylist(), strict=True))
            ranks, keys = _run_keys(table.column("host")[0].as_py(), pages, rank, run)
            repeats[ranks] = [k in known for k in map(tuple, keys.tolist())]
        cover = {ids[k]: c for k, c in zip(own, _covered(size, rank, repeats, run), strict=True)}
        texts = [_unique_text(open_[k], cover[i] if first[i] == k or open_[first[i]] == open_[k] else np.zeros(sum(len(b.split()) for b in open_[k]), bool), run) for k, i in enumerate(ids)]
        keep = [k for k, w in enumerate(table.column("wanted").to_pylist()) if w]
        return pa.table({"page_id": table.column("page_id").take(keep), "url": table.column("url").take(keep), "text": pa.array([texts[k] for k in keep], pa.string())})

    schema = f"page_id {kind}, url string, text string"
    whole = dealt.where("k = 1").groupBy("host").applyInArrow(lambda table: cleaned(table), schema)
    parts = dealt.where("k > 1")
    found = parts.groupBy("host", "deal").applyInArrow(runs, "host string, deal long, high long, low long, many boolean")
    # an id lies in one group, so a run of two groups is one of two pages
    found = found.groupBy("host", "high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"), F.collect_list("deal").alias("deals")).where("many or n > 1")
    found = found.select("host", F.explode("deals").alias("deal"), "high", "low")
    dealt_out = parts.groupBy("host", "deal").cogroup(found.groupBy("host", "deal")).applyInArrow(lambda table, repeated: cleaned(table, repeated), schema)
    return done.unionByName(whole).unionByName(dealt_out).withColumn("n_chars", F.length("text").cast("long"))


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
