"""Main text of web pages through wrappers: union-free regular expressions of a host's pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.llm.markup import HEADINGS, Node, parse
from kerbside.llm.store import plain, stash, with_text_columns

LONGEST_GROUP = 5
FAN_IN = 64
LEAST_PAGES = 3  # from so many on, a text that never differs is part of the template


class Item:
    """One term of a wrapper: a text slot, an element, or a group, with a quantifier.

    key names what it matches; many and maybe are the quantifiers (once, +, ?, *).
    A slot counts its characters, those in links, the pages that have it, and keeps a
    hash of the text while all were equal. main marks slots of the main text: 2 in an
    article, 1 elsewhere, for pages that fill none of the first.
    """

    __slots__ = ("key", "main", "many", "maybe", "parts", "stats")

    def __init__(self, key, parts=None, many=False, maybe=False, stats=None):
        self.key, self.parts, self.many, self.maybe, self.stats, self.main = key, parts, many, maybe, stats, 0

    def dump(self) -> list:
        return [self.key, [p.dump() for p in self.parts] if self.parts is not None else None, self.many, self.maybe, self.stats]


def load(dumped: list) -> Item:
    key, parts, many, maybe, stats = dumped
    return Item(key, [load(p) for p in parts] if parts is not None else None, many, maybe, stats)


def induce(node: Node) -> Item:
    """The wrapper of one element: its children with their repetitions folded."""
    if node.key == "#":
        return Item("#", stats=[len(node.text), node.linked, 1, xxhash.xxh64_hexdigest(node.text)])
    return Item(node.key, fold([induce(c) for c in node.children]))


def _join(a: Item, b: Item, one_page: bool = False) -> Item:
    """One term for both of equal key; of one page, or of different ones."""
    if a.key == "#":
        pages = max(a.stats[2], b.stats[2]) if one_page else a.stats[2] + b.stats[2]
        stats = [a.stats[0] + b.stats[0], a.stats[1] + b.stats[1], pages, a.stats[3] if a.stats[3] == b.stats[3] else None]
        return Item("#", None, a.many or b.many, a.maybe or b.maybe, stats)
    return Item(a.key, align(a.parts, b.parts, one_page), a.many or b.many, a.maybe or b.maybe)


def fold(items: list[Item]) -> list[Item]:
    """Neighbours that match the same become one repeated term; then so do repeated groups."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].key == item.key:
            maybe = out[-1].maybe and item.maybe
            out[-1] = _join(out[-1], item, True)
            out[-1].many, out[-1].maybe = True, maybe
        else:
            out.append(item)
    for size in range(2, LONGEST_GROUP + 1):
        at = 0
        while at + 2 * size <= len(out):
            run = out[at : at + size]
            keys = [x.key for x in run]
            if keys != [x.key for x in out[at + size : at + 2 * size]]:
                at += 1
                continue
            end = at + size
            while [x.key for x in out[end : end + size]] == keys:
                run = [_join(a, b, True) for a, b in zip(run, out[end : end + size])]
                end += size
            out[at:end] = [Item("(" + " ".join(keys) + ")", run, many=True)]
            at += 1
    return out


def align(a: list[Item], b: list[Item], one_page: bool = False) -> list[Item]:
    """The terms of both sequences in order: the longest common ones joined, the others optional."""
    same = 0  # equal beginnings need no table
    while same < min(len(a), len(b)) and a[same].key == b[same].key:
        same += 1
    out: list[Item] = [_join(x, y, one_page) for x, y in zip(a[:same], b[:same])]
    a, b = a[same:], b[same:]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    keys = [x.key for x in b]
    for i in range(n - 1, -1, -1):
        row, under, key = best[i], best[i + 1], a[i].key
        last = 0
        for j in range(m - 1, -1, -1):
            last = row[j] = under[j + 1] + 1 if key == keys[j] else max(under[j], last)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_join(a[i], b[j], one_page))
            i, j = i + 1, j + 1
            continue
        if j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            item, i = a[i], i + 1
        else:
            item, j = b[j], j + 1
        out.append(Item(item.key, item.parts, item.many, True, item.stats))
    return fold(out)


def match(items: list[Item], nodes: list[Node]) -> list[tuple[Item, Node]] | None:
    """Terms and the nodes they take, if the sequence as a whole matches."""
    failed: set[tuple[int, int]] = set()

    def once(parts: list[Item], at: int) -> tuple[int, list] | None:
        """A group's terms in order, each taking as much as it can."""
        taken: list = []
        for part in parts:
            found = take(part, at)
            if found is None:
                if not part.maybe:
                    return None
                continue
            at, more = found
            taken += more
        return at, taken

    def take(item: Item, at: int) -> tuple[int, list] | None:
        if not item.key.startswith("("):
            end = at
            while end < len(nodes) and nodes[end].key == item.key and (item.many or end == at):
                end += 1
            return (end, [(item, n) for n in nodes[at:end]]) if end > at else None
        taken, start = [], at
        while (found := once(item.parts, at)) is not None and found[0] > at:
            at, more = found
            taken += more
            if not item.many:
                break
        return (at, taken) if at > start else None

    # terms are taken or left out in turn; a dead end goes back to the last term that could still be left out
    path: list[tuple[int, int, int | None]] = []  # term, node, and what had been taken before it took (none: left out)
    out: list = []
    i = at = 0
    while i < len(items) or at < len(nodes):
        if i < len(items) and (i, at) not in failed:
            found = take(items[i], at)
            if found is not None:
                path.append((i, at, len(out)))
                out += found[1]
                i, at = i + 1, found[0]
                continue
            if items[i].maybe:
                path.append((i, at, None))
                i += 1
                continue
            failed.add((i, at))
        while path:
            i, at, before = path.pop()
            if before is not None:
                del out[before:]
                if items[i].maybe and (i + 1, at) not in failed:
                    path.append((i, at, None))
                    i += 1
                    break
            failed.add((i, at))
        else:
            return None
    return out


def mark_main(wrapper: Item) -> Item:
    """Mark the slots of the main text.

    Slots in boilerplate elements never count. Where a page fills others in an article or
    main element, those are its main text. On the host's other pages it is every slot
    outside that is not mostly links and whose text differs between the host's pages.
    """
    inside: list[Item] = []
    outside: list[Item] = []

    def walk(item: Item, article: bool) -> None:
        if item.key == "#":
            (inside if article else outside).append(item)
            return
        tag = item.key.split(".", 1)[0]
        if item.key.endswith("!"):
            return
        if tag == "header":
            # a page's header goes; an article's keeps its headings
            for part in item.parts if article else ():
                if part.key.split(".", 1)[0] in HEADINGS:
                    walk(part, article)
            return
        article = article or tag in ("article", "main") or "=main" in item.key or "=article" in item.key
        for part in item.parts or ():
            walk(part, article)

    walk(wrapper, False)
    outside = [s for s in outside if s.stats[1] <= s.stats[0] / 2]
    varied = [s for s in outside if s.stats[2] < LEAST_PAGES or s.stats[3] is None]
    for slot in varied or outside:
        slot.main = 1
    for slot in inside:
        slot.main = 2
    return wrapper


def main_text(wrapper: Item, root: Node) -> str | None:
    """Text of the main slots in page order; None if the page does not match.

    Pages of one host differ in layout: one that fills no slot in an article takes the others.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[Item, Node]] = [(wrapper, root)]
    while stack:
        item, node = stack.pop()
        if node.key == "#":
            if item.main:
                out.append((item.main, node.text))
            continue
        pairs = match(item.parts, node.children)
        if pairs is None:
            return None
        stack.extend(reversed(pairs))
    first = max((rank for rank, _ in out), default=0)
    return " ".join(text for rank, text in out if rank == first)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; empty for anything else."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def learn(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of every host, from all of its pages, as JSON.

    A task aligns the pages it reads, host by host; the wrappers of a host then meet
    in groups of bounded size, round after round, until one is left. So a host's
    pages are never gathered, however many there are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Item] = {}
        for batch in batches:
            for host, html in zip(*(c.to_pylist() for c in batch.columns)):
                found = induce(parse(html or ""))
                wrappers[host] = _join(wrappers[host], found) if host in wrappers else found
        columns = [pa.array(list(wrappers), pa.string()), pa.array([json.dumps(w.dump()) for w in wrappers.values()], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "wrapper"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        dumped = sorted(frame["wrapper"])
        whole = load(json.loads(dumped[0]))
        for other in dumped[1:]:
            whole = _join(whole, load(json.loads(other)))
        return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [json.dumps(whole.dump())]})

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = stash(rows.mapInArrow(partial, "host string, wrapper string"), "wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // FAN_IN)
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(groups))
        merged = parts.groupBy("host", salt.alias("salt")).applyInPandas(merge, "host string, wrapper string")
        parts = stash(merged, "wrappers")
    return parts


@lru_cache(maxsize=256)
def _wrapper(dumped: str) -> Item:
    return mark_main(load(json.loads(dumped)))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of pages (all by default) with the main text of each page.

    Wrappers are learned per host from all pages; a page's text is what its host's
    main slots take of it, blocks joined by one space. A page that its host's wrapper
    does not match as a whole, or finds no text in, is read through a wrapper of its own. Character
    references are decoded and white space is single. Null and empty pages have an
    empty text; pages without a host share one wrapper. A column named text is replaced.
    """
    names = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    rows, inner = plain(pages)
    rows = rows.select(*dict.fromkeys(inner[c] for c in [*names, url_col, html_col])).withColumn("host", host_of(F.col(inner[url_col])))
    joined = rows.join(learn(pages, url_col, html_col), "host", "left")
    # wrapper and page travel as one text: the length of the first comes before them
    both = joined.withColumn("_both", F.concat(F.length("wrapper").cast("string"), F.lit(":"), "wrapper", F.coalesce(inner[html_col], F.lit(""))))

    def compute(texts: list[bytes]) -> list[pa.Array]:
        out = []
        for both in texts:
            size, _, text = both.decode().partition(":")
            dumped, html = text[: int(size)], text[int(size) :]
            root = parse(html)
            found = main_text(_wrapper(dumped), root)
            out.append(main_text(mark_main(induce(root)), root) if not found else found)
        return [pa.array(out, pa.string())]

    done = with_text_columns(both, "_both", compute, "text string", [inner[c] for c in names])
    return done.toDF(*names, "text")
