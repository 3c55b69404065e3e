"""Benchmark passages in documents, found with a generalised suffix automaton."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from kerbside.llm.memory import keep_one
from kerbside.llm.store import open_folder, with_text_columns
from kerbside.llm.words import alnum_words
from kerbside.scratch import scratch_dir

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # letters, digits and non-ASCII characters, before lower-casing
SHARD_WORDS = 500_000


class Automaton:
    """Suffix automaton of several word sequences.

    State 0 is the empty sequence. ``windows[state]`` lists the items one of whose
    windows is the state's ``size``-word suffix; ``short[state]`` lists (length,
    item) of items shorter than the window that are a suffix of the state.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[int, list] = {}
        self.short: dict[int, list] = {}
        for name, words in items:
            if words and len(words) < window:
                state = 0
                for w in words:
                    state = self.step[state][w]
                self.short.setdefault(state, []).append((len(words), name))
            elif words:
                for state in {self.suffix(s, window) for s, n in self.matches(words) if n >= window}:
                    self.windows.setdefault(state, []).append(name)
        self.shortest = min((n for entry in self.short.values() for n, _ in entry), default=window)

    def _extend(self, last: int, w: bytes) -> int:
        step, link, size = self.step, self.link, self.size
        if w in step[last]:
            q = step[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, q, w)
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        step, link, size = self.step, self.link, self.size
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def suffix(self, state: int, n: int) -> int:
        """The state of a match's last n words."""
        while self.size[self.link[state]] >= n:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        step, link, size = self.step, self.link, self.size
        state = n = 0
        for w in words:
            to = step[state].get(w)
            while to is None and state:
                state = link[state]
                n = size[state]
                to = step[state].get(w)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            yield state, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (first, end) of words inside a window's occurrence, and the items that occur."""
        step, link, size = self.step, self.link, self.size
        window, shortest, short = self.window, self.shortest, self.short
        state = n = 0
        spans: list[tuple[int, int]] = []
        items: set = set()
        for i, w in enumerate(words):
            to = step[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    n = size[state]
                    to = step[state].get(w)
                if to is None:
                    n = 0
                    continue
            state = to
            n += 1
            if n < shortest:
                continue
            reach = 0
            if n >= window:
                items.update(self.windows[self.suffix(state, window)])
                reach = window
            at = state
            while short and at > 0:
                for length, item in short.get(at, ()):
                    if length <= n:
                        items.add(item)
                        reach = max(reach, length)
                at = link[at]
            if reach:
                spans.append((i + 1 - reach, i + 1))
        return _merged(spans), items


def build_shards(items: DataFrame, window: int, id_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> str:
    """Write automata of the items to the shared folder, about ``shard_words`` words in each; returns the folder.

    Items go to shards by the hash of their words; the number of shards follows the
    words of all items, so the memory of a task does not grow with them. An item
    is never split.
    """
    spark = items.sparkSession
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    shards = -(-total // (4 * shard_words)) or 1
    folder = scratch_dir(spark, "automata")

    def build(key, frame):
        rows = [(i, alnum_words((t or "").encode())) for i, t in zip(frame["item"], frame["text"])]
        built = Automaton([(i, w) for i, w in sorted(rows, key=lambda r: (r[0] is None, str(r[0]))) if w], window)
        return pd.DataFrame({"shard": [key[0]], "automaton": [pickle.dumps(built)]})

    # ids travel as text, which any type has; a null id stays null
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    keyed.groupBy("shard").applyInPandas(build, "shard bigint, automaton binary").write.parquet(folder)
    return folder


def _shard(folder: str, name: str, row: int) -> Automaton:
    fs, path = open_folder(folder)
    return pickle.loads(pq.read_table(f"{path}/{name}", filesystem=fs, columns=["automaton"]).column(0)[row].as_py())


@lru_cache(maxsize=1)
def _shards(folder: str) -> list[tuple[str, int]]:
    fs, path = open_folder(folder)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet"))
    return [(n, r) for n in names for r in range(pq.ParquetFile(fs.open_input_file(f"{path}/{n}")).metadata.num_rows)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    out.append(text[end:])
    return "".join(out)


def scan(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = SHARD_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with _n_words, _spans, _items and _clean.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z
    lower-cased. A window is ``window`` consecutive words of an item, or a whole item
    of fewer words; items without words have none. _spans lists the merged (first,
    end) word positions inside occurrences of windows, _items the ids (as text,
    sorted) of items with an occurring window, _clean the text without the spans
    where there are any, else null.

    The items become suffix automata in the shared folder; every document is read
    once and its words run through each of them, holding one at a time. Null and empty
    texts have no words. Rows are handled one by one, so repeated ids and rows stay
    as they are. No items, or only empty ones, leave every document clean; items
    with a null id count as one whose id is the empty text.
    """
    folder = build_shards(items, window, item_id, item_text, shard_words)

    def compute(texts: list[bytes]) -> list[pa.Array]:
        split = [alnum_words(t) for t in texts]
        spans: list[list] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        for name, row in _shards(folder):
            automaton = keep_one(("automaton", folder, name, row), partial(_shard, folder, name, row))
            for i, words in enumerate(split):
                hit, which = automaton.hits(words)
                if hit:
                    spans[i] += hit
                    found[i] |= which
        spans = [_merged(s) for s in spans]
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return [
            pa.array([len(w) for w in split], pa.int64()),
            pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], span),
            pa.array([sorted(x or "" for x in f) for f in found], pa.list_(pa.string())),
            pa.array([_without(t.decode(), s) if s else None for t, s in zip(texts, spans)], pa.string()),
        ]

    added = "_n_words bigint, _spans array<struct<first:bigint,end:bigint>>, _items array<string>, _clean string"
    return with_text_columns(docs, text_col, compute, added, keep)


def hit_words(spans="_spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_share: float = 0.5, text_col: str = "text", length_col: str | None = None, **names: str
) -> DataFrame:
    """docs without the benchmark's passages, in the columns of docs.

    The words of every occurrence of a window go from the text; a document loses its
    row where they are more than ``max_share`` of its words. Other documents,
    null and empty texts included, stay unchanged. Words that a removal brings
    together are not searched again. ``length_col`` names a column that holds the text's
    length in characters; it follows the change.
    """
    found = scan(docs, items, window, text_col=text_col, **names)
    share = hit_words() / F.col("_n_words")
    kept = found.where((F.size("_spans") == 0) | (share <= max_share))
    if length_col is not None:
        length = F.length("_clean").cast(docs.schema[length_col].dataType)
        kept = kept.withColumn(length_col, F.coalesce(length, length_col))
    return kept.withColumn(text_col, F.coalesce("_clean", text_col)).drop("_n_words", "_spans", "_items", "_clean")
