"""Licences of files: TF-IDF similarity of headers and licence files to templates, inherited by directory."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kerbside.llm.license_texts import HEADERS, TEXTS
from kerbside.llm.store import plain, slices, stash, with_text_columns
from kerbside.llm.words import alnum_words, raw_texts

THRESHOLD = 0.8
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*$"

# --- fixed values: public licence notices by SPDX identifier ---
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-only": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-only": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "proprietary": "All rights reserved.",
}


class Matcher:
    """Cosine of word sequences to templates, in TF-IDF vectors.

    A word's weight is its count times log((passages + 1) / (passages with it + 1)) + 1.
    Words that no template has take the weight of a word in no passage.
    """

    def __init__(self, templates: Mapping[str, str], df: Mapping[bytes, int], passages: int):
        self.names = sorted(templates)
        split = [alnum_words(templates[n].encode()) for n in self.names]
        self.place = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
        self.weight = np.array([math.log((passages + 1) / (df.get(w, 0) + 1)) + 1 for w in self.place])
        self.other = (math.log(passages + 1) + 1) ** 2
        rows = np.zeros((len(split), len(self.place)))
        for row, words in zip(rows, split):
            for w in words:
                row[self.place[w]] += 1
        rows *= self.weight
        self.rows = rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)

    def best(self, words: list[bytes], least: float) -> tuple[float, str | None]:
        """The most similar template (the first by name of equal ones) and its cosine, if at least ``least``."""
        place = self.place
        known = [i for w in words if (i := place.get(w)) is not None]
        if not known:
            return 0.0, None
        index, tf = np.unique(known, return_counts=True)
        x = tf * self.weight[index]
        inside = float(x @ x)
        # words that occur once each add least to the norm: a bound that needs no counting
        bound = inside + (len(words) - len(known)) * self.other
        if inside < least * least * bound:
            return 0.0, None
        others = Counter(w for w in words if w not in place)
        norm = math.sqrt(inside + self.other * sum(n * n for n in others.values()))
        cosine = self.rows[:, index] @ x / norm
        at = int(np.argmax(cosine))
        score = float(min(cosine[at], 1.0))
        return (score, self.names[at]) if score >= least else (0.0, None)


class LongMatcher:
    """Cosine of whole texts and of runs of their lines to headers and licence texts, in the vectors of Matcher."""

    def __init__(self, headers: Sequence[tuple[str, str]], texts: Sequence[tuple[str, str]], df: Mapping[bytes, int], passages: int):
        self.names = [n for n, _ in [*headers, *texts]]
        self.kind = [1] * len(headers) + [2] * len(texts)
        split = [alnum_words(t.encode()) for _, t in [*headers, *texts]]
        self.sizes = [len(w) for w in split]
        self.place = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
        self.weight = np.array([math.log((passages + 1) / (df.get(w, 0) + 1)) + 1 for w in self.place])
        self.other = math.log(passages + 1) + 1
        rows = np.zeros((len(split), len(self.place)))
        for row, words in zip(rows, split):
            for w in words:
                row[self.place[w]] += 1
        rows *= self.weight
        self.rows = rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)

    def best(self, lines: list[list[bytes]], least: float) -> tuple[float, str | None]:
        """Cosine and name of the best of all, if at least ``least``: licence texts come before headers,
        the whole text before a run of lines, then the higher cosine and the first name."""
        seen = {i for line in lines for w in line if (i := self.place.get(w)) is not None}
        # a cosine is at most the norm of the template's words that occur
        shared = (self.rows[:, sorted(seen)] ** 2).sum(axis=1)
        possible = np.flatnonzero(shared >= least * least - 1e-9)
        if not seen or not len(possible):
            return 0.0, None
        extra: dict[bytes, int] = {}
        known = len(self.place)
        ids = np.array([i if (i := self.place.get(w)) is not None else known + extra.setdefault(w, len(extra)) for line in lines for w in line])
        weight = np.concatenate([self.weight, np.full(len(extra), self.other)])
        ends = np.cumsum([len(line) for line in lines])
        starts = np.concatenate([[0], ends[:-1]])
        mass = np.concatenate([[0], np.cumsum(weight[ids] ** 2)])
        found: list[tuple[int, bool, float, str]] = []
        for t in possible:
            row = np.concatenate([self.rows[t], np.zeros(len(extra))]) * weight
            dot = np.concatenate([[0], np.cumsum(row[ids])])

            def cosine(a: int, b: int) -> float:
                code, n = np.unique(ids[a:b], return_counts=True)
                return float(min((dot[b] - dot[a]) / math.sqrt(((n * weight[code]) ** 2).sum()), 1.0))

            if (score := cosine(0, len(ids))) >= least:
                found.append((self.kind[t], True, score, self.names[t]))
                continue
            # runs of about as many words as the template: the lines that reach its length, and one line less
            last = np.minimum(np.searchsorted(ends, starts + self.sizes[t]), len(ends) - 1)
            first, last = np.tile(np.arange(len(ends)), 2), np.concatenate([last, last - 1])
            a, b = starts[first[first <= last]], ends[last[first <= last]]
            # counts of words are whole: the norm is at least the root of the mass
            bound = (dot[b] - dot[a]) / np.sqrt(mass[b] - mass[a])
            top = 0.0
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < max(least, top) or top == 1.0:
                    break
                top = max(top, cosine(a[i], b[i]))
            if top >= least:
                found.append((self.kind[t], False, top, self.names[t]))
        if not found:
            return 0.0, None
        kind, whole, score, name = min(found, key=lambda f: (-f[0], -f[1], -f[2], f[3]))
        return score, name


def passages(text: bytes) -> list[list[bytes]]:
    """The words of each line that has any, and of the whole text where it has several such lines."""
    lines = [w for line in text.split(b"\n") if (w := alnum_words(line))]
    return lines if len(lines) < 2 else [*lines, [w for line in lines for w in line]]


def matchers(
    files: DataFrame, templates: Mapping[str, str], headers: Sequence[tuple[str, str]], texts: Sequence[tuple[str, str]], text_col: str = "text"
) -> tuple[Matcher, LongMatcher]:
    """Matchers whose document frequencies come from every passage of all files."""
    words = {w for t in [*templates.values(), *(t for _, t in [*headers, *texts])] for w in alnum_words(t.encode())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in raw_texts(part.column(0)):
                    for p in passages(text):
                        total += 1
                        seen.update(words.intersection(p))
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], names=["word", "n"])

    found = files.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {None if r.word is None else bytes(r.word): r.n for r in found}  # a row for each template word
    total = df.pop(None, 0)
    return Matcher(templates, df, total), LongMatcher(headers, texts, df, total)


def scan(
    files: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    path_col: str = "path",
    text_col: str = "text",
    keep: list[str] | None = None,
    headers: Sequence[tuple[str, str]] = HEADERS,
    texts: Sequence[tuple[str, str]] = TEXTS,
) -> DataFrame:
    """The columns ``keep`` of files (all by default) with own_license, score, inherited_license, license_dir, license.

    own_license is the template most similar to a passage, if its cosine is at least
    ``threshold``. The licence texts and the headers of several lines are compared with the whole text and
    with every run of lines about as long as they are, wherever the lines break; where
    none is found, the one-sentence templates are compared with each line and the whole text. A file whose name says licence lends its
    own licence to its directory, the one with the highest score (then the first by name) if there
    are several; a file inherits from the nearest directory above it that has one, its own included.
    license is the own one, else the inherited one.

    Null and empty texts have no licence of their own, null paths nothing to inherit. Repeated
    rows stay. Columns of files with the new names are replaced.
    """
    added = ["own_license", "score", "inherited_license", "license_dir", "license"]
    names = [c for c in (files.columns if keep is None else keep) if c not in added]
    short, long = matchers(files, templates, headers, texts, text_col)

    def compute(texts: list[bytes]) -> list[pa.Array]:
        scores, found = [], []
        for text in texts:
            parts = passages(text)
            best = long.best(parts[:-1] or parts, threshold)
            if best[1] is None:
                best = max((short.best(p, threshold) for p in parts), key=lambda b: (b[0], [-x for x in (b[1] or "").encode()]), default=(0.0, None))
            scores.append(best[0])
            found.append(best[1])
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

    rows, at = plain(files)
    inner = [at[c] for c in names]
    rows = rows.select(*inner, F.col(at[path_col]).alias("_path"), F.col(at[text_col]).alias("_text"))
    own = stash(with_text_columns(rows, "_text", compute, "_own string, _score double", [*inner, "_path"]), "own")
    folder = F.regexp_extract("_path", r"^(.*?)/+[^/]*$", 1)
    own = own.withColumn("_dir", F.when(F.col("_path").isNotNull(), folder))
    lending = own.where(F.col("_path").rlike(LICENSE_FILE) & F.col("_own").isNotNull())
    best = lending.groupBy(F.col("_dir").alias("_from")).agg(F.min(F.struct(-F.col("_score"), "_own")).alias("_b")).select("_from", F.col("_b._own").alias("_lent"))
    # each directory once, with all above it
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = own.where("_dir is not null").select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("_from"))
    nearest = dirs.join(best, "_from").groupBy("_dir").agg(F.max_by(F.struct("_from", "_lent"), F.length("_from")).alias("_n"))
    joined = own.join(nearest.withColumnRenamed("_dir", "_d"), F.col("_dir") == F.col("_d"), "left")
    lent, where = F.col("_n._lent"), F.col("_n._from")
    found = joined.select(*inner, "_own", "_score", lent, where, F.coalesce("_own", lent))
    return found.toDF(*names, *added)
