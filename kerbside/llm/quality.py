"""Quality by importance resampling: hashed n-gram models of good and of raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.llm.memory import Memo, keep_one
from kerbside.llm.store import plain, ranked, slices, stash, with_text_columns
from kerbside.llm.words import ASCII_LOWER, raw_texts

WORD_BITS, SHAPE_BITS = 16, 14
WORDS, SHAPES = 1 << WORD_BITS, 1 << SHAPE_BITS  # buckets of either kind
MAX_LABELLED = 20_000  # ids of each label that the models and the cut are fitted on, about
HELD_OUT = 3  # one of so many labelled ids is kept from the models, for the cut
PRIOR = 10.0  # n-grams of the raw model that each bucket of the target model starts with
WORD_MEMORY = 300_000
AT_ONCE = 2_000_000  # bytes of text whose n-grams are held together
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """Case and punctuation of a word: runs of letters as a, A, Aa or aA, of digits as 0, the rest as it is."""
    letters = _RUNS[0].sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a" if m[0].islower() else "aA", word)
    return _RUNS[1].sub("0", letters)[:16]


class Grams:
    """Hashed 1- and 2-grams of a text's words, and of their shapes in buckets of their own.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Shapes keep the case and punctuation
    that this and rare words lose; a word equal to the one before it has a shape of its own kind.
    """

    def __init__(self):
        def code(w: bytes) -> int:
            return zlib.crc32(w.translate(ASCII_LOWER)) << 16 | zlib.crc32(shape(w.decode()).encode()) & 0xFFFF

        self.memo = Memo(code, WORD_MEMORY)

    def of(self, text: bytes) -> np.ndarray:
        """Buckets of all n-grams, repeats included: those of words, and beyond WORDS those of shapes."""
        words = text.split()
        if not words:
            return np.array([], dtype=np.int64)
        codes = np.array(self.memo.of(words), dtype=np.int64)
        names, shapes = (codes >> 16).astype(np.uint64), codes & 0xFFFF
        follow = (names[:-1] * _MIX ^ names[1:]) + np.uint64(1 << 40)
        shapes[1:][codes[1:] == codes[:-1]] += 1 << 16
        pairs = shapes[:-1] << 17 | shapes[1:]
        of_words = np.concatenate([names, follow]) * _MIX >> np.uint64(64 - WORD_BITS)
        of_shapes = np.concatenate([shapes, pairs + (1 << 34)]).astype(np.uint64) * _MIX >> np.uint64(64 - SHAPE_BITS)
        return np.concatenate([of_words, of_shapes + np.uint64(WORDS)]).astype(np.int32)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the target model over the raw model for each bucket, from their counts.

    The raw model is add-one smoothed. The target model is the raw one times the ratio of counted to expected
    n-grams, both with PRIOR added, so a bucket the target had no chance to show is not held against a text.
    """
    base = (raw + 1) / (raw + 1).sum()
    model = base * (target + PRIOR) / (target.sum() * base + PRIOR)
    return np.log(model / model.sum()) - np.log(base)


@dataclass
class Model:
    """Log ratio of each bucket, and the log ratio from which a document is good."""

    ratio: np.ndarray
    cut: float


def _sample(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _good): about MAX_LABELLED ids of each label at most, by a hash of the id.

    An id with both labels counts as good. The result is bounded, so it can be broadcast.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        (F.max(label_col) == 1).alias("_good")
    )
    sizes = {r._good: r["count"] for r in marks.groupBy("_good").count().collect()}
    share = F.when(F.col("_good"), min(1.0, MAX_LABELLED / max(sizes.get(True, 0), 1))).otherwise(min(1.0, MAX_LABELLED / max(sizes.get(False, 0), 1)))
    return F.broadcast(marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Models from the documents labelled 1 (target) and from all documents (raw), and the cut.

    The raw model counts every document, the target a bounded sample of labelled ids, without one of HELD_OUT.
    The cut separates the log ratios of these held-out documents with the fewest errors. Where too few labels leave either part without one it needs, both use
    all labelled documents; without documents of both labels nothing is rejected.
    """
    marks = _sample(labels, id_col, label_col).withColumn("_held", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(HELD_OUT)) == 0)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(marks, "_id", "left")
    side = F.when(F.col("_good"), F.when(F.col("_held"), 2).otherwise(1)).otherwise(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = keep_one("grams", Grams)
        total = np.zeros((3, WORDS + SHAPES), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, AT_ONCE):
                sides = part.column(1).to_numpy()
                found = [grams.of(text) for text in raw_texts(part.column(0))]
                for s in np.unique(sides):
                    total[s] += np.bincount(np.concatenate([f for f, of in zip(found, sides) if of == s]), minlength=WORDS + SHAPES)
        s, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(bucket), pa.array(total[s, bucket])], names=["side", "bucket", "n"])

    counts = np.zeros((3, WORDS + SHAPES))
    sent = rows.select("text", side.cast("int").alias("side")).mapInArrow(count, "side bigint, bucket bigint, n bigint")
    for r in sent.groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():  # at most a row for each bucket and side
        counts[r.side, r.bucket] += r.n
    judged = docs.join(marks, F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "_good", "_held")
    parts = {(r._good, r._held) for r in judged.select("_good", "_held").distinct().collect()}
    apart = {(True, False), (True, True), (False, True)} <= parts
    raw, target = counts.sum(axis=0), counts[1] if apart else counts[1] + counts[2]
    ratio = np.zeros(WORDS + SHAPES)
    if target.any():
        ratio = np.concatenate([log_ratios(raw[at], target[at]) for at in (slice(WORDS), slice(WORDS, None))])
    scored = weigh(judged.where("_held") if apart else judged, Model(ratio, -np.inf), "text", ["_good"])
    bins = scored.groupBy("_good", F.round("log_ratio", 2).alias("at")).count().collect()  # bounded by the sample
    return Model(ratio, _cut([(r["at"], r["count"]) for r in bins if r._good], [(r["at"], r["count"]) for r in bins if not r._good]))


def _cut(good: list[tuple[float, int]], bad: list[tuple[float, int]]) -> float:
    """The cut with the fewest errors in the middle of the widest gap, on a scale that is logarithmic far from 0.

    Log ratios grow with the length of a text, so long bad texts would otherwise draw the middle away from short ones.
    """
    if not good or not bad:
        return -np.inf
    values, at = np.unique([v for v, _ in good + bad], return_inverse=True)
    counts = np.zeros((2, len(values)), dtype=np.int64)
    np.add.at(counts, (np.repeat([1, 0], [len(good), len(bad)]), at), [n for _, n in good + bad])
    if len(values) < 2:
        return -np.inf
    below = counts.cumsum(axis=1)[:, :-1]  # a cut behind each value but the last
    errors = below[1] + counts[0].sum() - below[0]
    bent = np.arcsinh(values)
    best = np.lexsort((-np.diff(bent), errors))[0]
    return float(np.sinh((bent[best] + bent[best + 1]) / 2))


def weigh(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with n_grams, log_ratio and mean_log_ratio.

    log_ratio is the log of the document's target probability over its raw
    probability: the sum over its n-grams. A text without words has 0 in all three.
    """

    def compute(texts: list[bytes]) -> list[pa.Array]:
        grams = keep_one("grams", Grams)
        found = [grams.of(t) for t in texts]
        n = np.array([len(f) for f in found], dtype=np.int64)
        total = np.array([model.ratio[f].sum() for f in found], dtype=np.float64)
        return [pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))]

    return with_text_columns(docs, text_col, compute, "n_grams bigint, log_ratio double, mean_log_ratio double", keep, AT_ONCE)


def gumbel(*columns: str | Column, seed: int = 42) -> Column:
    """Standard Gumbel noise that follows from the row's values."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def resample(
    docs: DataFrame, model: Model, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with the weights, sample_key and selected.

    A document's weight is the ratio of its probabilities under the two models. Gumbel noise makes
    the k largest keys a draw without replacement in proportion to the weights; k is by default the number of
    documents at the model's cut or above. All rows whose key equals the k-th are
    selected, so repeated rows share their fate. The noise is a function of id and
    text. Columns of docs with the names of new ones are replaced. Texts without words have the log weight 0.
    """
    added = {"_key", "sample_key", "selected", "n_grams", "log_ratio", "mean_log_ratio"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows, inner = plain(docs)
    weighed = weigh(rows.withColumn("_key", F.xxhash64(inner[id_col], inner[text_col])), model, inner[text_col], [*[inner[c] for c in names], "_key"])
    keyed = stash(weighed.withColumn("sample_key", F.col("log_ratio") + gumbel("_key")).drop("_key"), "weighed")
    if k is None:
        k = keyed.where(F.col("log_ratio") >= F.lit(float(model.cut))).count()
    least = ranked(keyed.select("sample_key"), F.desc("sample_key")).where(F.col("rank") == k - 1).first()
    selected = F.lit(k > 0) if least is None else F.col("sample_key") >= F.lit(least.sample_key)
    return keyed.withColumn("selected", selected).toDF(*names, "n_grams", "log_ratio", "mean_log_ratio", "sample_key", "selected")
