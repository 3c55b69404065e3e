"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.llm.memory import Memo, keep_one
from kerbside.llm.store import slices, stash, with_text_columns
from kerbside.llm.words import alnum_words, raw_texts

# Bounds of the training sample, in documents.
MAX_CONFIRMED = 3_000
MAX_UNLABELLED = 9_000
MIN_Z = 6.0  # standard errors by which a feature must be more frequent in confirmed documents
MIN_SHARE = 0.4  # estimated share of positive documents among those with the feature
DEFAULT_PRIOR = 0.1
WORD_MEMORY = 250_000


class Features:
    """64-bit names of a text's distinct words and of their first four characters."""

    def __init__(self):
        self.memo = Memo(lambda w: (xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(w.decode()[:4].encode(), 1)), WORD_MEMORY)

    def of(self, text: bytes) -> set[int]:
        return set(chain.from_iterable(self.memo.of(list(set(alnum_words(text))))))


def fit(rows: list[np.ndarray], confirmed: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Names, weights and bias of a logistic classifier under the non-negative PU risk.

    rows are the feature names of each document; confirmed marks the positive ones,
    all others are draws from the whole population, of which a share ``prior`` is
    positive. The risk is prior * E_pos[loss(+)] + max(0, E_all[loss(-)] -
    prior * E_pos[loss(-)]), descended by Adam; where the second part falls below 0,
    only the first one counts.

    Only features that are significantly more frequent in confirmed documents than
    in the population (MIN_Z standard errors), and mostly in positive documents
    (MIN_SHARE), take part, so words that a few
    documents share by chance carry no weight.
    """
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if len(rows) else np.array([], dtype=np.uint64)
    names, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    n_pos, n_all = max(confirmed.sum(), 1), max((~confirmed).sum(), 1)
    in_pos = np.bincount(at[confirmed[owner]], minlength=len(names)) / n_pos
    in_all = np.bincount(at[~confirmed[owner]], minlength=len(names)) / n_all
    mean = (in_pos * n_pos + in_all * n_all) / (n_pos + n_all)
    keep = in_pos - in_all >= MIN_Z * np.sqrt(mean * (1 - mean) * (1 / n_pos + 1 / n_all))
    keep &= prior * in_pos >= MIN_SHARE * in_all
    owner, column = owner[keep[at]], (np.cumsum(keep) - 1)[at[keep[at]]]
    names = names[keep]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    w = np.zeros(len(names) + 1)
    if not confirmed.any() or confirmed.all():
        # nothing to learn from: every document is as likely as the prior
        return names[:0], w[:0], float(np.log(prior / (1 - prior)) if confirmed.any() else -50.0)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    random = np.random.default_rng(seed)
    sides = [np.flatnonzero(confirmed), np.flatnonzero(~confirmed)]
    batches = 1
    step = 0
    for _ in range(epochs):
        parts = [np.array_split(random.permutation(s), batches) for s in sides]
        for pos, unl in zip(*parts):
            if not len(pos) or not len(unl):
                continue
            docs = np.concatenate([pos, unl])
            many = starts[docs + 1] - starts[docs]
            index = np.arange(many.sum()) + np.repeat(starts[docs] - np.cumsum(many) + many, many)
            cols, local = column[index], np.repeat(np.arange(len(docs)), many)
            z = w[-1] + np.bincount(local, weights=w[cols], minlength=len(docs))
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            is_pos = np.arange(len(docs)) < len(pos)
            loss_neg = np.logaddexp(0, z)
            negative = loss_neg[~is_pos].mean() - prior * loss_neg[is_pos].mean()
            slope = np.where(is_pos, -prior * (1 - p) / len(pos), 0.0)
            if negative > 0:
                slope += np.where(is_pos, -prior * p / len(pos), p / len(unl))
            g = np.append(np.bincount(cols, weights=slope[local], minlength=len(names)), slope.sum())
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[:-1] *= 1 - rate * decay * 100
    told = np.abs(w[:-1]) > 1e-6
    return names[told], w[:-1][told], float(w[-1])


def _bucket(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_000))


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
) -> tuple[np.ndarray, np.ndarray, float]:
    """A classifier from the documents that ``held_out`` leaves for training.

    Documents with a label of 1 are confirmed; every document, whatever its label,
    may stand for the unlabelled population. ``prior`` is the share of positive
    documents; by default it is counted from the training labels. The classifier is
    fitted on a bounded sample, about MAX_CONFIRMED and MAX_UNLABELLED documents
    drawn by hashes of id and text; repeated rows count once in it. Null ids are held out.
    Without a confirmed document every score is 0.
    """
    marks = (
        labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_mark"))
    )
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    known = marks.agg(F.count("*").alias("n"), F.sum(F.when(F.col("_mark") == 1, 1).otherwise(0)).alias("pos")).first()
    total = rows.count()
    share = (known.pos or 0) / known.n if known.n else 0.0
    prior = min(max(share if prior is None else prior, 1e-4), 0.9) if known.n or prior else DEFAULT_PRIOR
    # at most about MAX_CONFIRMED ids, whatever the size of the labels
    confirmed = marks.where((F.col("_mark") == 1) & (_bucket("_id") < int(1e6 * min(1.0, MAX_CONFIRMED / max(known.pos or 0, 1)))))
    picked = rows.join(F.broadcast(confirmed), "_id", "left")
    drawn = _bucket("_id", "text") < int(1e6 * min(1.0, MAX_UNLABELLED / max(total, 1)))
    kinds = F.filter(F.array(F.when(F.col("_mark").isNotNull(), True), F.when(drawn, False)), lambda k: k.isNotNull())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = keep_one("features", Features)
        for batch in batches:
            for part in slices(batch, 0):
                found = [np.sort(np.fromiter(f.of(t), dtype=np.uint64)).tobytes() for t in raw_texts(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.binary()), part.column(2)], names=["id", "features", "kinds"])

    sample = picked.select("text", F.col("_id").cast("string").alias("id"), kinds.alias("kinds")).where("size(kinds) > 0")
    sample = sample.mapInArrow(features, "id string, features binary, kinds array<boolean>").select("id", "features", F.explode("kinds").alias("kind"))
    sample = stash(sample.distinct(), "sample")  # repeated rows count once

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["kind", "features"])
        rows = [np.frombuffer(x, dtype=np.uint64) for x in frame["features"]]
        names, weights, bias = fit(rows, frame["kind"].to_numpy(dtype=bool), prior)
        return pd.DataFrame({"names": [names.tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    fitted = sample.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(learn, "names binary, weights binary, bias double").collect()
    if not fitted:
        return np.array([], dtype=np.uint64), np.array([]), -50.0
    found = fitted[0]
    return np.frombuffer(found.names, dtype=np.uint64), np.frombuffer(found.weights), found.bias


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", name: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with the probability that a text is toxic.

    Whole texts count; null and empty ones get the classifier's bias.
    """
    names, weights, bias = model
    weight = dict(zip(names.tolist(), weights.tolist()))

    def compute(texts: list[bytes]) -> list[pa.Array]:
        f = keep_one("features", Features)
        told = weight.keys()
        z = np.array([bias + sum(map(weight.__getitem__, f.of(t) & told)) for t in texts])
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))]

    return with_text_columns(docs, text_col, compute, f"`{name}` double", keep)


def third(id_col: Column) -> Column:
    """True for the held-out third of ids; null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(True))
