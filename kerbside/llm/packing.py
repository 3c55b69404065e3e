"""Sequences of lexically related documents: BM25 retrieval inside content shards fills each window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kerbside.llm.memory import forget
from kerbside.llm.store import slices, stash
from kerbside.llm.tokens import buffers, cut, encoder, vocabulary_size

SHARD_DOCS = 1024  # rests that a shard is planned for
MOST_DOCS, MOST_BYTES = 16 * SHARD_DOCS, 4_000_000  # rests, and bytes of their ids, that a task indexes at once
FAN = 512  # shards whose open sequences meet in the next round
TEXT_AT_ONCE = 4_000_000  # bytes of text encoded together
AT_ONCE = 2_000_000  # bytes of ids whose terms are counted together
REMEMBERED = 600_000  # chunks
MOST_TASKS = 10_000
SHARDS_A_TASK = 4  # that a task fills one after another
K1, B = 1.2, 0.75
PIECE = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
PIECES = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


@dataclass
class Corpus:
    """What BM25 weights need of all indexed rests; the arrays are as long as the vocabulary."""

    df: np.ndarray
    docs: int
    mean: float

    @property
    def idf(self) -> np.ndarray:
        """log((docs - df + 0.5) / (df + 0.5)), at least 0: a term in half of the documents or more says nothing."""
        return np.maximum(np.log((self.docs - self.df + 0.5) / (self.df + 0.5)), 0.0)


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length of each document, and document, term and frequency of all its distinct terms in order."""
    lengths, flat = np.array([len(d) for d in docs], dtype=np.int64), np.concatenate(docs)
    # short keys sort faster
    bits, kind = (16, np.uint32) if flat.dtype.itemsize == 2 and len(docs) <= 1 << 16 else (32, np.int64)
    keys = np.repeat(np.arange(len(docs), dtype=kind) << bits, lengths)
    keys |= flat
    keys, tf = np.unique(keys, return_counts=True)
    return lengths, (keys >> bits).astype(np.int64), (keys & ((1 << bits) - 1)).astype(np.int64), tf


def weights(corpus: Corpus, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """BM25 weight of each term in its document."""
    norm = K1 * (1 - B + B * lengths / max(corpus.mean, 1))
    return corpus.idf[term] * tf * (K1 + 1) / (tf + norm[doc])


def corpus_of(rests: DataFrame, kind: str = "<u4") -> Corpus:
    """Document frequencies, number and mean length of all rests, added up in tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total, n, tokens = np.zeros(0, dtype=np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, 0, AT_ONCE) if batch.num_rows else ():
                lengths, _, term, _ = term_counts(_arrays(part.column(0), kind))
                found = np.bincount(term, minlength=len(total))
                found[: len(total)] += total
                total, n, tokens = found, n + len(lengths), tokens + int(lengths.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()]), pa.array([tokens, n, *total[at].tolist()])], names=["term", "n"])

    rows = rests.select("ids").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the vocabulary
    sums = {r.term: r.n for r in rows}
    df = np.zeros(max(sums, default=0) + 1, dtype=np.int64)
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    docs = sums.get(-1, 0)
    return Corpus(df, docs, sums.get(-2, 0) / max(docs, 1))


def leading_terms(corpus: Corpus, docs: list[np.ndarray]) -> np.ndarray:
    """The term of each document by which its neighbours are found, or -1.

    It has the largest BM25 weight times the logarithm of its document frequency, so a term that no other
    document has leads none. Of equal ones the smallest leads.
    """
    lengths, doc, term, tf = term_counts(docs)
    weight = weights(corpus, lengths, doc, term, tf) * np.log2(np.maximum(corpus.df[term], 1))
    starts = np.searchsorted(doc, np.arange(len(docs)))
    best = np.maximum.reduceat(weight, starts)
    at = np.flatnonzero(weight == best[doc])
    first = at[np.unique(doc[at], return_index=True)[1]]
    return np.where(best > 0, term[first], -1)


def shard_plan(sizes: dict[int, int], shard_docs: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first shard, number of shards) of each leading term, and the number of all shards.

    Terms that lead few documents share shards; one that leads more than a shard holds has several, to which its
    documents are dealt by a hash.
    """
    plan, shard, filled = {}, 0, 0
    for t in sorted(sizes):
        n = sizes[t]
        if filled and filled + n > shard_docs:
            shard, filled = shard + 1, 0
        several = -(-n // shard_docs)
        plan[t] = (shard, several)
        shard, filled = (shard + several, 0) if several > 1 else (shard, filled + n)
    return plan, shard + (filled > 0)


class Index:
    """An inverted index of a shard's documents with the BM25 weights of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = self.n = len(docs)
        lengths, doc, term, tf = term_counts(docs)
        weight = weights(corpus, lengths, doc, term, tf)
        told = weight > 0
        doc, weight = doc[told].astype(np.int32), weight[told]
        held = np.bincount(term[told]) > 0
        term, names = (np.cumsum(held) - 1)[term[told]], np.count_nonzero(held)
        # rows of a document are in order; postings need the order of terms
        self.doc_at, self.doc_terms = np.searchsorted(doc, np.arange(n + 1)), term.astype(np.int32)
        order = np.argsort(term.astype(np.uint16) if names <= 1 << 16 else term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.term_at = np.searchsorted(term[order], np.arange(names + 1))

    def keep(self, alive: np.ndarray) -> None:
        """Drop the postings of other documents, which score nothing from then on."""
        told = alive[self.post_doc]
        self.term_at = np.concatenate([[0], np.cumsum(told)])[self.term_at]
        self.post_doc, self.post_weight = self.post_doc[told], self.post_weight[told]

    def scores(self, query: int) -> np.ndarray:
        """BM25 score of every document for the distinct terms of document ``query``."""
        terms = self.doc_terms[self.doc_at[query] : self.doc_at[query + 1]]
        first, many = self.term_at[terms], self.term_at[terms + 1] - self.term_at[terms]
        total = int(many.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(self.post_doc[at], weights=self.post_weight[at], minlength=self.n)


def fill(docs: list[np.ndarray], window: int, corpus: Corpus) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that use every token of a shard's rests once.

    The longest rest seeds a sequence; its unused BM25 neighbours join it whole, best first,
    where they fit, and the best one that does not is cut to fill the gap. Only the last sequence may be shorter
    than the window, as nothing is left to fill it. Rests are shorter than the window.
    """
    start = np.zeros(len(docs), dtype=np.int64)
    left = np.array([len(d) for d in docs], dtype=np.int64)
    index, held = Index(docs, corpus), len(docs)

    def take(sequence: list, d: int, n: int) -> None:
        sequence.append((d, int(start[d]), int(n)))
        start[d] += n
        left[d] -= n

    for seed in np.argsort(-left, kind="stable"):
        if not left[seed]:
            continue
        if 2 * np.count_nonzero(left) < held:
            index.keep(left > 0)
            held = np.count_nonzero(left)
        sequence: list[tuple[int, int, int]] = []
        take(sequence, seed, left[seed])
        space = window - sequence[0][2]
        others = np.flatnonzero(left)
        ranked = others[np.argsort(-index.scores(seed)[others], kind="stable")]
        for d, n in zip(ranked.tolist(), left[ranked].tolist()):
            if n <= space:
                take(sequence, d, n)
                space -= n
                if not space:
                    break
        if space:
            rest = ranked[left[ranked] > 0]
            if len(rest):
                take(sequence, int(rest[0]), space)
        yield sequence


def _powers(sequence: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A short sequence as sequences whose lengths are powers of two."""
    pending = sequence[::-1]
    total = sum(n for _, _, n in sequence)
    while total:
        space, part = 1 << total.bit_length() - 1, []
        total -= space
        while space:
            d, at, n = pending.pop()
            used = min(n, space)
            part.append((d, at, used))
            space -= used
            if used < n:
                pending.append((d, at + used, n - used))
        yield part


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` tokens; one row per piece.

    Columns: the id, start (the document's tokens before the piece), length,
    doc_tokens (with the end id), sequence_id, offset (in the sequence), ids (the
    piece, little-endian unsigned 32-bit).

    Whole windows are cut from the front of long documents. The rests are sharded by content: each goes to the
    shard of its leading term, of those that other rests hold as well, so related rests meet wherever they
    were stored, and a term that leads many has many shards. Document frequencies and lengths
    are those of all rests. A task indexes a shard (at most MOST_DOCS rests or MOST_BYTES of ids at once) and fills windows
    with the neighbours of each seed. The one sequence that a shard can't fill goes on to the next round,
    where FAN shards meet, until one shard is left; its last tokens form sequences of power-of-two lengths. Which
    pieces meet doesn't depend on how the rows were stored. Sequence ids are unique; they are not consecutive.

    Null texts are empty; an empty document is its end id alone. Repeated rows are
    packed each. Null ids stay null. An empty table gives no rows. Other columns
    are ignored.
    """
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4  # bytes of an id until the result
    kind = f"<u{width}"
    encoded = stash(_encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer, end_id, window, width), "encoded")
    rests = encoded.where("sequence_id is null").select("id", "start", "doc_tokens", "ids")
    corpus = corpus_of(rests, kind)
    items, shards = _sharded(rests, corpus, shard_docs, kind)
    out, turn = encoded.where("sequence_id is not null"), 1
    while shards:
        packed = stash(_filled(items, shards, corpus, window, turn, kind), "packed")
        out = out.union(packed.where("sequence_id is not null").drop("shard"))
        items = packed.where("sequence_id is null").select("id", "start", "doc_tokens", "ids", F.floor(F.col("shard") / FAN).alias("shard"))
        shards, turn = 0 if shards == 1 else -(-shards // FAN), turn + 1

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column(6).cast(pa.large_binary()))
            ids = cut(2 * (at - at[0]), data[at[0] : at[-1]].view("<u2").astype("<u4")).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], ids], names=batch.schema.names)

    whole = out if width == 4 else out.mapInArrow(widen, out.schema)
    return whole.toDF(id_col, *out.columns[1:])


def _arrays(ids: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in ids.to_pylist()]


def _batch(rows: list[tuple], id_type: pa.DataType, shard: bool = False) -> pa.RecordBatch:
    names = [*PIECES, "shard"][: 7 + shard]
    kinds = [id_type, *[pa.int64()] * 5, pa.binary(), pa.int64()][: 7 + shard]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _encoded(rows: DataFrame, tokenizer: str, end_id: int, window: int, width: int) -> DataFrame:
    """The whole windows of every document as sequences, and its rest without a sequence."""
    end = int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, TEXT_AT_ONCE) if batch.num_rows else ():
                at, tokens = buffers(encoder(tokenizer, width, REMEMBERED).column(part.column(1), end))
                n = np.diff(at) // width
                many = -(-n // window)
                doc = np.repeat(np.arange(len(n)), many)
                start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
                length = np.minimum(window, n[doc] - start)
                rest = length < window
                places = sequence + np.cumsum(~rest) - 1
                sequence += int((~rest).sum())
                columns = [pa.array(x) for x in (start, length, n[doc])] + [pa.array(x, mask=rest) for x in (places, np.zeros_like(start))]
                ids = cut(np.append(at[doc] + width * start, at[-1:]), tokens).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *columns, ids], names=PIECES)

    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, {PIECE}")


def _sharded(rests: DataFrame, corpus: Corpus, shard_docs: int, kind: str) -> tuple[DataFrame, int]:
    """The rests with their shard, and the number of shards."""

    def led(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for part in slices(batch, at, AT_ONCE) if batch.num_rows else ():
            yield part, leading_terms(corpus, _arrays(part.column(at), kind))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(corpus.df) + 1, dtype=np.int64)
        for batch in batches:
            for _, terms in led(batch, 0):
                total += np.bincount(terms + 1, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(total[at])], names=["term", "n"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, terms in led(batch, 3):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(terms)], names=[*part.schema.names, "term"])

    sizes = rests.select("ids").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    plan, shards = shard_plan({r.term: r.n for r in sizes}, shard_docs)
    rows = [(t, first, several) for t, (first, several) in plan.items()]
    places = F.broadcast(rests.sparkSession.createDataFrame(rows, "term bigint, first bigint, several bigint"))
    dealt = F.col("first") + F.pmod(F.xxhash64("ids", "id"), F.col("several"))
    schema = f"id {rests.schema['id'].dataType.simpleString()}, start bigint, doc_tokens bigint, ids binary, term bigint"
    return rests.mapInArrow(lead, schema).join(places, "term").select("id", "start", "doc_tokens", "ids", dealt.alias("shard")), shards


def _filled(items: DataFrame, shards: int, corpus: Corpus, window: int, turn: int, kind: str) -> DataFrame:
    """Pieces of all items with their shard; those of a short sequence have none unless only one shard is left."""

    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple] = []
        size = number = 0
        id_type = pa.null()

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows, shard = [], held[0][4]
            for sequence in fill([np.frombuffer(h[3], dtype=kind) for h in held], window, corpus):
                short = sum(n for _, _, n in sequence) < window
                for part in _powers(sequence) if short and shards == 1 else [sequence]:
                    at, open_ = 0, short and shards > 1
                    for d, start, n in part:
                        i, before, total, ids, _ = held[d]
                        place = (None, None) if open_ else (turn << 58 | shard << 24 | number, at)
                        rows.append((i, before + start, n, total, *place, ids[width * start : width * (start + n)], shard))
                        at += n
                    number += 1
            return _batch(rows, id_type, shard=True)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (row[4] != held[0][4] or len(held) >= MOST_DOCS or size + len(row[3]) > MOST_BYTES):
                    yield packed()
                    if row[4] != held[0][4]:
                        number = 0
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield packed()

    dealt = items.repartition(min(-(-shards // SHARDS_A_TASK), MOST_TASKS), "shard").sortWithinPartitions("shard", F.xxhash64("ids"), "ids", "id", "start")
    schema = f"id {items.schema['id'].dataType.simpleString()}, {PIECE}, shard bigint"
    return dealt.mapInArrow(run, schema)
