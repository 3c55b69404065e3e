"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kerbside.llm.memory import Memo, keep_one
from kerbside.llm.store import open_folder, plain, slices
from kerbside.scratch import scratch_dir

MARK = "▁"  # stands for a space inside pieces
BUCKETS = 512
SLICE_BYTES = 16_000_000  # of text that share one list of distinct chunks
REMEMBERED = 500_000  # chunks of a bucket that a worker remembers, twice over
IDS_AT_ONCE = 1_000_000
_CHUNKS = re.compile(" +[^ ]*")


class Cutter:
    """Cuts texts into chunks that the model segments apart, and segments them.

    A model marks the text's beginning and every space. Where no piece holds a mark after another character,
    no merge joins a character to the mark behind it, so a run of marks with the word behind it
    is segmented alike wherever it stands. A chunk is kept without its first mark, which the model puts before
    every text itself. Models of other kinds (pieces across marks, normalisation, no mark at the beginning) have whole
    texts as chunks.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        probe = "a  B \tcéﬁＡ　é ​ \n "
        plain_marks = self.model.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.apart = plain_marks and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark = [self.model.piece_to_id(MARK)]
        self.forget()

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Number of chunks of each text, the distinct chunks, and the place of every chunk among them."""
        texts = texts.cast(pa.large_string())
        if not self.apart:
            coded = texts.dictionary_encode()
            return np.ones(len(texts), dtype=np.int64), coded.dictionary, coded.indices.to_numpy()
        texts = pc.replace_substring(texts, MARK, " ")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        # where no space follows another or an end, chunks are what lies between spaces
        runs = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(runs), "", texts), " ")
        lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
        flat = split.flatten()
        none = runs | empty
        if none.any():  # an empty text is one empty chunk of the split
            flat = flat.filter(pa.array(~np.repeat(none, lengths)))
            lengths[none] = 0
        if not runs.any():
            coded = flat.dictionary_encode()
            return lengths, coded.dictionary, coded.indices.to_numpy()
        at = np.flatnonzero(runs)
        odd = [[c[1:] for c in _CHUNKS.findall(" " + texts[i].as_py())] for i in at]
        odd_flat = [c for chunks in odd for c in chunks]
        coded = pa.concat_arrays([flat, pa.array(odd_flat, pa.large_string())]).dictionary_encode()
        codes, known = coded.indices.to_numpy(), len(flat)
        lengths[at] = [len(chunks) for chunks in odd]
        mixed = np.empty(len(codes), dtype=codes.dtype)
        late = np.repeat(runs, lengths)
        mixed[~late], mixed[late] = codes[:known], codes[known:]
        return lengths, coded.dictionary, mixed

    def forget(self) -> None:
        self.memo = Memo(lambda chunk: self.model.encode(chunk) if chunk or not self.apart else self.mark, REMEMBERED)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; those a worker knows are not segmented again."""
        known, before = self.memo.known, self.memo.before
        new = [c for c in dict.fromkeys(chunks) if c not in known and c not in before]
        known.update(zip(new, self.model.encode(new, num_threads=1)))
        if self.apart and "" in known:
            known[""] = self.mark
        return self.memo.of(chunks)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1)


def cutter(model: str) -> Cutter:
    """The worker's cutter for a model file."""
    return keep_one(("pieces", model), lambda: Cutter(model))


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default), ``ids`` (array of int) and ``decoded`` (the model's text of the ids).

    Ids are those the sentencepiece library gives the whole text, without begin or end ids. A null or empty text
    has no ids and decodes to an empty text. Rows are kept as they are, repeated ones and null ids too; columns of docs named
    ids or decoded are replaced, other names don't matter. An empty table gives no rows.

    Three steps. Tasks cut their texts, some megabytes at a time, list each distinct chunk once and write the texts as numbers
    into that list, a file in the shared folder. The lists are dealt by a hash of the chunk, so that all
    tasks' copies of a chunk meet and it is segmented once (a worker that has to forget chunks does so again,
    which changes nothing). The ids go back to their slice, where they take the chunks' places.
    The most frequent chunk moves once a slice, so no key is hot. Files carry the task's attempt in their names,
    and a repeated task reads the same rows and writes the same numbers, so lost executors leave unused files, never wrong ones.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    rows, inner = plain(docs)
    sent = rows.select(F.coalesce(F.col(inner[text_col]).cast("string"), F.lit("")), *[inner[c] for c in names])
    sent = sent.toDF("text", *[f"k{i}" for i in range(len(names))])
    folder = scratch_dir(docs.sparkSession, "pieces")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            key = f"{context.partitionId()}-{n}"
            return _write_slice(table, folder, key, f"{key}-{context.taskAttemptId()}", cutter(model))

        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                if held and size + part.column(0).nbytes > SLICE_BYTES:
                    yield flush()
                    held, size, n = [], 0, n + 1
                held.append(part)
                size += part.column(0).nbytes
        if held:
            yield flush()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("bucket")[i].as_py() != bucket:  # no other bucket has its chunks
                    bucket = batch.column("bucket")[i].as_py()
                    cutter(model).forget()
                ids = cutter(model).segment(_unpacked(batch.column("chunks")[i].as_py()))
                lengths = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids))
                flat = np.fromiter((x for part in ids for x in part), dtype=np.uint32, count=int(lengths.sum()))
                columns = [*[batch.column(c).slice(i, 1) for c in ("slice", "file", "bucket")], pa.array([_narrow(lengths)]), pa.array([_narrow(flat)])]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "file", "bucket", "lengths", "ids"])

    schema = StructType([*sent.schema[1:], StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", StringType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = file = None
        for batch in batches:
            for s, f, b, lengths, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if s != key and held:
                    yield from _read_slice(folder, file, held, cutter(model))
                    held = []
                key, file = s, f
                held.append((b, lengths, ids))
        if held:
            yield from _read_slice(folder, file, held, cutter(model))

    chunks = sent.mapInArrow(lists, "slice string, file string, packs array<struct<bucket:int,chunks:binary>>")
    chunks = chunks.select("slice", "file", F.explode("packs").alias("p")).select("slice", "file", "p.*")
    ids = chunks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(segment, "slice string, file string, bucket int, lengths binary, ids binary")
    placed = ids.repartition("slice").sortWithinPartitions("slice").mapInArrow(place, schema)
    return placed.toDF(*names, "ids", "decoded")


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as they all fit, with that width in front."""
    width = next(w for w in (1, 2, 4) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=f"<u{x[0]}", offset=1).astype(np.int64)


def _packed(chunks: list[bytes]) -> bytes:
    """Chunks as one compressed run of bytes; 0xFF, which no UTF-8 text holds, ends each."""
    raw = b"".join(c + b"\xff" for c in chunks)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(pack: bytes) -> list[str]:
    raw = pa.decompress(pack[8:], int.from_bytes(pack[:8], "little"), codec="zstd", asbytes=True)
    return [c.decode() for c in raw.split(b"\xff")[:-1]]


def _write_slice(table: pa.Table, folder: str, key: str, name: str, cut: Cutter) -> pa.RecordBatch:
    """Write the kept columns and each text as places in the slice's list; returns the list, dealt to buckets."""
    lengths, distinct, codes = cut.cut(table.column(0).combine_chunks() if table.num_rows else table.column(0))
    words = distinct.cast(pa.large_binary()).to_pylist()
    bucket = np.fromiter((zlib.crc32(c) % BUCKETS for c in words), dtype=np.uint16, count=len(words))
    order, ends = np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=BUCKETS))
    codes_column = _lists(lengths, pa.array(codes.astype(np.int32)))
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    kept = pa.table([*table.columns[1:], codes_column], names=[*table.column_names[1:], "codes"])
    with fs.open_output_stream(f"{base}/{name}.docs") as out, pa.ipc.new_file(out, kept.schema, options=options) as writer:
        writer.write_table(kept)
    buckets = pa.table([pa.array(bucket)], names=["bucket"])
    with fs.open_output_stream(f"{base}/{name}.buckets") as out, pa.ipc.new_file(out, buckets.schema, options=options) as writer:
        writer.write_table(buckets)
    full = np.flatnonzero(np.diff(ends, prepend=0)).tolist() or [0]  # empty texts only: an empty pack brings the slice back
    starts = [0, *ends[:-1].tolist()]
    packed = [_packed([words[i] for i in order[starts[b] : ends[b]].tolist()]) for b in full]
    packs = pa.StructArray.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "chunks"])
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([name]), _lists(np.array([len(packs)]), packs)], names=["slice", "file", "packs"])


def _read_slice(folder: str, name: str, packs: list[tuple], cut: Cutter) -> Iterator[pa.RecordBatch]:
    """The slice's documents with their ids, a bounded number of ids at a time."""
    packs.sort(key=lambda p: p[0])
    fs, base = open_folder(folder)
    with fs.open_input_file(f"{base}/{name}.buckets") as f:
        bucket = pa.ipc.open_file(f).read_all().column(0).to_numpy()
    place = np.empty(len(bucket), dtype=np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))  # the ids come bucket by bucket
    lengths = np.concatenate([_wide(p[1]) for p in packs])
    flat = np.concatenate([_wide(p[2]) for p in packs]).astype(np.int32)
    starts = (np.cumsum(lengths) - lengths)[place]
    lengths = lengths[place]
    with fs.open_input_file(f"{base}/{name}.docs") as f:
        docs = pa.ipc.open_file(f).read_all().combine_chunks()
    coded = docs.column("codes")
    sizes = pc.list_value_length(coded).to_numpy().astype(np.int64)
    codes = coded.combine_chunks().flatten().to_numpy() if docs.num_rows else np.empty(0, np.int32)
    ends = np.cumsum(sizes)
    n_ids = np.add.reduceat(np.append(lengths[codes], 0), np.minimum(ends - sizes, len(codes))) if docs.num_rows else np.empty(0, np.int64)
    n_ids[sizes == 0] = 0
    run = np.cumsum(n_ids) // IDS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), docs.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        own = codes[ends[a] - sizes[a] : ends[b - 1]]
        n = lengths[own]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(starts[own] - before, n) + np.arange(int(n.sum()))]
        at = np.concatenate([[0], np.cumsum(n_ids[a:b])])
        decoded = cut.decode([ids[i:j].tolist() for i, j in zip(at, at[1:])])
        part = docs.slice(a, b - a).drop_columns("codes").combine_chunks()
        columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in part.columns]
        columns += [_lists(n_ids[a:b], pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*part.column_names, "ids", "decoded"])
