"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kerbside.llm.memory import forget
from kerbside.llm.store import open_folder, slices, view
from kerbside.llm.tokens import buffers, encoder, vocabulary_size

AT_ONCE = 4_000_000  # bytes of text encoded before their ids are written
SLICE = 256  # documents read back together
SHARD = "shard int, name string, width int, n_docs bigint, n_tokens bigint"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and write them to ``folder`` in ascending id order; returns the shards.

    A shard is a range of ids written by one task: ``<name>.bin`` (ids, unsigned
    16-bit where the vocabulary and ``end_id`` fit, else 32-bit, little-endian),
    ``<name>.idx`` (n + 1 unsigned 64-bit token offsets within the shard) and
    ``<name>.ids`` (the ids column, Arrow). Names carry the attempt, and the
    ``shards`` table lists only files of tasks that succeeded, so a lost or
    repeated task leaves unused files, never wrong ones.

    Null texts are empty documents (the end id alone). Rows with a null id come
    first; rows with equal ids are ordered by their text. Every row is written,
    repeated ones too. An empty table gives no shards. Other columns are ignored.
    """
    width = 2 if max(vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4
    end = int(end_id).to_bytes(width, "little")
    id_type = docs.select(id_col).schema[0].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, fs_path = context.partitionId(), None
        lengths: list[np.ndarray] = []
        ids: list[pa.Array] = []
        fs, base = open_folder(folder)
        name = f"shard-{shard:06d}-{context.taskAttemptId()}"
        out = None
        for batch in batches:
            if out is None:
                fs_path = f"{base}/{name}"
                out = fs.open_output_stream(f"{fs_path}.bin")
            ids.append(batch.column(0))
            for part in slices(batch, 1, AT_ONCE):
                at, tokens = buffers(encoder(tokenizer, width).column(part.column(1), end))
                out.write(tokens[at[0] : at[-1]])
                lengths.append(np.diff(at) // width)
        if out is None:
            return
        out.close()
        n_tokens = np.concatenate(lengths)
        offsets = np.zeros(len(n_tokens) + 1, dtype="<u8")
        np.cumsum(n_tokens, out=offsets[1:], dtype="<u8")
        with fs.open_output_stream(f"{fs_path}.idx") as f:
            f.write(offsets.tobytes())
        table = pa.Table.from_arrays([pa.chunked_array(ids)], names=["id"])
        with fs.open_output_stream(f"{fs_path}.ids") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        columns = [[shard], [name], [width], [len(n_tokens)], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["shard", "name", "width", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(write, SHARD).write.parquet(f"{folder}/shards")
    return shards(spark, folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder with the number of documents and tokens before each.

    One row per writing task; the running sums over them are the only step in one task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(SHARD).parquet(f"{folder}/shards").withColumns(
        {
            "first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0).cast("bigint")),
            "first_token": F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")),
        }
    )


def read_token_files(spark: SparkSession, folder: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start (tokens of all documents before it), n_tokens, ids.

    ids has the document's tokens as little-endian unsigned 32-bit integers. A task reads one shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what the worker remembers from encoding
        fs, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['name']}"
                offsets = view(fs, f"{path}.idx", "<u8").astype("i8")
                tokens = view(fs, f"{path}.bin", f"<u{row['width']}")
                with fs.open_input_file(f"{path}.ids") as f:
                    ids = pa.ipc.open_file(f).read_all().column(0)
                for i in range(0, row["n_docs"], SLICE):
                    cuts = offsets[i : i + SLICE + 1]
                    parts = [tokens[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
                    columns = [
                        ids.slice(i, SLICE).combine_chunks(),
                        pa.array(cuts[:-1] + row["first_token"], pa.int64()),
                        pa.array(np.diff(cuts), pa.int64()),
                        pa.array(parts, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids"])

    found = shards(spark, folder)
    spread = found.repartitionByRange(max(1, found.count()), "shard")  # a task for each shard: its row is small, its files are not
    return spread.mapInArrow(read, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids binary")
