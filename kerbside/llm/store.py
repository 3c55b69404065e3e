"""Shared-folder helpers: tables that cut lineage, and files that tasks write and read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

import kerbside
from kerbside.llm.words import raw_texts
from kerbside.scratch import scratch_dir


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the workers import this package, however the driver found it; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(kerbside.__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="kerbside-")  # the driver's copy, which Spark serves to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / "kerbside.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, Path("kerbside") / f.relative_to(top))
        spark.sparkContext.addPyFile(str(archive))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and continue from the files."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, for use inside tasks."""
    uri = re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def view(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file system is mounted, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return np.frombuffer(f.read_buffer(), dtype=dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ... and what each name became, for names of any kind."""
    inner = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*inner), dict(zip(df.columns, inner))


def with_text_columns(
    docs: DataFrame,
    text_col: str,
    compute: Callable[[list[bytes]], list[pa.Array]],
    added: str,
    keep: list[str] | None = None,
    most: int = 8_000_000,
) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and new ones computed from whole texts.

    compute gets the UTF-8 texts of some rows (null as empty, about ``most`` bytes) and returns the arrays
    of the columns that the DDL string ``added`` names. Columns of docs with those
    names are replaced; their names otherwise don't matter.
    """
    new = StructType.fromDDL(added)
    names = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    kept = len(names)
    at = names.index(text_col) if text_col in names else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, most):
                columns = [*part.columns[:kept], *compute(raw_texts(part.column(at)))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    rows, inner = plain(docs)
    sent = rows.select(*[inner[c] for c in names], *([] if at < kept else [inner[text_col]])).toDF(*[f"c{i}" for i in range(kept + (at == kept))])
    types = [f.dataType for f in sent.schema[:kept]] + [f.dataType for f in new]
    schema = StructType([StructField(f"c{i}", t) for i, t in enumerate(types)])
    return sent.mapInArrow(run, schema).toDF(*names, *new.names)


def slices(batch: pa.RecordBatch, text: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    if batch.column(text).nbytes <= most:
        yield batch
        return
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    run = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """The rows with their 0-based position in the given order, without one task seeing them all.

    Rows are dealt out by range and sorted in their tasks; the number of rows in the
    tasks before gives each task its base. Equal rows get distinct positions.
    """
    local = stash(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumns({"_task": F.shiftright("_at", 33), "_local": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = local.groupBy("_task").agg(F.count("*").alias("_n"))
    bases = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row for each task
    return local.join(F.broadcast(bases), "_task").withColumn(name, F.col("_base") + F.col("_local")).drop("_task", "_at", "_local", "_base")
