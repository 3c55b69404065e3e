"""Near-duplicate embeddings by comparing blocks of each label, whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from kerbside.llm.components import connected_components
from kerbside.llm.store import open_folder, ranked, stash
from kerbside.scratch import scratch_dir

TILE = 1024  # vectors that are compared in one call
TILES = 4  # of a block, which is a file and a task
BITS = 62
MOST_TASKS = 10_000


@lru_cache(maxsize=8)
def _planes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, BITS))


def _keys(units: np.ndarray, seed: int) -> np.ndarray:
    """The signs of BITS random projections of each row, the first one most significant."""
    return (units @ _planes(units.shape[1], seed) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable from each of n by the links."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(before, least):
            return least


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of vectors.

    Vectors of equal, non-null label and length link where their cosine in double
    precision is at least ``threshold``. component_id is the smallest id reachable by
    links, n_links the number of other rows linked directly, kept whether the row's
    id is its component's.

    Rows with equal vectors are one node that counts for as many. The nodes are ordered by
    label and the signs of a series of random projections and cut into blocks, which are
    files in the shared folder. A task takes one block and compares it with all blocks of
    the labels it holds, so every link is found, whatever the size of a label. Only tiles
    whose bounding cone is out of reach of a vector are left out, which is exact. Links inside
    a block and repeated links between parts of two blocks leave the tasks as one.

    Vectors that are null, zero, or hold null or non-finite components link with nothing:
    0 links, their own id. So do rows with a null label. Of a component with null
    ids the others decide. Repeated ids are rows of their own.
    """
    names = {id_col: "id", vector_col: "vector", label_col: "label"}
    rows = vectors.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn(
        "vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    )
    fine = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & fine & F.exists("vector", lambda x: x != 0), F.lit(False))
    kind = rows.schema["label"].dataType.simpleString()

    nodes = rows.where(usable).groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, weight, vector = batch.columns
            dims = np.diff(vector.offsets.to_numpy())
            flat = vector.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                where = np.flatnonzero(dims == d)
                x = flat[at[where][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                take = pa.array(where)
                columns = [c.take(take) for c in (node, label, weight)]
                columns += [pa.array([r.tobytes() for r in x], pa.binary()), pa.array(_keys(x, seed), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "weight", "unit", "key"])

    units = nodes.select("node", "label", "weight", "vector").mapInArrow(project, f"node bigint, label {kind}, weight bigint, unit binary, key bigint")
    units = units.withColumn("width", F.length("unit"))
    in_order = stash(ranked(units, "label", "width", "key"), "units")
    counted = _linked(in_order, threshold)
    group = nodes.join(counted, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    found = group.join(ids, "component").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), "component_id",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    keyed = rows.withColumn("_key", F.when(usable, F.xxhash64("label", "vector")))
    same = (F.col("_key") == F.col("_hash")) & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    out = keyed.join(found.withColumn("_hash", F.xxhash64("_label", "_vector")), same, "left")
    component = F.when(F.col("_hash").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of ``threshold`` at least: in single precision, in double where that is too close."""
    found = a.astype(np.float32) @ b.astype(np.float32).T
    slack = (a.shape[1] + 4) * 2.0**-22
    near = found >= threshold + slack
    i, j = np.nonzero((found >= threshold - slack) & ~near)
    for at in range(0, len(i), 1 << 16):
        k, m = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near[k, m] = np.einsum("ij,ij->i", a[k], b[m]) >= threshold
    return near


def _within_reach(a: np.ndarray, tile: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of a that may link with a row of the tile: their angle to its centre is at most its radius and a link's angle."""
    centre = tile.sum(axis=0)
    norm = np.sqrt(centre @ centre)
    if norm < 1e-6:
        return np.arange(len(a))
    centre /= norm
    reach = np.arccos(np.clip((tile @ centre).min(), -1, 1)) + np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    return np.arange(len(a)) if reach >= np.pi else np.flatnonzero(a @ centre >= np.cos(reach))


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each row of a symmetric matrix of links, the diagonal included."""
    n = len(near)
    root = _stars(np.arange(n), near.argmax(axis=1), n)
    a, b = np.nonzero(near & (root[:, None] != root[None, :]))
    return _stars(root[a], root[b], n)[root]


def _runs(starts: np.ndarray) -> Iterator[slice]:
    cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def _linked(in_order: DataFrame, threshold: float) -> DataFrame:
    """(node, component, links): the component of every node and the rows linked with it, beside its own."""
    spark, tile = in_order.sparkSession, TILE
    block = TILES * tile
    folder = scratch_dir(spark, "blocks")
    spans = in_order.groupBy("label", "width").agg(F.min("rank").alias("start"), F.max("rank").alias("end"))
    rows = in_order.join(spans, ["label", "width"]).select("node", "weight", "unit", "rank", "start", "end", F.floor(F.col("rank") / block).alias("block"))

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        node, unit, root = frame["node"].to_numpy(), frame["unit"].to_numpy(), np.arange(len(frame))
        for run in _runs(frame["start"].to_numpy()):
            x = _matrix(unit[run])
            near = np.concatenate([_near(x[i : i + tile], x, threshold) for i in range(0, len(x), tile)])
            near |= near.T
            np.fill_diagonal(near, True)
            root[run] = run.start + _roots(near)
        frame = frame.assign(root=node[root])
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        draft = f"{path}/_{uuid.uuid4().hex}"  # attempts of a task don't meet
        pq.write_table(pa.Table.from_pandas(frame[["node", "weight", "unit", "start", "end", "root"]], preserve_index=False), draft, filesystem=fs, compression="none")
        fs.move(draft, f"{path}/{key[0]}")
        return frame[["node", "root"]]

    members = stash(rows.groupBy("block").applyInPandas(write, "node bigint, root bigint"), "members")

    def read(number: int) -> pd.DataFrame:
        fs, path = open_folder(folder)
        return pq.read_table(f"{path}/{number}", filesystem=fs).to_pandas()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number in (int(n) for frame in frames for n in frame["id"]):
            own = read(number)
            links, starts, roots = np.zeros(len(own), dtype=np.int64), own["start"].to_numpy(), own["root"].to_numpy()
            runs = [(run, _matrix(own["unit"].to_numpy()[run])) for run in _runs(starts)]
            for other in range(starts[0] // block, own["end"].iloc[-1] // block + 1):
                met = own if other == number else read(other)
                pairs = []
                for run, x in runs:
                    theirs = np.flatnonzero(met["start"].to_numpy() == starts[run.start])
                    for at in range(0, len(theirs), tile):
                        part = theirs[at : at + tile]
                        y = _matrix(met["unit"].to_numpy()[part])
                        reached = _within_reach(x, y, threshold)
                        for i in range(0, len(reached), tile):
                            mine = reached[i : i + tile]
                            near = _near(x[mine], y, threshold)
                            mine = mine + run.start
                            if other == number:
                                near[mine[:, None] == part[None, :]] = False
                            if not near.any():
                                continue
                            links[mine] += near @ met["weight"].to_numpy()[part]
                            if other > number:
                                a, b = np.nonzero(near)
                                pairs.append(pd.DataFrame({"a": roots[mine[a]], "b": met["root"].to_numpy()[part[b]]}).drop_duplicates())
                if pairs:
                    yield pd.concat(pairs).drop_duplicates().assign(links=0)
            some = np.flatnonzero(links)
            yield pd.DataFrame({"a": own["node"].to_numpy()[some], "b": pd.array([None] * len(some), dtype="Int64"), "links": links[some]})

    last = in_order.agg(F.max("rank")).first()[0]
    blocks = 0 if last is None else last // block + 1
    found = stash(spark.range(0, blocks, 1, max(1, min(blocks, MOST_TASKS))).mapInPandas(compare, "a bigint, b bigint, links bigint"), "found")
    joined = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "root")
    links = found.where("b is null").select(F.col("a").alias("node"), "links")
    return members.join(joined, "root", "left").join(links, "node", "left").select("node", F.coalesce("component", "root").alias("component"), "links")
