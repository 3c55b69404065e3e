"""Whitening of embeddings by the exact eigenvalues of their integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kerbside.llm.charpoly import RealRoots, combine, null_vectors, polynomial_modulo, primes_for
from kerbside.llm.store import plain, stash

SCALE, OFFSET = 64, 1_000_000
CLAMP = float(1 << 52)  # of a scaled entry
LIMB, RUN = 21, 2048  # products of two limbs, summed over a run of rows, are exact doubles
MERGERS = 8
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """Sums of the fit list (n vectors of scaled entries without OFFSET) and its leading components."""

    n: int
    dims: int
    sums: list[int]
    values: list[float]  # eigenvalues of the covariance
    explained: list[float]
    components: np.ndarray  # rows
    identity_error: float = 0.0


def _entries(vector: Column) -> Column:
    return F.transform(
        vector.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-CLAMP)), F.lit(CLAMP)))
    )


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _gram(x: np.ndarray) -> np.ndarray:
    """Exact integers x'x of int64 rows: products of limbs of LIMB bits, a run of rows at a time."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    limbs = max(1, -(-int(np.abs(x).max(initial=0)).bit_length() // LIMB))
    for at in range(0, len(x), RUN):
        run = x[at : at + RUN]
        parts = [(run >> LIMB * i & (1 << LIMB) - 1 if i < limbs - 1 else run >> LIMB * i).astype(np.float64) for i in range(limbs)]
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and sums of products of the fit list, as exact integers."""
    schema = "n bigint, sums array<string>, gram array<string>"
    upper = np.triu_indices(dims)

    def row(n: int, sums: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([n], pa.int64()), pa.array([[str(v) for v in sums]]), pa.array([[str(v) for v in gram]])]
        return pa.RecordBatch.from_arrays(columns, names=["n", "sums", "gram"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            sums += sum(x[i : i + RUN].sum(axis=0).astype(object) for i in range(0, len(x), RUN))
            gram += _gram(x)
        if n:
            yield row(n, sums, gram[upper])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(dims, dtype=object), np.zeros(len(upper[0]), dtype=object)
        for batch in batches:
            for m, s, g in zip(*[c.to_pylist() for c in batch.columns]):
                n, sums, gram = n + m, sums + np.array(list(map(int, s)), dtype=object), gram + np.array(list(map(int, g)), dtype=object)
        if n:
            yield row(n, sums, gram)

    parts = fit.mapInArrow(count, schema).repartition(MERGERS).mapInArrow(merge, schema).collect()
    n, sums, flat = 0, np.zeros(dims, dtype=object), np.zeros(len(upper[0]), dtype=object)
    for p in parts:
        n, sums, flat = n + p.n, sums + np.array(list(map(int, p.sums)), dtype=object), flat + np.array(list(map(int, p.gram)), dtype=object)
    gram = np.zeros((dims, dims), dtype=object)
    gram[upper] = flat
    gram.T[upper] = flat
    return n, sums.tolist(), gram


def _over_rows(spark: SparkSession, rows: list[tuple], schema: str, compute, out: str) -> list:
    """compute(row) for each of a few rows, a task each, collected."""
    struct = StructType.fromDDL(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                columns = [pa.array([v], f.type) for v, f in zip(compute(*values), to_arrow_schema(struct))]
                yield pa.RecordBatch.from_arrays(columns, names=struct.names)

    return spark.createDataFrame(rows, schema).repartition(len(rows)).mapInArrow(run, out).collect()


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial of a positive semidefinite integer matrix, constant first; tasks take a prime each."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    exact = np.array(matrix, dtype=object)

    def modulo(p: int) -> tuple[int, list[int]]:
        return p, polynomial_modulo((exact % p).astype(np.int64), p)

    found = _over_rows(spark, [(p,) for p in primes_for(len(matrix), trace)], "p bigint", modulo, "p bigint, c array<bigint>")
    return combine({r.p: r.c for r in found})


def fit(vectors: DataFrame, most: int = 16, vector_col: str = "embedding") -> Whitening:
    """Up to ``most`` leading components of the distinct scaled vectors.

    Entries become floor(64 c) (beyond 2**52 either way they stay there); each distinct vector counts once. Rows that
    are null, empty or hold null or non-finite entries are left out; of several lengths the one
    that most distinct vectors have (the smaller of equals) is fitted, as only those have a covariance. Components with eigenvalue
    zero can't be scaled and are left out, so a table of one vector, or none, has no components.

    Distinct vectors are one aggregate with partial results, so copies leave a task once. Tasks add up exact integers;
    what the driver gets is one matrix for each of a few mergers. n times the scatter matrix is an
    integer matrix; tasks find its characteristic polynomial modulo a prime each, the driver combines them and isolates the
    largest roots exactly, and a task for each root solves for its vectors in fixed-point numbers.
    """
    spark = vectors.sparkSession
    inner, names = plain(vectors)
    vector = F.col(names[vector_col])
    rows = inner.where(_usable(vector)).select(_entries(vector).alias("x"))
    distinct = stash(rows.distinct().withColumn("dims", F.size("x")), "vectors")
    common = distinct.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return Whitening(0, 0, [], [], [], np.zeros((0, 0)))
    dims = common.dims
    own = distinct.where(F.col("dims") == dims).select("x")
    n, sums, gram = _scatter(own, dims)
    s = np.array(sums, dtype=object)
    scatter = n * gram - np.outer(s, s)  # n * n times the covariance
    content = math.gcd(*scatter.flatten().tolist())
    if not content:
        return Whitening(n, dims, sums, [], [], np.zeros((0, dims)))
    matrix = (scatter // content).tolist()
    trace = sum(matrix[i][i] for i in range(dims))
    roots = RealRoots(characteristic(spark, matrix)).largest(most)

    def solve(i: int, numerator: str, denominator: str, count: int) -> tuple[int, list[list[float]]]:
        return i, null_vectors(matrix, Fraction(int(numerator), int(denominator)), count)

    asked = [(i, str(r.numerator), str(r.denominator), m) for i, (r, m) in enumerate(roots)]
    solved = _over_rows(spark, asked, "i int, a string, b string, m int", solve, "i int, v array<array<double>>")
    vectors_ = [v for r in sorted(solved, key=lambda r: r.i) for v in r.v][:most]
    each = [r for r, m in roots for _ in range(m)][:most]
    model = Whitening(
        n, dims, sums, [float(r * content / (n * n)) for r in each], [float(r / trace) for r in each], np.array(vectors_)
    )
    model.identity_error = _identity_error(own, model)
    return model


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Centred exactly up to the last rounding, then projected and scaled."""
    whole = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([float(Fraction(s % model.n, model.n)) for s in model.sums])
    return ((x - whole) - rest) @ (model.components.T / np.sqrt(model.values))


def _moments(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred sums of products of parts put together."""
    n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
    for m, other, products in parts:
        gap = other - mean
        spread = spread + products + np.outer(gap, gap) * (n * m / (n + m))
        n, mean = n + m, mean + gap * (m / (n + m))
    return n, mean, spread


def _identity_error(own: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, dims = len(model.values), model.dims
    schema = "n bigint, mean array<double>, spread array<double>"

    def row(found: tuple[int, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found[0]:
            columns = [pa.array([found[0]], pa.int64()), pa.array([found[1].tolist()]), pa.array([found[2].ravel().tolist()])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "mean", "spread"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                if batch.num_rows:
                    z = _whitened(_matrix(batch.column(0), dims), model)
                    centred = z - z.mean(axis=0)
                    yield len(z), z.mean(axis=0), centred.T @ centred

        yield from row(_moments(parts(), k))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((n, np.array(m), np.array(s).reshape(k, k)) for b in batches for n, m, s in zip(*[c.to_pylist() for c in b.columns]))
        yield from row(_moments(parts, k))

    found = own.mapInArrow(count, schema).repartition(MERGERS).mapInArrow(merge, schema).collect()
    n, _, spread = _moments(((p.n, np.array(p.mean), np.array(p.spread).reshape(k, k)) for p in found), k)
    return float(np.abs(spread / n - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), ``deviation`` and ``whitened`` (array of double, a component each).

    Rows are those with vectors of the model's length and finite entries; repeated rows and null ids stay. deviation is the exact sum of
    (n x - S)**2 over the dimensions, null where it exceeds a long. Columns of those names are replaced; other names don't matter.
    """
    names = [c for c in (vectors.columns if keep is None else keep) if c not in ("deviation", "whitened")]
    inner, known = plain(vectors)
    vector = F.col(known[vector_col])
    rows = inner.where(_usable(vector) & (F.size(vector) == model.dims)).select(_entries(vector).alias("x"), *[known[c] for c in names])
    rows = rows.toDF("x", *[f"k{i}" for i in range(len(names))])
    schema = StructType([*rows.schema[1:], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), model.dims)
            deviation = _deviations(x, model)
            flat = pa.array(_whitened(x, model).ravel() if k else np.empty(0))
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], deviation, white], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*names, "deviation", "whitened")


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    most = int(np.abs(x).max(initial=0)) * model.n + max(map(abs, model.sums))
    kind = np.int64 if model.dims * most * most <= LONG else object
    found = ((x.astype(kind) * model.n - np.array(model.sums, dtype=kind)) ** 2).sum(axis=1)
    return pa.array([v if v <= LONG else None for v in found.tolist()], pa.int64())
