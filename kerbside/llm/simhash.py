"""SimHash near-duplicates through per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kerbside.llm.components import connected_components
from kerbside.llm.memory import forget
from kerbside.llm.store import stash
from kerbside.llm.words import raw_texts, space_words

SEED = 42
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles of a text; 0 for a text without words.

    A bit is 1 if more than half of the shingles' hashes have it; a shingle counts
    as often as it occurs. A text of fewer words is one shingle.
    """
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, key (64-bit hash of the text), fingerprint (a signed long).

    Null is an empty text. Other columns are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in raw_texts(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["id", "key", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, key bigint, fingerprint bigint")


def segment_counts(bits: Column) -> Column:
    """The bit counts 0, 1, 2 of the 32 two-bit segments, each in unary (00, 01, 11).

    The Manhattan distance of two such vectors is the number of differing bits of
    the codes. It never exceeds the Hamming distance of the fingerprints.
    """
    other = F.shiftrightunsigned(bits, 1)
    low = bits.bitwiseOR(other).bitwiseAND(F.lit(LOW_BITS))
    high = bits.bitwiseAND(other).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _half(code: Column, upper: bool) -> Column:
    return F.shiftrightunsigned(code, 32) if upper else code.bitwiseAND(F.lit(0xFFFFFFFF))


def _steps(half: Column) -> Column:
    """The vectors one step away from a half vector of 16 counts."""

    low = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * i))
    # 00 and 01 change at their low bit, 01 and 11 at their high bit
    down = F.filter(low, lambda b: half.bitwiseAND(2 * b) == 0)
    up = F.filter(low, lambda b: half.bitwiseAND(b) != 0)
    return F.concat(F.transform(down, lambda b: half.bitwiseXOR(b)), F.transform(up, lambda b: half.bitwiseXOR(2 * b)))


def near_pairs(prints: DataFrame, name: str = "fingerprint", distance: int = 3) -> DataFrame:
    """(a, b), a < b, of the distinct fingerprints that differ in at most ``distance`` (0 to 3) bits.

    The bit counts of 32 segments form a vector, and vectors of near fingerprints
    are within Manhattan distance 3, so one half of the 16 + 16 counts is within 1.
    Each half is a grid of unit cells. Vectors one step apart have sums of
    different parity, so only those with an odd sum look into the cells around
    their own: an equi-join meets each pair once in a half. The whole Manhattan
    distance, then the exact one, decide in the join. Work is per distinct
    fingerprint; nothing is gathered per cell.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid covers distances from 0 to 3")
    codes = prints.select(F.col(name).alias("f")).where("f is not null").distinct().withColumn("u", segment_counts(F.col("f")))
    halves = codes.withColumn("h", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "cell", F.when(F.col("h"), _half(F.col("u"), True)).otherwise(_half(F.col("u"), False))
    )
    odd = F.bit_count("cell") % 2 == 1
    around = F.when(odd, F.concat(F.array("cell"), _steps(F.col("cell")))).otherwise(F.array("cell"))
    looking = halves.select("h", F.col("cell").alias("home"), F.explode(around).alias("cell"), F.col("f").alias("a"), F.col("u").alias("ua"))
    staying = halves.select("h", "cell", F.col("f").alias("b"), F.col("u").alias("ub"))
    once = (F.col("cell") != F.col("home")) | (F.col("a") < F.col("b"))
    bound = F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= distance
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    met = looking.join(staying, ["h", "cell"]).where(once & bound & exact)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, key, fingerprint, group, component_id.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the smallest id reachable, group a name of the component that
    holds even where ids repeat. Equal fingerprints are one node, however many rows
    have them. Texts without words (null, empty, white space) have fingerprint 0 and
    are linked like others. A null id is a component's id only where it has no other.
    """
    rows = stash(fingerprints(docs, width, id_col, text_col), "prints")
    nodes = rows.groupBy("fingerprint").agg(F.min("id").alias("_least"))
    found = connected_components(near_pairs(nodes, "fingerprint", distance))
    grouped = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("group")
    )
    ids = grouped.groupBy("group").agg(F.min("_least").alias("component_id"))
    return rows.join(grouped.drop("_least").join(ids, "group"), "fingerprint")


def keep_first(
    docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row with the smallest id.

    Null ids come last; of rows with the same id the smaller text hash stays, and of
    wholly repeated rows one.
    """
    found = near_duplicates(docs, width, distance, id_col, text_col)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("_first"))
    inner = [f"c{i}" for i in range(len(docs.columns))]  # names of docs may be anything
    i, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    # one struct as the key of both steps, in which nulls are equal: texts are shuffled once
    keyed = docs.toDF(*inner).withColumn("_k", F.struct(F.col(i).alias("id"), F.xxhash64(text).alias("key")))
    kept = keyed.join(first.select(F.struct("_first.id", F.coalesce("_first.key", F.lit(0)).alias("key")).alias("_k")), "_k", "left_semi").dropDuplicates(["_k"])
    return kept.drop("_k").toDF(*docs.columns)


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
