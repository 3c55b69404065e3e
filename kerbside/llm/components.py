"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbside.llm.store import stash


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Alternates large-star and small-star steps until the links no longer change: a
    node's larger neighbours, then its smaller ones, are linked to the smallest node
    near it. Neighbourhoods are never gathered: the smallest neighbour is a partial
    aggregate, and links meet it by a join whose hot keys can be split. Every round
    is written to the shared folder, which cuts the lineage. Links with a null end
    and loops are ignored; repeated links count once.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = stash(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    before = None
    while (state := _state(pairs)) != before:
        before = state
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        pairs = stash(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(pairs: DataFrame) -> tuple:
    """Number of links and a checksum of them."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first())
