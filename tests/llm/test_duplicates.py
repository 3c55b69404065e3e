"""SimHash, components and embeddings against brute force."""

import itertools
import random

import numpy as np
import xxhash
from cases import documents, groups, no_documents, space_words
from pyspark.sql import functions as F

from kerbside.llm import components, embeddings, simhash
from kerbside.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_print(text, width=3):
    words = space_words(text)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark):
    prints = {r.doc_id: slow_print(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    least = groups(links, sorted(prints))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, SF).collect()}
    assert found == {i: (f"{p:016x}", least[i]) for i, p in prints.items()}


def test_fingerprints_match_the_engines_own_hash(spark):
    row = spark.createDataFrame([("à b c",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % 2**64 == simhash.fingerprint("À B C".replace("À", "à").encode()) == slow_print("à B C")


def test_near_pairs_are_complete(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << i for i in random.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 3, 4, 5) for _ in range(6)} | {0, 2**64 - 1, 1, 7, 15}
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint bigint")
    for distance in (0, 1, 2, 3):
        found = {(r.a % 2**64, r.b % 2**64) for r in simhash.near_pairs(df, distance=distance).collect()}
        expected = {frozenset(p) for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= distance}
        assert {frozenset(p) for p in found} == expected and len(found) == len(expected)


def test_segment_counts_bound_the_distance(spark):
    random.seed(5)
    pairs = [(random.getrandbits(63), random.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumns({x: simhash.segment_counts(F.col(y)) for x, y in (("u", "a"), ("v", "b"))})
    for r in df.collect():
        counts = [[(x >> 2 * i & 3).bit_count() for i in range(32)] for x in (r.a, r.b)]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert ((r.u ^ r.v) % 2**64).bit_count() == manhattan <= (r.a ^ r.b).bit_count()


def test_near_duplicate_edge_cases(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    assert len(found) == 15
    wordless = [r for r in found if r.fingerprint == 0]
    assert sorted((r.id is None, r.id or 0) for r in wordless) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    assert {r.component_id for r in wordless} == {2}
    assert {r.component_id for r in found if r.id in (1, 9)} == {1}
    kept = simhash.keep_first(documents(spark))
    assert kept.columns == documents(spark).columns
    rows = kept.collect()
    ids = sorted(r.doc_id or 0 for r in rows)
    assert ids == [0, 1, 2, 5, 5, 6, 7, 8, 10, 11]
    assert sorted(r.text for r in rows if r.doc_id == 5) == ["another text", "one"]
    assert simhash.keep_first(no_documents(spark)).count() == 0


def test_whole_texts_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.keep_first(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(at for at, line in enumerate(plan.splitlines()) if "Scan parquet" in line and "lang" in line)
    above, depth = 0, len(plan.splitlines()[scan]) - len(plan.splitlines()[scan].lstrip(" :+-"))
    for line in reversed(plan.splitlines()[:scan]):  # the scan's ancestors
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth, above = indent, above + ("Exchange hashpartitioning" in line)
    assert above == 1


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1120)] + [(5000, i) for i in range(5001, 5100)]
    df = spark.createDataFrame([*links, (None, 1), (4, None), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components.connected_components(df).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert found == groups(links, sorted(nodes))
    assert components.connected_components(df.limit(0)).count() == 0


def slow_links(rows, threshold=0.93):
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    return [(a, b) for a, b in itertools.combinations(unit, 2) if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]


def clusters(seed=4):
    random = np.random.default_rng(seed)
    rows = []
    for size in [1] * 40 + [2] * 60 + [3] * 20 + [90, 400]:
        centre, label = random.standard_normal(64), int(random.integers(3))
        for _ in range(size):
            rows.append((len(rows), (centre + random.standard_normal(64) * 0.15).astype(np.float32).tolist(), label))
    return rows


def test_embedding_links_have_high_recall(spark):
    rows = clusters()
    links = slow_links(rows)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    n = np.array([found[i].n_links for i in range(len(rows))])
    assert (n <= degree).all() and n.sum() >= 0.95 * degree.sum() and ((n > 0) & (degree > 0)).sum() >= 0.95 * (degree > 0).sum()
    least = groups(links, range(len(rows)))
    assert np.mean([found[i].component_id == least[i] for i in range(len(rows))]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_embedding_edge_cases(spark):
    v = [1.0, 2.0, -0.0, 0.5]
    rows = [
        (1, v, 1), (2, [2.0, 4.0, 0.0, 1.0], 1), (3, v, 1), (3, v, 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1),
        (9, [float("nan")] * 4, 1), (10, [float("inf"), 1.0, 1.0, 1.0], 1), (11, [None, 1.0, 1.0, 1.0], 1), (12, [1.0, 2.0], 1), (None, v, 2), (13, [3e38] * 4, 3), (14, [1e-38] * 4, 3),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"node": F.lit(1), "rank": F.lit("x"), "id": F.lit(3)})
    found = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
    single = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 12)]
    assert found == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (0, 1, 4, False), (13, 1, 13, True), (14, 1, 13, False), *single])
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_tiles_count_whole_components(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 50)
    rows = clusters(9)[-490:]
    degree = np.bincount(np.array(slow_links(rows)).ravel(), minlength=len(rows))
    found = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert [found[r[0]] for r in rows] == degree.tolist()


def test_vectors_at_the_edge_of_a_dense_group_keep_their_links(spark):
    random = np.random.default_rng(6)
    centre = random.standard_normal(64)
    dense = centre + random.standard_normal((3000, 64)) * 0.15
    away = random.standard_normal((1500, 64))
    members = dense[:1500] / np.linalg.norm(dense[:1500], axis=1, keepdims=True)
    away -= (away * members).sum(axis=1, keepdims=True) * members
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    edge = members * 0.935 + away * np.sqrt(1 - 0.935**2)  # a cosine of 0.935 to one of the group
    vectors = np.concatenate([dense, edge, random.standard_normal((3000, 64))]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    least = groups(np.argwhere(np.triu(near)).tolist(), range(len(vectors)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert found == {i: (int(n), least[i]) for i, n in enumerate(near.sum(axis=1))}


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sum(r.n_links for r in QUERIES["op5_embeddings"](spark, SF).collect()) == 2 * len(slow_links(rows))
