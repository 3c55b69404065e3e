"""The operators as queries over the given tables."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbside.llm import brown, conversations, decontam, embeddings, licenses, packing, pieces, quality, simhash, token_files, toxicity, whitening, wrappers
from kerbside.llm.store import ship
from kerbside.scratch import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    @wraps(f)
    def shipped(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_brown(spark: SparkSession, sf: str) -> DataFrame:
    """Log10 probability of every document under the class model and under unigrams."""
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = brown.score(docs, brown.fit(docs, ~held_out), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


@query
def op2_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the packed documents with a checksum of their ids."""
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as read back from the token files, with a checksum of their ids."""
    folder = scratch_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    back = token_files.read_token_files(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf, "documents"), width=3, distance=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontam.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10, keep=["doc_id"])
    n_hit = decontam.hit_words()
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op7_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Importance weight and selection of every document."""
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.resample(docs, model, keep=["doc_id"])


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the ids."""
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"), toxicity.third)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    held_out = F.col("doc_id").isNotNull() & toxicity.third(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    found = wrappers.extract(table(spark, sf, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op5_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_vectors(table(spark, sf, "embeddings"), threshold=0.93)


@query
def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Own and inherited licence of every document.

    A document is a file /source/language/doc-<id>; those whose id is divisible by 50 are
    called LICENSE-<id>, and where it is divisible by 100 lie in /source.
    """
    i = F.col("doc_id")
    folder = F.concat_ws("/", F.lit(""), "source", F.when(F.coalesce(i % 100 != 0, F.lit(True)), F.col("lang")))
    name = F.concat(F.when(i % 50 == 0, "LICENSE-").otherwise("doc-"), i.cast("string"))
    files = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", folder, name))
    return licenses.scan(files, keep=["doc_id", "path"])


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened components of every vector."""
    vectors = table(spark, sf, "embeddings")
    model = whitening.fit(vectors, most=16)
    rows = whitening.transform(vectors, model, keep=["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


@query
def op12_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    found = pieces.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Faults, cheapest audit and digest of the repaired turns of every conversation, after damage."""
    report, _ = conversations.repair(conversations.damaged(table(spark, sf, "conversations")))
    return report.withColumnRenamed("id", "conv_id")


# --- the same results in SQL, where it can state them ---

ORACLES["op5_embeddings"] = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
  least AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN least ON x = vec_id"""

_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op8_decontaminate"] = f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
  windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
    FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))),
  docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
  grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
  hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""
