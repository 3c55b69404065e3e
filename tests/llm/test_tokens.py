"""Encoding, token files and packing against the tokenizers library itself."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import TEXTS, documents, no_documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm import packing, token_files, tokens
from kerbside.llm.queries import QUERIES
from kerbside.scratch import scratch_dir

SF = "/root/testdata/sf0.001"
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_whole_texts_encode_like_the_library(name):
    ours, theirs = tokens.Encoder(public_tokenizers.path(name)), library(name)
    texts = [t or "" for t in TEXTS.values()] + ["a\n b", "x \n y", "I'd. we'll, 1.5. é», İ. .a ,b", "a b  c", "  x", "a\x1cb \x1d"]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(e, "<u4").tolist() for e in ours.encode([t.encode() for t in texts])] == [theirs(t) for t in texts]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("aB1é'’s.,-!\n\t  ́　İ<|>"), max_size=30))
def test_any_text_encodes_like_the_library(name, text):
    ours, theirs = tokens.encoder(public_tokenizers.path(name)), library(name)
    assert np.frombuffer(ours.encode([text.encode()])[0], "<u4").tolist() == theirs(text)


def test_memory_is_renewed(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    ours, theirs = tokens.Encoder(public_tokenizers.path(FILES[0])), library(FILES[0])
    for text in ["a b c d e", "e f g. h", "a b, z", "a b c d e f"] * 2:
        assert np.frombuffer(ours.encode([text.encode()])[0], "<u4").tolist() == theirs(text)


@pytest.mark.parametrize("name", FILES)
def test_a_repeated_word_is_looked_up_once(name):
    """the work grows with the distinct words of the texts, not with their repeats or punctuation."""

    class Counted(dict):
        looked_up = 0

        def get(self, *args):
            self.looked_up += 1
            return super().get(*args)

    ours, theirs = tokens.Encoder(public_tokenizers.path(name)), library(name)
    ours.known = Counted()
    text = "alpha beta. beta, gamma alpha! beta "
    found = ours.encode([(text * 40).encode()] * 5)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [theirs(text * 40)] * 5
    assert ours.known.looked_up <= 8


@pytest.mark.parametrize("name", FILES)
def test_columns_encode_like_the_library(name):
    """Slices, nulls, empty texts and texts that only the library can encode, each with its end."""
    ours, theirs = tokens.Encoder(public_tokenizers.path(name)), library(name)
    texts = [*TEXTS.values(), None, "", "\x01 a\x01b", "Señor ñu ŒIL İstanbul straße x", "ab  c", "\n", " ", "a\u3000", "q,q,,q;"]
    column = pa.array(texts, pa.string())
    for at in range(0, len(texts), 3):
        found = ours.column(column.slice(at, 7), (2).to_bytes(4, "little")).to_pylist()
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [[*theirs(t), 2] for t in texts[at : at + 7]]
    assert ours.column(column.slice(0, 0)).to_pylist() == []


def test_token_files_round_trip(spark):
    encode, folder = library(FILES[0]), scratch_dir(spark, "tokens")
    docs = documents(spark)
    token_files.write_token_files(docs, folder, public_tokenizers.path(FILES[0]), end_id=0)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    expected = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in rows] == [i for i, _ in expected]
    at = 0
    for r, (_, text) in zip(rows, expected):
        ids = encode(text) + [0]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)


def test_token_files_of_wide_ids_and_of_nothing(spark):
    folder = scratch_dir(spark, "tokens")
    token_files.write_token_files(documents(spark), folder, public_tokenizers.path(FILES[0]), end_id=70_000)
    assert {r.width for r in token_files.shards(spark, folder).collect()} == {4}
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 70_000 for r in token_files.read_token_files(spark, folder).collect())
    folder = scratch_dir(spark, "tokens")
    token_files.write_token_files(no_documents(spark), folder, public_tokenizers.path(FILES[0]), end_id=0)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_a_task_reads_one_shard(spark):

    folder = scratch_dir(spark, "tokens")
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with shards of ordinary size
    try:
        token_files.write_token_files(many, folder, public_tokenizers.path(FILES[0]), end_id=0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r.n_docs for r in token_files.shards(spark, folder).collect())
    back = token_files.read_token_files(spark, folder).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and sorted(r["count"] for r in back) == sizes


def test_token_query(spark):
    encode, at = library(FILES[0]), 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sorted(QUERIES["op3_token_files"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array(encode(texts[r.doc_id]) + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def check_packed(rows, texts, window):
    """rows: (key, start, length, doc_tokens, sequence, offset, ids); every id once, sequences whole."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r[0]].append(r)
        sequences[r[4]].append(r)
    assert set(docs) == set(texts)
    for key, pieces in docs.items():
        pieces.sort(key=lambda r: r[1])
        at = 0
        for _, start, length, total, _, _, ids in pieces:
            assert start == at and length > 0 and total == len(texts[key]) and ids == texts[key][start : start + length]
            at += length
        assert at == len(texts[key])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[5]):
            assert r[5] == at
            at += r[2]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_pack_query(spark):
    encode = library(FILES[1])
    texts = {r.doc_id: np.array(encode(r.text) + [2], "<u4").tobytes() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op2_pack"](spark, SF).collect()
    rows = [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset, r.ids_crc32) for r in found]
    sums = {(i, r[1], r[2]): zlib.crc32(texts[i][4 * r[1] : 4 * (r[1] + r[2])]) for r in rows for i in [r[0]]}
    assert all(r[6] == sums[r[0], r[1], r[2]] for r in rows)
    as_ids = {i: np.frombuffer(t, "<u4").tolist() for i, t in texts.items()}
    assert check_packed([(*r[:6], as_ids[r[0]][r[1] : r[1] + r[2]]) for r in rows], as_ids, 4096) == 0


def test_pack_edge_cases(spark):
    encode = library(FILES[1])
    docs = documents(spark).where("doc_id is not null and doc_id != 1 and doc_id != 5")
    texts = {r.doc_id: encode(r.text) + [2] for r in docs.collect()}
    found = packing.pack(docs, public_tokenizers.path(FILES[1]), end_id=2, window=64, shard_docs=3).collect()
    rows = [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    assert check_packed(rows, texts, 64) == 0
    every = packing.pack(documents(spark), public_tokenizers.path(FILES[1]), end_id=2).groupBy("doc_id").count().count()
    assert every == 12  # the null id as well
    assert packing.pack(no_documents(spark), public_tokenizers.path(FILES[1]), end_id=2).count() == 0


def plain_corpus(docs):
    df = Counter(t for d in docs for t in set(d.tolist()))
    return packing.Corpus(np.array([df[t] for t in range(max(df) + 1)]), len(docs), sum(map(len, docs)) / len(docs))


def test_neighbours_are_lexical():
    topic = [np.arange(t * 1000, t * 1000 + 40, dtype="<u4") for t in range(8)]
    docs = [topic[i % 8] for i in range(64)]
    corpus = plain_corpus(docs)
    for sequence in packing.fill(docs, 160, corpus):
        assert len({d % 8 for d, _, _ in sequence}) == 1
    scores = packing.Index(docs, corpus).scores(3)
    assert set(np.flatnonzero(scores == scores.max())) == set(range(3, 64, 8))


def test_postings_of_used_documents_are_dropped(monkeypatch):
    """as documents are used up, the postings shrink; the sequences are those of a search of all."""
    random.seed(6)
    docs = [np.array([min(int(random.expovariate(0.02)), 900) for _ in range(random.randrange(1, 90))], dtype="<u2") for _ in range(300)]
    corpus, sizes, scores = plain_corpus(docs), [], packing.Index.scores

    def counted(index, query):
        sizes.append(len(index.post_doc))
        return scores(index, query)

    monkeypatch.setattr(packing.Index, "scores", counted)
    found = list(packing.fill(docs, 128, corpus))
    assert sizes[-1] < sizes[0] / 4
    monkeypatch.setattr(packing.Index, "keep", lambda index, alive: None)
    assert list(packing.fill(docs, 128, corpus)) == found


def test_bm25_by_brute_force():
    random.seed(4)
    docs = [np.array([min(int(random.expovariate(0.05)), 300) for _ in range(random.randrange(1, 60))], dtype="<u4") for _ in range(50)]
    corpus = plain_corpus(docs)
    mean = sum(map(len, docs)) / 50

    def score(query, doc):
        total = 0
        for t in set(query.tolist()):
            tf, df = doc.tolist().count(t), sum(t in d.tolist() for d in docs)
            total += max(math.log((50 - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return total

    index = packing.Index(docs, corpus)
    for q in (0, 7, 31):
        assert np.allclose(index.scores(q), [score(docs[q], d) for d in docs])


def test_shard_plan():
    plan, shards = packing.shard_plan({-1: 3, 4: 5, 9: 25, 11: 2, 12: 9}, 10)
    assert plan == {-1: (0, 1), 4: (0, 1), 9: (1, 3), 11: (4, 1), 12: (5, 1)} and shards == 6
    assert packing.shard_plan({}, 10) == ({}, 0)


def test_packing_does_not_depend_on_the_layout(spark):
    """Related documents meet from whatever files they come; few sequences are short; statistics are the corpus's."""
    random.seed(8)
    topics = [[f"{a}{b}{t}" for a in "klmnprst" for b in ("an", "or", "ing")] for t in ("bel", "cur", "dov", "fim", "gus")]
    texts = [(i, " ".join(random.choices(topics[i % 5], k=random.randrange(5, 60)))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = []
    for n in (1, 64):
        rows = packing.pack(docs.repartition(n, F.rand(n)), public_tokenizers.path(FILES[1]), end_id=2, window=256, shard_docs=20).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append(r)
        found.append(sorted(sorted((r.doc_id, r.start, r.length, r.offset) for r in s) for s in sequences.values()))
        sizes = [sum(r.length for r in s) for s in sequences.values()]
        assert sum(x < 256 for x in sizes) <= 8 and sum(sizes) == sum(r.doc_tokens for r in {r.doc_id: r for r in rows}.values())
        pure = sum(len({r.doc_id % 5 for r in s}) == 1 for s in sequences.values())
        assert pure > 0.7 * len(sequences)
    assert found[0] == found[1]

