"""Encoding by distinct chunks against the sentencepiece library on whole texts."""

import hashlib

import pyarrow as pa
import public_tokenizers
import pytest
from cases import TEXTS, documents, no_documents
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from kerbside.llm import pieces
from kerbside.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
ODD = ["a  b", " a", "a ", " ", "   ", "▁", "a▁▁b ▁", "\x00 a", "<s> </s><0x41>", "﻿ x", "  　 z", "x" * 5000, " " * 5000, "\n \n"]


def by_chunks(cut, texts):
    lengths, distinct, codes = cut.cut(pa.array(texts, pa.string()))
    ids, out, at = cut.segment(distinct.to_pylist()), [], 0
    for n in lengths:
        out.append([i for c in codes[at : at + n] for i in ids[c]])
        at += n
    return out


def test_whole_texts_encode_like_the_library():
    cut = pieces.Cutter(MODEL)
    assert cut.apart
    texts = [t or "" for t in TEXTS.values()] + ODD
    for _ in range(2):
        assert by_chunks(cut, texts) == [LIBRARY.encode(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab 1▁\n\t.,é中ﬁ\U0001f600<>s/"), max_size=25), min_size=1, max_size=4))
def test_any_texts_encode_like_the_library(texts):
    assert by_chunks(pieces.cutter(MODEL), texts) == [LIBRARY.encode(t) for t in texts]


def test_models_of_other_kinds_have_whole_texts_as_chunks():
    cut = pieces.Cutter(MODEL)
    cut.apart = False
    texts = ["a b", "", "a b", " x  y"]
    assert by_chunks(cut, texts) == [LIBRARY.encode(t) for t in texts]


def test_forgotten_chunks_are_segmented_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    cut = pieces.Cutter(MODEL)
    for text in ["a b c d e", "e f  g h", "a b z", "a b c d e "] * 2:
        assert by_chunks(cut, [text]) == [LIBRARY.encode(text)]


@pytest.mark.parametrize("size", [16_000_000, 50])
def test_every_kind_of_text(spark, monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE_BYTES", size)
    monkeypatch.setattr(pieces, "IDS_AT_ONCE", 100 if size == 50 else 1_000_000)
    docs = documents(spark).withColumnRenamed("kind", "ids").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string"), allowMissingColumns=True
    )
    found = pieces.encode(docs, MODEL)
    assert found.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.ids, r.decoded) for r in found.collect())
    texts = docs.select("doc_id", "text").collect()
    wanted = sorted((d is not None, d or 0, t or "", LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for d, t in texts)
    assert rows == wanted


def test_no_documents(spark):
    assert pieces.encode(no_documents(spark), MODEL).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_pieces"](spark, SF).collect()}
    ids = {i: LIBRARY.encode(t) for i, t in texts.items()}
    assert found == {i: (len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x))) for i, x in ids.items()}
