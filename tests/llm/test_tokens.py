"""Token ids against the library: letters and marks before punctuation, given documents, another tokenizer."""

import random
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from estatelens.llm import packing, token_store, tokens
from estatelens.llm.common import BATCH_BYTES, read


def library(name=tokens.VOCABULARY):
    return Tokenizer.from_file(tokens.vocabulary_path(name))


def same(encoder, texts, name=tokens.VOCABULARY):
    want = [e.ids for e in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


LETTERS = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM"]


def test_every_letter_before_every_punctuation_mark():
    encoder = tokens.ChunkEncoder(tokens.vocabulary_path())
    assert encoder.chunked
    changing = [c for c in LETTERS if len(unicodedata.normalize("NFC", c).lower()) > 1 or unicodedata.normalize("NFC", c) != c]
    rest = [c for c in LETTERS if c not in set(changing)]
    texts = [" ".join(f"ab{c}{p} {c}{p}" for c in changing) for p in ["", *string.punctuation]]
    texts += [" ".join(f"ab{c}{p} {c}{p}" for c in rest) for p in ("", ".", "'")]
    same(encoder, texts)


def test_marks_after_every_letter():
    encoder = tokens.ChunkEncoder(tokens.vocabulary_path())
    marks = [c for c in LETTERS if unicodedata.category(c)[0] == "M"]
    same(encoder, [" ".join(f"{a}{m}. {a}{m}" for m in marks) for a in string.ascii_letters + "İΣ"])


@given(st.lists(st.text(st.sampled_from("aAİJHΣzß0.,'\"!̱́̌̇ \n\x01<|>"), max_size=25), max_size=8))
@settings(max_examples=150, deadline=None)
def test_mixtures(texts):
    same(ENCODER, texts)


ENCODER = tokens.ChunkEncoder(tokens.vocabulary_path(), remembered=40)


def test_named_failures_of_an_earlier_form():
    same(ENCODER, ["ALİ.", "KADİ,", "J̌ H̱.", "\x01 a\x01b. \x01\x01", "a <|endoftext|> b <|startoftext|>", None, ""])


def test_given_documents(spark, sf):
    same(tokens.ChunkEncoder(tokens.vocabulary_path(), remembered=500), [r["text"] for r in read(spark, sf, "documents").select("text").collect()])


def test_other_tokenizers_take_whole_texts(spark, sf):
    name = "byte_bpe_50k.json"
    encoder = tokens.ChunkEncoder(tokens.vocabulary_path(name))
    assert not encoder.chunked
    texts = [r["text"] for r in read(spark, sf, "documents").select("text").limit(60).collect()]
    same(encoder, [*texts, " two  blanks ", None], name)
    docs = spark.createDataFrame([(1, " two  blanks "), (2, None)], "doc_id long, text string")
    path = token_store.write_token_files(docs, vocabulary=tokens.vocabulary_path(name))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read_token_files(spark, path).collect()}
    assert got == {1: [*library(name).encode(" two  blanks ").ids, 2], 2: [2]}
    assert packing.token_pieces(docs, vocabulary=tokens.vocabulary_path(name)).count() == 2


@pytest.mark.parametrize("most", [0, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1])
def test_segments_hold_ids_of_any_width(most):
    rng = random.Random(most)
    ids = [rng.randint(0, most) for _ in range(2000)] + [most]
    reader = token_store.SegmentReader(token_store.encode_segment(np.array(ids, np.uint32)))
    assert reader.ids().tolist() == ids and [reader.token(k) for k in range(0, 2001, 61)] == ids[::61]
    assert token_store.SegmentReader(token_store.encode_segment(np.empty(0, np.uint32))).ids().size == 0


def test_files_of_several_segments_and_parts(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PART_BYTES", 500)
    monkeypatch.setattr(token_store, "PARTS_AT_ONCE", 3)
    docs = spark.createDataFrame([(k, "some words here " * (k % 9)) for k in range(300)], "doc_id long, text string")
    path = token_store.write_token_files(docs)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.read_token_files(spark, path).collect())
    assert [d for _, d, _ in got] == list(range(300))
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0


def test_batches_of_whole_texts_are_bounded_in_bytes(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text")
    packing.token_pieces(docs)
    assert int(spark.conf.get(bound).rstrip("b")) == BATCH_BYTES
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) < BATCH_BYTES + 2_000_000
    assert packing.token_pieces(docs).agg({"length": "sum"}).first()[0] == 40 * 200_001
    spark.conf.unset(bound)
    spark.conf.set(bound, 1 << 20)
    packing.token_pieces(docs)
    assert int(spark.conf.get(bound).rstrip("b")) == 1 << 20
    spark.conf.unset(bound)
