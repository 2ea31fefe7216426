"""Ids and texts of the chunk table next to the library on whole texts."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import pyarrow as pa
import pytest

from ratingloom.llm import piece_chunks, queries
from ratingloom.llm.piece_chunks import encode_pieces, model_path, processor

SF_DIR = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "  a", "a ", "   ", "\u2581x\u2581\u2581 y", "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8\n\u6539\u884c", "a\0b",
         "\U0001f600\U0001f600 ok \u2460\u2461", "x" * 50_000, " " * 3_000, "\n\n \t", "<s> </s> <0x0A> <unk>",
         "The cat. " * 20_000, "e\u0301 \ufeffa \ufffd"]


def plain(text):
    model = processor(model_path())
    ids = model.encode(text or "") + [model.eos_id()]
    return ids, model.decode(ids)


def check(spark, rows, **cut):
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id long, text string, block int, payload string")
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encode_pieces(df, model_path(), **cut).collect())
    assert found == Counter((i, tuple(plain(t)[0]), plain(t)[1]) for i, t in rows)


def test_awkward_texts(spark):
    check(spark, [*enumerate(TEXTS), (None, "no id"), (3, "same id"), (3, "same id"), (None, None)])


def test_small_blocks_and_buckets(spark):
    """Many blocks and buckets give what one gives."""
    check(spark, [(k, f"{t} word{k % 7} {t}") for k, t in enumerate(TEXTS * 3) if t is None or len(t) < 4_000],
          block_bytes=400, bucket_bytes=2_000)


def test_changed_rows_are_noticed(spark):
    def other(batches):
        for batch in batches:
            words = [uuid.uuid4().hex for _ in range(batch.num_rows)]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(words)})

    texts = spark.range(50).mapInArrow(other, "doc_id long, text string")
    with pytest.raises(Exception, match="read again"):
        encode_pieces(texts, model_path()).collect()


def test_empty_table(spark):
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string"), model_path()).count() == 0


def test_crossing_piece_is_refused(monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as messages
    model = messages.ModelProto()
    model.ParseFromString(processor(model_path()).serialized_model_proto())
    model.pieces[900].piece = "of\u2581the"

    class Other:
        def serialized_model_proto(self):
            return model.SerializeToString()

    monkeypatch.setitem(piece_chunks._models, "other", Other())
    with pytest.raises(ValueError, match="cross"):
        piece_chunks.check_model("other")


def test_query(spark):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()
    found = {r.doc_id: r for r in queries.op12_piece_chunks(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids, decoded = plain(doc.text)
        row = found[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(ids), digest(" ".join(map(str, ids))), digest(decoded))
