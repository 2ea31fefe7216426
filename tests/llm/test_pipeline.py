"""The pipeline's stages on small and awkward tables."""

from __future__ import annotations

import os

import pytest

import brute
import corpus_pipeline
from test_operators_llm import ROWS, SF_DIR, table

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.mark.parametrize("rows", [ROWS, []], ids=["awkward", "empty"])
def test_stages_keep_columns(spark, rows):
    docs = table(spark, rows)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF_DIR)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= bool(rows)


def test_stages_decide_as_plainly(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    removed = brute.removed_lines(texts.items())
    got = corpus_pipeline.drop_repeated_lines(spark, docs, SF_DIR)
    assert {r.doc_id for r in got.collect()} == {i for i, (n, gone) in removed.items() if n == 0 or gone < n}
    groups = brute.components(texts)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert {r.doc_id for r in got.collect()} == {i for i, (_, c) in groups.items() if c == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {i for i, _ in brute.leaks(texts.items(), items)}
    got = corpus_pipeline.drop_contaminated(spark, docs, SF_DIR)
    assert {r.doc_id for r in got.collect()} == set(texts) - leaked


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < rows.select("doc_id").distinct().count() < 200


def test_rows_with_null_and_shared_ids(spark):
    """Copies go by text, clean rows stay whatever their id, and other columns pass through."""
    text = " ".join(f"word{k}" for k in range(40))
    clean = " ".join(f"other{k}" for k in range(40))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [(None, text), (None, text), (5, text), (5, text), (6, text), (5, clean), (None, f"{clean} {item}"), (6, item)]
    docs = spark.createDataFrame([(i, t, "s", len(t), 7, 8) for i, t in rows],
                                 "doc_id long, text string, source string, n_chars long, n_lines int, `a.b` int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text in (text, clean)) == [(0, text), (5, clean)]
    assert len(kept) == 4
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF_DIR).collect()
    assert len(kept) == 6 and not any(item in r.text for r in kept)
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, SF_DIR)
    assert kept.columns == docs.columns and {r["n_lines"] for r in kept.collect()} == {7}
