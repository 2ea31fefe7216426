"""What the quality operators learn depends on the rows alone, and on all of them."""

from __future__ import annotations

from ratingloom.llm.quality_model import FitBounds, fit_quality
from ratingloom.llm.quality_rules import quality_rules

BOUNDS = FitBounds(documents=40, dictionary_bytes=4096, piece=64, pieces=3)


def table(spark, count=160):
    words = ("alpha beta gamma delta", "zq xx 9 #", "omega psi chi")
    rows = [(k, " ".join(words[(k + j) % 3 if k % 2 else 1] for j in range(5 + k % 40)) + f" end{k}") for k in range(count)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")


def test_fit_does_not_depend_on_the_layout(spark):
    docs, labels = table(spark)
    first = fit_quality(docs.repartition(1), labels, BOUNDS)
    assert first.weights
    for other in (docs.repartition(7, "text"), docs.orderBy("text").coalesce(2)):
        assert fit_quality(other, labels, BOUNDS) == first


def test_dictionaries_see_the_end_of_long_texts(spark):
    rows = [(k, ("word " * 4000) + f"tail{k % 2}signal " * 8) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = fit_quality(docs, labels, FitBounds(documents=30, dictionary_bytes=2048, piece=9000, pieces=3))
    assert b"tail1signal" in model.good and b"tail0signal" in model.bad


def test_all_trusted_documents_count(spark):
    """Every trusted text moves the ratios, however many there are."""
    rows = [(k, f"common words here w{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(150)], "doc_id long")
    some = {r.doc_id: r.score for r in quality_rules(docs, trusted).collect()}
    more = {r.doc_id: r.score for r in quality_rules(docs, trusted.union(trusted).where("doc_id <> 149")).collect()}
    assert some[149] > more[149]
    assert min(some[k] for k in range(150)) > max(some[k] for k in range(150, 300))
