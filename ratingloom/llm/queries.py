"""The operators on the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ratingloom.llm.decontaminate import contaminated
from ratingloom.llm.jaccard import near_duplicates
from ratingloom.llm.license_rules import scan_licenses
from ratingloom.llm.line_dedup import WHOLE, dedup_lines
from ratingloom.llm.packing import pack_documents
from ratingloom.llm.piece_chunks import encode_pieces, model_path
from ratingloom.llm.quality_model import THRESHOLD, fit_quality, held_out, quality_score
from ratingloom.llm.quality_rules import quality_rules
from ratingloom.llm.secret_ledger import BASE_RULES, BlobLedger, span_text
from ratingloom.llm.token_ids import tokenizer_path
from ratingloom.llm.token_rollups import TokenRollups, blank_words, counted, word_marks
from ratingloom.llm.token_store import read_documents, write_tokens
from ratingloom.llm.turn_repair import damaged, repair
from ratingloom.llm.whitening import whiten
from ratingloom.session import shared_root


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _folder(spark, name):
    return f"{shared_root(spark)}/ratingloom/{name}-{uuid.uuid4().hex}"


def op1_secret_ledger(spark, sf_dir):
    found = BlobLedger(spark, _folder(spark, "ledger")).ingest(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{rule.kind}")
              for rank, rule in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"), "blob")


def op2_line_windows(spark, sf_dir):
    return dedup_lines(_documents(spark, sf_dir), WHOLE)


def op3_token_store(spark, sf_dir):
    path = _folder(spark, "tokens")
    write_tokens(_documents(spark, sf_dir), path, tokenizer_path())
    return read_documents(spark, path)


def op4_ngram_ratio(spark, sf_dir):
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality_rules(_documents(spark, sf_dir), trusted)


def op5_license_rules(spark, sf_dir):
    return scan_licenses(_documents(spark, sf_dir))


def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op7_ngram_jaccard(spark, sf_dir):
    return near_duplicates(_documents(spark, sf_dir))


def op8_spaced_seeds(spark, sf_dir):
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_compression_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         quality_score(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_token_rollups(spark, sf_dir):
    """Load all documents, recount them by another tokenizer version, delete later copies, load again."""
    docs = _documents(spark, sf_dir)
    rollups = TokenRollups(spark, _folder(spark, "rollups"))
    loaded = counted(docs, "words", blank_words)
    rollups.insert("load", loaded)
    rollups.insert("load-marks", counted(docs, "word-marks-draft", blank_words))
    rollups.revise("recount", counted(docs, "word-marks", word_marks), replaces="word-marks-draft")
    keys = docs.select("doc_id", F.sha2("text", 256).alias("content"))
    firsts = keys.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    copies = keys.where("content is not null").select("doc_id").join(firsts.select("doc_id"), "doc_id", "left_anti")
    rollups.delete("copies", copies)
    rollups.insert("load", loaded)
    return rollups.totals()


def op11_exact_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_piece_chunks(spark, sf_dir):
    encoded = encode_pieces(_documents(spark, sf_dir), model_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_turn_repair(spark, sf_dir):
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).summary()


OP10_SQL = r"""
WITH copies AS (
  SELECT doc_id FROM documents
  QUALIFY text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text)),
kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM copies)),
counts AS (
  SELECT source, lang, 'words' AS version,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS tokens FROM kept
  UNION ALL
  SELECT source, lang, 'word-marks',
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \t-\r]')) FROM kept)
SELECT source, lang, version, count(*) AS docs, sum(tokens)::BIGINT AS tokens
FROM counts GROUP BY ALL
"""


def queries():
    listed = [op1_secret_ledger, op2_line_windows, op3_token_store, op4_ngram_ratio, op5_license_rules,
              op6_best_fit_packing, op7_ngram_jaccard, op8_spaced_seeds, op9_compression_quality, op10_token_rollups,
              op11_exact_whitening, op12_piece_chunks, op13_turn_repair]
    return {query.__name__: query for query in listed}


def oracle_sql():
    return {"op10_token_rollups": OP10_SQL}
