"""Token counts as delta-maintained rollups.

Totals are additive over (source, lang, version of the tokenizer), so a change of documents is
a signed delta of them. A ledger folder holds, for each committed batch:

``entries/batch=...``  (doc_id, source, lang, version, docs, tokens): signed rows of documents
``deltas/batch=...``   (source, lang, version, docs, tokens): their sums
``commits/batch=...``  written last; a batch without it never happened

The totals are the sums of the committed deltas. Committing a batch again changes nothing; a
batch that broke off is overwritten by its next attempt.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.tables import text_column
from ratingloom.llm.token_ids import encoder

GROUP = ["source", "lang", "version"]
ENTRIES = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"


def blank_words(text: Column) -> Column:
    """Tokens of version ``words``: runs of characters other than blank and tab to carriage return."""
    return F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), "")).cast("long")


def word_marks(text: Column) -> Column:
    """Tokens of version ``word-marks``: runs of ASCII letters and digits, and each other character but blanks."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9 \\t-\\r]")).cast("long")


def file_tokens(path: str):
    """Tokens by a public tokenizer file, as a function of a text column."""
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        _, firsts = encoder(path).encode(texts)
        return pa.array(firsts[1:] - firsts[:-1], pa.int64())
    return count


def counted(docs: DataFrame, version: str, count, text: str = "text") -> DataFrame:
    """Documents as ``(doc_id, source, lang, version, tokens)``; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"),
                       count(text_column(text)).cast("long").alias("tokens"))


class TokenRollups:
    """Rollups in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch string")

    def batches(self) -> list[str]:
        """Committed batches, one name each."""
        return sorted(row.batch for row in self._table("commits", "at timestamp").select("batch").distinct().collect())

    def _committed(self, name: str, schema: str) -> DataFrame:
        rows = self._table(name, schema)
        return rows.join(self._table("commits", "at timestamp").select("batch").distinct(), "batch", "left_semi")

    def current(self) -> DataFrame:
        """What counts at present: ``(doc_id, source, lang, version, docs, tokens)`` where not null and void."""
        return (self._committed("entries", ENTRIES).groupBy("doc_id", *GROUP)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"))

    def totals(self) -> DataFrame:
        """``(source, lang, version, docs, tokens)``; groups that were emptied are left out."""
        return (self._committed("deltas", TOTALS).groupBy(*GROUP)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"))

    def _commit(self, batch: str, entries: DataFrame) -> bool:
        if not batch or set(batch) & set("/=\\:%"):
            raise ValueError(f"a batch name must be a plain folder name, not {batch!r}")
        if batch in self.batches():
            return False
        at = {name: f"{self.path}/{name}/batch={batch}" for name in ("entries", "deltas", "commits")}
        entries.select("doc_id", *GROUP, "docs", "tokens").write.mode("overwrite").parquet(at["entries"])
        written = self.spark.read.schema(ENTRIES).parquet(at["entries"])
        written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode(
            "overwrite").parquet(at["deltas"])
        self.spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(at["commits"])
        return True

    def insert(self, batch: str, rows: DataFrame) -> bool:
        """Add counted documents. False if the batch was committed before; then nothing happens.

        Each row adds one document, repeated rows and null ids included; null groups are groups.
        """
        return self._commit(batch, rows.withColumn("docs", F.lit(1).cast("long")))

    def _retracted(self, ids: DataFrame, version: str | None) -> DataFrame:
        """Present entries of some documents, negated; entries of other documents are not aggregated."""
        wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        entries = self._committed("entries", ENTRIES)
        if version is not None:
            entries = entries.where(F.col("version") == version)
        return (entries.join(wanted, "doc_id", "left_semi").groupBy("doc_id", *GROUP)
                .agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")).where("docs <> 0 or tokens <> 0"))

    def delete(self, batch: str, ids: DataFrame, version: str | None = None) -> bool:
        """Take documents out, of one version or of all; ids that are null or unknown change nothing."""
        return self._commit(batch, self._retracted(ids, version))

    def revise(self, batch: str, rows: DataFrame, replaces: str | None = None) -> bool:
        """Replace documents by newly counted rows: what they counted before, under the version
        ``replaces`` or under all, is taken back and the rows are added. Unknown ones are just added."""
        old = self._retracted(rows, replaces)
        new = rows.select("doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), "tokens")
        return self._commit(batch, old.unionByName(new))
