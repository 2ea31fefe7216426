"""Quality rules: heuristic counts, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into a fixed number of slots. Two smoothed multinomials are
counted over them: of trusted texts and of the whole corpus. A text's score is the mean, over
its n-grams, of the log ratio of both probabilities, so it does not depend on its length.
Every text with a score below a fixed threshold, or that fails the heuristics, is rejected.

All of it is DataFrame functions; texts are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.tables import text_column
from ratingloom.session import stage

WORD_BREAK = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class RatioRule:
    """Slots of the multinomials, smoothing and the threshold."""

    slots: int = 1 << 16
    smoothing: float = 0.5
    threshold: float = -0.1


def words(text: Column) -> Column:
    """Runs of characters other than blank and tab to carriage return."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def _after(values: Column, by: int = 1) -> Column:
    """The values from place ``by`` on; zipped with the values themselves, neighbours meet."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _with_keys(rows: DataFrame) -> DataFrame:
    """Add ``_words`` and the hash of each word, ``_keys``."""
    return rows.withColumn("_words", words(F.col("text"))).withColumn(
        "_keys", F.transform("_words", lambda w: F.xxhash64(w)))


def _slots(rule: RatioRule) -> Column:
    """Slots of all words and pairs of neighbouring words."""
    keys, size = F.col("_keys"), F.lit(rule.slots)
    pairs = F.zip_with(keys, _after(keys), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), size)))
    return F.concat(F.transform(keys, lambda k: F.pmod(k, size)), F.filter(pairs, lambda p: p.isNotNull()))


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside windows of eight that the text has twice or more.

    Windows are hashed, sorted with their places, and compared with their neighbours; the places
    of repeated ones, in order, cover up to eight words each. Texts without a repeated window
    take no more than the hashes.
    """
    keys = F.col("_keys")
    last = F.size(keys) - WINDOW
    hashes = F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(keys, i + k) for k in range(WINDOW)])))
    rows = rows.withColumn("_windows", F.coalesce(hashes, F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(repeats, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_placed", placed)
    same = F.zip_with("_placed", _after(F.col("_placed")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    rows = rows.withColumn("_same", F.when(F.col("_placed").isNotNull(), same))
    marked = F.transform("_placed", lambda p, k: F.when(
        F.get("_same", k) | F.coalesce(F.get("_same", k - 1), F.lit(False)), p["i"]))
    rows = rows.withColumn("_places", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    covered = F.zip_with("_places", _after(F.col("_places")),
                         lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, c: s + c)
    return rows.withColumn("n_repeat_words", F.when(F.col("_placed").isNotNull(), total).otherwise(F.lit(0).cast("long")))


def _ratios(rows: DataFrame, trusted: DataFrame, rule: RatioRule) -> Column:
    """The log ratios of all slots, by slot, as one array of fixed length (a scalar subquery).

    All trusted documents and the whole corpus are counted. The ids grow with the corpus, so the plan is a
    merge join at every size.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    marked = rows.join(ids.withColumn("_trusted", F.lit(1)).hint("merge"), "doc_id", "left")
    counts = (_with_keys(marked).select(F.explode(_slots(rule)).alias("slot"), "_trusted")
              .groupBy("slot").agg(F.count("*").alias("corpus"), F.count("_trusted").alias("target")))
    counts = stage(counts, "slots").df
    spark = rows.sparkSession
    totals = counts.agg(F.sum("corpus").alias("c"), F.sum("target").alias("t")).first()
    a, size = rule.smoothing, rule.slots

    def share(count: Column, total: int | None) -> Column:
        return (F.coalesce(count, F.lit(0)) + a) / ((total or 0) + a * size)

    dense = spark.range(size).select(F.col("id").alias("slot")).join(counts, "slot", "left").select(
        "slot", F.log(share(F.col("target"), totals.t) / share(F.col("corpus"), totals.c)).alias("ratio"))
    if not totals.t:  # without trusted texts there is nothing to tell apart
        dense = dense.withColumn("ratio", F.lit(0.0))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "ratio"))),
                                 lambda x: x["ratio"]).alias("ratios")).scalar()


def quality_rules(docs: DataFrame, trusted: DataFrame, rule: RatioRule = RatioRule(), doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Counts, score and verdict of every row: one row a document.

    ``trusted`` has the ``doc_id`` of trusted documents. Returns ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``. A null or empty text has
    no words, score 0 and fails the base rules. Without trusted documents every score is 0.
    Repeated rows are judged as often as they come, null ids stay null and are never trusted, an
    empty table gives an empty table, other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"))
    ratios = _ratios(rows, trusted, rule)
    judged = _repeated_words(_with_keys(rows)).withColumn("_slots", _slots(rule))
    total = F.aggregate("_slots", F.lit(0.0), lambda s, slot: s + F.get(F.col("_ratios"), slot.cast("int")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    measured = judged.withColumn("_ratios", ratios).withColumn("_lines", lines).select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.when(F.size("_slots") > 0, total / F.size("_slots")).otherwise(F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~failed & (F.col("score") >= rule.threshold)).alias("kept"), "score")
