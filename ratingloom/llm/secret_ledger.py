"""Secret scans over an incremental ledger of blobs.

A blob is a text named by the hash of its content. The ledger is a folder of tables:

``versions``  (doc_id, blob) of every version of every path that was ever ingested
``scanned``   (blob) for each rule version: what need not be scanned again
``findings``  (blob, kind, start, end) for each rule version

Ingesting a table of documents hashes every text, scans only the blobs that the rule version
has not seen, each once however many paths hold it, and joins findings back to all paths.
Rules are regular expressions; everything is DataFrame functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.tables import text_column
from ratingloom.session import stage


@dataclass(frozen=True)
class SecretRule:
    """One kind of secret: a pattern, texts that must occur (lower case) for it to be tried, and a
    least length of one group of a match; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 1


# The base kinds, then kinds of the ledger's own.
BASE_RULES = (
    SecretRule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
               ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6),
    SecretRule("access", "AKIA[A-Z0-9]+", ("akia",), 0, 20),
    SecretRule("hex", "[0-9a-f]{24,}"),
)
OWN_RULES = (
    SecretRule("private-key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("private key-----",)),
    SecretRule("forge-token", "gh[oprsu]_[A-Za-z0-9]{36,}", ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    SecretRule("chat-token", "xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    SecretRule("map-key", "AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    SecretRule("web-token", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    SecretRule("url-password", "[a-z][a-z0-9+.-]*://[^\\s/:@]+:[^\\s/:@]+@", ("://",)),
)


@dataclass(frozen=True)
class RuleSet:
    """Rules in order and the version under which scans are remembered."""

    version: str = "1"
    rules: tuple[SecretRule, ...] = BASE_RULES + OWN_RULES


SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """Leftmost matches of one rule that do not overlap, as spans in code points.

    The text between matches and the matches themselves alternate, so running sums of their
    lengths are the places of the matches.
    """
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    weighed = matched if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.zip_with(between, F.arrays_zip(matched.alias("m"), weighed.alias("w")), lambda b, p: F.struct(
        F.length(b).cast("long").alias("gap"), F.length(p["m"]).cast("long").alias("size"),
        F.length(p["w"]).alias("least")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["least"] >= rule.least, F.concat(state["found"], F.array(span)))
                        .otherwise(state["found"]).alias("found"))

    likely = F.lit(True)
    if rule.hints:
        likely = F.lit(False)
        for hint in rule.hints:
            likely = likely | F.contains(F.lower(text), F.lit(hint))
    tried = likely & F.rlike(text, pattern)
    return F.when(tried, F.aggregate(lengths, empty, step, lambda s: s["found"])).otherwise(
        F.array().cast(f"array<{SPAN}>"))


def find_secrets(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """All spans of a text by start, then order of the rules."""
    return F.sort_array(F.concat(*[spans_of(text, rule, rank) for rank, rule in enumerate(rules)]))


class BlobLedger:
    """A ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """Every version of every path ever ingested: ``(doc_id, blob)``."""
        return self._table("versions", "doc_id long, blob string")

    def findings(self, rules: RuleSet) -> DataFrame:
        """``(blob, spans)`` of the scanned blobs that hold a secret."""
        return self._table(f"findings/rules={rules.version}", f"blob string, spans array<{SPAN}>")

    def scanned(self, rules: RuleSet) -> DataFrame:
        """Blobs that a rule version has seen."""
        return self._table(f"scanned/rules={rules.version}", "blob string")

    def ingest(self, docs: DataFrame, rules: RuleSet = RuleSet(), doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
        """Record the rows as versions, scan what is unseen, and return ``(doc_id, blob, spans)`` of every row.

        A null text is an empty one; it has no spans. Ids may be null or repeat: each row is a
        version of its path. Findings are written before their blobs count as scanned, so an
        interrupted scan is simply done again. Other columns are not looked at.
        """
        rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text"))
        hashed = rows.withColumn("blob", F.sha2("text", 256))
        batch = f"{self.path}/versions/batch={uuid.uuid4().hex}"
        hashed.select("doc_id", "blob").write.parquet(batch)
        versions = self.spark.read.schema("doc_id long, blob string").parquet(batch)
        # One row to read each unseen blob from: of its path with the least hashed id.
        place = F.xxhash64("doc_id")
        holders = versions.select("blob", place.alias("place")).groupBy("blob").agg(F.min("place").alias("place"))
        unseen = stage(holders.join(self.scanned(rules), "blob", "left_anti"), "unseen")
        texts = hashed.withColumn("place", place).join(unseen.df.hint("shuffle_hash"), ["place", "blob"], "left_semi")
        found = texts.select("blob", find_secrets(F.col("text"), rules.rules).alias("spans"))
        # Blobs without a finding are left out after the grouping: a filter before it would be
        # pushed below the join, and known blobs would be scanned as well.
        found.dropDuplicates(["blob"]).where(F.size("spans") > 0).write.mode("append").parquet(f"{self.path}/findings/rules={rules.version}")
        unseen.df.select("blob").write.mode("append").parquet(f"{self.path}/scanned/rules={rules.version}")
        unseen.drop()
        # A scan that was interrupted may have written some findings twice.
        known = stage(self.findings(rules).dropDuplicates(["blob"]), "findings")
        return versions.join(known.df, "blob", "left").select(
            "doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
