"""Quality by compression: how much better a text compresses with a dictionary of good texts.

Two zstandard dictionaries are trained, one on texts labelled good, one on texts labelled
bad. A text is compressed with both, in chunks, so that a long text meets the dictionary as
often as a short one. The difference of the two compressed sizes and the size under the good
dictionary, each divided by the length of the text, become a probability by a logistic
calibration on labelled texts that neither dictionary saw.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.tables import text_column, trim

#: Rejected below this score.
THRESHOLD = 0.7
#: Texts that are held as Python strings at a time.
SCORED = 500
_compressors: dict[tuple[bytes, int], zstandard.ZstdCompressor] = {}


@dataclass(frozen=True)
class FitBounds:
    """What is learned from at most: documents of each label for the dictionaries, and as many others for calibration.

    The dictionaries take ``pieces`` stretches of at most ``piece`` characters of a document, spread over all of it.
    """

    documents: int = 2500
    dictionary_bytes: int = 262144
    level: int = 3
    chunk: int = 2048
    piece: int = 2048
    pieces: int = 4


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and calibration; without both labels, the share of label 1 for every text."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    bounds: FitBounds

    def features(self, texts: list[str]) -> np.ndarray:
        """Size difference and size under the good dictionary, a byte of text, for whole texts."""
        good = _compressor(self.good, self.bounds.level)
        bad = _compressor(self.bad, self.bounds.level)
        rows = np.zeros((len(texts), 2))
        for row, text in enumerate(texts):
            data = text.encode()
            sizes = np.zeros(2)
            for k in range(0, max(1, len(data)), self.bounds.chunk):
                part = data[k: k + self.bounds.chunk]
                sizes += len(good.compress(part)), len(bad.compress(part))
            rows[row] = (sizes[1] - sizes[0], sizes[0])
            rows[row] /= len(data) + 1
        return rows

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        bias, *rest = self.weights
        return 1 / (1 + np.exp(-np.clip(features @ np.array(rest) + bias, -50, 50)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        return self.probabilities(self.features(texts))


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """One compressor for each dictionary in a Python process."""
    if (content, level) not in _compressors:
        if len(_compressors) > 8:
            _compressors.clear()
        if content:
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=level)
            made = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False,
                                            write_dict_id=False)
        else:
            made = zstandard.ZstdCompressor(level=level, write_content_size=False)
        _compressors[content, level] = made
    return _compressors[content, level]


def train_dictionary(texts: list[str], bounds: FitBounds) -> bytes:
    """A dictionary from stretches of texts; their plain bytes where there are too few to train on."""
    pieces = [text.encode() for text in texts if text]
    try:
        return zstandard.train_dictionary(bounds.dictionary_bytes, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-bounds.dictionary_bytes:]


def calibrate(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Logistic weights (bias first) by Newton steps with a small ridge, on the raw features."""
    mean, spread = features.mean(0), features.std(0) + 1e-9
    rows = np.column_stack([np.ones(len(features)), (features - mean) / spread])
    beta = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -50, 50)))
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, rows.T @ (weights * (labels - p)) - 1e-2 * beta)
    slopes = beta[1:] / spread
    return (float(beta[0] - slopes @ mean), *map(float, slopes))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, bounds: FitBounds = FitBounds(), doc_id: str = "doc_id",
                text: str = "text") -> QualityModel:
    """Learn from labelled documents that are not held out.

    At most ``2 * bounds.documents`` of each label are used, those of least hashed id: half for
    the dictionaries, half for the calibration, which weighs them by how often each label occurs
    in the whole label table. Labels other than 0 and 1, null ids and labels without a document
    are not learned from. With one label only, or none, every score is the share of label 1 (1 if none).
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = {row.quality: row["count"] for row in usable.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 1.0
    if len(counts) < 2:
        return QualityModel(b"", b"", (), prior, bounds)
    chosen = None
    for label in (0, 1):
        some = usable.where(F.col("quality") == label).select("doc_id", "quality").distinct().orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(2 * bounds.documents)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 4 * bounds.documents ids, whatever the input.
    learned = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_column(text).alias("text")).join(
        F.broadcast(chosen), "doc_id").withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    step = F.greatest(F.lit(bounds.piece), F.ceil(F.length("text") / bounds.pieces)).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), F.lit(bounds.pieces - 1)),
                            lambda k: F.substring(F.col("text"), k * step + 1, F.lit(bounds.piece)))
    # In an order of its own, so that the layout of the files does not matter.
    tie = F.xxhash64("text").alias("tie")
    trained = learned.where("turn = 0").select("quality", "doc_id", tie, F.posexplode(stretches).alias("place", "part")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "tie", "place").select("quality", F.col("part").alias("text")).toArrow().to_pydict()
    texts = {label: [t for t, q in zip(trained["text"], trained["quality"]) if q == label] for label in (0, 1)}
    draft = QualityModel(train_dictionary(texts[1], bounds), train_dictionary(texts[0], bounds), (), prior, bounds)
    measured = learned.where("turn = 1").mapInArrow(
        _measure(draft, docs.sparkSession), "quality int, difference double, size double").toArrow()
    marks = measured.column("quality").to_numpy()
    if len(set(marks.tolist())) < 2:
        return QualityModel(b"", b"", (), prior, bounds)
    features = np.column_stack([measured.column("difference").to_numpy(), measured.column("size").to_numpy()])
    order = np.lexsort([features[:, 1], features[:, 0], marks])
    features, marks = features[order], marks[order]
    share = {label: counts[label] / total / (marks == label).sum() * len(marks) for label in (0, 1)}
    weights = np.where(marks == 1, share[1], share[0])
    return QualityModel(draft.good, draft.bad, calibrate(features, marks.astype(float), weights), prior, bounds)


def _measure(model: QualityModel, spark):
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.features(batch.column("text").to_pylist())
            yield pa.record_batch({"quality": batch.column("quality"), "difference": pa.array(found[:, 0]),
                                   "size": pa.array(found[:, 1])})
    return run


def quality_score(spark, model: QualityModel, text: str = "text") -> Column:
    """Score column of whole texts, 0 to 1; null and empty texts are scored like one another."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scores = [shared.value.scores(texts.slice(first, SCORED).to_pylist()) for first in range(0, len(texts), SCORED)]
        trim()
        return pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())

    return score(text_column(text))
