"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades run from 0 (clean) to 3. The model has one weight per feature, shared by all grades, and ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - weights * features). Features are hashed n-grams of
5 and 6 characters (with blanks at word ends, so stems and short words are features too) that occur in toxic texts
far more often or less often than in clean ones; a feature's value is log(1 + its count).

Labels say toxic or not, so the grade of a toxic training text is the third of toxic texts it falls in by
its number of toxic features. The model is fitted on a sample of at most about ``SAMPLE_ROWS`` labelled
rows (chosen by a hash of the id); every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.llm.common import bounded_batches
from visitflow.llm.language_id import ngrams, pieces
from visitflow.session import materialize

GRADES = 4
ORDERS = (5, 6)
BUCKETS = 1 << 20

#: Labelled rows that the model is fitted on, give or take chance; all of them if there are fewer.
SAMPLE_ROWS = 12_000

#: Different texts of one id in the sample.
TEXTS_OF_ID = 4

#: Tasks that read the sample: each sums its features before they are sent on.
SAMPLE_TASKS = 12

#: Features of the model, and what makes one: texts that have it, and the log of the odds that they are toxic.
MOST_FEATURES = 4096
LEAST_TEXTS = 4
LEAST_LOG_ODDS = 2.0

STEPS = 400
RATE = 0.05
SHRINK = 1e-4


def _present(texts: list[str | None]) -> np.ndarray:
    """Text number times ``BUCKETS`` plus bucket, once for each n-gram that a whole text has.

    Only what is present is kept of each piece, so long texts cost no more than their distinct n-grams.
    """
    keys = [np.zeros(0, np.int64)]
    for rows, parts in pieces(texts):
        bucket, owner = ngrams(parts, ORDERS, BUCKETS)
        keys.append(np.unique(np.asarray(rows)[owner] * BUCKETS + bucket))
    return np.unique(np.concatenate(keys))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Feature number of each bucket (-1: none), weights, and ascending thresholds."""

    feature: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def sparse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, feature number and count of every feature that occurs."""
        n = max(1, len(self.weights))
        keys = [np.zeros(0, np.int64)]
        for rows, parts in pieces(texts):
            bucket, owner = ngrams(parts, ORDERS, BUCKETS)
            feature = self.feature[bucket]
            some = feature >= 0
            keys.append(np.asarray(rows)[owner[some]] * n + feature[some])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        return key // n, key % n, count

    def grade_chances(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text (row) and k below the highest grade (column)."""
        row, feature, count = self.sparse(texts)
        score = np.bincount(row, self.weights[feature] * np.log1p(count), minlength=len(texts))
        return 1.0 - sigmoid(self.thresholds[None, :] - score[:, None])


def fit_ordinal(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, n_features: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood, with shrunk weights, by Adam over all rows.

    The thresholds are the first and the logs of the steps between them, so they stay in order.
    """
    n_cuts = GRADES - 1
    share = np.clip([(grades <= k).mean() for k in range(n_cuts)], 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    parameters = np.concatenate([np.zeros(n_features), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    infinite = np.array([np.inf])
    number = np.arange(len(grades))
    for step in range(1, STEPS + 1):
        weights, steps = parameters[:n_features], np.exp(parameters[n_features + 1 :])
        thresholds = np.cumsum(np.append(parameters[n_features], steps))
        bounds = np.concatenate([-infinite, thresholds, infinite])
        score = np.bincount(row, weights[feature] * value, minlength=len(grades))
        upper, lower = sigmoid(bounds[grades + 1] - score), sigmoid(bounds[grades] - score)
        chance = np.maximum(upper - lower, 1e-12)
        by_score = (upper + lower - 1.0) / len(grades)
        by_cut = np.zeros((len(grades), n_cuts + 2))
        by_cut[number, grades + 1] += upper * (1 - upper) / chance
        by_cut[number, grades] -= lower * (1 - lower) / chance
        by_threshold = by_cut[:, 1:-1].sum(axis=0) / len(grades)
        later = np.cumsum(by_threshold[::-1])[::-1]  # a step moves all thresholds behind it
        gradient = np.concatenate(
            [
                np.bincount(feature, by_score[row] * value, minlength=n_features) - SHRINK * weights,
                later[:1],
                later[1:] * steps,
            ]
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        parameters = parameters + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    steps = np.exp(parameters[n_features + 1 :])
    return parameters[:n_features], np.cumsum(np.append(parameters[n_features], steps))


def _grades(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """0 for clean texts; 1 to 3 for toxic ones, by thirds of their hits; equal hits have equal grades."""
    grades = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(hits[toxic], [(k + 1) / (GRADES - 1) for k in range(GRADES - 2)])
        grades[toxic] = 1 + np.searchsorted(cuts, hits[toxic], side="left")
    return grades


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> OrdinalModel:
    """Fit on labelled documents. ``labels`` has ``doc_id`` and ``toxic`` (0 or 1).

    Null ids, texts and labels are left out. Of several labels of one id the highest counts. Without
    a toxic and a clean text in the sample there is nothing to learn: the model then calls nothing toxic. The sample of
    labels, at most about ``sample_rows`` of a few bytes, is the only thing broadcast; the documents are
    scanned once and not shuffled, but for the sample's own texts. Rows of one id and text count once, and of the
    different texts of one id at most ``TEXTS_OF_ID`` do, chosen by hash: the sample stays bounded if ids repeat.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("_toxic")
    )
    total = known.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    texts = docs.select(F.col(id_column).cast("long").alias("_label_id"), F.col(text_column).cast("string").alias("_text"))
    sample = (
        texts.where("_label_id is not null and _text is not null")
        .join(F.broadcast(chosen), "_label_id")
        .withColumn("_print", F.xxhash64("_text"))
        .dropDuplicates(["_label_id", "_print"])
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_label_id").orderBy("_print")))
        .where(F.col("_rank") <= TEXTS_OF_ID)
        .select("_text", "_toxic")
        .repartition(SAMPLE_TASKS)
    )
    sample = materialize(sample, "toxicity-sample")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)  # the place behind the buckets counts texts
        for batch in batches:
            toxic = batch.column(1).to_numpy() > 0
            present = _present(batch.column(0).to_pylist())
            for k in (0, 1):
                mine = present[toxic[present // BUCKETS] == bool(k)]
                counts[k, :BUCKETS] += np.bincount(mine % BUCKETS, minlength=BUCKETS)
                counts[k, BUCKETS] += int((toxic == bool(k)).sum())
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "clean", "toxic"])

    both = sample.mapInArrow(sums, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    found = {r["bucket"]: r for r in both.where(F.col("bucket") == BUCKETS).collect()}
    n_clean, n_toxic = (found[BUCKETS]["clean"], found[BUCKETS]["toxic"]) if found else (0, 0)
    nothing = OrdinalModel(np.full(BUCKETS, -1, dtype=np.int32), np.zeros(0), np.full(GRADES - 1, np.inf))
    if not n_clean or not n_toxic:
        return nothing
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    chosen_features = (
        both.where((F.col("bucket") < BUCKETS) & (F.col("clean") + F.col("toxic") >= LEAST_TEXTS))
        .withColumn("odds", odds)
        .where(F.abs("odds") >= LEAST_LOG_ODDS)
        .withColumn("weight", F.abs(F.col("odds")) * F.sqrt(F.least(F.col("clean") + F.col("toxic"), F.lit(1e9))))
        .orderBy(F.desc("weight"), "bucket")
        .limit(MOST_FEATURES)
        .select("bucket", "odds")
        .collect()
    )
    feature = np.full(BUCKETS, -1, dtype=np.int32)
    feature[[r["bucket"] for r in chosen_features]] = np.arange(len(chosen_features))
    markers = np.array([r["odds"] > 0 for r in chosen_features], dtype=bool)
    if not len(chosen_features):
        return nothing
    selector = docs.sparkSession.sparkContext.broadcast(OrdinalModel(feature, np.zeros(len(chosen_features)), np.zeros(0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, count = selector.value.sparse(batch.column(0).to_pylist())
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(number, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(count, pa.int64())),
                ],
                ["toxic", "features", "counts"],
            )

    rows = sample.mapInArrow(features, "toxic int, features array<long>, counts array<long>").toArrow()
    toxic = rows["toxic"].to_numpy() > 0
    lengths = np.array([len(x) for x in rows["features"].to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(toxic)), lengths)
    number = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in rows["features"].chunks)])
    count = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in rows["counts"].chunks)])
    hits = np.bincount(row, count * markers[number], minlength=len(toxic))
    weights, thresholds = fit_ordinal(row, number, np.log1p(count), _grades(toxic, hits), len(chosen_features))
    return OrdinalModel(feature, weights, thresholds)


SCHEMA = "doc_id long, grade int, expected_severity double, p_toxic double, toxic boolean"


def toxicity_grades(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: most probable grade by the thresholds, expected severity (0 to 3), chance and verdict. Row-local.

    A null or empty text has no feature and the grade that goes with it, which is 0 unless most training
    texts were toxic. Null and repeated ids are carried along; an empty table gives no rows. Only id and text are read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a fixed number of buckets, features and thresholds

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = sent.value.grade_chances(batch.column(1).to_pylist())
            grades = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(grades, pa.int32()), pa.array(above.sum(axis=1)),
                    pa.array(above[:, 0].copy()), pa.array(grades > 0),
                ],
                ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(grade, SCHEMA)


def keep_clean(docs: DataFrame, model: OrdinalModel, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` of grade 0, with all their columns. Row-local."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = sent.value.grade_chances(batch.column(place).cast(pa.string()).to_pylist())
            yield batch.filter(pa.array(above[:, 0] < 0.5))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))
