"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, put into NFC, and all that is not a letter becomes one blank between words. Its features are
the counts of its n-grams of 1 to 3 characters in ``BUCKETS`` hash buckets. Training counts are summed over every
labelled text; the model is one matrix of log probabilities, ``BUCKETS`` rows by languages, whose
size is checked before it is broadcast. A batch is scored as one sparse sum: its n-grams gather their
rows of the matrix, which add up by document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import bounded_batches
from visitflow.llm.unicode_table import characters, letters

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5

#: Characters whose n-grams are held at once; longer texts are read in pieces of this length.
CHUNK = 1 << 18

#: So many languages are learned at most, those of the most rows: a broadcast matrix of 200 MB.
MOST_LANGUAGES = 400

#: Languages whose counts a task holds before it sends them on, and languages of a batch that are counted in full arrays.
LANGUAGES_AT_ONCE = 64
FEW_LANGUAGES = 16

UNDETERMINED = "und"


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row numbers, texts) of about :data:`CHUNK` characters; long texts come in pieces."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), CHUNK):
            part = text[at : at + CHUNK]
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def ngrams(
    texts: list[str], orders: tuple[int, ...] = ORDERS, n_buckets: int = BUCKETS
) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each n-gram; n-grams lie within a text and hold a letter.

    ``n_buckets`` is a power of two.
    """
    clean = [f" {unicodedata.normalize('NFC', text.lower())} " for text in texts]
    found = characters("".join(clean))
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    number = np.repeat(np.arange(len(clean)), lengths)
    first = np.zeros(len(found), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    letter = letters()[found]
    keep = letter | first
    keep[1:] |= letter[:-1]  # one blank after each word
    symbols = np.where(letter, found, 32).astype(np.uint32)[keep]
    letter, number = letter[keep], number[keep]
    buckets, owners = [], []
    for order in orders:
        count = max(0, len(symbols) - order + 1)
        mixed = np.full(count, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        inside = number[:count] == number[order - 1 : order - 1 + count]
        some = np.zeros(count, dtype=bool)
        for k in range(order):
            mixed = (mixed ^ symbols[k : k + count]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            some |= letter[k : k + count]
        inside &= some
        buckets.append((mixed[inside] & np.uint32(n_buckets - 1)).astype(np.int64))
        owners.append(number[:count][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    """Languages in ascending order, log probabilities (bucket, language), log priors."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The most probable language of each text and its probability; the first of equals.

        A text that is null or has no letter, and any text if no language was learned, is undetermined, at 0.
        """
        scores = np.tile(self.prior, (len(texts), 1)).astype(np.float64)
        seen = np.zeros(len(texts), dtype=np.int64)
        for rows, parts in pieces(texts):
            buckets, owners = ngrams(parts)
            owners = np.asarray(rows)[owners]
            seen += np.bincount(owners, minlength=len(texts))
            for k in range(len(self.languages)):
                scores[:, k] += np.bincount(owners, self.matrix[buckets, k], minlength=len(texts))
        out = []
        for row, any_letter in zip(scores, seen, strict=True):
            if not any_letter or not len(row):
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(np.argmax(row))
            out.append((self.languages[best], float(1.0 / np.exp(row - row[best]).sum())))
        return out


def fit_languages(
    docs: DataFrame, text_column: str = "text", language_column: str = "lang", most_languages: int = MOST_LANGUAGES
) -> LanguageModel:
    """Learn from every row whose language is not null and whose text has a letter.

    If the column holds more than ``most_languages`` values, those of the most rows are learned, so noise in it costs
    neither the driver nor the broadcast.

    Counts leave a task as (language, bucket, count), summed there first, so the shuffle and the model do not
    grow with the rows but with languages times buckets. No such row gives a model that knows no language.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["lang", "bucket", "n"]
                )
            sums.clear()

        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = {name: k for k, name in enumerate(dict.fromkeys(names))}
            kinds = np.array([order[name] for name in names])
            with_letter = np.zeros(len(texts), dtype=bool)
            for rows, parts in pieces(texts):
                buckets, owners = ngrams(parts)
                owners = np.asarray(rows)[owners]
                with_letter[owners] = True
                mixed = kinds[owners] * BUCKETS + buckets
                if len(order) <= FEW_LANGUAGES:
                    counts = np.bincount(mixed, minlength=len(order) * BUCKETS)
                    keys = np.flatnonzero(counts)
                    counts = counts[keys]
                else:
                    keys, counts = np.unique(mixed, return_counts=True)
                edges = np.searchsorted(keys, np.arange(len(order) + 1) * BUCKETS)
                for name, k in order.items():
                    # The place behind the last bucket counts texts.
                    mine = sums.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                    part = slice(edges[k], edges[k + 1])
                    mine[keys[part] - k * BUCKETS] += counts[part]
            for name, k in order.items():
                if name in sums:
                    sums[name][BUCKETS] += int((with_letter & (kinds == k)).sum())
            if len(sums) > LANGUAGES_AT_ONCE:
                yield from sent()
        yield from sent()

    rows = docs.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(text_column).cast("string").alias(text_column), F.col(language_column).cast("string").alias(language_column)
    )
    often = rows.groupBy(F.col(language_column).alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    # Cut in each task before it meets: at most so many names reach the driver.
    learned = [r["name"] for r in often.orderBy(F.desc("rows"), "name").limit(most_languages).collect()]
    rows = rows.where(F.col(language_column).isin(learned))
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((BUCKETS + 1, len(languages)), dtype=np.float64)
    counts[table["bucket"].to_numpy(), [place[name] for name in names]] = table["n"].to_numpy()
    grams, texts = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS]
    matrix = np.log(grams) - np.log(grams.sum(axis=0)) if languages else grams
    return LanguageModel(languages, matrix, np.log(texts / texts.sum()) if languages else texts)


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` per row; only id and text are read. Row-local.

    Null and repeated ids are carried along. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from training: a quarter of all ids, by their crc32. A null id is not."""
    text = F.col(id_column).cast("long").cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % 4 == 2, F.lit(False))
