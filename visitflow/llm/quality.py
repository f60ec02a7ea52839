"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms of a document, over character classes and over a language's common words, are compared with
reference histograms learned from the whole corpus, one of each per language. The measure is the
Jensen-Shannon distance (base 2, so 0 to 1). Each histogram takes the nearest language, which needs no
label, and has a length below which it says nothing. How far a document's words may lie from a language
is learned too: the distance that its number of words gives by chance, and a margin by the median and the
spread of what the language's documents have beyond theirs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.llm.common import bounded_batches
from visitflow.llm.unicode_table import categories, characters
from visitflow.session import materialize

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BLANKS = " \t\n\r\v\f"

#: Common words of a language in its reference.
COMMON_WORDS = 50

#: A histogram of fewer characters or words says nothing.
MIN_CHARACTERS = 200
MIN_COUNTED_WORDS = 20

#: How far from every language a document may lie before any document says how far they lie; measured distances outweigh
#: it as they come. The distance of words widens for texts of fewer words than ``FULL_WORDS``.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.435
FULL_WORDS = 80

#: A language has a reference from so many characters and words on. Without its longest document, they must still
#: be enough for a histogram, so that no document is a reference of its own.
MIN_REFERENCE_CHARACTERS = 10 * MIN_CHARACTERS
MIN_REFERENCE_WORDS = 10 * FULL_WORDS

#: At most so many languages have a reference, those of the most words: about 2 kB each in a broadcast.
MOST_LANGUAGES = 5000

#: A margin is the median and so many robust deviations: for words the usual limit of a modified z-score; twice that for
#: classes, whose distances have long tails, since a text of many numbers or signs may be good. It counts as much as
#: what is expected without measurement once ``MIN_JUDGED`` documents are measured, and more beyond. Many copies must
#: not shrink the deviation to nothing.
WORD_DEVIATIONS, CLASS_DEVIATIONS = 3.5, 7.0
MIN_JUDGED = 100
LEAST_DEVIATION = 0.01

#: Steps of a distance of 1 in which documents are counted for medians.
STEPS = 2048

#: Entries of a task's word counts, and languages, before they are sent on.
COUNTED_AT_ONCE = 300_000
LANGUAGES_AT_ONCE = 2_000
SENT_AT_ONCE = 20_000

#: Characters whose classes are looked up at once.
CHUNK = 1 << 20

CLASSES = ("lower", "upper", "letter", "digit", "stop", "punctuation", "symbol", "blank", "line", "other")

#: Every byte of ASCII that is no letter becomes a blank.
_TO_WORDS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def _class_table() -> np.ndarray:
    """The class of each code point, by its Unicode category; some of ASCII by name."""
    found = categories()
    major = found.view("S1").reshape(-1, 2)[:, 0]
    table = np.full(len(found), CLASSES.index("other"), dtype=np.uint8)
    for test, name in (
        (major == b"L", "letter"), (major == b"M", "letter"), (found == b"Ll", "lower"), (found == b"Lu", "upper"),
        (major == b"N", "digit"), (major == b"P", "punctuation"), (major == b"S", "symbol"), (major == b"Z", "blank"),
    ):
        table[test] = CLASSES.index(name)
    for signs, name in ((SYMBOLS, "symbol"), (".,", "stop"), (BLANKS, "blank"), ("\n", "line")):
        table[[ord(c) for c in signs]] = CLASSES.index(name)
    return table


_table: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    if not _table:
        _table.append(_class_table())
    counts = np.zeros(len(CLASSES), dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        counts += np.bincount(_table[0][characters(text[at : at + CHUNK])], minlength=len(CLASSES))
    return counts


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation and digits, as UTF-8."""
    return text.lower().encode().translate(_TO_WORDS).split()


def base_metrics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()  # bytes: ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    if n > 3 and len(set(zip(words, words[1:], words[2:], strict=False))) < n - 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        often = np.fromiter((counts[w] > 1 for w in windows), bool, n - 2)
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : k + n - 2] |= often
        repeated = int(covered.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two distributions, base 2."""
    middle = (p + q) / 2

    def divergence(a: np.ndarray) -> float:
        some = a > 0
        return float((a[some] * np.log2(a[some] / middle[some])).sum())

    return float(np.sqrt(max(0.0, (divergence(p) + divergence(q)) / 2)))


def by_chance(shares: np.ndarray, n: int) -> float:
    """About how far ``n`` draws from a distribution lie from it.

    A value that is expected more than once adds 1 / (8 ln 2 n) to the divergence, one that is not there
    half of its share.
    """
    return float(np.sqrt(np.minimum(1 / (8 * np.log(2) * n), shares / 2).sum()))


@dataclass
class References:
    """By language: its class distribution, and its common words with their shares and that of all others."""

    languages: list[str]
    classes: list[np.ndarray]
    words: list[list[bytes]]
    shares: list[np.ndarray]
    #: How far words may lie beyond chance, by language, and classes.
    margins: list[float] | None = None
    class_margin: float | None = None

    def __post_init__(self) -> None:
        self._index = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(self.words)))}
        self._places = [np.array([self._index[w] for w in words], dtype=np.int64) for words in self.words]

    def class_distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """Distance to each language and the number of characters, or None if they are too few or no language is known."""
        counts = class_counts(text)
        n = int(counts.sum())
        if not self.languages or n < MIN_CHARACTERS:
            return None
        return np.array([jensen_shannon(counts / n, r) for r in self.classes]), n

    def class_distance(self, text: str) -> float | None:
        """Distance to the nearest language, or None."""
        found = self.class_distances(text)
        return None if found is None else float(found[0].min())

    def near_classes(self, found: tuple[np.ndarray, int] | None) -> bool:
        """Whether characters of these distances are near a language, or say nothing."""
        if found is None:
            return True
        if self.class_margin is None:
            return float(found[0].min()) <= MAX_CLASS_DISTANCE
        return any(d <= by_chance(self.classes[k], found[1]) + self.class_margin for k, d in enumerate(found[0]))

    def word_distances(self, words: list[bytes]) -> np.ndarray | None:
        """Distance to each language, or None if the words are too few or no language is known."""
        if not self.languages or len(words) < MIN_COUNTED_WORDS:
            return None
        known = [k for k in map(self._index.get, words) if k is not None]
        counts = np.bincount(known, minlength=len(self._index)) if known else np.zeros(len(self._index))
        distances = []
        for places, shares in zip(self._places, self.shares, strict=True):
            own = counts[places]
            histogram = np.append(own, len(words) - own.sum()) / len(words)
            distances.append(jensen_shannon(histogram, shares))
        return np.array(distances)

    def word_distance(self, text: str) -> float | None:
        distances = self.word_distances(plain_words(text))
        return None if distances is None else min(1.0, float(distances.min()))

    def by_chance(self, language: int, n: int) -> float:
        """About how far ``n`` words of a language lie from it."""
        return by_chance(self.shares[language], n)

    def expected_margin(self, language: int) -> float:
        """How far beyond chance words may lie before any document is measured."""
        return MAX_WORD_DISTANCE - self.by_chance(language, FULL_WORDS)

    def allowed(self, language: int, n: int) -> float:
        """How far ``n`` words may lie from a language."""
        margin = self.margins[language] if self.margins else self.expected_margin(language)
        return self.by_chance(language, n) + margin

    def near_words(self, distances: np.ndarray | None, n: int) -> bool:
        """Whether ``n`` words of these distances are near a language, or say nothing."""
        return distances is None or any(d <= self.allowed(k, n) for k, d in enumerate(distances))


def language_references(
    docs: DataFrame, text_column: str = "text", language_column: str = "lang", common_words: int = COMMON_WORDS
) -> References:
    """Histograms of every language over all documents that pass the base rules, and the margins of distances.

    Rows with a null text or language say nothing. A language of less evidence than the minimum has no reference, so
    its documents are judged by the others; if no language has enough, there are no references; beyond
    ``MOST_LANGUAGES``, those of the most words have one. Words are counted in each task first; then their sums are, by
    language and word. Evidence is filtered in Spark before anything is ranked, and the commonest words of each
    language are cut in each task before they meet, so whatever codes the language column holds, to the driver come
    ``common_words`` words and a few class counts for each of a bounded number of languages. A second pass counts
    how far all documents lie from them (see :func:`margins`).
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        totals: Counter = Counter()
        longest: dict[str, tuple[int, int]] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, found in words.items():
                entries = iter(found.items())
                while part := list(islice(entries, SENT_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part), pa.string()),
                            pa.nulls(len(part), pa.int64()),
                            pa.array([word for word, _ in part], pa.binary()),
                            pa.array([n for _, n in part], pa.int64()),
                        ],
                        ["lang", "class", "word", "n"],
                    )
            words.clear()
            rows = [(lang, k, int(n)) for lang, counts in classes.items() for k, n in enumerate(counts)]
            rows += [(lang, len(CLASSES), n) for lang, n in totals.items()]  # the places behind the classes: all words,
            rows += [(lang, len(CLASSES) + 1 + k, n) for lang, most in longest.items() for k, n in enumerate(most)]  # and the longest
            if rows:
                lang, number, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(number, pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array(n, pa.int64())],
                    ["lang", "class", "word", "n"],
                )
            for held in (classes, totals, longest):
                held.clear()

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, _, _, _, repeated = base_metrics(text)
                if base_failed(n, repeated):
                    continue
                found = plain_words(text)
                words.setdefault(lang, Counter()).update(found)
                totals[lang] += len(found)
                classes[lang] = classes.get(lang, 0) + class_counts(text)
                most = longest.get(lang, (0, 0))
                longest[lang] = (max(most[0], len(found)), max(most[1], len(text)))
            if sum(map(len, words.values())) > COUNTED_AT_ONCE or len(totals) > LANGUAGES_AT_ONCE:
                yield from sums()
        yield from sums()

    rows = docs.where(F.col(text_column).isNotNull() & F.col(language_column).isNotNull()).select(
        F.col(text_column).cast("string"), F.col(language_column).cast("string")
    )
    sums = (
        rows.mapInArrow(count, "lang string, class long, word binary, n long")
        .groupBy("lang", "class", "word")
        .agg(F.when(F.col("class") > len(CLASSES), F.max("n")).otherwise(F.sum("n")).alias("n"))
    )
    sums = materialize(sums, "language-sums")  # one row for each language and word; read three times
    told = sums.where(F.col("word").isNull())
    characters_, words_, most_words, most_characters = (
        F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
        for test in (F.col("class") < len(CLASSES), *(F.col("class") == len(CLASSES) + k for k in range(3)))
    )
    evidence = told.groupBy("lang").agg(
        characters_.alias("characters"), words_.alias("words"), most_words.alias("most_words"), most_characters.alias("most_characters")
    )
    enough = (
        (F.col("words") >= MIN_REFERENCE_WORDS) & (F.col("words") - F.col("most_words") >= FULL_WORDS)
        & (F.col("characters") >= MIN_REFERENCE_CHARACTERS) & (F.col("characters") - F.col("most_characters") >= MIN_CHARACTERS)
    )
    known = materialize(evidence.where(enough).orderBy(F.desc("words"), "lang").limit(MOST_LANGUAGES).select("lang", "words"), "languages")
    kept = sums.join(F.broadcast(known), "lang")  # at most MOST_LANGUAGES rows
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = kept.where(F.col("word").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= common_words)
    by_language: dict[str, tuple[int, np.ndarray, list]] = {
        r["lang"]: (r["words"], np.zeros(len(CLASSES)), []) for r in known.collect()
    }
    for row in kept.where(F.col("class") < len(CLASSES)).select("lang", "class", "n").toArrow().to_pylist():
        by_language[row["lang"]][1][row["class"]] = row["n"]
    for row in common.select("lang", "rank", "word", "n").toArrow().to_pylist():
        by_language[row["lang"]][2].append((row["rank"], row["word"], float(row["n"])))
    languages, classes, words, shares = [], [], [], []
    for lang, (total, counts, found) in sorted(by_language.items()):
        languages.append(lang)
        classes.append(counts / counts.sum())
        words.append([word for _, word, _ in sorted(found)])
        often = np.array([n for *_, n in sorted(found)])
        shares.append(np.append(often, total - often.sum()) / total)
    references = References(languages, classes, words, shares)
    references.margins, references.class_margin = margins(docs, references, text_column)
    return references


def _margin(steps: np.ndarray, counts: np.ndarray, deviations: float, expected: float) -> float:
    """Median and deviations of counted steps, weighed by their documents against what is expected without any."""
    n = counts.sum()
    if not n:
        return expected

    def median(values: np.ndarray) -> float:
        order = np.argsort(values)
        return float(values[order][np.searchsorted(np.cumsum(counts[order]), n / 2)])

    middle = median(steps)
    deviation = 1.4826 * median(np.abs(steps - middle)) / STEPS
    measured = middle / STEPS + deviations * max(LEAST_DEVIATION, deviation)
    return float((n * measured + MIN_JUDGED * expected) / (n + MIN_JUDGED))


def margins(docs: DataFrame, references: References, text_column: str = "text") -> tuple[list[float], float | None]:
    """How far beyond chance the words of each language's documents may lie from it, and the classes of any.

    Every document that passes the base rules counts for the language nearest to it. Median and median deviation hold
    while less than half of the documents are junk. A language of few documents leans on all documents, and these, if
    they are few, on the fixed distances. To the driver come counts by language and step.
    """
    if not references.languages:
        return [], None
    sent = docs.sparkSession.sparkContext.broadcast(references)  # at most MOST_LANGUAGES of about 2 kB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                metrics = base_metrics(text)
                if base_failed(metrics[0], metrics[4]):
                    continue
                words = plain_words(text)
                distances = sent.value.word_distances(words)
                if distances is not None:
                    k = int(distances.argmin())
                    found[k, round(STEPS * float(distances[k] - sent.value.by_chance(k, len(words))))] += 1
                classes = sent.value.class_distances(text)
                if classes is not None:
                    k = int(classes[0].argmin())
                    found[-1, round(STEPS * float(classes[0][k] - by_chance(sent.value.classes[k], classes[1])))] += 1
        if found:
            rows = [(k, step, n) for (k, step), n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["k", "step", "n"])

    texts = docs.where(F.col(text_column).isNotNull()).select(F.col(text_column).cast("string"))
    sums = texts.mapInArrow(count, "k long, step long, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).toArrow()
    k, steps, counts = (sums.column(c).to_numpy() for c in ("k", "step", "n"))
    of_words, found = k >= 0, []
    for i in range(len(references.languages)):
        of_all = _margin(steps[of_words], counts[of_words], WORD_DEVIATIONS, references.expected_margin(i))
        found.append(_margin(steps[k == i], counts[k == i], WORD_DEVIATIONS, of_all))
    return found, _margin(steps[k == -1], counts[k == -1], CLASS_DEVIATIONS, MAX_CLASS_DISTANCE)


def judge(text: str | None, references: References) -> tuple:
    """Base metrics, whether they fail, both distances (None: too short, or not asked for), and the verdict."""
    text = text or ""
    metrics = base_metrics(text)
    failed = base_failed(metrics[0], metrics[4])
    classes = None if failed else references.class_distances(text)
    by_class = None if classes is None else float(classes[0].min())
    words = [] if failed else plain_words(text)
    distances = references.word_distances(words)
    by_word = None if distances is None else min(1.0, float(distances.min()))
    kept = not failed and references.near_classes(classes) and references.near_words(distances, len(words))
    return (*metrics, failed, by_class, by_word, kept)


JUDGED = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("class_distance", pa.float64()),
    ("word_distance", pa.float64()), ("kept", pa.bool_()),
]

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def quality_verdicts(docs: DataFrame, references: References, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Metrics, distances and verdict of each row; a null text has no words and fails. Row-local.

    Null and repeated ids are carried along; an empty table gives no rows; other columns are not read. A text of any
    length is judged whole; a task holds it and its words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(references)  # common words and classes: 2 kB for each of at most MOST_LANGUAGES

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text, sent.value) for text in batch.column(1).to_pylist()]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), JUDGED, strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(name for name, _ in JUDGED)])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(verdicts, SCHEMA)


def keep_good(docs: DataFrame, references: References, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Row-local."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(references)
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([judge(text, sent.value)[-1] for text in texts], pa.bool_()))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))
