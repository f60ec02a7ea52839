"""Quality rules: base metrics and distances against slow definitions, verdicts on odd documents."""

import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitflow.llm import quality
from visitflow.llm.quality import (
    CLASSES,
    References,
    base_metrics,
    class_counts,
    jensen_shannon,
    judge,
    keep_good,
    language_references,
    plain_words,
    quality_verdicts,
)
from visitflow.llm.queries import QUERIES


def brute_metrics(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


SAMPLES = [
    "", " ", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\n \nl1\r\nl1", "#a *b $c %d &e |f <g> h", "日 本 日 本 日 本",
    "a b c d a b c e a b", "one\x1ctwo\x85three\xa0four",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_base_metrics(text):
    assert base_metrics(text) == brute_metrics(text)


def test_classes_of_characters(monkeypatch):
    text = "aÀ日1.,!#$+ \t\n\r\x00́é"
    expected = dict(lower=2, upper=1, letter=2, digit=1, stop=2, punctuation=1, symbol=3, blank=3, line=1, other=1)
    assert dict(zip(CLASSES, class_counts(text).tolist(), strict=True)) == expected
    monkeypatch.setattr(quality, "CHUNK", 3)
    assert class_counts(text).tolist() == list(expected.values())


def test_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.4, 0.5])
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    bits = sum(a * math.log2(a / c) for a, c in zip(p, m, strict=True) if a) + sum(b * math.log2(b / c) for b, c in zip(q, m, strict=True) if b)
    assert math.isclose(jensen_shannon(p, q), math.sqrt(bits / 2))
    assert jensen_shannon(p, p) == 0 and jensen_shannon(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def brute_references(rows, common):
    words, classes = {}, {}
    for text, lang in rows:
        if text is None or lang is None or quality.base_failed(brute_metrics(text)[0], brute_metrics(text)[4]):
            continue
        words.setdefault(lang, Counter()).update(plain_words(text))
        classes[lang] = classes.get(lang, 0) + class_counts(text)
    top = {lang: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:common] for lang, found in words.items()}
    return words, classes, top


def test_references_count_every_document(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "COUNTED_AT_ONCE", 10)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.text, r.lang) for r in docs.collect()]
    words, classes, top = brute_references(rows, 5)
    found = language_references(spark.createDataFrame(rows, "text string, lang string"), common_words=5)
    assert found.languages == sorted(top)
    for lang, shares, common, histogram in zip(found.languages, found.shares, found.words, found.classes, strict=True):
        total = sum(words[lang].values())
        assert common == [w for w, _ in top[lang]]
        assert np.allclose(shares, [*(n / total for _, n in top[lang]), 1 - sum(n for _, n in top[lang]) / total])
        assert np.allclose(histogram, classes[lang] / classes[lang].sum())


def test_verdict_takes_the_nearest_language_and_guards_short_texts():
    plain = " ".join(["the of and to a"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(95)])
    counts = Counter(plain_words(plain))
    common = [b"the", b"of"]
    shares = np.array([counts[b"the"], counts[b"of"], 0]) / len(plain_words(plain))
    shares[2] = 1 - shares.sum()
    near = class_counts(plain) / class_counts(plain).sum()
    far = np.zeros(len(CLASSES))
    far[-1] = 1.0
    references = References(["xx", "yy"], [far, near], [[b"zz"], common], [np.array([1.0, 0.0]), shares])
    assert references.class_distance(plain) == 0 and references.word_distance(plain) < 1e-9
    assert judge(plain, references)[-1]
    assert not judge("|" * 30 + " | " * 90 + " ".join(map(str, range(60))), references)[-1]
    assert references.class_distance("short") is None and references.word_distance("short") is None
    nothing = References([], [], [], [])
    assert judge(plain, nothing)[-1] and not judge(None, nothing)[-1] and not judge("too few words", nothing)[-1]


def drawn(draw, vocabulary, n):
    return " ".join(draw.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=n))


def invented(draw, n):
    return ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 9))) for _ in range(n)]


def test_documents_of_invented_words_are_found(spark):
    draw = random.Random(5)
    vocabularies = {lang: invented(draw, 3000) for lang in ("xx", "yy")}
    good = [(k, drawn(draw, v, draw.choice((55, 70, 150, 400, 1000))), lang) for lang, v in vocabularies.items() for k in range(400)]
    # Junk takes a fifth of its words from the language and makes up the others.
    junk = []
    for k in range(80):
        n = draw.choice((70, 150, 400))
        mixed = drawn(draw, vocabularies["xx"], n // 5).split() + invented(draw, n - n // 5)
        junk.append((1000 + k, " ".join(draw.sample(mixed, n)), "xx"))
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string").repartition(3)
    references = language_references(docs)
    rows = quality_verdicts(docs, references).collect()
    assert np.mean([r.kept for r in rows if r.doc_id < 1000]) > 0.98
    assert np.mean([r.kept for r in rows if r.doc_id >= 1000]) < 0.1
    assert references.allowed(0, 50) > references.allowed(0, 500) > references.allowed(0, 5000)


@pytest.mark.parametrize("n", [300, 30_000])
def test_a_junk_document_is_no_reference_of_its_own(spark, n):
    draw = random.Random(6)
    vocabulary = invented(draw, 3000)
    good = [(k, drawn(draw, vocabulary, draw.choice((150, 400))), "xx") for k in range(200)]
    signs = " ".join("".join(draw.choices("0123456789|#$", k=6)) for _ in range(n))
    junk = [(1000, " ".join(invented(draw, n)), "qq"), (1001, " ".join(invented(draw, 300)), "xx"), (1002, signs, "zz")]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string").repartition(3)
    references = language_references(docs)
    assert references.languages == ["xx"]
    kept = {r.doc_id for r in quality_verdicts(docs, references).collect() if r.kept}
    assert len(kept) > 190 and not kept & {1000, 1001, 1002}


def test_labelled_bad_documents_are_found(spark):
    folder = "/root/testdata/sf0.01"
    labels = dict(tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    rows = [r for r in QUERIES["op9_distribution_divergence"](spark, folder).collect() if not r.base_failed]
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) == 1]) > 0.97
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) == 0]) < 0.25


def test_odd_documents(edge_rows, clashing_docs, no_docs):
    references = language_references(clashing_docs)
    assert references.languages  # from the long texts
    rows = quality_verdicts(clashing_docs, references).collect()
    assert Counter(r.doc_id for r in rows) == Counter(row[0] for row in edge_rows)
    texts = {row[0]: row[1] for row in edge_rows if row[0] not in (None, 6)}
    for r in rows:
        if r.doc_id in texts and len(texts[r.doc_id] or "") < 6000:
            assert tuple(r)[1:6] == brute_metrics(texts[r.doc_id])
    kept = keep_good(clashing_docs, references)
    assert kept.columns == clashing_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert language_references(no_docs).languages == []
    assert quality_verdicts(no_docs, references).count() == 0 and keep_good(no_docs, references).count() == 0


def test_query(spark, sf):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    labels = dict(tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op9_distribution_divergence"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r.doc_id]) < 3000:
            assert tuple(r)[1:6] == brute_metrics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.97


def test_fifty_thousand_language_codes(spark, monkeypatch):
    """Codes without evidence are filtered in Spark: only languages with a reference reach the driver."""
    monkeypatch.setattr(quality, "LANGUAGES_AT_ONCE", 50)
    draw = random.Random(8)
    vocabulary = invented(draw, 2000)
    good = [(k, drawn(draw, vocabulary, 200), "xx") for k in range(60)]
    text = drawn(draw, vocabulary, 60)
    noise = spark.range(50_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, text).otherwise("short").alias("text"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("lang")
    )
    docs = spark.createDataFrame(good, "doc_id long, text string, lang string").unionByName(noise).repartition(4)
    references = language_references(docs)
    assert references.languages == ["xx"]
    monkeypatch.setattr(quality, "MOST_LANGUAGES", 1)
    more = docs.unionByName(docs.where("lang = 'xx'").limit(30).withColumn("lang", F.lit("yy")))
    assert language_references(more).languages == ["xx"]


def brute_margin(values, deviations, expected):
    if not values:
        return expected
    middle = statistics.median_low(values)
    deviation = max(quality.LEAST_DEVIATION, 1.4826 * statistics.median_low(abs(v - middle) for v in values))
    return (len(values) * (middle + deviations * deviation) + quality.MIN_JUDGED * expected) / (len(values) + quality.MIN_JUDGED)


def test_margins_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    references = language_references(docs)
    by_word, by_class = {}, []
    for r in docs.collect():
        metrics = base_metrics(r.text or "")
        if quality.base_failed(metrics[0], metrics[4]):
            continue
        distances, n = references.word_distances(plain_words(r.text)), len(plain_words(r.text))
        if distances is not None:
            k = int(distances.argmin())
            by_word.setdefault(k, []).append(distances[k] - references.by_chance(k, n))
        found = references.class_distances(r.text)
        if found is not None:
            k = int(found[0].argmin())
            by_class.append(found[0][k] - quality.by_chance(references.classes[k], found[1]))
    assert references.class_margin == pytest.approx(brute_margin(by_class, 7.0, 0.22), abs=0.01)
    everything = [v for values in by_word.values() for v in values]
    for k, margin in enumerate(references.margins):
        of_all = brute_margin(everything, 3.5, references.expected_margin(k))
        assert margin == pytest.approx(brute_margin(by_word.get(k, []), 3.5, of_all), abs=0.01)
    assert len(everything) > 100
