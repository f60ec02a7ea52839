"""Language identification against a slow copy of the formula, and held-out accuracy."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitflow.llm import language_id
from visitflow.llm.language_id import BUCKETS, ORDERS, SMOOTHING, LanguageModel, fit_languages, held_out, identify_languages, ngrams
from visitflow.llm.queries import QUERIES


def brute_grams(text):
    """n-grams of words of letters, one blank on each side, as text."""
    clean = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in unicodedata.normalize("NFC", text.lower()))
    joined = " " + "".join(word + " " for word in clean.split())
    return [joined[i : i + n] for n in ORDERS for i in range(len(joined) - n + 1) if joined[i : i + n].strip()]


def test_ngrams_are_those_of_each_text():
    texts = ["Don't, it's 12 Àé", "", "a", "日本 x", "...", "ab ab"]
    buckets, owners = ngrams(texts)
    for k, text in enumerate(texts):
        mine = Counter(buckets[owners == k].tolist())
        grams = Counter(brute_grams(text))
        assert sorted(mine.values()) == sorted(grams.values()) or len(mine) < len(grams)  # two may share a bucket
        assert sum(mine.values()) == sum(grams.values())


def test_fit_and_predict_follow_the_formula(spark, monkeypatch):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the end", "en"), ("1 2 3", "fr"), (None, "en"), ("xx", None)]
    model = fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "fr"]
    counts = {}
    for lang in model.languages:
        buckets, _ = ngrams([t for t, name in rows if name == lang and t])
        counts[lang] = np.bincount(buckets, minlength=BUCKETS)
    text = "the chat"
    score = []
    for lang, texts in (("en", 2), ("fr", 1)):  # texts with a letter
        total = counts[lang].sum() + SMOOTHING * BUCKETS
        score.append(math.log(texts / 3) + sum(math.log((counts[lang][b] + SMOOTHING) / total) for b in ngrams([text])[0]))
    best = int(np.argmax(score))
    expected = (model.languages[best], 1 / sum(math.exp(s - score[best]) for s in score))
    [(lang, chance)] = model.predict([text])
    assert lang == expected[0] and abs(chance - expected[1]) < 1e-9
    long = "le chat " * 50
    [whole] = model.predict([long])
    monkeypatch.setattr(language_id, "CHUNK", 64)
    [in_pieces] = model.predict([long])
    assert whole[0] == in_pieces[0] == "fr"


def test_odd_documents(edge_rows, clashing_docs, no_docs):
    model = fit_languages(clashing_docs)
    got = identify_languages(clashing_docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(row[0] for row in edge_rows)
    for r in got:
        assert r.lang_pred in {"en", "de", "und"} and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id == 0} == {"und"}  # null text
    nothing = fit_languages(no_docs)
    assert nothing.languages == [] and nothing.predict(["some text"]) == [("und", 0.0)]
    assert identify_languages(no_docs, model).count() == 0


def test_equal_chances_go_to_the_first_language():
    model = LanguageModel(["aa", "bb"], np.zeros((BUCKETS, 2)), np.log(np.array([0.5, 0.5])))
    assert model.predict(["text"]) == [("aa", 0.5)]


def test_query(spark, sf):
    rows = QUERIES["op2_naive_bayes_language"](spark, sf).collect()
    truth = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.95


def test_prediction_reads_no_label(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_languages(docs.where(~held_out()))
    plain = identify_languages(docs, model).orderBy("doc_id").collect()
    other = identify_languages(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model)
    assert other.orderBy("doc_id").collect() == plain


def test_fifty_thousand_language_codes(spark):
    """Noise in the language column: the codes of the most rows are learned, and no more reach the driver."""
    rows = [(k, "the cat and the dog", "en") for k in range(40)] + [(k, "le chat et le chien", "fr") for k in range(30)]
    noise = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("zzz qqq").alias("text"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(noise)
    model = fit_languages(docs, most_languages=40)
    assert len(model.languages) == 40 and {"en", "fr"} < set(model.languages)
    assert [lang for lang, _ in model.predict(["the dog", "le chien"])] == ["en", "fr"]


def test_whole_query_against_brute_force(spark, sf):
    """Model and predictions of the query, from the formula over dictionaries of counts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts, texts = {}, {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 or r.lang is None or not r.text:
            continue
        buckets = ngrams([r.text])[0].tolist()
        if buckets:
            counts.setdefault(r.lang, Counter()).update(buckets)
            texts[r.lang] = texts.get(r.lang, 0) + 1
    langs = sorted(counts)
    totals = {lang: sum(counts[lang].values()) + 0.5 * BUCKETS for lang in langs}
    found = {r.doc_id: r for r in QUERIES["op2_naive_bayes_language"](spark, sf).collect()}
    for r in docs[:80]:
        grams = Counter(ngrams([r.text or ""])[0].tolist())
        if not grams:
            assert found[r.doc_id].lang_pred == "und"
            continue
        logs = [
            math.log(texts[lang] / sum(texts.values())) + sum(n * math.log((counts[lang][b] + 0.5) / totals[lang]) for b, n in grams.items())
            for lang in langs
        ]
        best = max(logs)
        assert found[r.doc_id].lang_pred == langs[logs.index(best)]
        assert found[r.doc_id].score == pytest.approx(1 / sum(math.exp(x - best) for x in logs), abs=1e-6)
