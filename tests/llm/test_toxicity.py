"""Ordinal regression: likelihood, order of thresholds, held-out accuracy, odd input."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitflow.llm import toxicity
from visitflow.llm.language_id import ngrams
from visitflow.llm.queries import QUERIES
from visitflow.llm.toxicity import BUCKETS, GRADES, OrdinalModel, _grades, fit_ordinal, fit_toxicity, keep_clean, sigmoid, toxicity_grades


def test_fit_finds_the_model_that_made_the_data():
    draw = np.random.default_rng(0)
    n, weights, cuts = 6000, np.array([2.0, -1.0]), np.array([0.0, 1.5, 3.0])
    values = draw.random((n, 2)) * 2
    noise = np.log(1 / draw.random(n) - 1)
    grades = np.searchsorted(cuts, values @ weights + noise)
    row, feature = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    found, thresholds = fit_ordinal(row, feature, values.reshape(-1), grades, 2)
    assert np.allclose(found, weights, atol=0.25) and np.allclose(thresholds, cuts, atol=0.3)
    assert (np.diff(thresholds) > 0).all()


def test_expected_severity_is_the_sum_of_chances():
    feature = np.full(BUCKETS, -1, dtype=np.int32)
    model = OrdinalModel(feature, np.zeros(0), np.array([1.0, 2.0, 3.0]))
    above = model.grade_chances(["any", None])
    assert np.allclose(above, 1 - sigmoid(np.array([[1.0, 2.0, 3.0]] * 2)))
    grade_chance = -np.diff(np.hstack([np.ones((2, 1)), above, np.zeros((2, 1))]))
    assert np.allclose(above.sum(axis=1), grade_chance @ np.arange(GRADES))


def test_grades_are_thirds_and_ties_stay_together():
    toxic = np.array([False, True, True, True, True, True, True])
    assert _grades(toxic, np.array([9, 1, 1, 2, 2, 5, 6])).tolist() == [0, 1, 1, 2, 2, 3, 3]
    assert _grades(toxic, np.array([9, 4, 4, 4, 4, 4, 4])).tolist() == [0, 1, 1, 1, 1, 1, 1]
    assert _grades(np.zeros(2, bool), np.zeros(2)).tolist() == [0, 0]


@pytest.fixture(scope="module")
def made(spark):
    """Toxic texts hold stems with endings that differ; every third row has no label."""
    draw = np.random.default_rng(1)
    rows = []
    for k in range(900):
        words = [f"word{draw.integers(200)}" for _ in range(60)]
        toxic = k % 5 == 0
        for _ in range(int(toxic) * int(draw.integers(2, 12))):
            words[draw.integers(60)] = f"vilest{chr(97 + draw.integers(26))}{chr(97 + draw.integers(26))}"
        rows.append((k, " ".join(words), int(toxic), k % 3 != 0))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, labelled boolean")


def test_unlabelled_documents_are_told_apart(spark, made):
    model = fit_toxicity(made, made.where("labelled").select("doc_id", "toxic"))
    found = toxicity_grades(made, model).withColumnRenamed("toxic", "called").join(made, "doc_id").where("not labelled").collect()
    assert all(r.called == bool(r.toxic) for r in found)
    toxic = [r for r in found if r.toxic]
    counts = [r.text.count("vilest") for r in toxic]
    assert np.corrcoef(counts, [r.expected_severity for r in toxic])[0, 1] > 0.8
    kept = keep_clean(made, model)
    assert kept.columns == made.columns and kept.where("not labelled and toxic = 1").count() == 0


def test_repeated_ids_do_not_grow_the_sample(spark, made, monkeypatch):
    labels = made.where("doc_id < 300").select("doc_id", "toxic")
    sizes = []
    copies = made.where("doc_id = 3").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("copy")
    texts = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("other text "), "id").alias("text"))
    many = made.unionByName(copies).unionByName(texts, allowMissingColumns=True)
    with monkeypatch.context() as patch:
        patch.setattr(toxicity, "materialize", lambda df, name, put=toxicity.materialize: sizes.append((t := put(df, name)).count()) or t)
        fit_toxicity(made, labels)
        fit_toxicity(many, labels)
    assert sizes[0] == 300 and 300 <= sizes[1] <= 299 + toxicity.TEXTS_OF_ID


def test_odd_documents(spark, edge_rows, edge_docs, clashing_docs, no_docs, made):
    labels = made.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None), (0, 0)], "doc_id long, toxic int"))
    model = fit_toxicity(made, labels.withColumn("text", F.lit("x")))
    rows = toxicity_grades(clashing_docs, model).collect()
    assert len(rows) == len(edge_rows) and not any(r.toxic for r in rows)
    assert keep_clean(clashing_docs, model).columns == clashing_docs.columns
    assert toxicity_grades(no_docs, model).count() == 0 and keep_clean(no_docs, model).count() == 0
    for docs, known in ((no_docs, labels), (edge_docs, labels.limit(0)), (edge_docs, labels.where("toxic = 0"))):
        nothing = fit_toxicity(docs, known)
        assert toxicity_grades(edge_docs, nothing).where("toxic").count() == 0


def test_query(spark, sf):
    rows = QUERIES["op5_ordinal_toxicity"](spark, sf).collect()
    labels = dict(tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.expected_severity <= GRADES - 1 and (r.grade > 0) == r.toxic for r in rows)
    assert np.mean([r.toxic == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]) > 0.9


def test_whole_query_against_brute_force(spark, sf):
    """Sample, features by log odds, grades, fit and every row's chances, recomputed with dictionaries."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    toxic = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.toxic is not None:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    grams = {doc: Counter(ngrams([text or ""], toxicity.ORDERS, BUCKETS)[0].tolist()) for doc, text in docs}
    sample = sorted(doc for doc, text in docs if text is not None and doc in toxic)
    texts = [sum(toxic[doc] == k for doc in sample) for k in (0, 1)]
    holding = [Counter(b for doc in sample if toxic[doc] == k for b in grams[doc]) for k in (0, 1)]
    ranked = []
    for bucket in holding[0].keys() | holding[1].keys():
        clean, bad = holding[0][bucket], holding[1][bucket]
        odds = math.log((bad + 0.5) / (texts[1] + 1)) - math.log((clean + 0.5) / (texts[0] + 1))
        if clean + bad >= toxicity.LEAST_TEXTS and abs(odds) >= toxicity.LEAST_LOG_ODDS:
            ranked.append((-abs(odds) * math.sqrt(clean + bad), bucket, odds))
    chosen = {bucket: (i, odds > 0) for i, (_, bucket, odds) in enumerate(sorted(ranked)[: toxicity.MOST_FEATURES])}
    assert len(chosen) > 20
    cells = [(row, chosen[b][0], n, chosen[b][1]) for row, doc in enumerate(sample) for b, n in sorted(grams[doc].items()) if b in chosen]
    hits = np.zeros(len(sample))
    for row, _, n, marker in cells:
        hits[row] += n * marker
    grades = _grades(np.array([toxic[doc] > 0 for doc in sample]), hits)
    row, feature, count = (np.array([c[i] for c in cells]) for i in range(3))
    weights, thresholds = fit_ordinal(row, feature, np.log1p(count), grades, len(chosen))
    found = {r.doc_id: r for r in QUERIES["op5_ordinal_toxicity"](spark, sf).collect()}
    assert len(found) == len(docs)
    for doc, _ in docs:
        score = sum(weights[chosen[b][0]] * math.log1p(n) for b, n in grams[doc].items() if b in chosen)
        above = [1 / (1 + math.exp(min(500, t - score))) for t in thresholds]
        assert found[doc].p_toxic == pytest.approx(above[0], abs=2e-3)
        assert found[doc].expected_severity == pytest.approx(sum(above), abs=5e-3)
        if abs(above[0] - 0.5) > 0.01:
            assert found[doc].toxic == (above[0] >= 0.5)
