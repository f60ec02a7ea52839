"""Ranked search against a brute-force ranking of every document for every item."""

import math
import re
from collections import Counter

import pytest

from visitflow.llm import ranked_search as search
from visitflow.llm.queries import QUERIES
from visitflow.llm.ranked_search import ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k=10):
    bags = [(doc, brute_terms(text)) for doc, text in docs]
    bags = [(doc, terms) for doc, terms in bags if terms]
    total, length = len(bags), sum(len(terms) for _, terms in bags)
    holding = Counter(term for _, terms in bags for term in set(terms))
    out = []
    for item, text in items:
        scores = []
        for doc, terms in bags:
            m, score = 10 + 90 * len(terms) * total // length, 0
            for term in set(brute_terms(text)) & set(terms):
                df, tf = holding[term], terms.count(term)
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    for text in ["", "a1_b-C\x00d\x7fe", "Él İx ſ ﬁ z\x85y", "9~`@[{/:", "日本 語🙂"]:
        assert [t.decode() for t in terms_of(text.encode())] == brute_terms(text)


ODD_ITEMS = [
    (1, "w1 w2 W3 w3 one naïve 日本語"),
    (1, "w1 w2 W3 w3 one naïve 日本語"),
    (2, None),
    (None, "other café no id"),
    (4, "..."),
    (5, "absent entirely"),
    (6, " ".join(f"w{i}" for i in range(400))),
]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, edge_rows, clashing_docs, small, monkeypatch):
    if small:
        monkeypatch.setattr(search, "BLOCK_ITEMS", 2)
        monkeypatch.setattr(search, "GROUPED_BYTES", 1000)
        monkeypatch.setattr(search, "CLASSES_AT_ONCE", 1)
    expected = brute_ranking([row[:2] for row in edge_rows], ODD_ITEMS, k=4)
    assert rows_of(ranked_search(clashing_docs, spark.createDataFrame(ODD_ITEMS, ITEMS), k=4)) == expected
    assert any(row[2] is None for row in expected)


def test_blocks_end_by_terms(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 3)
    blocks = list(search.item_blocks(spark.createDataFrame(ODD_ITEMS, ITEMS)))
    assert sorted(len(b.ids) for b in blocks) == [1] * 5


def test_large_class_and_ties(spark):
    """One bag in most rows: its smallest ids rank, also where many copies tie with other bags of equal score."""
    docs = [(i, "alpha beta beta") for i in range(3000, 0, -1)] + [(5000 + i, "beta alpha Beta") for i in range(40)]
    docs += [(-i, f"alpha filler{i} more") for i in range(1, 30)] + [(9000, "beta"), (9001, "beta")]
    items = [(0, "alpha"), (1, "beta gamma"), (2, "filler3 filler4")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert rows_of(ranked_search(frame, spark.createDataFrame(items, ITEMS))) == brute_ranking(docs, items)


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    """All classes under one hash still are classes of their own."""
    monkeypatch.setattr(search.F, "xxhash64", lambda *_: search.F.lit(0))
    docs = [(i, f"alpha t{i % 5} t{i % 3}") for i in range(60)]
    items = [(i, f"t{i} alpha") for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(ranked_search(frame, spark.createDataFrame(items, ITEMS))) == brute_ranking(docs, items)


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "w1")], ITEMS)
    assert rows_of(ranked_search(no_docs, some)) == rows_of(ranked_search(edge_docs, none)) == []
    assert rows_of(ranked_search(spark.createDataFrame([(1, None), (2, "!?")], "doc_id long, text string"), some)) == []


def test_query(spark, sf):
    found = QUERIES["op11_bag_search"](spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        ("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint"),
    ]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(found) == brute_ranking(docs, items)
