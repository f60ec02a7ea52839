"""SimHash near-duplicates against pairwise comparison."""

import re

import numpy as np
import pytest
import xxhash

from visitflow.llm import simhash
from visitflow.llm.components import connected_components
from visitflow.llm.queries import QUERIES
from visitflow.llm.simhash import TrieJoin, drop_near_duplicates, fingerprint, near_duplicates, near_links


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_labels(values, budget=4):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    labels = np.arange(len(values))
    while True:
        least = np.where(near, labels[None, :], len(values)).min(axis=1)
        if (least == labels).all():
            return labels
        labels = least


def clustered(seed, n, centres, flips):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 2**64, centres, dtype=np.uint64)[draw.integers(0, centres, n)]
    for _ in range(flips):
        values = values ^ (np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64))
    return np.unique(values)


def test_fingerprints(edge_rows, monkeypatch):
    for text in [row[1] for row in edge_rows]:
        assert fingerprint((text or "").encode()) == brute_fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    text = " ".join(f"a{k % 13}" for k in range(60))
    assert fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(12))
def test_trie_join(seed, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    values = clustered(seed, 300, 1 + seed * 4, seed % 6)
    assert TrieJoin(values, 4).run(np.array([0]), 0).tolist() == brute_labels(values).tolist()


@pytest.mark.parametrize("hot_bucket", [16, 1_000_000])
def test_links_connect_what_pairs_connect(spark, hot_bucket, monkeypatch):
    values = clustered(5, 1500, 40, 5)
    signed = values.view(np.int64)
    rows = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(near_links(rows, 4, hot_bucket)).collect()}
    groups, expected = {}, {}
    for v, label in zip(signed.tolist(), brute_labels(values).tolist(), strict=True):
        groups.setdefault(roots.get(v, v), set()).add(v)
        expected.setdefault(label, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def brute_components(rows):
    prints = [brute_fingerprint(text) for _, text in rows]
    labels = brute_labels(np.array(prints, dtype=np.uint64))
    ids = {}
    for label, (key, _) in zip(labels, rows, strict=True):
        ids.setdefault(label, []).append(key)
    least = {label: min((k for k in keys if k is not None), default=None) for label, keys in ids.items()}
    return prints, [least[label] for label in labels], labels


def order(row):
    return [(x is not None, x or 0) for x in row]


def test_odd_documents(edge_rows, clashing_docs, no_docs):
    rows = [row[:2] for row in edge_rows]
    prints, components, labels = brute_components(rows)
    expected = [(key, int(np.uint64(p).view(np.int64)), c) for (key, _), p, c in zip(rows, prints, components, strict=True)]
    got = [(r.doc_id, r.fp, r.component_id) for r in near_duplicates(clashing_docs).collect()]
    assert sorted(got, key=order) == sorted(expected, key=order)
    kept = drop_near_duplicates(clashing_docs)
    assert kept.columns == clashing_docs.columns
    rows_kept = kept.collect()
    assert len(rows_kept) == len(set(labels.tolist()))
    assert sorted((r.doc_id for r in rows_kept), key=str) == sorted({l: c for l, c in zip(labels, components, strict=True)}.values(), key=str)
    assert near_duplicates(no_docs).count() == 0
    assert drop_near_duplicates(no_docs).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints, components, _ = brute_components(rows)
    expected = sorted((key, f"{p:016x}", c) for (key, _), p, c in zip(rows, prints, components, strict=True))
    assert sorted(tuple(r) for r in QUERIES["op4_simhash_trie"](spark, sf).collect()) == expected


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(7, 7), (None, 3), (500, 501)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert roots == {**{k: 0 for k in range(1, 201)}, 501: 500}
