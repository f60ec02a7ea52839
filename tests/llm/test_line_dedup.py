"""Line dedup against a brute-force count of every key's documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from visitflow.llm import line_dedup
from visitflow.llm.line_dedup import drop_repeated_lines, keep_bitmaps, line_hashes
from visitflow.llm.queries import QUERIES
from visitflow.session import materialize

DOCS = "doc_id long, text string"


def brute_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))


def brute(docs, min_chars=40, min_documents=5):
    """Kept and all lines of each row."""
    holding = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(brute_key(line)) >= min_chars:
                holding.setdefault(brute_key(line), set()).add(doc)
    largest = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holding.items() if len(ids) >= min_documents}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        out.append((doc, lines, [x for x in lines if brute_key(x) not in largest or largest[brute_key(x)] == doc]))
    return out


def texts_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def expected_texts(docs, **limits):
    kept = zip(docs, brute(docs, **limits), strict=True)
    return sorted(((doc, None if text is None else "\n".join(lines)) for (doc, text), (_, _, lines) in kept), key=repr)


def random_docs(seed, n=120):
    draw = random.Random(seed)
    pool = [f"{'Shared Line ' * 4}{i} ÀÉİß" for i in range(12)] + ["exactly forty code points, as counted: é" , "short", "", " \t "]
    pool += [pool[0].upper().replace("SHARED", "shared"), f"\t {pool[1]} \r", f"\x0b{pool[2].lower()}", "\x85" + pool[3], f"{pool[4]}\xa0"]
    docs = []
    for i in range(n):
        lines = [draw.choice(pool) if draw.random() < 0.5 else f"own line {draw.random()} of some length, long enough to count" for _ in range(draw.randrange(12))]
        docs.append((draw.choice([i, i, i, None, 7]), "\n".join(lines) if draw.random() < 0.95 else None))
    return docs + docs[:5]


@pytest.mark.parametrize("seed", range(4))
def test_random_documents(spark, seed, monkeypatch):
    docs = random_docs(seed)
    if seed % 2:  # most keys are hot
        monkeypatch.setattr(line_dedup, "LEAST_HOT", 3)
        monkeypatch.setattr(line_dedup, "HOT_SHARE", 1000)
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    assert texts_of(drop_repeated_lines(frame)) == expected_texts(docs)
    got = keep_bitmaps(frame, min_chars=5, min_documents=2).selectExpr("row.doc_id", "n_lines", "keep").collect()
    wanted = sorted(((d, len(lines), len(kept)) for d, lines, kept in brute(docs, 5, 2)), key=repr)
    assert sorted(((r["doc_id"], r["n_lines"], sum(x["length"] for x in r["keep"])) for r in got), key=repr) == wanted


def test_bitmaps_are_runs(spark):
    line = "the same line in every document, of forty and more code points"
    docs = [(i, "\n".join(["a", "b", line, line, "c", line, "d"])) for i in range(6)]
    rows = {r["doc_id"]: [tuple(x) for x in r["keep"]] for r in keep_bitmaps(spark.createDataFrame(docs, DOCS)).selectExpr("row.doc_id", "keep").collect()}
    assert rows[5] == [(0, 7)]
    assert all(rows[i] == [(0, 2), (4, 1), (6, 1)] for i in range(5))


def test_hot_line_is_no_group(spark, monkeypatch):
    """A line in every document is found by the sketch, and the groups that are left are small."""
    line = "one line that stands in every document of the table, and is long"
    docs = [(i, f"{line}\n{i} is the number of this document, which no other has\n{line}") for i in range(3000)]
    frame = spark.createDataFrame(docs, DOCS)
    rows = materialize(line_hashes(frame), "lines")
    hot = line_dedup.hot_keys(rows, 5).collect()
    assert [(r["last"], r["often"]) for r in hot] == [(2999, True)]
    assert texts_of(drop_repeated_lines(frame)) == expected_texts(docs)


def test_odd_rows(spark, edge_rows, clashing_docs):
    found = drop_repeated_lines(clashing_docs)
    assert found.columns == clashing_docs.columns
    assert texts_of(found) == expected_texts([row[:2] for row in edge_rows])


def test_empty_table(spark, no_docs):
    assert drop_repeated_lines(no_docs).collect() == []
    assert keep_bitmaps(spark.createDataFrame([(1, None), (2, "")], DOCS)).selectExpr("n_lines", "keep[0].length").collect() == [(1, 1), (1, 1)]


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op13_line_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "ArrowEval", "MapInArrow", "MapInPandas", "ExternalRDD"))
    assert plan.count("rangepartitioning") >= 1


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for d, lines, kept in brute(docs)]
    found = QUERIES["op13_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert any(row[2] for row in expected)
