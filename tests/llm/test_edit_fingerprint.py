"""Edit embedding: walks, sampling, neighbours across tasks, and classes against all pairs."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from visitflow.llm import edit_fingerprint
from visitflow.llm.edit_fingerprint import SLOTS, EditEmbedding, edited_fingerprints, likeness, near_classes
from visitflow.llm.queries import QUERIES

from conftest import words


@pytest.fixture(scope="module")
def walk():
    return EditEmbedding()


def test_pieces_of_a_text_give_its_fingerprint(walk, monkeypatch):
    text = words(4, 2000) + " é日🙂"
    whole = walk.fingerprint(text)
    monkeypatch.setattr(edit_fingerprint, "CHUNK", 97)
    assert walk.fingerprint(text) == whole
    state = walk.read(walk.start(), walk.characters(text[:777]))
    assert walk.read(state, walk.characters(text[777:]))[1].tobytes() == whole
    assert EditEmbedding().fingerprint(text) == whole
    assert walk.fingerprint("") == bytes(SLOTS) and likeness(b"\0", b"\0") == 1.0


def test_few_edits_keep_most_slots(walk):
    draw = random.Random(0)
    near, far = [], []
    for seed in range(20):
        text = words(seed, 400)
        edited = list(text)
        for _ in range(3):
            at = draw.randrange(len(edited))
            edited[at : at + draw.randrange(2)] = draw.choice("xyz")
        near.append(likeness(walk.fingerprint(text), walk.fingerprint("".join(edited))))
        far.append(likeness(walk.fingerprint(text), walk.fingerprint(words(seed + 100, 400, 9000))))
    assert np.mean(near) > 0.8 and min(near) > max(far) and np.mean(far) < 0.4


def test_slots_sample_the_whole_text(walk):
    text = "a" * 20_000
    share = [likeness(walk.fingerprint(text), walk.fingerprint(text[:k] + "b" * (20_000 - k))) for k in (5_000, 10_000, 15_000)]
    assert np.allclose(share, [0.25, 0.5, 0.75], atol=0.15)


def brute(walk, rows):
    out = []
    for k, (key, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(walk.fingerprint, (text, edited, following))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


def test_odd_documents(spark, walk, no_docs, clashing_docs):
    rows = [(3, None), (9, ""), (1, "one"), (4, words(3, 50)), (20, "日本語🙂 text"), (2, " "), (7, words(3, 50)), (8, "b" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, edited_fingerprints(docs).collect()))
    assert got == sorted(brute(walk, sorted(rows, key=lambda r: r[0])))
    assert edited_fingerprints(no_docs).count() == 0
    assert near_classes(edited_fingerprints(no_docs)).count() == 0
    one = spark.createDataFrame([(5, "only one")], "doc_id long, text string")
    [row] = edited_fingerprints(one).collect()
    assert tuple(row) == brute(walk, [(5, "only one")])[0]
    assert near_classes(edited_fingerprints(clashing_docs)).count() == clashing_docs.count()


def brute_classes(prints, least):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if sum(x == y for x, y in zip(a, b, strict=True)) >= least:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("tile", [3, 4096])
def test_classes_are_those_of_all_candidates(spark, tile):
    draw = random.Random(tile)
    prints = []
    for _ in range(6):
        centre = [draw.randrange(4) for _ in range(16)]
        for _ in range(7):
            copy = list(centre)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(16)] = draw.randrange(4)
            prints.append(bytes(copy))
    rows = [(100 + k, p) for k, p in enumerate(prints)] + [(None, None)]
    # Bands of one slot: every pair that agrees in 80 % of 16 slots shares one.
    found = near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint binary"), 0.8, bands=16, tile=tile).collect()
    label = brute_classes(prints, 13)
    groups, expected = defaultdict(set), defaultdict(set)
    for r in found:
        if r.doc_id is not None:
            groups[r.class_id].add(r.doc_id)
    for k, l in enumerate(label):
        expected[100 + l].add(100 + k)
    assert groups == expected
    assert [r.class_id for r in found if r.doc_id is None] == [None]


def test_classes_miss_no_pair_at_the_threshold(spark):
    draw = random.Random(8)
    rows = []
    for k in range(0, 40, 2):
        one = [draw.randrange(256) for _ in range(SLOTS)]
        other = list(one)
        # 25 of 128 slots differ, at least one in each run of eight.
        places = [8 * b + draw.randrange(8) for b in range(16)]
        places += draw.sample(sorted(set(range(SLOTS)) - set(places)), 25 - 16)
        for place in places:
            other[place] = (one[place] + 1 + draw.randrange(255)) % 256
        rows += [(k, bytes(one)), (k + 1, bytes(other))]
    found = near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint binary")).collect()
    assert {r.doc_id: r.class_id for r in found} == {k: k - k % 2 for k in range(40)}


def test_query(spark, walk, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r)[:7] for r in QUERIES["op7_edit_embedding"](spark, sf).collect())
    assert got == sorted((k, n, s, a.hex(), b.hex(), x, y) for k, n, s, a, b, x, y in brute(walk, rows))
