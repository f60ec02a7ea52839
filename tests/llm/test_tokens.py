"""Word tokenizing, token shards and packing against the library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from visitflow.llm.common import WordTokenizer
from visitflow.llm.packing import SumOfSquaresPacker, pack_documents
from visitflow.llm.queries import QUERIES, WORD_VOCABULARY
from visitflow.llm.token_shards import (
    Block,
    EliasFano,
    blocks_of,
    encode_block,
    read_token_shards,
    token_table,
    write_token_shards,
)
from visitflow.session import new_table_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


def encode(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_word_tokenizer_equals_the_library(library, edge_rows):
    tokenizer = WordTokenizer(WORD_VOCABULARY, memo=50)  # the memo is cleared many times
    draw = random.Random(0)
    alphabet = "abcXYZ  \n\t.,'s'tÀé日🙂12½<|>́\x85"
    texts = [row[1] or "" for row in edge_rows]
    texts += ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(500)]
    for text in texts:
        assert tokenizer.encode(text.encode()) == encode(library, text).tobytes(), text


def test_word_tokenizer_on_every_latin_character(library):
    tokenizer = WordTokenizer(WORD_VOCABULARY)
    texts = [text for c in map(chr, range(0x250)) for text in (c, f"{c}li", f"ma{c}li", f"ma{c}", f"a {c}li, b", f"x'{c}")]
    wrong = [text for text in texts if tokenizer.encode(text.encode()) != encode(library, text).tobytes()]
    assert wrong == []


@pytest.mark.parametrize("universe", [0, 1, 7, 1000, 10**6, 2**31])
def test_elias_fano(universe):
    draw = np.random.default_rng(universe % 97)
    values = np.sort(draw.integers(0, universe + 1, 500))
    values[-1] = universe
    sequence = EliasFano.encode(values, universe)
    assert sequence.all().tolist() == values.tolist()
    assert [sequence.select(k) for k in range(len(values))] == values.tolist()
    bits = 8 * (len(sequence.lower) + len(sequence.upper) + 4 * len(sequence.samples))
    assert bits <= len(values) * (3.5 + np.log2(max(1, universe / len(values)))) + 64


def test_block_round_trip():
    documents = [np.arange(n, dtype="<u4").tobytes() for n in (0, 3, 0, 200, 1)]
    content = b"".join(encode_block(2, k, [1, None, 5, 5, -1], documents, width) + b"\n" for k, width in ((0, 2), (1, 4)))
    for k, block in enumerate(blocks_of(content)):
        assert (block.part, block.number, block.keys) == (2, k, [1, None, 5, 5, -1])
        assert [block.document(i).tolist() for i in range(5)] == [list(range(n)) for n in (0, 3, 0, 200, 1)]
    with pytest.raises(ValueError):
        Block(content, 1)


@pytest.mark.parametrize("which", ["edge_docs", "clashing_docs"])
def test_shards_of_odd_documents(spark, library, edge_rows, which, request):
    path = new_table_path(spark, "shards")
    write_token_shards(request.getfixturevalue(which), path, WORD_VOCABULARY, block_tokens=500, blocks_per_file=2)
    got = token_table(spark, path).orderBy("start").collect()
    expected = Counter()
    for key, text, *_ in edge_rows:
        ids = np.append(encode(library, text), 1).astype("<u4")
        expected[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k))
    ids = {r.doc_id: r.ids for r in read_token_shards(spark, path).collect()}
    assert np.frombuffer(ids[12], "<u4").tolist() == [*encode(library, edge_rows[4][1]).tolist(), 1]


def test_shards_of_no_documents(spark, no_docs):
    path = new_table_path(spark, "shards")
    write_token_shards(no_docs, path, WORD_VOCABULARY)
    assert token_table(spark, path).count() == 0


def test_shard_query(spark, library, sf):
    got = sorted(tuple(r) for r in QUERIES["op1_token_shards"](spark, sf).collect())
    start, expected = 0, []
    for key, text in sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.append(encode(library, text), 1).astype("<u4")
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def brute_level(levels, size, window):
    """The level that gives the smallest sum of squares, by trying each."""
    best = None
    for fill in [*range(window - size, 0, -1), 0]:
        if fill and not levels[fill]:
            continue
        after = levels.copy()
        after[fill] -= fill > 0
        after[fill + size] += 1
        cost = int((after[1:window] ** 2).sum())
        if best is None or cost < best[0]:
            best = (cost, fill)
    return best[1]


def test_placement_minimises_the_sum_of_squares():
    draw = random.Random(3)
    packer = SumOfSquaresPacker(32)
    for k in range(400):
        size = draw.randrange(1, 32)
        assert packer.level_for(size) == brute_level(packer.levels, size, 32)
        packer.add(k, bytes(4 * size))


def check_pieces(pieces, documents, window):
    """``pieces`` are rows; ``documents`` their ids by key, in any order of equal keys."""
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
        assert 0 < p.length == len(p.ids) // 4
    for key, texts in documents.items():
        assert sum(p.length for p in found[key]) == sum(map(len, texts))
        if len(texts) == 1:
            ids = b"".join(p.ids for p in sorted(found[key], key=lambda p: p.start))
            assert ids == texts[0].tobytes()
            assert [p.start for p in sorted(found[key], key=lambda p: p.start)][0] == 0
            assert {p.doc_tokens for p in found[key]} == {len(texts[0])}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)


@pytest.mark.parametrize("max_open", [1, 3, 512])
def test_packing_of_odd_documents(library, edge_rows, clashing_docs, max_open):
    documents = defaultdict(list)
    for key, text, *_ in edge_rows:
        documents[key].append(np.append(encode(library, text), 2).astype("<u4"))
    pieces = pack_documents(clashing_docs, WORD_VOCABULARY, window=64, max_open=max_open).collect()
    check_pieces(pieces, documents, 64)


def test_packing_of_no_documents(no_docs):
    assert pack_documents(no_docs, WORD_VOCABULARY).count() == 0


def test_packing_query(spark, library, sf):
    got = QUERIES["op6_sum_of_squares_packing"](spark, sf).collect()
    ids = {
        r.doc_id: np.append(encode(library, r.text), 2).astype("<u4")
        for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    }
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in fills.values())  # no padding at all


def test_many_mixed_texts_at_once(library, monkeypatch):
    """Runs of plain and other words of many texts are looked up together, whatever the size of a chunk."""
    draw = random.Random(9)
    alphabet = ["plain ", "it's ", "日本 ", "Привет", "x1 ", "é ", "<|x|> ", "\n", "́", "🙂 ", "end."]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(300)]
    expected = [encode(library, t).tobytes() for t in texts]
    tokenizer = WordTokenizer(WORD_VOCABULARY)
    calls = []
    look_up = tokenizer._pieces.look_up
    monkeypatch.setattr(tokenizer._pieces, "look_up", lambda found: calls.append(1) or look_up(found))
    assert tokenizer.encode_all([t.encode() for t in texts]) == expected
    assert len(calls) == 1
    monkeypatch.setattr(tokenizer, "CHUNK", 40)
    assert tokenizer.encode_all([t.encode() for t in texts]) == expected
