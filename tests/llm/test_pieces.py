"""SentencePiece encoding by prefix tables against the library."""

import hashlib
import random

import numpy as np
import pytest

from visitflow.llm.piece_codec import PieceCodec, encode_and_decode
from visitflow.llm.queries import PIECE_MODEL, QUERIES


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PIECE_MODEL, memo=200)  # cleared many times


def library_ids(codec, text):
    return codec.library.encode(text or "", add_bos=True, add_eos=True)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_random_texts(codec, edge_rows):
    draw = random.Random(1)
    alphabet = "abcdefghinorstu      \n\t▁<>/0123.,'éüß日한🙂\x00́ABCTHE"
    some = ["the", "ing", " the", "    ", "tion", "\n\n", "def ", "<s>", "</s>", "<0x0A>", " " * 15, " " * 31, " " * 70, "n't"]
    texts = [row[1] or "" for row in edge_rows]
    texts += ["".join(draw.choice(some if draw.random() < 0.4 else alphabet) for _ in range(draw.randrange(30))) for _ in range(5000)]
    for text in texts:
        assert ids(codec, text) == library_ids(codec, text), text


def test_joined_pieces(codec):
    draw = random.Random(2)
    pieces = [codec.library.id_to_piece(i) for i in range(300, codec.library.get_piece_size())]
    for _ in range(5000):
        text = "".join(draw.choices(pieces, k=draw.randrange(1, 5))).replace("▁", " ")
        assert ids(codec, text) == library_ids(codec, text), text


def test_every_prefix_ends_in_its_last_token(codec):
    part = "▁unbelievabletions"
    last = codec.last_tokens(part)
    for n in range(2, len(part) + 1):
        assert last[n] == codec.library.encode(part[:n].replace("▁", " ").removeprefix(" "))[-1]


def test_odd_documents(codec, edge_rows, clashing_docs, no_docs):
    def order(row):
        return (row[0] is not None, row[0] or 0, row[1])

    got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode_and_decode(clashing_docs, PIECE_MODEL).collect()), key=order)
    expected = []
    for key, text, *_ in edge_rows:
        found = library_ids(codec, text)
        expected.append((key, np.array(found, "<u4").tobytes(), codec.library.decode(found)))
    assert got == sorted(expected, key=order)
    assert encode_and_decode(no_docs, PIECE_MODEL).count() == 0


def test_query(spark, codec, sf):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op8_sentencepiece_prefix_table"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = library_ids(codec, texts[r.doc_id])
        assert r.n_tokens == len(found)
        assert r.ids_sha256 == hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(found).encode()).hexdigest()
