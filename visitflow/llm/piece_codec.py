"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding by the library.

A text's encoding has the encoding of each of its prefixes "inside": for every prefix there is exactly
one token that ends it. The table of these tokens is filled from left to right. An Aho-Corasick automaton
names the tokens that end at a place; one of them is the prefix's last token if it may stand beside
the last token of the shorter prefix before it. Two tokens may stand side by side if no merge
across their border comes before the merges that make them. The ids then follow backwards from the end.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import U32, bounded_batches, text_or_empty

#: The mark that stands for a blank (fixed value of the format).
BLANK = "▁"

SCHEMA = "doc_id long, ids binary, decoded string"


class PieceCodec:
    """Encodes as the model's library does; only models of the supported kind are accepted.

    Supported: BPE with byte fallback and unchanged characters (no normalization), a blank put
    before the text, blanks kept, and no piece in which a blank follows another character. Texts then fall into
    parts that begin with blanks, and a memo of parts, cleared at ``memo`` entries, saves most of the work.
    """

    def __init__(self, path: str, memo: int = 500_000):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self._id: dict[str, int] = {}
        self._byte: dict[int, int] = {}
        ranks: dict[str, float] = {}
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self._byte[int(piece[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self._id[piece] = i
                ranks[piece] = -self.library.get_score(i)
        if any(BLANK in piece.lstrip(BLANK) for piece in ranks) or len(self._byte) != 256:
            raise ValueError("unsupported model: a piece holds a blank behind other characters, or bytes are missing")
        if self.library.normalize("  Ａ ́e ") != f"{BLANK * 3}Ａ{BLANK}́e{BLANK}":
            raise ValueError("unsupported model: it normalizes texts")
        self._rank = ranks
        self._piece = {i: piece for piece, i in self._id.items()}
        self._length = {i: len(piece) for piece, i in self._id.items()}
        self._outer = [array("I", [i]).tobytes() for i in (self.library.bos_id(), self.library.eos_id())]
        self._right_spine: dict[str, list[tuple[str, float]]] = {}
        self._left_spine: dict[str, list[tuple[str, float]]] = {}
        self._automaton = ahocorasick.Automaton()
        alphabet = {c for piece in ranks for c in piece}
        for piece in sorted(ranks, key=lambda p: (len(p) > 1, ranks[p], len(p))):  # made from earlier ones
            if self._make(piece):
                self._automaton.add_word(piece, (self._id[piece], len(piece)))
        if not all(c in ranks for c in alphabet):
            raise ValueError("unsupported model: a piece holds a character that is no piece")
        self._automaton.make_automaton()
        #: Characters in no piece become bytes and stand alone; the commonest of them parts texts.
        end = "" if "\n" in alphabet else "\n"
        self._split = re.compile(f"{BLANK}*[^{BLANK}{end}]+|{BLANK}+" + (f"|{end}" if end else ""))
        self._memo_size = memo
        self._memo: dict[str, bytes] = {}
        self._beside: dict[int, bool] = {}  # by the two ids

    def _make(self, piece: str) -> bool:
        """Note the last merge that makes ``piece``; False if no merges lead to it."""
        if len(piece) == 1:
            self._right_spine[piece] = self._left_spine[piece] = [(piece, -1.0)]
            return True
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            if left in self._right_spine and right in self._left_spine and self._meet(left, right):
                # From the border outwards: the pieces at it in the order they are made, with their ranks.
                self._right_spine[piece] = [*self._right_spine[right], (piece, self._rank[piece])]
                self._left_spine[piece] = [*self._left_spine[left], (piece, self._rank[piece])]
                return True
        return False

    def _meet(self, left: str, right: str) -> bool:
        """Whether both pieces are made whole before any merge crosses their border.

        The next merge is the one of the lowest rank. Of equal ranks the leftmost goes first: a merge
        inside the left piece comes before one across the border, and this before one inside the right.
        """
        a, b = self._right_spine[left], self._left_spine[right]
        i = j = 0
        rank = self._rank
        while i < len(a) - 1 or j < len(b) - 1:
            next_a = a[i + 1][1] if i < len(a) - 1 else float("inf")
            next_b = b[j + 1][1] if j < len(b) - 1 else float("inf")
            across = rank.get(a[i][0] + b[j][0])
            if across is not None and across < next_a and across <= next_b:
                return False
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        return True

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side; the answer is kept."""
        a, b = self._piece[left], self._piece[right]
        found = self._beside[left << 32 | right] = a + b not in self._rank and self._meet(a, b)
        return found

    def last_tokens(self, part: str) -> list[int]:
        """For each prefix, by length, the id of its last token; -1 after a character that becomes bytes."""
        last = [-1] * (len(part) + 1)
        done, beside, compatible = 0, self._beside.get, self._compatible
        for end, (token, length) in self._automaton.iter(part):
            end += 1
            if end == done:
                continue
            before = last[end - length]
            if before >= 0:
                fits = beside(before << 32 | token)
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    continue
            last[end] = token
            done = end
        return last

    def _encode_part(self, part: str) -> bytes:
        last, ids, at = self.last_tokens(part), [], len(part)
        lengths = self._length
        while at:
            token = last[at]
            if token < 0:
                ids.extend([self._byte[b] for b in reversed(part[at - 1].encode())])
                at -= 1
            else:
                ids.append(token)
                at -= lengths[token]
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, with the begin and end ids."""
        if len(self._memo) > self._memo_size or len(self._beside) > 4 * self._memo_size:
            self._memo.clear()
            self._beside.clear()
        memo = self._memo
        parts = self._split.findall(BLANK + text.replace(" ", BLANK)) if text else []
        ids = list(map(memo.get, parts))
        for k, found in enumerate(ids):
            if found is None:
                part = parts[k]
                if part not in memo:
                    memo[part] = self._encode_part(part)
                ids[k] = memo[part]
        return b"".join([self._outer[0], *ids, self._outer[1]])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype=U32).tolist())


_codecs: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    """One codec per worker and model file."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_and_decode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, its ids with begin and end, and the text decoded from them.

    A null text is empty and has the two outer ids alone. Null and repeated ids are carried along; an
    empty table gives no rows; other columns are not read. Row-local: no shuffle.
    """
    bounded_batches(docs.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)
        for batch in batches:
            ids = [codec.encode(text) for text in batch.column(1).to_pylist()]
            decoded = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return texts.mapInArrow(code, SCHEMA)
