"""Helpers that several operators share: Arrow columns, word tokenizing, shared tables."""

from __future__ import annotations

import gc
import itertools
import os
import re
import time
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch while texts are in Python: a batch then stays far below a worker's memory
#: even if all of its texts are very long.
BATCH_ROWS = 250

U32 = np.dtype("<u4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Make the session ready for texts in Python.

    Lowers the rows per Arrow batch to :data:`BATCH_ROWS` (a smaller value stays), and lets workers that
    share the driver's disk find this package, from whatever folder the session was started.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done, which it does once their plans are collected as garbage.

    The first collection lets go of what Python and Spark's queues still held, the second of the plans.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop, whatever its scheme."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _plain_characters() -> str:
    """The characters that texts are split by here, escaped for a character class: their lower case must lie there too."""
    kept = [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x132, 0x250)]
    return "".join(f"\\u{i:04x}" for i in kept if all(ord(c) in kept for c in chr(i).lower()))


class Memo:
    """Ids of texts, made by ``make`` when they are new; kept in flat arrays of at most ``size`` entries.

    Beyond that, entries that were not asked for since the last cut go, so common texts are never made again,
    however many rare ones pass through.
    """

    def __init__(self, make: Callable[[str], list[int]], size: int):
        self._make, self._size = make, size
        self._clear()

    def _clear(self) -> None:
        self._known = pa.array([], pa.string())
        self._sizes, self._ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U32)
        self._used = np.zeros(0, dtype=bool)

    def _cut(self) -> None:
        if self._used.all():
            self._clear()
            return
        self._ids = self._ids[np.repeat(self._used, self._sizes)]
        self._known, self._sizes = self._known.filter(pa.array(self._used)), self._sizes[self._used]
        self._used = np.zeros(len(self._sizes), dtype=bool)

    def look_up(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(first, size, ids)``: the ids of each of the different ``texts`` are ``ids[first : first + size]``."""
        if len(self._sizes) > self._size:
            self._cut()
        found = pc.index_in(texts, value_set=self._known)
        new = texts.filter(found.is_null())
        if len(new):
            flat: list[int] = []
            sizes = []
            for text in new.to_pylist():
                ids = self._make(text)
                flat += ids
                sizes.append(len(ids))
            self._known = pa.concat_arrays([self._known, new])
            self._sizes = np.concatenate([self._sizes, np.array(sizes, dtype=np.int64)])
            self._ids = np.concatenate([self._ids, np.array(flat, dtype=U32)])
            self._used = np.concatenate([self._used, np.zeros(len(new), dtype=bool)])
        at = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self._sizes) - len(new), len(self._sizes))
        self._used[at] = True
        return (np.cumsum(self._sizes) - self._sizes)[at], self._sizes[at], self._ids


#: Kinds of characters that the pre-tokenizer of the vocabulary tells apart.
_SPACE, _LETTER, _NUMBER, _MARK = range(4)


def _kinds() -> np.ndarray:
    kinds = np.full(0x250, _MARK, dtype=np.uint8)
    for i in range(0x250):
        kinds[i] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(i))[0], _MARK)
    kinds[[*range(0x09, 0x0E), 0x20]] = _SPACE
    return kinds


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, one library call per new piece.

    The vocabulary's pre-tokenizer never crosses white space, and its normalizer (NFC, lower case)
    works on each side of it alone, so a text's ids are its pieces' ids in a row. Texts of Latin
    characters are cut into pieces here, many texts at once, and the library's model encodes each piece that
    is new; words with any other character go to the whole library, word by word. Memos of about ``memo`` entries a
    generation hold what was encoded, so memory stays bounded and results do not depend on it.
    """

    #: Texts whose NFC form and lower case the library and Python agree on, character by character.
    _PLAIN = re.compile(f"[{_plain_characters()}]*")
    _KINDS = _kinds()
    #: Endings that the pre-tokenizer's pattern cuts off behind an apostrophe (fixed values of the vocabulary file).
    _ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
    #: Characters of text that are cut at once.
    CHUNK = 4 << 20

    def __init__(self, path: str, memo: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The symbols that stand for the bytes of each character beyond ASCII; ASCII ones stand for themselves.
        self._symbols = {i: alphabet.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x250)}
        self._pieces = Memo(self._piece, memo)
        self._others = Memo(self._other, memo)
        self.vocabulary_size = max(self._library.get_vocab(with_added_tokens=True).values()) + 1

    def _piece(self, piece: str) -> list[int]:
        """Encode a new piece; the model's alphabet stands for bytes, and white space has no ids."""
        if piece[0] <= " ":
            return []
        return [t.id for t in self._model.tokenize(piece if piece.isascii() else piece.translate(self._symbols))]

    def _other(self, word: str) -> list[int]:
        return self._library.encode(word, add_special_tokens=False).ids

    def _is_plain(self, text: str) -> bool:
        return bool(self._PLAIN.fullmatch(text)) and "<|" not in text

    def _bounds(self, data: np.ndarray) -> np.ndarray:
        """Where the pieces, and the white space between them, begin in lower-case bytes; and the end."""
        kinds = self._KINDS[np.minimum(data, 0x7F)]
        wide = np.flatnonzero(data >= 0xC0)  # first bytes of two
        kinds[wide] = self._KINDS[((data[wide].astype(np.int32) & 0x1F) << 6) | (data[wide + 1] & 0x3F)]
        kinds[wide + 1] = kinds[wide]
        begins = np.empty(len(data) + 1, dtype=bool)
        begins[0] = begins[-1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:-1])
        begins[np.flatnonzero(kinds == _NUMBER)] = True  # each number alone
        begins[wide + 1] = False
        marks = np.flatnonzero(data[:-1] == 0x27)
        marks = marks[begins[marks] & (kinds[marks + 1] == _LETTER)]  # a lone apostrophe before a letter
        rest = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
        for ending in self._ENDINGS:
            found = marks
            for i, c in enumerate(ending.encode(), 1):
                found = found[rest[found + i] == c]
            begins[found + 1] = False
            begins[found + 1 + len(ending)] = True
        return np.flatnonzero(begins)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: pieces are looked up once each, and put in place together."""
        encoded = [text.lower().encode() for text in texts]
        joined = b"\n".join(encoded) + b"\n"  # no text is followed by the next one's piece
        bounds = self._bounds(np.frombuffer(joined, dtype=np.uint8))
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined))
        told = pieces.dictionary_encode()
        first, size, ids = self._pieces.look_up(told.dictionary)
        which = told.indices.to_numpy()
        counts = size[which]
        after = np.cumsum(counts)
        at = np.arange(after[-1]) + np.repeat(first[which] - after + counts, counts)
        found = ids[at].tobytes()
        ends = np.cumsum([len(e) + 1 for e in encoded])
        tokens = np.concatenate([[0], after])[np.searchsorted(bounds, np.concatenate([[0], ends]))] * 4
        return [found[a:b] for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)]

    def _whole_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the library has to read whole."""
        told = pa.array(words, pa.string()).dictionary_encode()
        first, size, ids = self._others.look_up(told.dictionary)
        bounds = zip(first.tolist(), (first + size).tolist(), strict=True)
        found = [ids[a:b].tobytes() for a, b in bounds]
        return [found[i] for i in told.indices.to_pylist()]

    def _parts(self, text: str) -> list[str]:
        """The text, cut at white space into parts of about a chunk."""
        if len(text) <= self.CHUNK:
            return [text]
        space = re.compile(r"\s")
        parts, at = [], 0
        while at < len(text):
            cut = space.search(text, at + self.CHUNK)
            end = cut.start() if cut else len(text)
            parts.append(text[at:end])
            at = end
        return parts

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of UTF-8 texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        plain: list[tuple[int, int, str]] = []  # row, place in it, text; looked up together, a chunk at a time
        others: list[tuple[int, int, str]] = []
        size = 0

        def put(queue: list[tuple[int, int, str]], row: int, text: str) -> None:
            nonlocal size
            queue.append((row, len(out[row]), text))
            out[row].append(b"")
            size += len(text)
            if size >= self.CHUNK:
                flush()

        def flush() -> None:
            nonlocal size
            for queue, encode in ((plain, self._plain), (others, self._whole_words)):
                if queue:
                    for (row, place, _), ids in zip(queue, encode([text for *_, text in queue]), strict=True):
                        out[row][place] = ids
                    queue.clear()
            size = 0

        for row, text in enumerate(texts):
            whole = text.decode()
            if self._is_plain(whole):
                for part in self._parts(whole):
                    put(plain, row, part)
                continue
            # Bytes split at ASCII white space only, which every Unicode definition agrees on.
            words = [word.decode() for word in text.split()]
            for is_plain, run in itertools.groupby(words, key=self._is_plain):
                if is_plain:
                    put(plain, row, " ".join(run))
                else:
                    for word in run:
                        put(others, row, word)
        flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker and path; its memo lives on between batches."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def encoded_documents(
    batches: Iterator[pa.RecordBatch], tokenizer: WordTokenizer, end_id: int
) -> Iterator[list[tuple[int | None, bytes]]]:
    """Keys and 32-bit ids, with the end id, of rows of a key and a text; about a chunk of text at a time, in order."""
    end = np.array([end_id], dtype=U32).tobytes()
    keys: list[int | None] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= tokenizer.CHUNK:
                yield [(k, ids + end) for k, ids in zip(keys, tokenizer.encode_all(texts), strict=True)]
                keys, texts, size = [], [], 0
    yield [(k, ids + end) for k, ids in zip(keys, tokenizer.encode_all(texts), strict=True)]
