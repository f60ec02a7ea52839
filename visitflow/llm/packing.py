"""Sum-of-squares online packing of token ids into windows.

Every partition packs its own documents as they come, without a shuffle. A document of more than a
window is cut into whole windows and a remainder. The remainder goes to the fill level that keeps the
sum of squared counts of partially filled windows smallest; an array holds the count of each level.
What is still open at the end, or beyond ``max_open`` windows, is evened out by cutting: pieces of the
emptiest windows fill up the fullest. One window at most then stays partial, and it is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import bounded_batches, encoded_documents, text_or_empty, word_tokenizer

WINDOW = 4096

#: Open windows of a task; beyond it they are evened out. 512 windows hold 8 MB of ids.
MAX_OPEN = 512

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)

#: A piece: key of its document, first id, ids, ids of the whole document.
Piece = tuple[int | None, int, bytes, int]


class SumOfSquaresPacker:
    """Places pieces into windows; :meth:`closed` gives the finished ones."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window = window
        self.max_open = max_open
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows of each fill
        self._open: dict[int, list[list[Piece]]] = {}  # by fill
        self._n_open = 0
        self._closed: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """The fill whose window takes ``size`` ids (0: a new one) at the smallest sum of squares.

        Taking a window from level h changes the sum by 1 - 2 N(h), adding one to h + size by
        1 + 2 N(h + size); empty and full windows do not count. The fullest of equal levels wins.
        """
        if size == self.window:
            return 0
        fills = np.flatnonzero(self.levels[1 : self.window - size + 1]) + 1
        if not len(fills):
            return 0
        to = fills + size
        change = (1 - 2 * self.levels[fills]) + np.where(to < self.window, 1 + 2 * self.levels[to], 0)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(fills[best]) if change[best] <= 1 + 2 * self.levels[size] else 0

    def _put(self, fill: int, pieces: list[Piece]) -> None:
        if fill == self.window:
            self._closed.append(pieces)
            return
        self._open.setdefault(fill, []).append(pieces)
        self.levels[fill] += 1
        self._n_open += 1

    def _take(self, fill: int) -> list[Piece]:
        if not fill:
            return []
        self.levels[fill] -= 1
        self._n_open -= 1
        return self._open[fill].pop()

    def add(self, key: int | None, ids: bytes) -> None:
        """Place one document; ``ids`` are 32-bit."""
        total, step = len(ids) // 4, self.window * 4
        whole = total // self.window
        for k in range(whole):
            self._closed.append([(key, k * self.window, ids[k * step : (k + 1) * step], total)])
        rest = total - whole * self.window
        if rest:
            fill = self.level_for(rest)
            self._put(fill + rest, [*self._take(fill), (key, whole * self.window, ids[whole * step :], total)])
            if self._n_open > self.max_open:
                self._even_out()

    def _even_out(self) -> None:
        """Cut the emptiest windows to fill up the fullest; one partial window stays at most."""
        windows = [
            (fill, self._take(fill)) for fill in sorted(self._open, reverse=True) for _ in range(len(self._open[fill]))
        ]
        self._open.clear()
        first, last = 0, len(windows) - 1
        fill, pieces = windows[0] if windows else (0, [])
        while first < last:
            donor_fill, donor = windows[last]
            gap = self.window - fill
            taken: list[Piece] = []
            while gap and donor:
                key, start, ids, total = donor.pop()
                take = min(gap, len(ids) // 4)
                taken.append((key, start, ids[: take * 4], total))
                if take * 4 < len(ids):
                    donor.append((key, start + take, ids[take * 4 :], total))
                gap -= take
                donor_fill -= take
            pieces, fill = [*pieces, *taken], self.window - gap
            windows[last] = (donor_fill, donor)
            if not donor:
                last -= 1
            if not gap:
                self._closed.append(pieces)
                first += 1
                fill, pieces = windows[first] if first <= last else (0, [])
        if fill:
            self._put(fill, pieces)

    def finish(self) -> None:
        """Close what is open; the last window falls into sequences of powers of two."""
        self._even_out()
        for fill in list(self._open):
            while self._open[fill]:
                pieces, left = self._take(fill)[::-1], fill
                while left:
                    room, sequence = 1 << (left.bit_length() - 1), []
                    left -= room
                    while room:
                        key, start, ids, total = pieces.pop()
                        take = min(room, len(ids) // 4)
                        sequence.append((key, start, ids[: take * 4], total))
                        if take * 4 < len(ids):
                            pieces.append((key, start + take, ids[take * 4 :], total))
                        room -= take
                    self._closed.append(sequence)

    def closed(self) -> list[list[Piece]]:
        done, self._closed = self._closed, []
        return done


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    window: int = WINDOW,
    max_open: int = MAX_OPEN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: its document, place there, ids (little-endian unsigned 32-bit), sequence and offset.

    ``tokenizer`` is the path of a vocabulary file that the workers can open. A null or empty text has
    the end id alone. A null or repeated id is carried along, each row being a document of its own. An
    empty table gives no rows. Other columns are not read, so their names cannot clash. Sequence ids
    hold the task's number above 32 bits: they are unique, not gapless. Memory: a chunk of texts of 4 MB, one
    document's ids and ``max_open`` windows a task. Beyond ``max_open`` open windows, which takes as many fill levels in
    use at once, documents are cut to fill windows up; that costs cuts, and no padding. A task that runs again packs the same rows the
    same way, if its input comes in the same order, as a scan's does.
    """
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquaresPacker(window, max_open)
        sequence_id = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id
            out: list[tuple] = []
            for pieces in packer.closed():
                offset = 0
                for key, start, ids, total in pieces:
                    out.append((key, start, len(ids) // 4, ids, total, sequence_id, offset))
                    offset += len(ids) // 4
                sequence_id += 1
            if out:
                names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
                kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

        for documents in encoded_documents(batches, word_tokenizer(tokenizer), end_id):
            for key, ids in documents:
                packer.add(key, ids)
            yield from rows()
        packer.finish()
        yield from rows()

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return texts.mapInArrow(pack, SCHEMA)
