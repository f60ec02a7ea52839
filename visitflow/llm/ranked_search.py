"""Ranked lexical search by classes of equal bags.

Documents are cut down to the items' vocabulary. Documents whose remaining term counts and whose length weight
``m`` are equal get equal scores for every item, so they are one class: classes are found by hash, verified by their whole bag,
scored once, and expanded to their members in ascending order of ids.

Items come in blocks of a bounded number of terms; each block is held against all documents. Nothing that grows with the
documents reaches the driver or a broadcast: only a block's terms, and one count for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.common import U32, bounded_batches, utf8
from visitflow.session import materialize

#: Terms of all items of a block, repeats over items included, and items of a block.
BLOCK_TERMS, BLOCK_ITEMS = 500_000, 2_000
#: Bytes of bags that a task groups before it sends classes on, and classes scored at once.
GROUPED_BYTES, CLASSES_AT_ONCE = 16 << 20, 256
#: The spread and the floor of a document's length weight, in percent (fixed values of the ranking).
LENGTH_SHARE, WHOLE = 90, 100

#: A blank for every byte that no term holds; letters A-Z in lower case. Bytes beyond ASCII belong to terms.
_TERM_BYTES = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else 0x20 for i in range(256)
)

Ids = list[int | None]


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class ItemBlock:
    """Items, the sorted terms of all of them, and for each term the items that hold it."""

    ids: Ids
    place: dict[bytes, int]
    first: np.ndarray  # of each term in ``holders``, one more at the end
    holders: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, list[bytes]]]) -> ItemBlock:
        terms = sorted({t for _, held in items for t in held})
        place = {t: i for i, t in enumerate(terms)}
        pairs = sorted((place[t], k) for k, (_, held) in enumerate(items) for t in held)
        counts = np.bincount([t for t, _ in pairs], minlength=len(terms)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return cls([i for i, _ in items], place, first, np.array([k for _, k in pairs], dtype=np.int64))


def item_blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """The items with a term, streamed to the driver block by block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(set(terms_of(text))) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(held, pa.list_(pa.binary()))], ["item_id", "terms"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for row in texts.mapInArrow(cut, "item_id long, terms array<binary>").where(F.size("terms") > 0).toLocalIterator():
        held = [bytes(t) for t in row["terms"]]
        if block and (size + len(held) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield ItemBlock.of(block)
            block, size = [], 0
        block.append((row["item_id"], held))
        size += len(held)
    if block:
        yield ItemBlock.of(block)


def bags(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, bag)``: number of terms, and the terms of the vocabulary with their counts, sorted by term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found = [], []
            for text in utf8(batch.column("text")):
                terms = terms_of(text)
                lengths.append(len(terms))
                known = [i for i in map(place.get, terms) if i is not None]
                which, counts = np.unique(np.array(known, dtype=np.int64), return_counts=True)
                found.append(np.concatenate([which, counts]).astype(U32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "bag"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, "doc_id long, n long, bag binary")


def _halves(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bag, dtype=U32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def document_counts(held: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for bag in batch.column("bag").to_pylist():
                sums[_halves(bag)[0]] += 1  # a term is in a bag once
        which = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(sums[which])], ["term", "docs"])

    parts = held.select("bag").mapInArrow(count, "term long, docs long")
    rows = parts.groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    counts = np.zeros(n_terms, dtype=np.int64)
    counts[rows["term"].to_numpy()] = rows["docs"].to_numpy()
    return counts


def _first_ids(ids: Ids, k: int) -> Ids:
    """The ``k`` smallest, nulls last."""
    return sorted(ids, key=lambda i: (i is None, i or 0))[:k]


def equal_bags(held: DataFrame, k: int) -> DataFrame:
    """``(m, bag, members)``: classes of equal rows of a task, each with its ``k`` smallest ids."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, bytes], Ids] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            keys = list(classes)
            return pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.binary()),
                 pa.array([_first_ids(ids, k) for ids in classes.values()], pa.list_(pa.int64()))],
                ["m", "bag", "members"],
            )

        for batch in batches:
            for doc, m, bag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "m", "bag")), strict=True):
                ids = classes.get((m, bag))
                if ids is None:
                    classes[m, bag] = [doc]
                    size += len(bag) + 200
                else:
                    ids.append(doc)
                    if len(ids) > 8 * k:
                        ids[:] = _first_ids(ids, k)
            if size > GROUPED_BYTES:
                yield sent()
                classes, size = {}, 0
        if classes:
            yield sent()

    return held.mapInArrow(group, "m long, bag binary, members array<long>")


class Ranking:
    """The best ``k`` documents of each item among the classes seen so far."""

    def __init__(self, block: ItemBlock, weights: np.ndarray, k: int):
        self._block, self._weights, self._k = block, weights, k
        self._best: list[list[tuple[int, bool, int]]] = [[] for _ in block.ids]
        self._least = np.ones(len(block.ids), dtype=np.int64)  # score that an item's next document needs

    def scores(self, classes: list[tuple[int, bytes, Ids]]) -> np.ndarray:
        """Scores of classes (rows) for items (columns), in 64-bit integers."""
        halves = [_halves(bag) for _, bag, _ in classes]
        sizes = np.array([len(t) for t, _ in halves])
        terms, tf = (np.concatenate([h[i] for h in halves]) for i in (0, 1))
        row = np.repeat(np.arange(len(classes)), sizes)
        m = np.array([c[0] for c in classes], dtype=np.int64)[row]
        parts = self._weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        start = self._block.first[terms]
        fan = self._block.first[terms + 1] - start
        at = np.arange(fan.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan)
        sums = np.zeros((len(classes), len(self._block.ids)), dtype=np.int64)
        np.add.at(sums, (np.repeat(row, fan), self._block.holders[at]), np.repeat(parts, fan))
        return sums

    def add(self, classes: list[tuple[int, bytes, Ids]]) -> None:
        if not classes:
            return
        sums = self.scores(classes)
        least = self._least
        if len(classes) > self._k:  # k classes have k documents
            least = np.maximum(least, np.partition(sums, len(classes) - self._k, axis=0)[len(classes) - self._k])
        found: dict[int, list[tuple[int, bool, int]]] = {}
        for row, item in zip(*(i.tolist() for i in np.nonzero(sums >= least)), strict=True):
            score = -int(sums[row, item])
            found.setdefault(item, []).extend((score, i is None, i or 0) for i in classes[row][2])
        for item, rows in found.items():
            best = self._best[item] = sorted([*self._best[item], *rows])[: self._k]
            if len(best) == self._k:
                self._least[item] = max(1, -best[-1][0])

    def rows(self) -> Iterator[tuple[int, int | None, int | None, int]]:
        """``(place of the item, item_id, doc_id, score)``."""
        for item, best in enumerate(self._best):
            for score, null, doc in best:
                yield item, self._block.ids[item], None if null else doc, -score


RANKED = "item long, item_id long, doc_id long, score long"


def scored_classes(classes: DataFrame, block: ItemBlock, weights: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` documents of each item in each task, by classes that meet by hash."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(block, weights, k)
        same: dict[tuple[int, bytes], Ids] = {}  # classes of one hash, told apart by weight and bag
        waiting: list[tuple[int, bytes, Ids]] = []
        last = None
        for batch in batches:
            for h, m, bag, ids in zip(*(batch.column(c).to_pylist() for c in ("hash", "m", "bag", "members")), strict=True):
                if h != last:
                    waiting += [(*key, members) for key, members in same.items()]
                    same, last = {}, h
                    if len(waiting) >= CLASSES_AT_ONCE:
                        ranking.add(waiting)
                        waiting = []
                same[m, bag] = _first_ids([*same[m, bag], *ids], k) if (m, bag) in same else ids
        ranking.add([*waiting, *((*key, members) for key, members in same.items())])
        rows = list(ranking.rows())
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    met = classes.withColumn("hash", F.xxhash64("m", "bag")).repartition("hash").sortWithinPartitions("hash")
    return met.mapInArrow(score, RANKED)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z count as their lower case. A row of either table is a
    document or an item of its own, also when it repeats another; a null text has no terms, null ids are the last of equal
    scores. Items without a term, or of which no document holds a term of any weight, have no rows; neither has an
    empty table. Other columns are ignored. A text may be of any length: a task holds it and its terms, nothing more.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranked = []
    for block in item_blocks(items):
        held = materialize(bags(docs, block.place), "search-bags")
        total = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        some = held.where(F.octet_length("bag") > 0)
        counts = document_counts(some, len(block.place))
        ratio = (2 * total["docs"] + 2) / (2 * counts + 1)
        weights = np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)
        # Wider than 64 bits in between, so that no corpus is too large.
        length = F.expr(f"(cast({LENGTH_SHARE * total['docs']} as decimal(20,0)) * cast(n as decimal(18,0))) div {total['terms']}")
        weighed = some.select("doc_id", (length + (WHOLE - LENGTH_SHARE)).cast("long").alias("m"), "bag")
        ranked.append(scored_classes(equal_bags(weighed, k), block, weights, k))
    if not ranked:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = []
    for rows in ranked:
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best.append(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionAll, best).select("item_id", "rank", "doc_id", "score")
