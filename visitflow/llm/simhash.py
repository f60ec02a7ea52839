"""SimHash near-duplicates by a self-join of a binary trie.

Equal fingerprints are one node. Two fingerprints within four bits agree in one of five blocks of bits,
so each fingerprint goes to five buckets (one for each block, the block's bits moved to the front), and a task
joins the trie of each of its buckets with itself: it walks pairs of trie nodes together, adds up the bits in
which their paths differ, and leaves a pair when the sum exceeds the budget. A pair of subtrees that
already are one component is left as well: links inside it could not change the answer. Buckets of
more than ``HOT_BUCKET`` fingerprints are parted again, by five blocks of their remaining bits, until
none is left; that loses no link, because the budget holds for the remaining bits too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.llm.common import bounded_batches, fresh_name, text_or_empty, utf8
from visitflow.llm.components import connected_components
from visitflow.session import materialize

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4

#: A bucket of more fingerprints is parted by further bits; beyond it, a task would work too long alone.
HOT_BUCKET = 20_000

#: Trie node pairs that are expanded at once, and fingerprints joined at once: bounds of a task's memory.
PAIRS_AT_ONCE = 1 << 18
VALUES_AT_ONCE = 1 << 18

#: Shingles hashed at once in a long text.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included; no word gives 0."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = max(1, len(words) - words_each + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, shingles, SHINGLES_AT_ONCE):
        last = min(at + SHINGLES_AT_ONCE, shingles)
        part = words[at : last + words_each - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: last - at].tolist()
        ends = ends[min(words_each, len(part)) - 1 :].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles).view(">u8")[0])


def fingerprints(
    docs: DataFrame, words_each: int = SHINGLE_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's text as a signed 64-bit number. Row-local."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_each) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return texts.mapInArrow(hashed, "doc_id long, fp long")


class TrieJoin:
    """The binary trie over sorted distinct 64-bit values, joined with itself.

    A trie node is a range of the sorted values that share their first bits. ``labels`` gives each
    value the smallest place of its component, the links being pairs within ``budget`` bits.
    """

    def __init__(self, values: np.ndarray, budget: int):
        self.values, self.budget = values, budget
        self.labels = np.arange(len(values))
        self._run_ends = self.labels + 1  # where the run of equal labels that holds a place ends

    def _middle(self, low: np.ndarray, depth: int) -> np.ndarray:
        """The first place of each node's right child; ``low`` are the nodes' first places."""
        bit = np.uint64(1 << (63 - depth))
        prefix = self.values[low] & ~np.uint64((1 << (64 - depth)) - 1) if depth else np.uint64(0)
        return np.searchsorted(self.values, prefix | bit).astype(np.int64)

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            x, y = labels[a], labels[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = labels[labels]
                if np.array_equal(up, labels):
                    break
                labels = up
        self.labels = labels
        changes = np.flatnonzero(labels[1:] != labels[:-1]) + 1
        bounds = np.append(changes, len(labels))
        self._run_ends = np.repeat(bounds, np.diff(bounds, prepend=0))

    def _unsettled(self, pairs: np.ndarray) -> np.ndarray:
        """Leave out pairs of subtrees that already are one component."""
        a_low, a_high, b_low, b_high, _ = pairs
        one = (
            (self.labels[a_low] == self.labels[b_low])
            & (self._run_ends[a_low] >= a_high)
            & (self._run_ends[b_low] >= b_high)
        )
        return pairs[:, ~one]

    def _leaves(self, pairs: np.ndarray) -> np.ndarray:
        """Link pairs of single values within the budget; returns the other pairs."""
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        if single.any():
            a, b = pairs[0, single], pairs[2, single]
            near = np.bitwise_count(self.values[a] ^ self.values[b]) <= self.budget
            if near.any():
                self._union(a[near], b[near])
        return pairs[:, ~single]

    def _children(self, pairs: np.ndarray, depth: int) -> np.ndarray:
        a_low, a_high, b_low, b_high, differing = pairs
        a_mid = np.clip(self._middle(a_low, depth), a_low, a_high)
        b_mid = np.clip(self._middle(b_low, depth), b_low, b_high)
        same = a_low == b_low  # a node with itself: of its mixed children, one order is enough
        apart = ~same
        out = np.concatenate(
            [
                np.stack([a_low, a_mid, b_low, b_mid, differing]),
                np.stack([a_mid, a_high, b_mid, b_high, differing]),
                np.stack([a_low, a_mid, b_mid, b_high, differing + 1]),
                np.stack([a_mid, a_high, b_low, b_mid, differing + 1])[:, apart],
            ],
            axis=1,
        )
        alone = (out[0] == out[2]) & (out[1] - out[0] == 1)
        return out[:, (out[1] > out[0]) & (out[3] > out[2]) & (out[4] <= self.budget) & ~alone]

    def run(self, roots: np.ndarray, depth: int) -> np.ndarray:
        """Join each root with itself; roots are the first places of nodes ``depth`` bits down."""
        ends = np.append(roots[1:], len(self.values))
        start = np.stack([roots, ends, roots, ends, np.zeros_like(roots)])
        stack = [(depth, start[:, ends - roots > 1])]
        while stack:
            depth, pairs = stack.pop()
            if pairs.shape[1] > PAIRS_AT_ONCE:
                half = pairs.shape[1] // 2
                stack += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
                continue
            pairs = self._unsettled(self._leaves(self._unsettled(pairs)))
            if pairs.shape[1]:
                children = self._children(pairs, depth)
                # Nodes paired with themselves come first off the stack: they settle near values early.
                own = children[0] == children[2]
                stack += [(depth + 1, part) for part in (children[:, ~own], children[:, own]) if part.shape[1]]
        return self.labels


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """Offsets and widths of ``parts`` blocks of ``width`` bits."""
    cuts = [round(width * k / parts) for k in range(parts + 1)]
    return list(zip(cuts[:-1], np.diff(cuts).tolist(), strict=True))


def _moved(fixed: int, offset: int, width: int) -> str:
    """SQL for ``value`` with the ``width`` bits at ``offset`` of the part behind ``fixed`` bits put before it."""
    rest = 64 - fixed
    keep = f"(value & {~((1 << rest) - 1) if rest < 64 else 0}L)"
    if not offset:
        return "value"
    mask = (1 << rest) - 1
    signed = mask if mask < 1 << 63 else -1
    tail = f"(value & {signed}L)"
    return f"{keep} | (shiftleft({tail}, {offset}) & {signed}L) | shiftrightunsigned({tail}, {rest - offset})"


def _deal(rows: DataFrame, fixed: int, parts: int) -> DataFrame:
    """Each row once for each block of the bits behind ``fixed``, with that block moved to the front."""
    dealt = [
        F.struct(
            F.concat("path", F.lit(f"{number}")).alias("path"),
            F.expr(_moved(fixed, offset, width)).alias("value"),
            F.lit(fixed + width).alias("depth"),
        )
        for number, (offset, width) in enumerate(_blocks(64 - fixed, parts))
    ]
    return rows.select("fp", F.explode(F.array(*dealt)).alias("d")).select("fp", "d.*")


def _with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.expr("shiftrightunsigned(value, 64 - depth)"))


def _buckets(values: DataFrame, max_bits: int, hot_bucket: int) -> DataFrame:
    """Buckets of fingerprints of which each pair within ``max_bits`` shares one, none above ``hot_bucket``."""
    parts = max_bits + 1
    open_ = _deal(values.select("fp", F.col("fp").alias("value"), F.lit("").alias("path")), 0, parts)
    done: DataFrame | None = None
    while True:
        open_ = _with_bucket(open_)
        hot = open_.groupBy("path", "depth", "bucket").count().where(F.col("count") > hot_bucket)
        hot = materialize(hot.select("path", "depth", "bucket"), "hot-buckets")
        key = ["path", "depth", "bucket"]
        depths = [r[0] for r in hot.select("depth").distinct().collect()]
        if not depths:
            return open_ if done is None else done.unionByName(open_)
        fine = open_.join(hot, key, "left_anti")
        done = fine if done is None else done.unionByName(fine)
        again = open_.join(hot, key, "left_semi")
        dealt = [_deal(again.where(F.col("depth") == d), d, parts) for d in depths]
        open_ = dealt[0]
        for more in dealt[1:]:
            open_ = open_.unionByName(more)
        # Depths have few values (one for each width of block), so this is a few unions, not one a bucket.
        open_ = materialize(open_, "parted-buckets")


def near_links(values: DataFrame, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links ``a, b`` that connect just the fingerprints connected by pairs within ``max_bits`` bits.

    ``values`` has distinct non-null ``fp``. Each bucket gives a star per component inside it, so there are
    at most ``max_bits + 1`` links a fingerprint (more in parted buckets), however dense it is.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, group, last = 0, None, None

        def links() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size > 1:
                fp = np.concatenate([f for f, _ in held])
                value = np.concatenate([v for _, v in held])
                depth = group[1]
                bucket = value >> np.uint64(64 - depth)
                roots = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
                labels = TrieJoin(value, max_bits).run(roots, depth)
                member = np.flatnonzero(labels != np.arange(len(labels)))
                if len(member):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[labels[member]])], ["a", "b"])
            held, size = [], 0

        for batch in batches:
            paths = batch.column(0).to_pylist()
            depths = batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy()
            value = batch.column(3).to_numpy().view(np.uint64)
            bucket = value >> (np.uint64(64) - depths.astype(np.uint64))
            # A run is a stretch of one path; runs are joined bucket by bucket, many at once.
            cuts = [i for i in range(1, len(paths)) if paths[i] != paths[i - 1] or (size + i >= VALUES_AT_ONCE and bucket[i] != bucket[i - 1])]
            for low, high in zip([0, *cuts], [*cuts, len(paths)], strict=True):
                if low == high:
                    continue
                now = (paths[low], int(depths[low]))
                if now != group or (size >= VALUES_AT_ONCE and bucket[low] != last):
                    yield from links()
                    group = now
                held.append((fp[low:high], value[low:high]))
                size += high - low
                last = bucket[high - 1]
        yield from links()

    rows = _buckets(values, max_bits, hot_bucket)
    # Unsigned order of the values: the sign bit flipped.
    ordered = rows.repartition("path", "bucket").sortWithinPartitions(
        "path", "depth", F.expr(f"value ^ {-(1 << 63)}")
    )
    return ordered.select("path", "depth", "fp", "value").mapInArrow(join, "a long, b long")


def _components(rows: DataFrame, max_bits: int, hot_bucket: int) -> DataFrame:
    """``fp, first_id, root`` for each fingerprint of ``rows``; ``root`` names its component."""
    if hot_bucket < 1 << max_bits:
        raise ValueError(f"hot_bucket must be at least {1 << max_bits}")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = materialize(near_links(nodes.select("fp"), max_bits, hot_bucket), "near-links")
    roots = connected_components(links)
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    return materialize(joined.select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "near-nodes")


def near_duplicates(
    docs: DataFrame,
    words_each: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    hot_bucket: int = HOT_BUCKET,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id reachable over links of at most ``max_bits``.

    A null text is empty; texts without a word have fingerprint 0 and link like others. A null id is
    carried along and never the smallest (a component of null ids only has a null one). Repeated rows
    are rows of one fingerprint. An empty table gives no rows. Only the two columns are read.
    """
    rows = materialize(fingerprints(docs, words_each, id_column, text_column), "fingerprints")
    joined = _components(rows, max_bits, hot_bucket)
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    # Copies are rows of a hot key on the left only, so Spark can split its partition.
    return rows.join(member, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    words_each: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    hot_bucket: int = HOT_BUCKET,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the one of the smallest id, with all columns.

    Of rows that share this id, the one of the smallest fingerprint stays, and one of equal rows. A
    component stays with a row without an id only if it has no other. Nulls and empty texts as above.
    """
    rows = materialize(fingerprints(docs, words_each, id_column, text_column), "fingerprints")
    joined = _components(rows, max_bits, hot_bucket)
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("w")
    key, fp = fresh_name(docs, "key"), fresh_name(docs, "fp")
    winners = joined.groupBy("root").agg(first).select(
        F.coalesce(F.col("w.first_id").cast("string"), F.lit("")).alias(key), F.col("w.fp").alias(fp)
    )
    place, n_columns = docs.columns.index(text_column), len(docs.columns)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(place).cast(pa.string()))
            found = np.array([fingerprint(t, words_each) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_columns], pa.array(found.view(np.int64))], [*batch.schema.names, fp]
            )

    marked = docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    marked = marked.withColumn(key, F.coalesce(F.col(id_column).cast("long").cast("string"), F.lit("")))
    # Equal keys are put together inside each task first, then dealt once for both steps.
    return marked.dropDuplicates([key, fp]).join(winners, [key, fp], "left_semi").select(*docs.columns)
