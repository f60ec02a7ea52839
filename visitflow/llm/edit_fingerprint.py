"""Fingerprints that keep edit distance: a randomised embedding, sampled, banded and verified.

One random walk, shared by all texts, reads a text: at each step it puts out the character it stands on and
then stays or moves on, as a coin for (step, character) says. Texts a few edits apart fall into step again
soon after each edit, so their outputs differ in few steps: edit distance becomes Hamming distance. A
fingerprint samples ``SLOTS`` steps of the whole output. Each slot has its own random order of all
steps and takes the first in this order that the output has, so texts of similar length sample the same steps,
and none is left out. A slot's byte is a hash of the character, and 0 if the text is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.common import bounded_batches, release_shuffles, text_or_empty
from visitflow.llm.components import connected_components
from visitflow.session import materialize

SLOTS = 128
SEED = 7

#: The coins repeat after so many steps, and for characters of equal hash.
PERIOD = 4096
CLASSES = 256

#: Characters walked at once: bounds memory for very long texts.
CHUNK = 1 << 18

#: Steps that slots are prepared for; the longest text Spark can hold has fewer.
MOST_STEPS = 1 << 40

THRESHOLD = 0.8

#: One band more than slots that a near pair may differ in, so that it agrees in a whole band.
BANDS = SLOTS - math.ceil(THRESHOLD * SLOTS - 1e-9) + 1

#: Members of a band group that are compared in one tile.
TILE = 4096

State = tuple[int, np.ndarray]


class EditEmbedding:
    """The walk and the sampled slots for one seed; equal for every task and every run."""

    def __init__(self, slots: int = SLOTS, seed: int = SEED):
        coins = np.random.Generator(np.random.PCG64(seed))
        # How long the walk stays on a character of each class if it comes to it at each step.
        stay = coins.geometric(0.5, (CLASSES, PERIOD)).clip(1, 255).astype(np.uint8)
        self._stay = [row.tobytes() for row in stay]
        records = []
        for _ in range(slots):
            # The steps that are first in the slot's order among all steps before them: after a record
            # at step t, none comes before step m with probability (t + 1) / m.
            steps = [0]
            while steps[-1] < MOST_STEPS:
                steps.append(int((steps[-1] + 1) / (1.0 - coins.random())))
            records.append(steps)
        width = max(map(len, records))
        self._records = np.array([r + [MOST_STEPS * 2] * (width - len(r)) for r in records], dtype=np.int64)
        self._slots = np.arange(slots)

    @staticmethod
    def characters(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")

    def start(self) -> State:
        return 0, np.zeros(len(self._slots), dtype=np.uint8)

    def read(self, state: State, characters: np.ndarray) -> State:
        """Walk on over ``characters``; the given state stays as it is."""
        step, symbols = state
        symbols = symbols.copy()
        stay, period = self._stay, PERIOD - 1
        for at in range(0, len(characters), CHUNK):
            part = characters[at : at + CHUNK]
            mixed = part * np.uint32(2654435761)
            first, j = step, step
            ends = np.array([j := j + stay[c][j & period] for c in (mixed >> np.uint32(24)).astype(np.uint8).tobytes()])
            step = j
            chosen = self._records[self._slots, (self._records < step).sum(axis=1) - 1]
            new = chosen >= first
            found = mixed[np.searchsorted(ends, chosen[new], side="right")]
            symbols[new] = 1 + ((found >> np.uint32(8)) % 255).astype(np.uint8)
        return step, symbols

    def fingerprint(self, text: str) -> bytes:
        return self.read(self.start(), self.characters(text))[1].tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of slots in which two fingerprints agree."""
    return float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))


_embeddings: dict[tuple[int, int], EditEmbedding] = {}


def embedding(slots: int = SLOTS, seed: int = SEED) -> EditEmbedding:
    """One table of coins per worker."""
    if (slots, seed) not in _embeddings:
        _embeddings[slots, seed] = EditEmbedding(slots, seed)
    return _embeddings[slots, seed]


class _Document:
    """A text with its walk up to the middle and to the end."""

    def __init__(self, walk: EditEmbedding, key: int | None, text: str):
        self.walk, self.key, self.text = walk, key, text
        self.tail = len(text) // 2  # characters that the edit replaces
        characters = walk.characters(text)
        self.middle = walk.read(walk.start(), characters[: len(text) - self.tail])
        self.print = walk.read(self.middle, characters[len(text) - self.tail :])[1].tobytes()

    def beside(self, following: _Document) -> tuple:
        """The result row of this document, given the next one."""
        put = following.text[: self.tail]
        digest = hashlib.sha256()
        digest.update(self.text[: len(self.text) - self.tail].encode())
        digest.update(put.encode())
        edited = self.walk.read(self.middle, self.walk.characters(put))[1].tobytes()
        return (
            self.key, len(self.text), digest.digest(), self.print, edited,
            likeness(self.print, edited), likeness(self.print, following.print),
        )


ROW_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
ROW_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def edited_fingerprints(
    docs: DataFrame, slots: int = SLOTS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: fingerprints of its text and of an edited text, and how like they and the next row's are.

    The edited text has the last half of the characters (rounded down) replaced by as many first ones of the
    next text in ascending order of ids, or by all it has; after the last row comes the first. Null texts are
    empty, null ids come first, rows of one id are ordered by a hash of their text and by their place. A
    single row is its own next; an empty table gives no rows. Two empty texts are alike. Other columns are
    not read. One shuffle of the texts by range; a task holds an Arrow batch and two texts. The last
    row of each task is compared in a second small step that reads a text or two per task.
    """
    bounded_batches(docs.sparkSession)
    names = [*(part.split()[0] for part in ROW_SCHEMA.split(", ")), "part", "edge", "edge_text"]
    kinds = [*ROW_KINDS, pa.int64(), pa.string(), pa.string()]
    nothing = (None,) * 6

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk = TaskContext.get().partitionId(), embedding(slots, seed)
        last: _Document | None = None
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = _Document(walk, key, text)
                if last is None:
                    out.append((key, *nothing, part, "first", text))
                else:
                    out.append((*last.beside(now), part, None, None))
                last = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if last is not None:
            row = (last.key, *nothing, part, "last", last.text)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("at")]
    found = (
        texts.withColumn("at", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(neighbours, f"{ROW_SCHEMA}, part long, edge string, edge_text string")
    )
    found = materialize(found, "edit-fingerprints")
    release_shuffles(docs.sparkSession)  # the texts are sorted and read; nothing later needs them

    # Two rows a task: which task follows which, then the texts of the two that meet.
    firsts = found.where("edge = 'first'").select("part")
    whole = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(whole), F.min("part").over(Window.partitionBy(F.lit(0))))
    following = firsts.select("part", after.alias("next_part"))
    heads = found.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    edges = (
        found.where("edge = 'last'")
        .select("doc_id", F.col("edge_text").alias("text"), "part")
        .join(following, "part")
        .join(heads, "next_part")
        .select("doc_id", "text", "next_text")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = embedding(slots, seed)
        for batch in batches:
            out = [
                _Document(walk, key, text).beside(_Document(walk, None, next_text))
                for key, text, next_text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), ROW_KINDS, strict=True)], names[:7]
                )

    rows = found.where("edge is null").select(*names[:7]).union(edges.mapInArrow(meet, ROW_SCHEMA))
    return rows.withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))


def _group_links(prints: np.ndarray, others: np.ndarray | None, least: int) -> list[tuple[int, int]]:
    """Links that connect what pairs of at least ``least`` equal slots connect; ``others`` follow ``prints``.

    With ``others``, only pairs across the two are looked at. Pairs inside one component are skipped.
    """
    both = prints if others is None else np.concatenate([prints, others])
    labels = np.arange(len(both))
    links = []
    for i in range(len(prints)):
        low = i + 1 if others is None else len(prints)
        open_ = low + np.flatnonzero(labels[low:] != labels[i])
        if not len(open_):
            continue
        near = open_[(both[open_] == both[i]).sum(axis=1) >= least]
        for label in np.unique(labels[near]).tolist():
            links.append((i, int(near[labels[near] == label][0])))
        if len(near):
            labels[np.isin(labels, labels[near])] = labels[i]
    return links


def near_classes(
    rows: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    tile: int = TILE,
    id_column: str = "doc_id",
    print_column: str = "fingerprint",
) -> DataFrame:
    """``rows`` with ``class_id``: the smallest id connected to each row by verified near pairs.

    Each band is a run of slots (the slots are random, so a band is a random sample of them); widths differ by
    one at most. Fingerprints that agree in a band are candidates, and every pair of them is verified: at least
    ``threshold`` of all slots must agree. With more bands than slots that may differ, no near pair is missed. Equal
    fingerprints are one node. Near fingerprints agree in many bands: groups of the same nodes, told by two sums of
    hashes, are verified once. Only groups of two or more nodes carry fingerprints along, and groups above
    ``tile`` nodes are compared tile against tile in several tasks. A null id is never the smallest of a class that has
    another; a null fingerprint has a null class. A column ``class_id`` that ``rows`` has already is replaced; one
    named ``print`` is not allowed.
    """
    nodes = rows.where(F.col(print_column).isNotNull()).groupBy(F.col(print_column).alias("print")).agg(
        F.min(F.col(id_column).cast("long")).alias("first_id")
    )
    # Numbered once, in the written table, so that rows of bands are two numbers. The hash of a number is as unique, and
    # in random order: components would take many rounds along chains of ascending ones.
    number = F.xxhash64(F.monotonically_increasing_id())
    nodes = materialize(nodes.select(number.alias("node"), "print", "first_id"), "print-nodes")
    ends = [F.expr(f"cast(octet_length(print) * {b} div {bands} as int)") for b in range(bands + 1)]
    cut = [F.xxhash64(F.lit(b), F.substring("print", ends[b] + 1, ends[b + 1] - ends[b])) for b in range(bands)]
    # One exchange of two numbers a band: groups are counted, and joined back, where it put them.
    keys = nodes.select("node", F.explode(F.array(*cut)).alias("key")).repartition("key")
    sets = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), F.col("node"))).alias("two"),
    )
    groups = sets.where("count > 1").groupBy("count", "one", "two").agg(F.min("key").alias("key")).select("key", "count")
    tiles = F.ceil(F.col("count") / tile).cast("int")
    members = (
        keys.join(groups, "key")
        .withColumn("tiles", tiles)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .join(nodes.select("node", "print"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
            (F.col("mine") > F.col("other")).alias("second"), "node", "print",
        )
    )
    place = ["key", "low", "high"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bool]] = []
        group = None

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            prints = np.frombuffer(b"".join(p for _, p, _ in held), np.uint8).reshape(len(held), -1)
            first = sum(not s for _, _, s in held)
            least = int(np.ceil(threshold * prints.shape[1] - 1e-9))
            apart = group[1] != group[2]
            found = _group_links(prints[:first], prints[first:] if apart else None, least)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held[k][0] for k in side], pa.int64()) for side in zip(*found, strict=True)], ["a", "b"]
                )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, second, node, print_ in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
                if key != group:
                    yield from links()
                    held, group = [], key
                held.append((node, print_, second))
        yield from links()

    found = (
        members.repartition(*place)
        .sortWithinPartitions(*place, "second", "node")
        .select(*place, "second", "node", "print")
        .mapInArrow(verify, "a long, b long")
    )
    links = materialize(found, "print-links")
    release_shuffles(rows.sparkSession)  # bands and their fingerprints are compared
    roots = connected_components(links)
    joined = nodes.join(roots, "node", "left").select("print", "first_id", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("class_id"))
    member = joined.select("print", "root").join(least, "root").select("print", "class_id")
    # Copies are rows of a hot key on the left only, so Spark can split its partition.
    wanted = rows.drop("class_id")
    return wanted.join(member, wanted[print_column] == member["print"], "left").drop("print")
