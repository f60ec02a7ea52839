"""Binary shards of token ids with Elias-Fano document boundaries.

A shard is a file of blocks in document order. A block holds the ids of some documents as one array,
2 bytes an id if the vocabulary allows it, else 4, and the documents' boundaries in that array as an
Elias-Fano sequence: about 2 + log2(ids / documents) bits a boundary, with sampled select positions of
32 bits, and no table of 64-bit offsets. Only a block's own place is a full number, and it follows from the
blocks before it.

Files are written by Spark's text writer, each row a block and the line end a block's last byte, so
commits, retries and any Hadoop file system work as for every other table. The bytes of a block, little-endian:

    magic "VFT1" | bytes of the block, line end included (u4) | part (u4) | block in the part (u4)
    | documents (u4) | ids (u4) | width of an id (u1) | low bits (u1) | samples (u4) | bytes of upper (u4)
    | validity of keys (bits) | keys (i8 each) | samples (u4 each) | lower bits | upper bits | ids | "\\n"
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitflow.llm.common import U32, bounded_batches, encoded_documents, text_or_empty, word_tokenizer
from visitflow.session import materialize

MAGIC = b"VFT1"
HEADER = struct.Struct("<4sIIIIIBBII")

#: One select position is kept for so many set bits.
SAMPLE = 64

#: A block ends at the document that reaches so many ids.
BLOCK_TOKENS = 1 << 20

#: Blocks of a file: with two bytes an id, a file has about 16 MB.
BLOCKS_PER_FILE = 8


class EliasFano:
    """A sorted sequence of whole numbers from 0 to ``universe`` in near-minimal space."""

    def __init__(self, count: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits = count, low_bits
        self.lower, self.upper, self.samples = lower, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        count = len(values)
        low_bits = max(0, (universe // max(1, count)).bit_length() - 1)
        low = values & ((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        lower = np.packbits(bits.reshape(-1), bitorder="little")
        places = (values >> low_bits) + np.arange(count)
        flags = np.zeros((universe >> low_bits) + count + 1, dtype=np.uint8)
        flags[places] = 1
        return cls(count, low_bits, lower, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype(U32))

    def _low(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), dtype=np.int64)
        for bit in range(self.low_bits):
            at = k * self.low_bits + bit
            out |= ((self.lower[at >> 3] >> (at & 7)) & 1).astype(np.int64) << bit
        return out

    def select(self, k: int) -> int:
        """The k-th value: from the nearest sample, count set bits up to the k-th."""
        left, at = k % SAMPLE, int(self.samples[k // SAMPLE])
        byte, skip = at >> 3, at & 7
        word = int(self.upper[byte]) >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return ((place - k) << self.low_bits) | int(self._low(np.array([k]))[0])

    def all(self) -> np.ndarray:
        """Every value, by one pass over the upper bits."""
        k = np.arange(self.count)
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.count]
        return ((places - k) << self.low_bits) | self._low(k)


def encode_block(part: int, number: int, keys: list[int | None], documents: list[bytes], width: int) -> bytes:
    """A block without its final line end; ``documents`` are 32-bit ids."""
    ids = np.frombuffer(b"".join(documents), dtype=U32)
    ends = np.cumsum([0, *(len(d) // 4 for d in documents)])
    bounds = EliasFano.encode(ends, int(ends[-1]))
    valid = np.packbits([k is not None for k in keys], bitorder="little").tobytes()
    body = b"".join(
        [
            valid,
            np.array([0 if k is None else k for k in keys], dtype="<i8").tobytes(),
            bounds.samples.tobytes(),
            bounds.lower.tobytes(),
            bounds.upper.tobytes(),
            ids.astype(f"<u{width}").tobytes(),
        ]
    )
    head = HEADER.pack(
        MAGIC, HEADER.size + len(body) + 1, part, number, len(keys), len(ids), width,
        bounds.low_bits, len(bounds.samples), len(bounds.upper),
    )
    return head + body


class Block:
    """A block read back: keys, boundaries and ids, without a copy of the ids."""

    def __init__(self, content: memoryview | bytes, at: int = 0):
        view = memoryview(content)
        magic, self.size, self.part, self.number, n, n_ids, width, low_bits, n_samples, n_upper = HEADER.unpack_from(view, at)
        if magic != MAGIC or view[at + self.size - 1] != 0x0A:
            raise ValueError(f"no block at byte {at}")
        self.documents, self.tokens = n, n_ids
        place = at + HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            found = np.frombuffer(view, dtype=kind, count=count, offset=place)
            place += found.nbytes
            return found

        valid = np.unpackbits(take("u1", -(-n // 8)), count=n, bitorder="little")
        self.keys = [k if v else None for k, v in zip(take("<i8", n).tolist(), valid, strict=True)]
        samples = take("<u4", n_samples)
        lower = take("u1", -(-(n + 1) * low_bits // 8))
        self.bounds = EliasFano(n + 1, low_bits, lower, take("u1", n_upper), samples)
        self.ids = take(f"<u{width}", n_ids)

    def document(self, k: int) -> np.ndarray:
        """The ids of the block's k-th document, found by two selects."""
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]


def blocks_of(content: bytes) -> Iterator[Block]:
    at = 0
    while at < len(content):
        block = Block(content, at)
        yield block
        at += block.size


def write_token_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    blocks_per_file: int = BLOCKS_PER_FILE,
) -> None:
    """Encode whole texts and write them in ascending order of their ids.

    A null text is empty and has the end id alone; null ids come first; rows of one id are ordered
    by a hash of their text, and equal rows by their place, so that no id fills a task. An empty table gives no
    blocks. Other columns are not read. One shuffle of the texts by range; memory is a block a task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        library = word_tokenizer(tokenizer)
        width = 2 if max(library.vocabulary_size - 1, end_id) < 1 << 16 else 4
        keys: list[int | None] = []
        documents: list[bytes] = []
        held = 0
        for encoded in encoded_documents(batches, library, end_id):
            for key, ids in encoded:
                keys.append(key)
                documents.append(ids)
                held += len(ids) // 4
                if held >= block_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_block(part, number, keys, documents, width)])], ["block"])
                    keys, documents, held, number = [], [], 0, number + 1
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([encode_block(part, number, keys, documents, width)])], ["block"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("at")]
    (
        texts.withColumn("at", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(blocks, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("compression", "none")
        .option("maxRecordsPerFile", blocks_per_file)
        .text(path)
    )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: key, part, block, place in the block, and its ids (32-bit, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for block in blocks_of(content.as_buffer().to_pybytes()):
                    bounds = block.bounds.all()
                    for first in range(0, block.documents, 2000):
                        last = min(first + 2000, block.documents)
                        ends = bounds[first : last + 1]
                        ids = block.ids[ends[0] : ends[-1]].astype(U32).tobytes()
                        near = (ends - ends[0]) * 4
                        n = last - first
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(block.keys[first:last], pa.int64()),
                                pa.array([block.part] * n, pa.int64()),
                                pa.array([block.number] * n, pa.int64()),
                                pa.array(ends[:-1], pa.int64()),
                                pa.array([ids[a:b] for a, b in zip(near[:-1].tolist(), near[1:].tolist(), strict=True)], pa.binary()),
                            ],
                            ["doc_id", "part", "block", "place", "ids"],
                        )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, "doc_id long, part long, block long, place long, ids binary")


def document_offsets(documents: DataFrame) -> DataFrame:
    """``start``: the ids before each document, from ``part``, ``block``, ``place`` and ``n_tokens``.

    Blocks are summed, then parts; the one window without a key has a row per written part, as many
    as the writer had tasks, whatever the number of documents.
    """
    blocks = documents.groupBy("part", "block").agg(F.sum("n_tokens").alias("tokens"))
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = (Window.unboundedPreceding, -1)
    part_start = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(*before)
    starts = blocks.join(parts.select("part", part_start.alias("part_start")), "part").select(
        "part", "block", (F.col("part_start") + F.coalesce(F.sum("tokens").over(in_part), F.lit(0))).alias("block_start")
    )
    return documents.join(starts, ["part", "block"]).withColumn("start", F.col("block_start") + F.col("place"))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under ``path``: start, number of ids, and their crc32."""
    read = read_token_shards(spark, path).select(
        "doc_id", "part", "block", "place",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return document_offsets(materialize(read, "token-table")).select("doc_id", "start", "n_tokens", "ids_crc32")


