"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

Records of an archive stand one behind the other in files of about ``FILE_BYTES``. A leaf is a record's SHA-256 with
its offset; a node covers a range of offsets, 64 kB at the lowest level and 16 times as many at each next
one, and hashes its children in order; a root covers a file. Two replicas are compared root by root, and only the
branches that differ are followed down to the records. A node has at most a few hundred children, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.common import bounded_batches
from visitflow.session import materialize

FILE_BYTES = 64 << 20
RANGE_BYTES = 64 << 10
FANOUT = 16


#: Date of records whose pages say none; the format demands one.
NO_DATE = "1970-01-01T00:00:00Z"


def warc_record(
    id_column: str = "page_id", url_column: str = "url", body_column: str = "html", date: str = NO_DATE
) -> Column:
    """A page as a WARC resource record; null urls and bodies are empty, a null id is the word null."""
    body = F.coalesce(F.col(body_column).cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url_column).cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def running_total(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of the whole-number column ``value`` over all rows before each in ``order``.

    Rows are dealt by range, so equal keys do not meet in one task if ``order`` ends in a column that tells
    them apart. Each task sums its own rows; the sums of tasks, one row each, are added up by a window.
    """
    bounded_batches(rows.sparkSession)
    names = rows.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column(names.index(value)).to_numpy()) + total
            before = np.concatenate([[total], sums[:-1]])[: len(sums)]
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(len(sums), part), pa.int64())],
                [*names, "before", "part"],
            )

    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.mapInArrow(local, f"{schema},before:bigint,part:bigint"), "running-total")
    parts = ranged.groupBy("part").agg(F.sum(value).alias("whole"))
    earlier = F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", earlier.alias("start"))
    return ranged.join(starts, "part").withColumn("before", F.col("start") + F.col("before")).select(*names, "before")


def archive_layout(
    pages: DataFrame, record: Column, id_column: str = "page_id", file_bytes: int = FILE_BYTES, also: dict[str, Column] | None = None
) -> DataFrame:
    """``id, file, offset, length, digest`` of each page's record in an archive in ascending order of ids.

    ``also`` gives further columns of the page by name, which go along with its record's place.

    Null ids come first; pages of one id go by their record's hash and by their place. A file begins with the first
    record whose place in the archive passes a multiple of ``file_bytes``; a record lies in one file. Records are
    hashed where they are read: the shuffle carries a hash and a length each, no page.
    """
    also = also or {}
    records = pages.select(
        F.col(id_column).cast("long").alias("id"), record.cast("binary").alias("record"), *[c.alias(n) for n, c in also.items()]
    ).select("id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *also)
    records = records.withColumn("at", F.monotonically_increasing_id())
    placed = running_total(records, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("at")], "length")
    placed = placed.withColumn("file", F.expr(f"before div {file_bytes}")).drop("at")
    starts = placed.groupBy("file").agg(F.min("before").alias("file_start"))
    return placed.join(starts, "file").select("id", "file", (F.col("before") - F.col("file_start")).alias("offset"), "length", "digest", *also)


def _parents(nodes: DataFrame, size: int | None) -> DataFrame:
    """Nodes over ranges of ``size`` bytes (None: a whole file) from ``file, start, digest`` of their children."""
    start = F.lit(0).cast("long") if size is None else F.expr(f"start - start % {size}")
    child = F.concat_ws(":", F.col("start").cast("string"), F.col("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", child.alias("line")))), lambda c: c["line"])
    return nodes.groupBy("file", start.alias("parent")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest")).select(
        "file", F.col("parent").alias("start"), "digest"
    )


def merkle_levels(records: DataFrame, file_bytes: int = FILE_BYTES) -> list[tuple[int | None, DataFrame]]:
    """(range size, nodes) from the lowest level up to the roots, from ``file, offset, length, digest``.

    The length is part of what a leaf says, so a record that is cut or grown differs too.
    """
    nodes = records.select("file", F.col("offset").alias("start"), F.concat_ws(":", F.col("length").cast("string"), "digest").alias("digest"))
    levels: list[tuple[int | None, DataFrame]] = []
    size = RANGE_BYTES
    while size < file_bytes:
        nodes = materialize(_parents(nodes, size), "merkle-level")
        levels.append((size, nodes))
        size *= FANOUT
    levels.append((None, materialize(_parents(nodes, None), "merkle-level")))
    return levels


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    both = left.select(*keys, F.col("digest").alias("a")).join(right.select(*keys, F.col("digest").alias("b")), keys, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def fixity_audit(primary: DataFrame, replica: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The records in which two replicas differ: ``file, offset, id, length, digest, replica_digest, status``.

    Both have ``id, file, offset, length, digest`` of each record, a record's place being its file and
    offset. Status: changed, missing (not in the replica) or extra (only there). Equal replicas, and two empty
    ones, give no rows. Only ranges whose parents differ are joined further down.
    """
    a, b = (materialize(x.select("id", "file", "offset", "length", "digest"), "warc-records") for x in (primary, replica))
    levels = list(zip(merkle_levels(a, file_bytes), merkle_levels(b, file_bytes), strict=True))[::-1]
    (_, left), (_, right) = levels[0]
    differ, above = _differing(left, right, ["file", "start"]), None
    for (size, left), (_, right) in levels[1:]:
        differ = materialize(differ, "merkle-differing")
        parent = F.lit(0).cast("long") if above is None else F.expr(f"start - start % {above}")
        parents = differ.withColumnRenamed("start", "parent")
        left, right = (x.withColumn("parent", parent).join(parents, ["file", "parent"], "left_semi") for x in (left, right))
        differ, above = _differing(left, right, ["file", "start"]), size
    ranges = materialize(differ, "merkle-differing").withColumnRenamed("start", "range")
    lowest = F.lit(0).cast("long") if above is None else F.expr(f"offset - offset % {above}")
    left, right = (x.withColumn("range", lowest).join(ranges, ["file", "range"], "left_semi").drop("range") for x in (a, b))
    right = right.select("file", "offset", F.col("id").alias("id_b"), F.col("length").alias("length_b"), F.col("digest").alias("replica_digest"))
    both = left.join(right, ["file", "offset"], "full_outer")
    same = F.col("digest").eqNullSafe(F.col("replica_digest")) & F.col("length").eqNullSafe(F.col("length_b"))
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "missing").otherwise("changed")
    return both.where(~same).select(
        "file", "offset", F.coalesce("id", "id_b").alias("id"), F.coalesce("length", "length_b").alias("length"),
        "digest", "replica_digest", status.alias("status"),
    )
