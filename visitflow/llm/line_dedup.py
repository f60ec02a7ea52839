"""Line deduplication by range-partitioned hashes, in DataFrame expressions only.

Every long line becomes a narrow row: a 128-bit hash of its key, its document and its place. The rows are partitioned by
ranges of hashes and sorted by hash, document (largest first) and place, so one pass over a group meets the first
occurrence, which stays, and counts the documents behind it. What comes back is a compressed bitmap for each
document, not text: runs of lines that stay.

A key that holds more than its share of the rows never becomes one group: a sketch of bounded size names such keys, their
counts are summed in each task first, and their few results are broadcast. There are at most :data:`HOT_KEYS` of
them for each shuffle partition, so the broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.functions.binding import let
from visitflow.session import materialize

MIN_CHARS, MIN_DOCUMENTS = 40, 5
#: A key with over 1 / (4 * partitions) of the rows is hot, if that is over ``LEAST_HOT`` rows. The sketch tracks 64 entries a
#: partition and misses no key of 7 / 64 of a partition's rows; at most 8 a partition reach its estimate.
HOT_SHARE, LEAST_HOT, HOT_KEYS, TRACKED = 4, 1000, 8, 64
#: Most entries that the sketch function takes (fixed value of Spark).
MOST_TRACKED = 1_000_000

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one, which is empty."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(_SPACE))
    # An ASCII text takes the fast path; in others only A-Z change.
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _text_print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, print, place, high, low)`` of each line whose key has ``min_chars`` code points.

    ``print`` tells texts of one id apart; ``high`` and ``low`` are two 64-bit hashes of the key.
    """
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_print(F.col("text")).alias("print"),
        F.posexplode(lines_of(F.col("text"))).alias("place", "line"),
    )
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "print", "place", F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), F.col("key")).alias("low"))


def hot_keys(rows: DataFrame, min_documents: int) -> DataFrame:
    """``(high, low, last, often)`` of keys with a large share of the rows: their largest id, and whether enough documents hold them."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(TRACKED * partitions, MOST_TRACKED)
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"approx_top_k(high, {min(HOT_KEYS * partitions, tracked)}, {tracked})").alias("top"),
    ).first()
    least = max(found["rows"] // (HOT_SHARE * partitions), LEAST_HOT)
    heavy = [(entry["item"],) for entry in found["top"] or [] if entry["count"] >= least]
    chosen = spark.createDataFrame(heavy, "high long")
    held = rows.join(F.broadcast(chosen), "high", "left_semi").select("high", "low", "doc_id").distinct()
    return held.groupBy("high", "low").agg(F.max("doc_id").alias("last"), (F.count(F.lit(1)) >= min_documents).alias("often"))


def dropped_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(doc_id, print, place)`` of the lines that go: all of a key in enough documents, but for its largest id."""
    hot = hot_keys(rows, min_documents)
    marked = rows.join(F.broadcast(hot), ["high", "low"], "left")
    told = marked.where(F.col("often") & ~F.col("doc_id").eqNullSafe(F.col("last")))
    met = marked.where(F.col("often").isNull()).select(*rows.columns).repartitionByRange("high", "low")
    # Streams each key's rows, the largest document first; the count of documents is that of the last row.
    group = Window.partitionBy("high", "low")
    ordered = group.orderBy(F.desc_nulls_last("doc_id"), "place")
    opens = (F.row_number().over(ordered) == 1) | ~F.lag("doc_id").over(ordered).eqNullSafe(F.col("doc_id"))
    nth = F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ranked = met.withColumn("opens", opens).withColumn("nth", nth).withColumn("documents", F.max("nth").over(group))
    later = ranked.where((F.col("nth") > 1) & (F.col("documents") >= min_documents))
    columns = ["doc_id", "print", "place"]
    return told.select(*columns).unionAll(later.select(*columns))


def _dropped_runs(lost: DataFrame) -> DataFrame:
    """``(doc_id, print, firsts, lasts)``: the runs of lines of each document that go."""
    places = lost.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def edges(step: int) -> Column:
        return F.filter("places", lambda x, i: ~F.get("places", i + step).eqNullSafe(x + step))

    # get() of the place before the first gives null, as that behind the last does.
    return places.select("doc_id", "print", edges(-1).alias("firsts"), edges(1).alias("lasts"))


def _keep_runs(n_lines: Column) -> Column:
    """The runs between those that go, as ``array<struct<first, length>>``; whole for a document that loses none."""

    def run(i: Column) -> Column:
        first = F.coalesce(F.get("lasts", i - 1) + 1, F.lit(0))
        return F.struct(first.alias("first"), (F.coalesce(F.get("firsts", i), n_lines) - first).alias("length"))

    runs = F.transform(F.sequence(F.lit(0), F.coalesce(F.size("firsts"), F.lit(0))), run)
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(row, n_lines, keep)``: each document's columns as a struct, its number of lines, and its keep bitmap.

    The bitmap of lines is run-length compressed: ``keep`` lists ``(first, length)`` of each run of lines that stay, from 0.
    Documents are told apart by id: rows with one id are one document in the counts, and null ids are one
    document, the smallest. Null and empty texts have one line, which stays. An empty table gives an empty result.
    Texts of any length are read whole; a task holds one document and the places of its lines.
    """
    rows = materialize(line_hashes(docs, min_chars), "line-hashes")
    runs = _dropped_runs(dropped_lines(rows, min_documents)).select(F.struct("*").alias("lost"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_print(F.col("text")).alias("fp"))
    same = F.col("id").eqNullSafe(F.col("lost.doc_id")) & (F.col("fp") == F.col("lost.print"))
    joined = whole.join(runs, same, "left").select("row", "lost.firsts", "lost.lasts")
    n_lines = F.size(lines_of(F.col("row.text")))
    return joined.withColumn("n_lines", n_lines.cast("long")).select("row", "n_lines", _keep_runs(F.col("n_lines").cast("int")).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of the bitmap, joined by line breaks."""

    def cut(lines: Column) -> Column:
        return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["length"]))), "\n")

    return let(lines_of(text), cut)


def kept_lines(keep: Column) -> Column:
    """How many lines a bitmap keeps."""
    return F.aggregate(keep, F.lit(0).cast("long"), lambda n, r: n + r["length"])


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``; null texts stay null. For the rest see :func:`keep_bitmaps`."""
    found = keep_bitmaps(docs, min_chars, min_documents)
    shortened = kept_lines(F.col("keep")) < F.col("n_lines")
    text = F.when(shortened, kept_text(F.col("row.text"), F.col("keep"))).otherwise(F.col("row.text"))
    return found.select(*[(text if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
