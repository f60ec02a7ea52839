"""Fixity audit: the trees find just what a record-by-record comparison finds."""

import hashlib

from pyspark.sql import functions as F

from visitflow.llm.merkle import archive_layout, fixity_audit, merkle_levels, warc_record
from visitflow.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, key string, file string, offset string"


def pages(spark, n=300):
    rows = [(k, f"http://x/{k}", "é" * (k * 37 % 900), "a", "b", "c") for k in range(n)]
    rows += [(5, "http://again", None, None, None, None), (None, None, None, None, None, None), (5, "http://again", None, None, None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_layout_is_gapless_and_ordered(spark):
    laid = archive_layout(pages(spark), warc_record(), file_bytes=40_000).collect()
    laid.sort(key=lambda r: (r.file, r.offset))
    assert [r.id for r in laid] == sorted((r.id for r in laid), key=lambda k: (k is not None, k))
    place, end, start = 0, {}, {}
    for r in laid:
        start.setdefault(r.file, place)
        assert r.file == place // 40_000 and r.offset == place - start[r.file]
        place += r.length
    record = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: http://x/7\r\nContent-Type: text/html\r\n"
    body = "é" * (7 * 37 % 900)
    record = f"{record}Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()
    assert (len(record), hashlib.sha256(record).hexdigest()) in {(r.length, r.digest) for r in laid}


def test_roots_follow_from_their_children(spark):
    laid = archive_layout(pages(spark), warc_record(), file_bytes=400_000)
    levels = merkle_levels(laid, 400_000)
    assert [size for size, _ in levels] == [65536, None]
    rows = sorted(laid.collect(), key=lambda r: (r.file, r.offset))
    for nodes, children in (
        (levels[0][1], [(r.file, r.offset - r.offset % 65536, r.offset, f"{r.length}:{r.digest}") for r in rows]),
        (levels[1][1], [(r.file, 0, r.start, r.digest) for r in levels[0][1].orderBy("file", "start").collect()]),
    ):
        expected = {}
        for file, parent, start, digest in children:
            expected.setdefault((file, parent), []).append(f"{start}:{digest}")
        got = {(r.file, r.start): r.digest for r in nodes.collect()}
        assert got == {k: hashlib.sha256("\n".join(lines).encode()).hexdigest() for k, lines in expected.items()}


def test_audit_finds_every_damage(spark):
    primary = archive_layout(pages(spark), warc_record(), file_bytes=60_000)
    damaged = (
        primary.where("coalesce(id, 0) % 50 != 9")
        .withColumn("digest", F.when(F.col("id") % 40 == 3, F.sha2("digest", 256)).otherwise(F.col("digest")))
        .withColumn("length", F.when(F.col("id") == 100, F.col("length") - 1).otherwise(F.col("length")))
    )
    extra = spark.createDataFrame([(777, 99, 0, 10, "x")], "id long, file long, offset long, length long, digest string")
    found = {(r.id, r.status) for r in fixity_audit(primary, damaged.unionByName(extra), 60_000).collect()}
    expected = {(k, "missing") for k in range(300) if k % 50 == 9}
    expected |= {(k, "changed") for k in range(300) if k % 40 == 3 and k % 50 != 9}
    assert found == expected | {(100, "changed"), (777, "extra")}


def test_equal_and_empty_replicas(spark):
    primary = archive_layout(pages(spark), warc_record())
    assert fixity_audit(primary, primary).count() == 0
    nothing = archive_layout(spark.createDataFrame([], PAGES), warc_record())
    assert nothing.count() == 0
    assert fixity_audit(nothing, nothing).count() == 0
    assert {r.status for r in fixity_audit(primary, nothing).collect()} == {"missing"}


def test_query_with_null_and_repeated_ids(spark, tmp_path):
    """Null and repeated ids are records of their own: only planted damage is found, each once."""
    rows = [(k, f"http://x/{k}", "é" * (k % 40)) for k in range(300)]
    rows += [(None, "a", "b"), (None, "a", "b"), (68, "again", "x"), (68, "again", "x"), (72, "again", "y"), (0, "twice", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    found = QUERIES["op3_merkle_fixity"](spark, str(tmp_path)).collect()
    kinds = {7: "changed", 11: "missing", 17: "changed", 23: "changed", 29: "extra"}
    expected = [(k, kinds[k % 61]) for k, _, _ in rows if k is not None and k % 61 in kinds]
    assert sorted((r.page_id, r.status) for r in found) == sorted(expected)
    assert len({(r.file, r.offset) for r in found}) == len(found)
