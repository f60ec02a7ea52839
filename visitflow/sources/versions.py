"""A table that is rewritten as a whole: a new version beside the old one, and a pointer that is switched at the end.

A table is a folder with one folder for each version and a small file that names the current one. Readers follow the
pointer. A writer fills a folder of its own first and then replaces the pointer by one atomic rename, so readers see the old
table or the new one, and a writer that dies leaves the old. Stores whose rename is not atomic need another pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


class ConflictError(RuntimeError):
    """Another writer switched the pointer since this one read it."""


def _context(spark: SparkSession, path: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the folder that readers see; None before the first commit."""
    files = _context(spark, path)
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not files.util().exists(pointer):
        return None
    source = files.open(pointer)
    try:
        return bytes(source.readNBytes(4096)).decode()
    finally:
        source.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no committed version in {path}")
    return spark.read.parquet(f"{path}/{version}")


def commit(spark: SparkSession, path: str, version: str, expected: str | None) -> None:
    """Point readers to ``version``, if they are still pointed to ``expected``.

    The check and the rename are two steps: writers of one table take turns, readers need not.
    """
    if current_version(spark, path) != expected:
        raise ConflictError(f"{path} was rewritten by another writer")
    jvm = spark._jvm
    files, hadoop = _context(spark, path), jvm.org.apache.hadoop.fs
    draft = hadoop.Path(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    sink = files.create(draft, flags, spark.sparkContext._gateway.new_array(hadoop.Options.CreateOpts, 0))
    sink.write(version.encode())
    sink.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(draft, hadoop.Path(f"{path}/{POINTER}"), how)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Write the changed table as a new version and switch to it; gives the version's name.

    ``change`` gets the current version. If it or the write fails, readers keep the old version, and the new folder is garbage.
    """
    expected = current_version(spark, path)
    return _publish(spark, path, change(read_current(spark, path)), expected)


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version, whatever the current one holds."""
    spark = df.sparkSession
    return _publish(spark, path, df, current_version(spark, path))


def _publish(spark: SparkSession, path: str, df: DataFrame, expected: str | None) -> str:
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    commit(spark, path, version, expected)
    return version


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions but the current one, once nobody reads them; gives their number."""
    current = current_version(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName() not in (POINTER, current)]
    for place in old:
        store.delete(place, True)
    return len(old)
