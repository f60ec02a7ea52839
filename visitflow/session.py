"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_owners: list[list[str]] = []  # paths written inside open temporary_tables(), innermost last


def build_session(
    app_name: str = "visitflow",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings the operators rely on; ANSI mode stays on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: executors of a
    cluster do not share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="visitflow-")
        atexit.register(shutil.rmtree, _local_folders[application], ignore_errors=True)
    return _local_folders[application]


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table's folder through Hadoop, whatever the store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was written to the shared folder inside, also after an error.

    Results that are read lazily, such as those of ``fit_transform``, must be used
    or written elsewhere before.
    """
    _owners.append([])
    try:
        yield
    finally:
        for path in _owners.pop():
            drop_table(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Later steps scan the table with column pruning, and a lost executor costs
    a re-read, not a recomputation of the lineage.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
