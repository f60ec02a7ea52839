"""CSV and parquet sources and sinks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.numbers import text_to_long
from visitflow.operators.clean import ID_COLUMNS
from visitflow.sources.records import REASON, bad_records, only_good, read_records

ROWS_PER_FILE = 500_000
FOOTER_READERS = 16
ROWS_PER_TASK = 100_000  # of rows whose cells are parsed
# Raw columns that are whole numbers.
LONG_COLUMNS = ["date", "visitNumber", "visitStartTime"]

# Texts that a CSV reader takes for a missing value.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def read_sessions_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool = False,
    long_columns: list[str] | None = None,
    id_columns: list[str] | None = None,
) -> DataFrame:
    """Raw sessions by column name; identifiers keep their leading zeros.

    Every cell is read as text, without an inference pass. A record whose fields are not those of
    the header, or whose quotes are open, is an error when it is read, which names the file and the record;
    :func:`split_sessions_csv` keeps such records apart instead. ``multi_line`` makes one task per file: set
    it only when cells contain line breaks.
    """
    names, rows = read_records(spark, path, multi_line)
    return _session_cells(only_good(rows, multi_line), names, long_columns, id_columns)


def split_sessions_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool = False,
    long_columns: list[str] | None = None,
    id_columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Good sessions, as :func:`read_sessions_csv` gives them, and ``(file, record, reason)`` of the bad records."""
    names, rows = read_records(spark, path, multi_line)
    good = rows.where(F.col(REASON).isNull())
    return _session_cells(good, names, long_columns, id_columns), bad_records(rows)


def _session_cells(
    rows: DataFrame, names: list[str], long_columns: list[str] | None, id_columns: list[str] | None
) -> DataFrame:
    ids = ID_COLUMNS if id_columns is None else id_columns
    longs = LONG_COLUMNS if long_columns is None else long_columns
    cells = []
    for i, name in enumerate(names):
        c = F.col(f"cells.c{i}")
        if name not in ids:
            c = F.when(~c.isin(MISSING_TOKENS), c)
        cells.append((text_to_long(c) if name in longs else c).alias(name))
    return rows.select(*cells)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All parquet parts of a folder as one table; an empty folder is an error of Spark's reader."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def rows_per_part(spark: SparkSession, path: str) -> DataFrame:
    """``(part, rows)`` of every parquet part that has rows."""
    table = read_table(spark, path)
    return table.groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def spread_rows(scan: DataFrame) -> DataFrame:
    """Spread a table scan over all cores before CPU-heavy parsing, in tasks that grow in number, not in rows.

    The rows are counted from the footers. A table with enough splits is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, math.ceil(scan.count() / ROWS_PER_TASK))
    return scan if scan.rdd.getNumPartitions() >= tasks else scan.repartition(tasks)


def is_broadcast(df: DataFrame) -> bool:
    """Whether a join sends ``df`` to every executor, by Spark's size estimate."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def write_table(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """New parquet table; never a folder that is being read."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type that holds the values of both; text when there is no numeric one."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def union_relaxed(*parts: DataFrame) -> DataFrame:
    """Union by name: absent columns become null, differing types their common type."""
    types: dict[str, T.DataType] = {}
    for part in parts:
        for f in part.schema:
            types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    shaped = [
        part.select(
            *[
                (F.col(f"`{c}`") if c in part.columns else F.lit(None)).cast(t).alias(c)
                for c, t in types.items()
            ]
        )
        for part in parts
    ]
    return reduce(DataFrame.union, shaped)


def read_parts_relaxed(spark: SparkSession, path: str) -> DataFrame:
    """Parquet parts whose schemas may differ, as one table.

    Spark merges the footers in parallel. Only when parts disagree on a type are
    the footers read again in one job, the parts grouped by schema and united, one
    branch per schema.
    """

    def reader() -> DataFrameReader:
        return spark.read.option("pathGlobFilter", "*.parquet")

    try:
        return reader().option("mergeSchema", True).parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" not in str(error):
            raise
    files = sorted(reader().parquet(path).inputFiles())
    groups: dict[str, list[str]] = {}
    for row in _footer_schemas(spark, files).groupBy("shape").agg(F.collect_list("file").alias("files")).collect():
        if row["shape"] is not None:
            groups[row["shape"]] = row["files"]
            continue
        # A store that only Spark's readers can open: its own reader gives the schema, file by file.
        with ThreadPoolExecutor(FOOTER_READERS) as pool:
            schemas = pool.map(lambda name: spark.read.parquet(name).schema.json(), row["files"])
            for name, schema in zip(row["files"], schemas, strict=True):
                groups.setdefault(schema, []).append(name)
    ordered = sorted(groups.values(), key=min)
    return union_relaxed(*[spark.read.parquet(*sorted(names)) for names in ordered])


def _footer_schemas(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, shape)``: the columns in each parquet footer, read in tasks; null if tasks cannot open the store."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for uri in batch.column(0).to_pylist():
                try:
                    store, name = fs.FileSystem.from_uri(uri)
                    shapes.append(pq.read_schema(name, filesystem=store).remove_metadata().to_string())
                except (pa.ArrowException, OSError, ImportError):
                    shapes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], ["file", "shape"])

    tasks = max(1, min(len(files) // 100, 1000))
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    return names.mapInArrow(read, "file string, shape string")
