"""CSV records held against the header: those that do not fit are told apart, never cut or filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, RECORD, REASON = "file", "record", "reason"
#: Reasons why a record is bad.
FEW, MANY, OPEN, BEHIND = "too few fields", "too many fields", "open quote", "text behind a quote"
SHOWN_CHARS = 200

# A quoted field holds quotes in pairs; another field does not begin with one. Possessive, so no cell is read twice.
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELD = rf'(?:{_QUOTED}(?=,|$)|(?!")[^,]*+)'
#: No CSV text has it: the reader then gives each line as one cell.
_NO_SEPARATOR = "\x01"


def _reader(spark: SparkSession, multi_line: bool = False) -> DataFrameReader:
    quoted = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return quoted.option("multiLine", multi_line).option("enforceSchema", False)


def _plain_lines(spark: SparkSession) -> DataFrameReader:
    lines = spark.read.option("header", True).option("sep", _NO_SEPARATOR).option("quote", "").option("escape", "")
    return lines.option("enforceSchema", False)


def bad_reason(record: Column, n_fields: int) -> Column:
    """Why a line is no record of ``n_fields`` fields; null for a good one."""
    first, more = rf"^{_FIELD}", rf"(?:,{_FIELD})"
    return (
        F.when(record.rlike(f"{first}{more}{{{n_fields - 1}}}+$"), F.lit(None).cast("string"))
        .when(record.rlike(f"{first}{more}{{{n_fields}}}"), MANY)
        .when(record.rlike(f"{first}{more}*+$"), FEW)
        .when(record.rlike(rf'^(?:{_FIELD},)*+"(?:[^"]++|"")*+$'), OPEN)
        .otherwise(BEHIND)
    )


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[list[str], DataFrame]:
    """The header's names, and ``(file, record, reason, cells)``, where cell ``c<i>`` is a text.

    ``reason`` is null for a good record; of a bad one the whole ``record`` is kept. Every file begins
    with the same header, or reading it fails. Without ``multi_line`` a record is a line, and files are split among
    tasks; with it, a file is one task, and one more job counts its quotes first.
    """
    names = _reader(spark, multi_line).csv(path).columns
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    if multi_line:
        _refuse_open_quotes(spark, path)
        record = "_record"
        while record in names:
            record = f"_{record}"
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, record]])
        read = _reader(spark, True).schema(schema).option("columnNameOfCorruptRecord", record).csv(path)
        rows = read.select(F.col("_metadata.file_path"), "*").toDF(FILE, *cells.names, RECORD)
        # A bad record still has its text; fields are counted as the reader does.
        many = F.col(f"c{len(names) - 1}").isNotNull()
        reason = F.when(F.col(RECORD).isNotNull(), F.when(many, MANY).otherwise(FEW))
        return names, rows.select(FILE, RECORD, reason.alias(REASON), F.struct(*cells.names).alias("cells"))
    header = _plain_lines(spark).csv(path).columns[0]
    # Named like the header, so Spark holds the first line of each file against it.
    lines = _plain_lines(spark).schema(T.StructType([T.StructField(header, T.StringType())])).csv(path)
    rows = lines.select(F.col("_metadata.file_path"), "*").toDF(FILE, RECORD)
    parsed = F.from_csv(F.col(RECORD), ", ".join(f"{c} string" for c in cells.names), {"quote": '"', "escape": '"'})
    return names, rows.select(FILE, RECORD, bad_reason(F.col(RECORD), len(names)).alias(REASON), parsed.alias("cells"))


def _refuse_open_quotes(spark: SparkSession, path: str) -> None:
    """A file whose quotes do not pair has no end of its last record: an error that names up to ten such files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias(FILE), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy(FILE).agg(F.sum(quotes).alias("quotes")).where(F.col("quotes") % 2 == 1)
    files = [row[FILE] for row in odd.orderBy(FILE).limit(10).collect()]
    if files:
        raise ValueError(f"{OPEN} in {', '.join(files)}: quotes do not pair, so records have no end")


def only_good(rows: DataFrame, multi_line: bool) -> DataFrame:
    """The rows, which fail at the first bad record when they are read, whatever columns are."""
    hint = "" if multi_line else "; set multi_line=True if cells hold line breaks, or split_sessions_csv to keep bad records apart"
    message = F.concat(
        F.lit("bad CSV record, "), F.col(REASON), F.lit(", in "), F.col(FILE), F.lit(": "),
        F.substring(F.col(RECORD), 1, SHOWN_CHARS), F.lit(hint),
    )
    return rows.where(F.when(F.col(REASON).isNull(), True).otherwise(F.raise_error(message).cast("boolean")))


def bad_records(rows: DataFrame) -> DataFrame:
    """``(file, record, reason)`` of the bad records."""
    return rows.where(F.col(REASON).isNotNull()).select(FILE, RECORD, REASON)


def bad_record_counts(bad: DataFrame) -> DataFrame:
    """``(file, reason, records)``."""
    return bad.groupBy(FILE, REASON).agg(F.count(F.lit(1)).alias("records"))
