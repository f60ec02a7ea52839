"""Fitted parameters as JSON documents, and metric reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_json(spark: SparkSession, path: str) -> dict:
    """One JSON document, such as a numeric policy or a categorical dictionary."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_version(spark: SparkSession, values: dict, path: str) -> int:
    """Store a document as a new version; earlier versions stay as they are."""
    version = (latest_version(spark, path) or 0) + 1
    text = json.dumps(values, ensure_ascii=False)
    document = spark.createDataFrame([(text,)], "value string").coalesce(1)
    document.write.mode("error").text(f"{path}/version={version}")
    return version


def latest_version(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.text(path).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_version(spark: SparkSession, path: str, version: int | None = None) -> dict:
    wanted = version or latest_version(spark, path)
    if wanted is None:
        raise FileNotFoundError(f"no parameters in {path}")
    return load_json(spark, f"{path}/version={wanted}")


def write_report(report: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header."""
    report.write.mode("overwrite").option("header", True).csv(path)
