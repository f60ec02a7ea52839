"""Per-visitor sums and regression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.operators.clean import LABEL
from visitflow.operators.model import PREDICTION

VISITOR = "fullVisitorId"


def visitor_predictions(scored: DataFrame, visitor: str = VISITOR) -> DataFrame:
    """Sum of the predicted log revenue per visitor; rows without a visitor are left out.

    Rows are summed before the shuffle, so a visitor with much of the table
    costs one row per task.
    """
    return (
        scored.filter(F.col(visitor).isNotNull())
        .groupBy(visitor)
        .agg(F.sum(PREDICTION).alias(PREDICTION))
    )


def visitor_actuals(df: DataFrame, visitor: str = VISITOR, label: str = LABEL) -> DataFrame:
    """Sum of the label per visitor, named ``actual``."""
    return (
        df.filter(F.col(visitor).isNotNull()).groupBy(visitor).agg(F.sum(label).alias("actual"))
    )


def compare_visitors(predictions: DataFrame, actuals: DataFrame, visitor: str = VISITOR) -> DataFrame:
    """Stored predictions beside the actual sums; one row per visitor on both sides."""
    return predictions.join(actuals, visitor, "inner")


def visitor_table(scored: DataFrame, visitor: str = VISITOR, label: str = LABEL) -> DataFrame:
    """Prediction and actual per visitor of one table, with one shuffle and no join."""
    return (
        scored.filter(F.col(visitor).isNotNull())
        .groupBy(visitor)
        .agg(F.sum(PREDICTION).alias(PREDICTION), F.sum(label).alias("actual"))
    )


def write_by_visitor(df: DataFrame, table: str, buckets: int, path: str | None = None, visitor: str = VISITOR) -> None:
    """Save a table in buckets of visitors, sorted within: sums per visitor and joins by visitor then need no shuffle.

    ``buckets`` is for the whole table's life: about its size over that of a comfortable task. With ``path`` the
    files lie there instead of in the warehouse.
    """
    dealt = df.repartition(buckets, F.col(visitor))  # one file a bucket
    writer = dealt.write.bucketBy(buckets, visitor).sortBy(visitor)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def visitors_missing(df: DataFrame, visitor: str = VISITOR) -> DataFrame:
    """Number of rows without a visitor."""
    return df.agg(F.count_if(F.col(visitor).isNull()).alias("rows_without_visitor"))


def regression_metrics(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """``(n, rmse, mae, r2)`` in one aggregate.

    A constant actual gives r2 1 for perfect predictions and 0 otherwise.
    """
    error = actual - predicted
    sums = df.agg(
        F.count(error).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(actual).alias("variance"),
    )
    r2 = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(F.col("variance") > 0, 1 - F.try_divide(F.col("mse"), F.col("variance")))
        .when(F.col("mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select("n", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def evaluation_report(
    validation: DataFrame, test: DataFrame, label: str = LABEL, visitor: str = VISITOR
) -> DataFrame:
    """``(section, metric, value)``: validation per row, test per visitor.

    Validation predictions are taken as they are, test predictions after the floor.
    """
    per_row = regression_metrics(validation, F.col(PREDICTION), F.col(label))
    per_visitor = regression_metrics(
        visitor_table(test, visitor, label), F.col(PREDICTION), F.col("actual")
    )
    sections = []
    for name, metrics in (("validation", per_row), ("test", per_visitor)):
        values = metrics.select(F.col("n").cast("double").alias("n"), "rmse", "mae", "r2")
        sections.append(
            values.unpivot([], ["n", "rmse", "mae", "r2"], "metric", "value").select(
                F.lit(name).alias("section"), "metric", "value"
            )
        )
    return sections[0].unionByName(sections[1])
