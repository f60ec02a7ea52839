"""Column profiles: counts, distinct values, top values, numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.numbers import nan_to_null
from visitflow.operators.order_stats import SORTED_ROWS, exact_quantiles

TOP_VALUES = 15
PROFILE_SCHEMA = "column string, dtype string, non_null bigint, null_count bigint, n_unique bigint"


def _as_text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.FractionalType):
        c = c + F.lit(0).cast(df.schema[name].dataType)  # -0.0 counts as 0.0
    return c.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` for every value of every column; null is a value.

    One scan and one shuffle for all columns. Rows are counted before the
    shuffle, so a value that holds much of the table costs one row per task.
    """
    names = columns or df.columns
    texts = df.select(*[_as_text(df, c).alias(c) for c in names])
    long = texts.unpivot([], [F.col(f"`{c}`") for c in names], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """``(column, value, n, rank)`` of the ``k`` most frequent values, ties by value.

    Spark keeps only ``k`` rows per column in each task before the shuffle
    (WindowGroupLimit), so no task sees all values of a column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``(column, dtype, non_null, null_count, n_unique, low_variance)`` per column.

    Null counts as one unique value. ``approximate`` replaces the shuffle of
    distinct values by one sketch per column.
    """
    names = sorted(df.columns)
    types = F.create_map(
        *[x for c in names for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))]
    )
    if approximate:
        stats = df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.count(F.col(f"`{c}`")).alias("non_null"),
                        F.count_if(F.col(f"`{c}`").isNull()).alias("null_count"),
                        (
                            F.approx_count_distinct(_as_text(df, c))
                            + F.max(F.col(f"`{c}`").isNull().cast("bigint"))
                        ).alias("n_unique"),
                    )
                    for c in names
                ]
            ).alias("s")
        ).select(F.inline("s"))
    else:
        stats = value_counts(df, names).groupBy("column").agg(
            F.sum(F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.col("n"))).alias("non_null"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0))).alias("null_count"),
            F.count(F.lit(1)).alias("n_unique"),
        )
    return stats.select(
        "column",
        F.element_at(types, F.col("column")).alias("dtype"),
        "non_null",
        "null_count",
        "n_unique",
        (F.col("n_unique") <= 1).alias("low_variance"),
    )


def single_valued_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value, null being one: the same as the profile finds.

    One aggregate of minima, maxima and null counts; no value is shuffled. NaN
    is a value like any other, and 0.0 and -0.0 are the same.
    """
    names = sorted(df.columns)
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.struct(
                F.count(F.col(f"`{c}`")).alias("non_null"),
                F.coalesce(F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`")), F.lit(True)).alias("one"),
            ).alias(f"c{i}")
            for i, c in enumerate(names)
        ],
    ).first()
    return [
        c
        for i, c in enumerate(names)
        if found[f"c{i}"]["one"] and found[f"c{i}"]["non_null"] in (0, found["n"])
    ]


def low_variance_columns(profile: DataFrame) -> list[str]:
    rows = profile.filter("low_variance").select("column").collect()
    return sorted(r["column"] for r in rows)


def table_totals(df: DataFrame) -> DataFrame:
    """Row and column count of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint")
    )


def describe_numeric(
    df: DataFrame,
    columns: list[str] | None = None,
    interpolation: str = "nearest",
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """count, null_count, mean, std, min, quartiles and max of numeric columns."""
    names = columns or [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType)
    ]
    numbers = {c: F.col(f"`{c}`").cast("double") for c in names}
    quartiles = exact_quantiles(
        df,
        {c: (nan_to_null(x), [0.25, 0.5, 0.75]) for c, x in numbers.items()},
        interpolation,
        sorted_rows,
    )
    rows = []
    for c, x in numbers.items():
        q25, q50, q75 = [F.lit(q).cast("double") for q in quartiles[c]]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.count_if(x.isNull()).alias("null_count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                q25.alias("q25"),
                q50.alias("q50"),
                q75.alias("q75"),
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))
