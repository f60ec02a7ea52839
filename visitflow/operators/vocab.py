"""Vocabularies of categorical columns.

Index 0 is missing, 1 is unknown, 2.. are the retained values by frequency and
the index after them is every other value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.sentinels import NONE_VALUES, OTHER_VALUES, UNKNOWN_VALUES, is_reserved
from visitflow.functions.text import trim_ws
from visitflow.operators.clean import ID_COLUMNS
from visitflow.operators.profile import TOP_VALUES, top_values, value_counts

RESERVED = 2
# Labels of the reserved indices.
NONE_LABEL = "__NONE__"
UNKNOWN_LABEL = "__UNKNOWN__"
OTHER_LABEL = "__OTHER__"

# Columns that are numbers, whatever type they arrive in.
NUMERIC_COLUMNS = [
    "average_price_product_viewed",
    "date",
    "total_category_viewed",
    "total_product_viewed",
    "total_revenue",
    "visitId",
    "visitNumber",
    "visitStartTime",
    "totals_bounces",
    "totals_hits",
    "totals_newVisits",
    "totals_pageviews",
    "totals_sessionQualityDim",
    "totals_timeOnSite",
    "totals_totalTransactionRevenue",
    "totals_transactionRevenue",
    "totals_transactions",
    "totals_visits",
]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text columns that are neither numbers nor identifiers."""
    excluded = {*NUMERIC_COLUMNS, *ID_COLUMNS}
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in excluded
    ]


def rank_categories(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """``(column, value, index)`` of the retained values.

    Reserved values take part in the top ``k`` and are left out afterwards, so
    a column may retain fewer than ``k`` values.
    """
    top = top_values(counts, k).filter(~is_reserved(F.col("value")))
    stripped = top.groupBy("column", trim_ws(F.col("value")).alias("value")).agg(
        F.min("rank").alias("rank")
    )
    order = Window.partitionBy("column").orderBy("rank")
    return stripped.select(
        "column", "value", (F.row_number().over(order) + (RESERVED - 1)).cast("bigint").alias("index")
    )


def vocabulary_spec(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """Sizes and ordered categories of every column, one row each."""
    kept = (
        rank_categories(counts, k)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("kept"))
    )
    # Reading ``n`` here keeps both branches on one shuffle of the counts.
    sizes = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("requested_top_k"))
    names = F.coalesce(F.col("kept.value"), F.array().cast("array<string>"))
    return sizes.join(kept, "column", "left").select(
        "column",
        "requested_top_k",
        F.size(names).cast("bigint").alias("top_n"),
        F.lit(RESERVED).cast("bigint").alias("reserved"),
        (F.size(names) + RESERVED).cast("bigint").alias("others_index"),
        (F.size(names) + RESERVED + 1).cast("bigint").alias("vocab_size"),
        names.alias("top_categories_order"),
    )


def _fixed_entries(others: Column | int) -> list[tuple[str, Column | int, int]]:
    """Labels and the raw texts they cover: text, index, strength.

    Of entries for one text the strongest counts. Retained values have strength
    ``RETAINED``: raw texts win over them, and they over the first two labels.
    """
    return [
        (NONE_LABEL, 0, 0),
        (UNKNOWN_LABEL, 1, 0),
        (OTHER_LABEL, others, 2),
        *[(v, 0, 3) for v in NONE_VALUES],
        *[(v, 1, 3) for v in UNKNOWN_VALUES],
        *[(v, others, 3) for v in OTHER_VALUES],
    ]


RETAINED = 1


def value_index(spec: DataFrame) -> DataFrame:
    """``(column, value, index)`` incl. the reserved labels and the raw texts they cover."""

    def entry(value: str, index: Column | int, strength: int) -> Column:
        index = F.lit(index) if isinstance(index, int) else index
        return F.struct(
            F.lit(value).alias("value"),
            index.cast("bigint").alias("index"),
            F.lit(strength).alias("strength"),
        )

    fixed = [entry(*e) for e in _fixed_entries(F.col("others_index"))]
    retained = F.transform(
        F.col("top_categories_order"),
        lambda v, i: F.struct(
            v.alias("value"), (i + RESERVED).cast("bigint").alias("index"), F.lit(RETAINED).alias("strength")
        ),
    )
    entries = spec.select("column", F.explode(F.concat(F.array(*fixed), retained)).alias("e"))
    return entries.groupBy("column", F.col("e.value").alias("value")).agg(
        F.max_by("e.index", "e.strength").alias("index")
    )


def index_value(spec: DataFrame) -> DataFrame:
    """``(column, index, value)``: the label or category each index stands for."""
    labels = F.concat(
        F.array(F.lit(NONE_LABEL), F.lit(UNKNOWN_LABEL)),
        F.col("top_categories_order"),
        F.array(F.lit(OTHER_LABEL)),
    )
    return spec.select("column", F.posexplode(labels).alias("pos", "value")).select(
        "column", F.col("pos").cast("bigint").alias("index"), "value"
    )


def fit_vocabulary(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> dict:
    """Dictionary document of all categorical columns.

    At most ``k`` values per column reach the driver.
    """
    names = categorical_columns(df) if columns is None else columns
    if not names:
        return {"columns": {}}
    return dictionary_of(vocabulary_spec(value_counts(df, names), k), names)


def dictionary_of(spec: DataFrame, names: list[str] | None = None) -> dict:
    rows = {r["column"]: r for r in spec.collect()}
    columns = {}
    for name in names or sorted(rows):
        if name not in rows:
            continue
        r = rows[name]
        top, others = list(r["top_categories_order"]), r["others_index"]
        retained = [(v, RESERVED + i, RETAINED) for i, v in enumerate(top)]
        by_strength = sorted([*_fixed_entries(others), *retained], key=lambda e: e[2])
        to_index = {value: index for value, index, _ in by_strength}  # a later one replaces an earlier
        labels = [NONE_LABEL, UNKNOWN_LABEL, *top, OTHER_LABEL]
        columns[name] = {
            "requested_top_k": r["requested_top_k"],
            "top_n": r["top_n"],
            "reserved": r["reserved"],
            "others_index": others,
            "vocab_size": r["vocab_size"],
            "value_to_index": to_index,
            "index_to_value": {str(i): v for i, v in enumerate(labels)},
            "top_categories_order": top,
        }
    return {"columns": columns}


def vocab_sizes(dictionary: dict) -> dict[str, int]:
    """Vocabulary size per column, 2 where none is stored."""
    return {c: spec.get("vocab_size", 2) for c, spec in (dictionary.get("columns") or {}).items()}
