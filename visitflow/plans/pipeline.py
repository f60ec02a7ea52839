"""Fit on raw training sessions, apply unchanged to new sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from visitflow.operators.clean import (
    ID_COLUMNS,
    LABEL,
    SINGLE_VALUED_COLUMNS,
    cast_ids,
    cast_totals,
    drop_columns,
)
from visitflow.operators.flatten import (
    Leaf,
    category_width,
    discover_leaves,
    flatten_sessions,
    spread_categories,
)
from visitflow.operators.order_stats import SORTED_ROWS
from visitflow.operators.policy import DEFAULT_POLICY, fit_caps, model_input
from visitflow.operators.profile import single_valued_columns
from visitflow.operators.vocab import categorical_columns, fit_vocabulary
from visitflow.session import materialize, temporary_tables
from visitflow.sources.params import load_version, save_version


def clean_sessions(
    raw: DataFrame, leaves: list[Leaf], width: int, dropped: list[str] | None = None
) -> DataFrame:
    """Flatten, drop single-valued columns, cast totals and identifiers; row-local."""
    flat = flatten_sessions(raw, leaves, width)
    return cast_ids(cast_totals(drop_columns(flat, dropped)))


@dataclass(frozen=True)
class FittedPipeline:
    """Frozen parameters of the pipeline."""

    leaves: list[Leaf]
    category_width: int
    dropped: list[str]
    policy: dict
    dictionary: dict

    def clean(self, raw: DataFrame) -> DataFrame:
        return clean_sessions(raw, self.leaves, self.category_width, self.dropped)

    def transform(self, raw: DataFrame) -> DataFrame:
        """Model input of raw sessions: one chain without a shuffle, also on a stream.

        The number of category columns was fixed by the training sessions; a session
        with more keeps its first ones in text order. ``categories_past`` counts the others.
        """
        return model_input(self.clean(raw), self.policy, self.dictionary)

    def to_dict(self) -> dict:
        return {
            "leaves": [leaf.to_dict() for leaf in self.leaves],
            "category_width": self.category_width,
            "dropped": self.dropped,
            "policy": self.policy,
            "dictionary": self.dictionary,
        }

    @staticmethod
    def from_dict(values: dict) -> FittedPipeline:
        leaves = [Leaf.from_dict(x) for x in values["leaves"]]
        return FittedPipeline(**{**values, "leaves": leaves})

    def save(self, spark: SparkSession, path: str) -> int:
        return save_version(spark, self.to_dict(), path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> FittedPipeline:
        return FittedPipeline.from_dict(load_version(spark, path, version))


def fit_pipeline(
    raw: DataFrame,
    policy: dict | None = None,
    drop_low_variance: bool = False,
    sorted_rows: int = SORTED_ROWS,
) -> FittedPipeline:
    """Discover columns, fit vocabulary and caps.

    The flat table is written once, scanned for all fits and deleted. With
    ``drop_low_variance`` the single-valued columns are found in the data
    instead of taken from the fixed list.
    """
    with temporary_tables(raw.sparkSession):
        return _fit(raw, policy, drop_low_variance, sorted_rows)[0]


def fit_transform(
    raw: DataFrame,
    policy: dict | None = None,
    drop_low_variance: bool = False,
    sorted_rows: int = SORTED_ROWS,
) -> tuple[FittedPipeline, DataFrame]:
    """Fit, and the model input of the same sessions without parsing them again.

    The model input reads the flat table in the shared folder; put the call and the
    use of its result inside ``temporary_tables`` to have that table deleted.
    """
    fitted, cleaned = _fit(raw, policy, drop_low_variance, sorted_rows)
    return fitted, model_input(cleaned, fitted.policy, fitted.dictionary)


def _fit(
    raw: DataFrame, policy: dict | None, drop_low_variance: bool, sorted_rows: int
) -> tuple[FittedPipeline, DataFrame]:
    leaves = discover_leaves(raw)
    flat = materialize(flatten_sessions(raw, leaves), "flat-sessions")
    width = category_width(flat)
    wide = spread_categories(flat, width)
    dropped = SINGLE_VALUED_COLUMNS
    if drop_low_variance:
        dropped = single_valued_columns(wide)
    dropped = [c for c in dropped if c in wide.columns and c not in (*ID_COLUMNS, LABEL)]
    cleaned = cast_ids(cast_totals(drop_columns(wide, dropped)))
    fitted = FittedPipeline(
        leaves=leaves,
        category_width=width,
        dropped=dropped,
        policy=fit_caps(cleaned, policy or DEFAULT_POLICY, sorted_rows),
        dictionary=fit_vocabulary(cleaned, sorted(categorical_columns(cleaned))),
    )
    return fitted, cleaned
