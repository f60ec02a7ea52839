"""Feature preparation fitted on the training split."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.numbers import clip, nan_to_null
from visitflow.operators.clean import ID_COLUMNS, LABEL
from visitflow.operators.encode import clamp_index
from visitflow.operators.order_stats import SORTED_ROWS, exact_quantiles

CLIP = 10.0


@dataclass(frozen=True)
class FeaturePrep:
    """Fill value, mean and standard deviation of every number; vocabulary size of every index, which stays as it is."""

    fill: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    indices: dict[str, int] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.fill, *self.indices]

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(values: dict) -> FeaturePrep:
        return FeaturePrep(**values)


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but identifiers and label."""
    return [c for c in df.columns if c not in {*ID_COLUMNS, LABEL}]


def numeric_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """Feature columns that are numbers, and those left out because they are not."""
    numeric = (T.NumericType, T.BooleanType)
    names = feature_columns(df)
    kept = [c for c in names if isinstance(df.schema[c].dataType, numeric)]
    return kept, [c for c in names if c not in kept]


def split_features(features: list[str], dictionary: dict) -> tuple[list[str], list[str]]:
    """Categorical and numeric features by membership in the vocabulary."""
    known = dictionary.get("columns") or {}
    return [c for c in features if c in known], [c for c in features if c not in known]


def align_columns(df: DataFrame, columns: list[str], fill: dict[str, float]) -> list[Column]:
    """The training columns as doubles; a column absent here is its fill value."""
    return [
        (F.col(f"`{c}`").cast("double") if c in df.columns else F.lit(float(fill.get(c, 0)))).alias(c)
        for c in columns
    ]


def _filled(name: str, fill: float) -> Column:
    return F.coalesce(nan_to_null(F.col(f"`{name}`").cast("double")), F.lit(float(fill)))


def medians(
    df: DataFrame, columns: list[str], sorted_rows: int = SORTED_ROWS
) -> dict[str, float | None]:
    """Exact medians, NaN counted as missing."""
    wanted = {c: (nan_to_null(F.col(f"`{c}`").cast("double")), [0.5]) for c in columns}
    found = exact_quantiles(df, wanted, sorted_rows=sorted_rows) if wanted else {}
    return {c: values[0] for c, values in found.items()}


def fit_prep(
    train: DataFrame,
    features: list[str] | None = None,
    sorted_rows: int = SORTED_ROWS,
    indices: dict[str, int] | None = None,
) -> FeaturePrep:
    """Fill values (median of float columns, 0 else), then mean and population std.

    ``indices`` gives the vocabulary size of columns that hold category indices; they are neither filled nor scaled.
    """
    indices = indices or {}
    names = numeric_features(train)[0] if features is None else features
    names = [c for c in names if c not in indices]
    if not names:
        return FeaturePrep({}, {}, {}, indices)
    floats = [c for c in names if isinstance(train.schema[c].dataType, (T.FloatType, T.DoubleType))]
    centre = medians(train, floats, sorted_rows)
    fill = {c: float(centre.get(c) or 0.0) for c in names}
    stats = train.agg(
        *[F.avg(_filled(c, fill[c])).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(_filled(c, fill[c])).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    mean = {c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(names)}
    # A constant column is centred only.
    std = {c: float(stats[f"s{i}"] or 1.0) for i, c in enumerate(names)}
    return FeaturePrep(fill, mean, std, indices)


def apply_prep(
    df: DataFrame, prep: FeaturePrep, keep: list[str] | None = None, bound: float = CLIP
) -> DataFrame:
    """Align, fill, scale and clip the numbers, limit indices to their vocabulary; row-local.

    A number that is absent here is its fill value; an absent or missing index is 0, one past the vocabulary its last.
    """
    kept = [c for c in ([*ID_COLUMNS, LABEL] if keep is None else keep) if c in df.columns]
    clamped = [
        (clamp_index(F.col(f"`{c}`"), size) if c in df.columns else F.lit(0)).cast("bigint").alias(c)
        for c, size in prep.indices.items()
    ]
    aligned = df.select(
        *[F.col(f"`{c}`") for c in kept], *align_columns(df, list(prep.fill), prep.fill), *clamped
    )
    scaled = [
        clip((_filled(c, prep.fill[c]) - F.lit(prep.mean[c])) / F.lit(prep.std[c]), bound).alias(c)
        for c in prep.fill
    ]
    return aligned.select(*[F.col(f"`{c}`") for c in kept], *scaled, *[F.col(f"`{c}`") for c in prep.indices])
