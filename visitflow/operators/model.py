"""Regression of log revenue with Spark ML, and scoring of fitted dense nets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.operators.clean import LABEL
from visitflow.operators.split import time_split
from visitflow.session import shared_folder

PREDICTION = "PredictedLogRevenue"
SEED = 42
HOT = "_hot_"  # before the name of a category's sparse vector
MOST_NORMAL = 4096  # features that Spark solves by normal equations
NET_BYTES = 512 << 20  # a larger net is no broadcast variable


def floor_at_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def fit_regressor(
    train: DataFrame,
    features: list[str],
    label: str = LABEL,
    kind: str = "gbt",
    seed: int = SEED,
    stop_frac: float = 0.1,
    one_hot: dict[str, int] | None = None,
    **settings: object,
) -> PipelineModel:
    """Boosted trees or linear regression on prepared features.

    The trees stop early on the last ``stop_frac`` of the *training* rows, so
    the validation split stays unseen. ``one_hot`` gives the vocabulary size of index columns (limited to it, as
    ``apply_prep`` does): each becomes a sparse vector of that size, so wide vocabularies cost what a row holds.
    """
    sizes = one_hot or {}
    features = [c for c in features if c not in sizes]
    # The sizes are known: as metadata, they spare the encoder a pass over the data.
    train = train.withColumns(
        {
            c: F.col(f"`{c}`").cast("double").alias(c, metadata={"ml_attr": {"type": "nominal", "num_vals": size}})
            for c, size in sizes.items()
        }
    )
    stages = []
    if sizes:
        vectors = [f"{HOT}{c}" for c in sizes]
        stages.append(OneHotEncoder(inputCols=list(sizes), outputCols=vectors, dropLast=False))
        features = [*features, *vectors]
    stages.append(VectorAssembler(inputCols=features, outputCol="_features"))
    if kind == "linear":
        # The normal equations are dense and limited in width; all values of a category add up to the intercept.
        wide = sizes or len(features) > MOST_NORMAL
        options = {"solver": "l-bfgs" if wide else "normal", **settings}
        model = LinearRegression(featuresCol="_features", labelCol=label, **options)
        return Pipeline(stages=[*stages, model]).fit(train)
    if kind != "gbt":
        raise ValueError(f"unknown regressor {kind!r}")
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(train.sparkSession))
    fitted, stop = time_split(train, 1.0 - stop_frac)
    marked = fitted.withColumn("_stop", F.lit(False)).unionByName(stop.withColumn("_stop", F.lit(True)))
    options = {"maxIter": 20, "maxDepth": 5, "checkpointInterval": 10, **settings}
    model = GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        seed=seed,
        validationIndicatorCol="_stop",
        **options,
    )
    return Pipeline(stages=[*stages, model]).fit(marked)


def score(model: PipelineModel, df: DataFrame, floor: bool = True) -> DataFrame:
    """Add the predicted log revenue; negative predictions become 0 unless asked not to."""
    predicted = F.col("prediction")
    return model.transform(df).select(
        *[F.col(f"`{c}`") for c in df.columns if c != PREDICTION],
        (floor_at_zero(predicted) if floor else predicted).alias(PREDICTION),
    )


@dataclass(frozen=True)
class DenseLayer:
    """Linear layer, batch norm with running statistics, relu."""

    weight: np.ndarray  # (outputs, inputs)
    bias: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray
    running_mean: np.ndarray
    running_var: np.ndarray
    eps: float = 1e-5


@dataclass(frozen=True)
class DenseNet:
    """Fitted net: embeddings of the categorical inputs beside the numeric inputs."""

    numeric: list[str]
    layers: list[DenseLayer]
    out_weight: np.ndarray  # (inputs,)
    out_bias: float
    embeddings: dict[str, np.ndarray] = field(default_factory=dict)  # (vocabulary, size)

    @property
    def nbytes(self) -> int:
        """Bytes of all weights."""
        layers = [a for x in self.layers for a in (x.weight, x.bias, x.gamma, x.beta, x.running_mean, x.running_var)]
        return sum(a.nbytes for a in (*layers, self.out_weight, *self.embeddings.values()))

    def predict(self, numeric: np.ndarray, indices: dict[str, np.ndarray], dtype: type) -> np.ndarray:
        parts = [
            table.astype(dtype)[np.clip(indices[c], 0, len(table) - 1)]
            for c, table in self.embeddings.items()
        ]
        x = np.concatenate([*parts, numeric.astype(dtype)], axis=1)
        for layer in self.layers:
            x = x @ layer.weight.T.astype(dtype) + layer.bias.astype(dtype)
            scale = layer.gamma / np.sqrt(layer.running_var + layer.eps)
            x = (x - layer.running_mean.astype(dtype)) * scale.astype(dtype)
            x = np.maximum(x + layer.beta.astype(dtype), 0)
        return x @ self.out_weight.astype(dtype) + dtype(self.out_bias)


def score_dense(
    df: DataFrame,
    net: DenseNet,
    keep: list[str],
    floor: bool = True,
    dtype: type = np.float32,
) -> DataFrame:
    """Score prepared rows with a fitted net, Arrow batch by Arrow batch.

    The net goes to every executor once; only its inputs and ``keep`` reach Python. An index column that
    is absent counts as 0 in every row, and an index past a table as its last.
    """
    if net.nbytes > NET_BYTES:
        raise ValueError(f"a net of {net.nbytes} bytes is too large to send to every executor")
    weights = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = weights.value
        for batch in batches:
            numeric = batch[[f"_x_{c}" for c in fitted.numeric]].to_numpy()
            indices = {c: batch[f"_i_{c}"].to_numpy() for c in fitted.embeddings}
            predicted = fitted.predict(numeric, indices, dtype).astype(np.float64)
            result = batch[keep].copy()
            result[PREDICTION] = np.maximum(predicted, 0.0) if floor else predicted
            yield result

    inputs = df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[F.col(f"`{c}`").cast("double").alias(f"_x_{c}") for c in net.numeric],
        *[
            (F.coalesce(F.col(f"`{c}`").cast("bigint"), F.lit(0)) if c in df.columns else F.lit(0)).cast("bigint").alias(f"_i_{c}")
            for c in net.embeddings
        ],
    )
    schema = T.StructType(
        [*[df.schema[c] for c in keep], T.StructField(PREDICTION, T.DoubleType())]
    )
    return inputs.mapInPandas(run, schema)
